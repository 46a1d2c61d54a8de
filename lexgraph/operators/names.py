"""Many names sought in many texts at once: an Aho–Corasick automaton over all names, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..storage import stored, written

#: Characters of names in one automaton; more names are sought by several, one after the other.
PART = 8 << 20


def _parts(names: DataFrame) -> str:
    """Distinct names that are not empty, written in parts of about PART characters; the path."""
    names = names.select(F.col(names.columns[0]).alias("name")).where("name <> ''").distinct()
    size = names.agg(F.sum(F.length("name"))).first()[0] or 0
    names = names.repartition(max(1, -(-size // PART)), "name")
    return written(names.mapInArrow(_gathered, "names array<string>"), "names")._lexgraph_path


def _gathered(batches) -> Iterator[pa.RecordBatch]:
    found = [n for b in batches for n in b.column(0).to_pylist()]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["names"])


def _automata(path: str) -> Iterator[ahocorasick.Automaton]:
    for row in stored(path):
        automaton = ahocorasick.Automaton()
        for name in row.column(0)[0].as_py():
            automaton.add_word(name, name)
        automaton.make_automaton()
        yield automaton


def mentions(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True) -> DataFrame:
    """(id_col, name, start, end) of the names (first column of names) that stand in the texts, in characters from 0.

    longest: from left to right the longest name at the first place where any stands, then on from its end, so that
    mentions do not overlap; else every occurrence. The time is in proportion to the text, whatever the
    number of names, but for the occurrences found. Names go to the tasks in a table, of which one automaton's part
    is held at a time. Null texts and null or empty names match nothing; repeated names count once.
    """
    path = _parts(names)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        one: list[ahocorasick.Automaton] = []  # kept between batches if it is the only one
        for batch in batches:
            content = batch.column(1).to_pylist()
            found: list[list[tuple[int, int, str]]] = [[] for _ in content]
            for n, automaton in enumerate(one or _automata(path)):
                one = [automaton] if n == 0 else []
                for k, text in enumerate(content):
                    if text and len(automaton):
                        found[k] += [(end + 1 - len(name), end + 1, name) for end, name in automaton.iter(text)]
            whose, rows = [], []
            for k, hits in enumerate(found):
                if longest:
                    hits, at = sorted(hits, key=lambda h: (h[0], -h[1])), 0
                    kept = []
                    for h in hits:
                        if h[0] >= at:
                            kept.append(h)
                            at = h[1]
                    hits = kept
                whose += [k] * len(hits)
                rows += hits
            starts, ends, words = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), pa.array(words, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["_id", "name", "start", "end"])

    found = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, name string, start long, end long")
    return found.withColumnRenamed("_id", id_col)


def asked_titles(questions: DataFrame, keywords: DataFrame, id_col: str = "doc_id", normalized: str = "normal") -> DataFrame:
    """(id_col, title_asked): whether a normalised question holds a keyword between blanks, and no word that vetoes; for any number of keywords."""
    padded = keywords.select(F.concat(F.lit(" "), F.col(keywords.columns[0]), F.lit(" ")).alias("k"))
    rows = questions.select(F.col(id_col).alias("_q"), F.concat(F.lit(" "), normalized, F.lit(" ")).alias("_padded"), ((F.col(normalized) != "") & ~F.col(normalized).rlike(fixed.TITLE_VETOES)).alias("_open"))
    hits = mentions(rows.where("_open"), padded, "_q", "_padded", longest=False).select(F.col("_q").alias("_hit")).distinct()
    return rows.join(hits, F.col("_q") == F.col("_hit"), "left").select(F.col("_q").alias(id_col), (F.coalesce("_open", F.lit(False)) & F.col("_hit").isNotNull()).alias("title_asked"))
