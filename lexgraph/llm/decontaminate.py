"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed as a table of postings in the shared folder: per segment of documents and term the
ascending positions of all its tokens there, as differences in seven-bit groups. A segment also has a row with
its documents and their lengths.

Windows of the test items become rows of (window, rarest term), by the terms' counts in the whole corpus. An
equi-join on the rarest term names the segments that may hold a window. The postings of the tests' terms and
these candidates meet in one task per segment, where the position lists, each shifted by the term's offset in
the window, are intersected in ascending order of length until one is empty. With no slack the intersection
gives exact phrases; with slack, lists are intersected to within so many words, which gives proximity matches.
Nothing of tests or corpus passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, tidy, words, written

#: Empty positions between documents of a segment, so that no window spans two.
GAP = 64
WINDOW = 10
TASK_SEGMENTS = 4


def packed(values: np.ndarray, lists: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2**35 in groups of seven bits, low ones first, and the byte at which each list of `lists` numbers ends."""
    width = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out, first = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - width
    for k in range(int(width.max(initial=0))):
        here = width > k
        out[first[here] + k] = (values[here] >> (7 * k) & 0x7F) | ((width[here] > k + 1) << 7)
    return out.tobytes(), np.concatenate([[0], ends])[np.cumsum(lists)]


def unpacked(data: bytes) -> np.ndarray:
    """The ascending places whose differences packed() has written."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    steps = raw[first].astype(np.int64) & 0x7F
    for k in range(1, int((last - first).max(initial=0)) + 1):
        more = last - first >= k
        steps[more] |= (raw[first[more] + k].astype(np.int64) & 0x7F) << (7 * k)
    return np.cumsum(steps)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """The place at which each document of a segment begins."""
    return np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64) if len(lengths) else lengths


def postings(lists: list[list[bytes]]) -> tuple[pa.Array, np.ndarray, bytes, np.ndarray]:
    """The terms of a segment's documents, their counts, and their positions as packed() has them."""
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    lengths, terms = np.array([len(x) for x in lists], np.int64), coded.indices.to_numpy().astype(np.int64)
    places = np.repeat(starts_of(lengths) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(terms))
    places = np.sort(terms << 36 | places.astype(np.int64)) & ((1 << 36) - 1)
    counts = np.bincount(terms, minlength=len(coded.dictionary)).astype(np.int64)
    steps, first = np.diff(places, prepend=0), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    if len(places):
        steps[first] = places[first]
    data, ends = packed(steps, counts)
    return coded.dictionary, counts, data, ends


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes()), pa.py_buffer(data)])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 500_000, segment_docs: int = 20_000) -> DataFrame:
    """Index every word of every document; return the written index.

    A row has segment, term, n and positions; the row of a segment without a term has docs and lengths. A segment
    is closed once it has segment_words words or segment_docs documents, so a very long document may make one
    larger. Null texts have no words. Null and repeated ids, of any type, are kept: each row is a document.
    """
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        def out(number):
            segment = (TaskContext.get().partitionId() << 32) + number
            found, counts, data, ends = postings(lists)
            names = ["segment", "term", "n", "positions", "docs", "lengths"]
            ids = pa.concat_arrays(held)
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            lengths = pa.array([[len(x) for x in lists]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), whole, lengths], names)
            n = len(found)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), found.cast(pa.string()), pa.array(counts), _binaries(data, ends), pa.nulls(n, whole.type), pa.nulls(n, lengths.type)], names)

        held, lists, size, number = [], [], 0, 0
        for batch in batches:
            ids = batch.column(0).cast(arrow)
            for k, text in enumerate(batch.column(1)):
                held.append(ids[k : k + 1] if len(ids) else ids)
                lists.append(words(text.as_py()))
                size += len(lists[-1])
                if size >= segment_words or len(lists) >= segment_docs:
                    yield from out(number)
                    held, lists, size, number = [], [], 0, number + 1
        if lists:
            yield from out(number)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"segment long, term string, n long, positions binary, docs array<{kind.simpleString()}>, lengths array<int>"
    return written(rows.mapInArrow(tidy(run), schema), "index")


class Segment:
    """The postings of one segment for the terms that are asked for."""

    def __init__(self, lengths: list[int]):
        self.lengths = np.array(lengths, np.int64)
        self.starts = starts_of(self.lengths)
        self.packed: dict[str, tuple[int, bytes]] = {}
        self.open: dict[str, np.ndarray] = {}

    def places(self, term: str) -> np.ndarray:
        if term not in self.open:
            self.open[term] = unpacked(self.packed[term][1])
        return self.open[term]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def find(self, window: list[str], slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places where the window starts, and the documents that hold it with slack.

        With slack a document holds a window if there is a place such that each word of the window stands within
        slack words of its own place counted from there.
        """
        none = np.empty(0, np.int64)
        try:
            terms = sorted((self.packed[w][0], offset, w) for offset, w in enumerate(window))
        except KeyError:
            return none, none
        _, own, rarest = terms[0]
        found = self.places(rarest) - own  # seen from any start that the slack allows, words are within twice the slack
        for _, offset, term in terms[1:]:
            found = found[self._near(found + offset, term, 2 * slack)]
            if not len(found):
                return none, none
        exact = found
        for _, offset, term in terms[1:] if slack else ():
            exact = exact[self._near(exact + offset, term, 0)]
        if len(rest := np.setdiff1d(found, exact, assume_unique=True)):
            start = rest[:, None] + np.arange(-slack, slack + 1)
            held = np.ones(start.shape, bool)
            for _, offset, term in terms:
                held &= self._near((start + offset).ravel(), term, slack).reshape(start.shape)
            rest = rest[held.any(axis=1)]
        return exact, np.unique(self.document(np.concatenate([exact, rest]) + own))

    def _near(self, at: np.ndarray, term: str, slack: int) -> np.ndarray:
        """Which of the places have the term within slack."""
        other = self.places(term)
        k = np.searchsorted(other, at - slack)
        near = k < len(other)
        near[near] = other[k[near]] <= at[near] + slack
        return near


def windows(text: str | None, n: int = WINDOW) -> list[str]:
    """The distinct windows of n consecutive words, joined by blanks; fewer words, but not none, are one window."""
    found = [w.decode() for w in words(text)]
    return list(dict.fromkeys(" ".join(found[k : k + n]) for k in range(max(1, len(found) - n + 1)))) if found else []


def _windows(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(win, item) of every item, written."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = windows(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([batch.column(0)[k].as_py()] * len(found), batch.column(0).type)], ["win", "item"])

    rows = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).where("_text IS NOT NULL")
    return written(rows.mapInArrow(tidy(run), f"win string, item {benchmark.schema[item_col].dataType.simpleString()}"), "windows")


def _asked(index: DataFrame, wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of the tests' terms, and (segment, win) for every segment with a window's rarest term."""
    split = wins.select("win", F.explode(F.array_distinct(F.split("win", " "))).alias("_term"))
    terms = written(split.select("_term").distinct(), "terms")  # on disk its size is known: Spark broadcasts it only if it is small
    found = written(index.where("term IS NOT NULL").join(terms, F.col("term") == F.col("_term"), "left_semi").select("segment", "term", "n", "positions"), "asked-postings")
    df = found.groupBy(F.col("term").alias("_t")).agg(F.sum("n").alias("_df"))
    ranked = split.join(df, F.col("_term") == F.col("_t"), "left").groupBy("win").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_term").alias("t"))).alias("_r"))
    ranked = written(ranked.where("_r.d > 0").select("win", F.col("_r.t").alias("_rarest")), "rarest-terms")  # a window with an unknown term is nowhere
    return found, found.select("segment", "term").join(ranked, F.col("term") == F.col("_rarest")).select("segment", "win")


HITS = "segment long, ord int, n_hit long, hit_spans array<struct<s:int,e:int>>, win string, exact boolean"


def _search(index: DataFrame, wins: DataFrame, slack: int) -> DataFrame:
    """Per document with hits a row with their number and spans, and a row per window that it holds, exactly or with slack."""
    found, spots = _asked(index, wins)
    segments = index.where("term IS NULL").count()
    tasks = max(1, min(segments, index.sparkSession.sparkContext.defaultParallelism), -(-segments // TASK_SEGMENTS))
    # in a segment: its lengths, then postings, then windows
    rows = index.where("term IS NULL").select("segment", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("positions"), "lengths")
    rows = rows.unionByName(found.select("segment", F.lit(1).alias("kind"), F.col("term").alias("key"), "n", "positions"), allowMissingColumns=True)
    rows = rows.unionByName(spots.select("segment", F.lit(2).alias("kind"), F.col("win").alias("key")), allowMissingColumns=True)

    def run(batches):
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.string(), pa.bool_()]
        names = ["segment", "ord", "n_hit", "hit_spans", "win", "exact"]
        seg, number, hits, made = None, None, [], []

        def flush():
            out = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)] if made else []
            made.clear()
            return out

        def closed():
            """Rows of the segment that ends here: per document its hits."""
            if not hits:
                return
            edges = np.zeros(int(seg.starts[-1] + seg.lengths[-1]) + 2, np.int32)
            for at, n in hits:
                np.add.at(edges, at, 1)
                np.add.at(edges, at + n, -1)
            inside = np.cumsum(edges) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
            s, e = turns[::2], turns[1::2]
            docs = seg.document(s)
            for d in np.unique(docs).tolist():
                own, base = docs == d, int(seg.starts[d])
                made.append((number, d, int((e[own] - s[own]).sum()), [{"s": int(a) - base, "e": int(b) - base} for a, b in zip(s[own], e[own], strict=True)], None, None))

        for batch in batches:
            segments, kinds, keys, counts, data = (batch.column(c) for c in ("segment", "kind", "key", "n", "positions"))
            for k, (segment, kind) in enumerate(zip(segments.to_pylist(), kinds.to_pylist(), strict=True)):
                if segment != number:
                    closed()
                    number, hits = segment, []
                    seg = Segment(batch.column("lengths")[k].as_py())
                elif kind == 1:
                    seg.packed[keys[k].as_py()] = counts[k].as_py(), data[k].as_py()
                else:
                    win = keys[k].as_py()
                    window = win.split(" ")
                    exact, near = seg.find(window, slack)
                    if not len(near):
                        continue
                    docs = set(seg.document(exact).tolist())
                    if len(exact):
                        hits.append((exact, len(window)))
                    made += [(number, d, None, None, win, d in docs) for d in near.tolist()]
                    if len(made) >= 20_000:
                        yield from flush()
        closed()
        yield from flush()

    rows = rows.repartition(tasks, "segment").sortWithinPartitions("segment", "kind")
    return rows.mapInArrow(tidy(run), HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slack: int = 2) -> DataFrame:
    """Return a row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated, n_near, item_ids, hit_spans, near_ids.

    n_hit counts the words inside any exact window of an item, hit_spans are their word positions, item_ids the
    items that occur. near_ids are the items with a window of which each word stands within `slack` words of its
    place (exact ones included), n_near their number. An item with a null id has its words hit, but is in no list
    of items; one with a null text or no word has no windows; rows that repeat an item's id add to it. If the
    benchmark is empty, all documents are clean. Null texts have no words; null and repeated ids stay, a row
    each; other columns are ignored.
    """
    if slack * 4 >= GAP:
        raise ValueError(f"slack must be below {GAP // 4}")
    index = build_index(docs, id_col, text_col)
    pairs = _windows(benchmark, item_col, item_text)
    hits = written(_search(index, pairs.select("win").distinct(), slack), "hits")
    held = hits.where("win IS NOT NULL").join(pairs.withColumnRenamed("win", "_w"), F.col("win") == F.col("_w"))
    parts = hits.where("win IS NULL").select("segment", "ord", "n_hit", "hit_spans").unionByName(held.select("segment", "ord", "item", "exact"), allowMissingColumns=True)
    found = parts.groupBy("segment", "ord").agg(
        F.max("n_hit").alias("_hit"), F.first("hit_spans", ignorenulls=True).alias("_spans"),
        F.collect_set(F.when(F.col("exact"), F.col("item"))).alias("_items"), F.collect_set("item").alias("_near"),
    )
    found = written(found.select(F.col("segment").alias("_s"), F.col("ord").alias("_o"), "_hit", "_spans", "_items", "_near"), "hits-by-document")
    rows = index.where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("docs", "lengths")).alias("ord", "_d"))
    rows = rows.join(found, (F.col("segment") == F.col("_s")) & (F.col("ord") == F.col("_o")), "left")
    none = F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>")
    n_hit, items, near = F.coalesce("_hit", F.lit(0)), F.array_sort(F.coalesce("_items", none)), F.array_sort(F.coalesce("_near", none))
    ids = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return rows.select(
        F.col("_d.docs").alias(id_col), F.col("_d.lengths").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size(near).cast("long").alias("n_near"), items.alias("item_ids"), F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>")).alias("hit_spans"), near.alias("near_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of an item, whatever their ids.

    Rows are told apart by the digest of their text, on which alone contamination depends.
    """
    key, bad_key = fresh(docs, "_lg_key"), fresh(docs, "_lg_bad")
    marked = docs.withColumn(key, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    bad = contamination(marked, benchmark, key, text_col, **{"slack": 0, **how}).where("contaminated").select(F.col(key).alias(bad_key)).distinct()
    bad = written(bad, "contaminated")
    return marked.join(bad, F.col(key) == F.col(bad_key), "left_anti").drop(key)


#: The contract's columns of contamination as SQL, over documents and benchmark.
SQL = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
lower_docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern)) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern)) AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM lower_docs, sizes WHERE len(w) >= n) x),
found AS (SELECT s.rid, s.k, s.n, v.item_id FROM spots s JOIN wins v ON s.n = v.n AND s.win = v.win),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM found) x GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) x GROUP BY rid),
tokens AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM lower_docs),
dfs AS (SELECT word, count(*) AS df FROM tokens GROUP BY word),
parts AS (SELECT win, unnest(string_split(win, ' ')) AS word, unnest(range(0, n)) AS k, n FROM (SELECT DISTINCT win, n FROM wins) x),
ranked AS (SELECT win, p.word, k, n, row_number() OVER (PARTITION BY win ORDER BY df, p.word, k) AS r FROM parts p JOIN dfs USING (word)),
starts AS (SELECT DISTINCT rid, win, n, pos - k + shift AS place FROM ranked JOIN tokens USING (word), (SELECT unnest(range(-2, 3)) AS shift) s WHERE r = 1),
pruned AS (
  SELECT DISTINCT s.rid, s.win, s.n, s.place FROM starts s JOIN ranked r2 ON r2.win = s.win AND r2.r = least(s.n, 2)
  JOIN tokens t ON t.rid = s.rid AND t.word = r2.word AND abs(t.pos - s.place - r2.k) <= 2),
close AS (
  SELECT p.rid, p.win FROM pruned p JOIN ranked r ON r.win = p.win JOIN tokens t ON t.rid = p.rid AND t.word = r.word AND abs(t.pos - p.place - r.k) <= 2
  GROUP BY p.rid, p.win, p.n, p.place HAVING count(DISTINCT r.k) = p.n),
near AS (SELECT rid, count(DISTINCT item_id) AS n_near FROM close JOIN wins USING (win) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM lower_docs LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)
"""
