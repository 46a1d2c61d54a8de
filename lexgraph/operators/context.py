"""Context blocks from ranked hits: one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import first_sentences, sentences, strip, truncate


def joined(hits: DataFrame, line: Column, between: str = "\n\n", most: int | None = None, guide: str = "", order: str = "rank") -> DataFrame:
    """(query_id, context): a guide and the lines of the hits in order of rank, null or empty lines left out."""
    rows = hits.where(F.col(order) <= most) if most else hits
    lines = rows.select("query_id", F.col(order).alias("_rank"), line.alias("_line")).where("_line <> ''")
    parts = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "_line"))).alias("_l"))
    return parts.select("query_id", F.concat(F.lit(guide), F.array_join(F.transform("_l", lambda x: x["_line"]), between)).alias("context"))


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def span_of(start: Column, end: Column) -> Column:
    return F.when((start >= 0) & (end >= 0), F.concat(start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.lit(""))


def passages(hits: DataFrame) -> DataFrame:
    """[rank] (file:start-end) and the text."""
    span = span_of(F.col("start"), F.col("end"))
    where = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), file_name(F.col("source")), F.when(span == "", "").otherwise(F.concat(F.lit(":"), span)), F.lit(")"))
    return joined(hits, F.concat(where, F.lit("\n"), F.col("text")))


def snippets(hits: DataFrame) -> DataFrame:
    """A guide, then (#rank) [file:start-end] and the snippet on one line."""
    span = span_of(F.col("start"), F.col("end"))
    where = F.concat(F.lit("(#"), F.col("rank"), F.lit(") ["), file_name(F.col("source")), F.when(span == "", "").otherwise(F.concat(F.lit(":"), span)), F.lit("]"))
    body = F.translate(F.coalesce(F.nullif("snippet", F.lit("")), F.col("text")), "\n", " ")
    return joined(hits, F.concat(where, F.lit("\n"), body), guide=fixed.GUIDE_REFERENCE + "\n\n")


def titled(hits: DataFrame) -> DataFrame:
    """A guide, then (#rank) [title] text."""
    title = F.when(F.coalesce("title", F.lit("")) == "", "").otherwise(F.concat(F.lit("["), F.col("title"), F.lit("]")))
    return joined(hits, F.concat(F.lit("(#"), F.col("rank"), F.lit(") "), title, F.lit(" "), F.col("text")), guide=fixed.GUIDE_TERMS + "\n\n")


def headed(hits: DataFrame) -> DataFrame:
    """A guide, then the header and the summary or 400 characters."""
    body = F.translate(F.coalesce(F.nullif("summary", F.lit("")), F.substring("text", 1, 400)), "\n", " ")
    return joined(hits, F.concat(F.coalesce(F.nullif("header", F.lit("")), F.lit("[REF]")), F.lit("\n"), body), guide=fixed.GUIDE_ATTACK + "\n\n")


def bulleted(hits: DataFrame, most: int = 5, n_sentences: int = 2, n_chars: int = 220) -> DataFrame:
    """The first sentences of the first hits as bullets."""
    body = truncate(first_sentences("text", n_sentences), n_chars)
    return joined(hits, F.when(body == "", "").otherwise(F.concat(F.lit("- "), body)), between="\n", most=most)


def chunked(hits: DataFrame, most_chars: int = 2000) -> DataFrame:
    """[rank] (file #chunk) and the text, cut to most_chars with a mark."""
    where = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), file_name(F.col("file")), F.lit(" #"), F.col("chunk_id"), F.lit(")\n"))
    out = joined(hits, F.concat(where, F.col("text")))
    cut = F.concat(strip(F.substring("context", 1, most_chars)), F.lit("\n…(생략)"))
    return out.withColumn("context", F.when(F.length("context") <= most_chars, F.col("context")).otherwise(cut))


def numbered(hits: DataFrame) -> DataFrame:
    """rank) source and the text."""
    return joined(hits, F.concat(F.col("rank"), F.lit(") "), F.col("source"), F.lit("\n"), F.col("text")))


def header_of(extra: Column, source: Column) -> Column:
    """[LAW] articles, [ATT&CK] tactics techniques or [REF], and the file name."""
    three = lambda a, sep: F.coalesce(F.array_join(F.slice(a, 1, 3), sep), F.lit(""))
    law = strip(F.concat(F.lit("[LAW] "), three(extra["articles"], ", ")))
    mitre = strip(F.concat(F.lit("[ATT&CK] "), three(extra["tactics"], ","), F.lit(" "), three(extra["techniques"], ",")))
    return F.concat_ws(" | ", F.when(extra["domain"] == "law", law).when(extra["domain"] == "mitre", mitre).otherwise("[REF]"), file_name(source))


def three_sentences(c: Column) -> Column:
    return strip(F.array_join(F.slice(F.split(c, r"(?U)(?<=[.!?。])\s+|\n"), 1, 3), " "))


def inject(messages: Column, context: Column, way: str = "system") -> Column:
    """Messages with the context before them as a system or user turn ('system', 'user') or in the last turn ('prefix')."""
    if way == "prefix":
        guide = F.concat(F.lit(fixed.GUIDE_SNIPPETS), context, F.lit("\n\n"))
        n = F.size(messages)
        return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == n - 1, F.concat(guide, m["content"])).otherwise(m["content"]).alias("content")))
    content = context if way == "system" else F.concat(F.lit(fixed.CONTEXT_LABEL), context)
    turn = F.array(F.struct(F.lit("system" if way == "system" else "user").alias("role"), content.alias("content")))
    return F.when(F.coalesce(context, F.lit("")) == "", messages).otherwise(F.concat(turn, messages))


__all__ = ["bulleted", "chunked", "headed", "header_of", "inject", "joined", "numbered", "passages", "sentences", "snippets", "three_sentences", "titled"]
