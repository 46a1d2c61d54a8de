"""Corpora of chunks and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import domain_meta
from ..storage import written
from .records import exact_dedup


def text_chunks(files: DataFrame, file_col: str = "file", text_col: str = "text", size: int = 900, overlap: int = 200, domain: str | None = None) -> DataFrame:
    """(id, text, source, start, end, extra) of overlapping spans of cleaned texts; an id is file:::number of the span."""
    rows = files.select(F.col(file_col).alias("_f"), F.posexplode(T.chunks(T.clean(text_col), size, overlap)).alias("_k", "_c"))
    meta = domain_meta(F.col("_c.text"), F.col("_f"))
    extra = meta if domain is None else meta.withField("domain", F.lit(domain))
    return rows.select(F.concat_ws(":::", "_f", "_k").alias("id"), T.clean("_c.text").alias("text"), F.col("_f").alias("source"), F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), extra.alias("extra"))


def numbered(rows: DataFrame, order: list[str], out: str = "uid") -> DataFrame:
    """Adds a number from 0 on over all rows, in the given order; ties are numbered in any order.

    Rows are sorted into ranges, and running sums of the ranges' counts give the numbers, so no task sorts all rows.
    """
    spark = rows.sparkSession
    parts = written(rows.repartitionByRange(spark.sparkContext.defaultParallelism * 4, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = parts.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select(F.col("_range").alias("_r"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out_rows = parts.join(F.broadcast(counts), F.col("_range") == F.col("_r"))  # four rows a core
    return out_rows.withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_r", "_first", "_before")


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns, of those there are, that is not empty; '' without any."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns), F.lit(""))


def record_chunks(records: DataFrame, source: str, key: str, domain: str | None = None) -> DataFrame:
    """Records as chunks that are not cut (start and end -1): text from text, passage or content; the rest is extra. Empty texts are left out."""
    text = T.clean(first_filled(records, ["text", "passage", "content"]))
    others = [c for c in records.columns if c not in ("text", key)]
    pairs = [x for c in others for x in (F.lit(c), T.to_text(F.col(c), records.schema[c].dataType.simpleString()))]
    pairs += [F.lit("domain"), F.lit(domain)] if domain else []
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    rows = records.select(F.concat(F.lit(f"{source}:::"), F.col(key).cast("string")).alias("id"), text.alias("text"), F.lit(source).alias("source"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), extra.alias("extra"))
    return rows.where("text <> ''")


def picked(df: DataFrame, names: list[str]) -> Column:
    """The first named column that is not empty, also inside a struct column meta, else the row as JSON."""
    inner = [F.col(f"meta.{c}") for c in names if "meta" in df.columns and c in getattr(df.schema["meta"].dataType, "names", [])]
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in df.columns] + [F.nullif(c.cast("string"), F.lit("")) for c in inner]
    return F.coalesce(*found, F.to_json(F.struct(*df.columns)))


def merged(corpora: list[DataFrame], key: str = "text", order: tuple[str, ...] = ("id",), dedup: bool = True) -> DataFrame:
    """The union of corpora; with dedup the first row of each text, by corpus and then by order."""
    rows = corpora[0].withColumn("corpus", F.lit(0))
    for k, c in enumerate(corpora[1:], 1):
        rows = rows.unionByName(c.withColumn("corpus", F.lit(k)))
    return exact_dedup(rows, F.col(key), ["corpus", *order]) if dedup else rows


def line_corpus(files: DataFrame, exclude: str = "tta") -> DataFrame:
    """(file, line_no, text): the lines that are not blank of files whose name doesn't hold `exclude`."""
    rows = files.where(~F.contains(F.lower("file"), F.lit(exclude))).select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.where(T.strip(F.col("text")) != "")
