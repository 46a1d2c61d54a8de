"""Greedy packing of lines and sentences, and token streams cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strip


def pack_lines(lines: Column, limit: int = 1800) -> Column:
    """Lines joined by blanks into blocks: a line costs its length and 1, the first after a cut its length alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] + F.length(x) + 1 > limit) & (F.size(s["held"]) > 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["held"], " ")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(s["held"], F.array(x))).alias("held"), F.when(full, F.length(x)).otherwise(s["n"] + F.length(x) + 1).alias("n"),
        )

    done = F.aggregate(lines, state, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(F.array_join(s["held"], " ")))).otherwise(s["done"]))
    return F.filter(F.transform(done, lambda x: strip(x)), lambda x: x != "")


def pack_sentences(c: Column | str, limit: int = 900) -> Column:
    """A text as it is if it fits, else its sentences joined into parts of up to `limit` characters; one longer sentence is a part."""
    t = strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s: Column, x: Column) -> Column:
        full = (F.length(s["held"]) + F.length(x) + 1 > limit) & (s["held"] != "")
        return F.struct(F.when(full, F.concat(s["done"], F.array(strip(s["held"])))).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(strip(F.concat(s["held"], F.lit(" "), x))).alias("held"))

    parts = F.aggregate(sentences(t), state, step, lambda s: F.when(s["held"] != "", F.concat(s["done"], F.array(strip(s["held"])))).otherwise(s["done"]))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= limit, F.array(t)).otherwise(parts)


def token_blocks(rows: DataFrame, size: int = 2048, batch_col: str = "batch", ord_col: str = "ord", ids_col: str = "input_ids", labels_col: str = "labels", end_id: int | None = None) -> DataFrame:
    """(batch, block, input_ids, labels, attention_mask): the ids of a batch in order, cut into blocks; a last one under half is dropped.

    Labels are cut alike. With end_id, a row that doesn't end in it gets it.
    """
    ids, labels = F.col(ids_col), F.col(labels_col)
    if end_id is not None:
        open_end = (F.size(ids) > 0) & (F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(-1)) != end_id)
        ids, labels = (F.when(open_end, F.concat(x, F.array(F.lit(end_id)))).otherwise(x) for x in (ids, labels))
    rows = rows.select(F.col(batch_col).alias("batch"), F.col(ord_col).alias("ord"), ids.alias("ids"), labels.alias("labels"))
    before = Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))
    # pieces of rows, not single tokens, are shuffled: a row is cut where blocks end
    n = F.size("ids")
    cuts = F.when(n > 0, F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + n - 1) / size))).otherwise(F.array().cast("array<bigint>"))
    parts = rows.withColumn("block", F.explode(cuts))
    start, end = F.greatest(F.col("block") * size - F.col("at"), F.lit(0)).cast("int"), F.least((F.col("block") + 1) * size - F.col("at"), n).cast("int")
    parts = parts.select("batch", "block", "ord", F.slice("ids", start + 1, end - start).alias("ids"), F.slice("labels", start + 1, end - start).alias("labels"))
    made = parts.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "ids", "labels"))).alias("p"))
    made = made.select("batch", "block", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("p", lambda x: x["labels"])).alias("labels"))
    last = F.max("block").over(Window.partitionBy("batch"))
    made = made.withColumn("_last", last).where((F.col("block") < F.col("_last")) | (F.size("input_ids") >= size // 2)).drop("_last")
    return made.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
