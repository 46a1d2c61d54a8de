"""Proportional stratified interleaving of rows into shards.

Rows are shuffled by a seeded hash within each source, ranked there, and given the fraction
(rank + 1/2) / rows of the source. Sorted by that fraction and cut into runs of equal length, every
shard holds each source in the proportion of the whole, to within a row or so.

No source is ranked in one task: the hash range is cut into as many buckets as keep a bucket near
`bucket_rows` rows, rows are numbered within (source, bucket), and running sums of the bucket counts
give the ranks. The global order is numbered in the same way over buckets of the fraction. Rows that repeat
entirely are one row with a number of copies until their ranks are known, so that they make no large bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written


def _before(counts: DataFrame, by: list[str], at: str, n: str, step: int = 4096) -> DataFrame:
    """by, at and _before: the sum of n over the rows of the same `by` with a lower `at`, in two levels of `step` rows."""
    counts = counts.withColumn("_g", F.floor(F.col(at) / step))
    tops = counts.groupBy(*by, "_g").agg(F.sum(n).alias("_gn"))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*(F.col(c).alias(f"_top{c}") for c in by), F.col("_g").alias("_tg"), F.coalesce(F.sum("_gn").over(earlier), F.lit(0)).alias("_gb"))
    inner = Window.partitionBy(*by, "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    same = F.col("_g") == F.col("_tg")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_top{c}"))
    return counts.join(tops, same).select(*by, at, (F.col("_gb") + F.col("_in")).alias("_before"))


def _each(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """A row per copy, with _k from 0 on; many copies are dealt out in chunks."""
    upto = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    few = rows.where(F.col("_copies") <= chunk).withColumn("_k", upto(F.lit(0).cast("long"), F.col("_copies")))
    many = rows.where(F.col("_copies") > chunk).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))))
    many = many.repartition("_hash", "_chunk").withColumn("_k", upto(F.col("_chunk") * chunk, F.least(F.lit(chunk), F.col("_copies") - F.col("_chunk") * chunk)))
    return few.unionByName(many.drop("_chunk"))


def assign_shards(docs: DataFrame, n_shards: int = 40, source: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 17, carry: tuple[str, ...] = (), bucket_rows: int = 20_000) -> DataFrame:
    """Return id_col, size, text_crc32, law, shard, slot and grown_shard, and the columns named in carry.

    law is 'rows': shards differ by one row at most. size is the UTF-8 bytes of the text plus 16, text_crc32
    the unsigned CRC-32 of those bytes; a null text counts as empty for both. Null sources are one source.
    Rows that are equal throughout get different slots. Null ids are allowed. The order is that of the MD5 of
    seed, id and text; with carry, where equal rows may differ in what they carry, also of the row's place in
    the table as it is read. Other columns of docs are ignored, whatever their names; an empty table gives no rows.
    """
    if n_shards < 1 or bucket_rows < 1:
        raise ValueError("n_shards and bucket_rows must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["_hash", "_id", "_crc", "_size"]
    place = [F.lit("|"), F.monotonically_increasing_id().cast("string")] if carry else []
    mixed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text, *place).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"), (F.octet_length(text) + 16).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long").alias("_hash"), *(F.col(c).alias(f"_carry_{c}") for c in carry),
    )
    rows = rows.withColumn("_copies", F.lit(1).cast("long")) if carry else rows.groupBy("_source", *keys).agg(F.count("*").alias("_copies"))
    rows = written(rows, "shard-rows")
    n = rows.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    buckets = max(1, -(-n // bucket_rows))
    rows = rows.withColumn("_bucket", F.least(F.floor(F.col("_hash") / F.lit(2.0**60) * buckets), F.lit(buckets - 1)).cast("long"))

    # the rank of a row within its source: rows of earlier buckets, then its number in its own
    per = rows.groupBy("_source", "_bucket").agg(F.sum("_copies").alias("_n"))
    totals = per.groupBy(F.col("_source").alias("_t")).agg(F.sum("_n").alias("_all"))
    per = _before(per, ["_source"], "_bucket", "_n").join(totals, F.col("_source").eqNullSafe(F.col("_t"))).select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "_all")
    within = Window.partitionBy("_source", "_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_rn", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    ranked = ranked.join(per, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ranked = _each(ranked).withColumn("_at", (F.col("_before") + F.col("_rn") + F.col("_k") + 0.5) / F.col("_all"))
    ranked = ranked.withColumn("_cut", F.least(F.floor(F.col("_at") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked = written(ranked.drop("_s", "_b", "_before", "_all", "_rn", "_bucket", "_copies", "_k"), "shard-ranks")

    # the same over fractions gives the place in the interleaved order
    cuts = _before(ranked.groupBy("_cut").agg(F.count("*").alias("_n")), [], "_cut", "_n").select(F.col("_cut").alias("_c"), "_before")
    placed = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy("_cut").orderBy("_at", "_source", *keys)))
    placed = placed.join(cuts, F.col("_cut") == F.col("_c")).withColumn("_place", F.col("_before") + F.col("_rn") - 1)
    shard = F.expr(f"_place * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(({shard_sql(n_shards, n)}) * {n} + {n_shards - 1}) div {n_shards}")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"_carry_{c}").alias(c) for c in carry),
    )


def shard_sql(n_shards: int, n: int) -> str:
    return f"_place * {n_shards} div {max(n, 1)}"


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, file_rows: int = 100_000, **how) -> None:
    """Write docs with their shard and slot as one folder per shard, in files sorted by slot.

    A shard is dealt to tasks in runs of file_rows slots, so that the writers are as many as the rows ask for, not
    as the shards; a file holds one run, or several where the session has fewer shuffle partitions than runs. Where
    docs has a column of a name that assign_shards adds, the added one, the folder's too, gets underscores at its end.
    """
    id_col = how.get("id_col", "doc_id")
    carry = tuple(c for c in docs.columns if c != id_col)
    added = [fresh(docs, c) for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    placed, shard, slot = assign_shards(docs, n_shards, carry=carry, **how).toDF(id_col, *added, *carry), added[3], added[4]
    run = F.floor(F.col(slot) / file_rows)
    placed.repartition(F.col(shard), run).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


#: The rows of assign_shards over the table documents as SQL. CRC-32 is taken over blocks of 512 bytes by its public
#: table, made by its rule; a block's state is led over the next one by tables for 512 zero bytes.
SQL = r"""
WITH crc_table AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
lead AS (SELECT t, list_transform(range(0, 1024), lambda v: list_reduce(range(0, 512), lambda c, _: xor(c >> 8, t[1 + (c & 255)]), (v & 255) << (8 * (v >> 8)))) AS z FROM crc_table),
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
cuts AS (SELECT rid, k, CASE WHEN k = 0 THEN h[1:2 * ((n - 1) % 512 + 1)] ELSE h[2 * ((n - 1) % 512 + 1 + (k - 1) * 512) + 1:2 * ((n - 1) % 512 + 1 + k * 512)] END AS h FROM (SELECT *, unnest(range(0, (n + 511) // 512)) AS k FROM docs) x),
states AS (
  SELECT rid, k, list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CASE WHEN k = 0 THEN 4294967295 ELSE 0 END) AS c
  FROM cuts, lead),
crcs AS (
  SELECT rid, xor(list_reduce(cs, lambda c, b: xor(b, xor(xor(z[1 + (c & 255)], z[257 + (c >> 8 & 255)]), xor(z[513 + (c >> 16 & 255)], z[769 + (c >> 24)])))), 4294967295) AS crc
  FROM (SELECT rid, list(c ORDER BY k) AS cs FROM states GROUP BY rid) x, lead),
marked AS (
  SELECT doc_id, source, n + 16 AS size, coalesce(crc, 0) AS crc, CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, 15) AS BIGINT) AS hash
  FROM docs LEFT JOIN crcs USING (rid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST, crc, size) AS r, count(*) OVER (PARTITION BY source) AS total FROM marked),
placed AS (SELECT *, row_number() OVER (ORDER BY (r - 1 + CAST(0.5 AS DOUBLE)) / total, source NULLS FIRST, hash, doc_id NULLS FIRST, crc, size) - 1 AS place, count(*) OVER () AS n_all FROM ranked)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(place * {shards} // n_all AS INTEGER) AS shard, place - ((place * {shards} // n_all) * n_all + {shards} - 1) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
