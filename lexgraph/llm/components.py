"""Connected components of an edge table, by alternating stars over written tables.

The large-star and small-star operations of the public map-reduce algorithm are joins with per-node minima:
no neighbourhood is gathered, so a node with very many links is a skewed join key at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_u"), F.least("_m", "a").alias("_m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(_minima(both), F.col("a") == F.col("_u"))
    return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = down.join(_minima(down), F.col("a") == F.col("_u"))
    return near.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(near.select("a", F.col("_m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component) for every node with an edge to another: component is the smallest node reachable.

    Edges have no direction; repeated ones, loops and those with a null end change nothing. The loop ends when a
    round changes no edge, after about the logarithm of the largest component's width.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = written(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        last, old = state, now
        now = written(_small(_large(now)).where("a <> b").distinct(), "edges")
        discard(old)
