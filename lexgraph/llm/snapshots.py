"""What changed between two snapshots of a table, and which rows only got another key.

Both snapshots are dealt by key to the same partitions. Each builds a minimal perfect hash over its earlier keys and
streams its later rows past it: a slot is verified against the key it holds, what finds none is new, and what is left
in the bitmap of vacant slots is gone. Rows that found no partner are then ranked within equal content, earlier ones by
rising and later ones by falling key, and those of equal rank are one row under another key. Only keys and digests of
the columns are moved, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, tidy, written


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: in each level, keys that are alone at their place stay, the rest go on."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = max(8, int(room * len(left)))
            at = self._place(left, size, len(self.levels))
            taken = np.bincount(at, minlength=size) == 1
            self.levels.append((taken, np.cumsum(taken) - 1 + base))
            base += int(taken.sum())
            left = left[~taken[at]]
        self.slots = base

    @staticmethod
    def _place(keys: np.ndarray, size: int, level: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, below self.slots; of a key that was not put in, any slot or -1."""
        out, ask = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (taken, rank) in enumerate(self.levels):
            at = self._place(keys[ask], len(taken), level)
            out[ask[taken[at]]] = rank[at[taken[at]]]
            ask = ask[~taken[at]]
        return out


class Slots:
    """Earlier rows, found by key: a slot holds the rows whose keys have one fingerprint, and who they are is verified."""

    def __init__(self, rows: pa.Table, prints: str, exact: list[str]):
        self.exact = exact
        has = pc.is_valid(rows.column(exact[0])).to_numpy(zero_copy_only=False)
        self.rows = rows.take(pa.array(np.argsort(np.where(has, 0, 1), kind="stable")))  # rows without a key come last
        marks = self.rows.column(prints).to_numpy()[: int(has.sum())].view(np.uint64)
        order = np.argsort(marks, kind="stable")
        marks = marks[order]
        first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else np.zeros(0, np.int64)
        self.hash = PerfectHash(marks[first])
        self.order, bounds = order, np.append(first, len(marks))
        slot = self.hash.of(marks[first])
        self.start, self.end = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        self.start[slot], self.end[slot] = bounds[:-1], bounds[1:]
        self.vacant = np.ones(self.rows.num_rows, bool)

    def find(self, later: pa.RecordBatch, prints: str) -> np.ndarray:
        """The number of each later row's partner among self.rows, or -1; partners are no longer vacant."""
        out = np.full(later.num_rows, -1, np.int64)
        if not len(self.start):
            return out
        slot = self.hash.of(later.column(prints).to_numpy().view(np.uint64))
        ask = np.flatnonzero((slot >= 0) & pc.is_valid(later.column(self.exact[0])).to_numpy(zero_copy_only=False))
        step = 0
        while len(ask):  # more than once only where fingerprints are equal and keys are not
            at = self.start[slot[ask]] + step
            ask, at = ask[at < self.end[slot[ask]]], at[at < self.end[slot[ask]]]
            row = self.order[at]
            equal = np.ones(len(ask), bool)
            for name in self.exact:
                equal &= pc.equal(later.column(name).take(pa.array(ask)), self.rows.column(name).take(pa.array(row)).combine_chunks()).to_numpy(zero_copy_only=False)
            out[ask[equal]] = row[equal]
            ask, step = ask[~equal], step + 1
        self.vacant[out[out >= 0]] = False
        return out


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; null equals null only."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return ~pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)


def _digest(c: str) -> Column:
    """A column's value, or the SHA-256 of a long one, as bytes; null stays null."""
    data = F.col(c).cast("string").cast("binary")
    return F.when(F.octet_length(data) <= 31, F.concat(F.lit(b"="), data)).otherwise(F.unhex(F.sha2(data, 256)))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `name`: the number of each row within its group in the given order, from 0 on.

    Rows are dealt by ranges of order within a hash of the group, so that a large group is many tasks' work, numbered
    within their partition, and led by the counts of their group in earlier partitions. The order should be of short
    columns, as a sample of it goes to the driver.
    """
    rest = [*order, F.col("_place")]
    parts = df.withColumn("_place", F.monotonically_increasing_id()).withColumn("_hash", F.xxhash64(*group)).repartitionByRange("_hash", *rest)
    parts = parts.sortWithinPartitions("_hash", *group, *rest).drop("_hash")
    parts = parts.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    parts = written(parts, "ranks")
    per = parts.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_of{i}") for i, g in enumerate(group)), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g) == F.col(f"_of{i}")
    out = parts.join(per, same).withColumn(name, F.col("_row") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, name)


def _numbered(df: DataFrame, digests: list[str]) -> DataFrame:
    """df with _nth: 0, and for rows of a key that repeats their number in the order of their digests."""
    repeated = df.where("_key IS NOT NULL").groupBy(F.col("_key").alias("_again")).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return df.withColumn("_nth", F.lit(0).cast("long"))
    repeated = written(repeated, "repeated-keys")
    many = ranked(df.join(repeated, F.col("_key") == F.col("_again")).drop("_again"), ["_key"], [F.col(c) for c in digests], "_nth")
    return df.join(repeated, F.col("_key") == F.col("_again"), "left_anti").withColumn("_nth", F.lit(0).cast("long")).unionByName(many)


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: list[str], content: list[str], carry: tuple[str, ...] = (), partition_rows: int = 100_000) -> DataFrame:
    """Compare two snapshots: a row per pair and per row without a partner, with key, old_key, op, changed and carry.

    Rows of equal key are a pair: op is 'same', or 'update' if any of `columns` differs. Rows left over whose `content`
    columns are equal pair by rank, the i-th smallest earlier key with the i-th largest later one: 'rekey'. What is
    left is 'insert' (later) or 'delete' (earlier). key is the later row's, of a delete the earlier one's; old_key the
    earlier row's, null for an insert; changed is an array of a pair's columns that differ, in the order of
    `columns`; `carry` are columns of the later row (null for a delete). Null equals null only. A null key
    is no key: such rows pair by content, smaller than all others. Of a key that repeats, the i-th row of each
    snapshot are a pair, in the order of their values. Keys may be of any type that can be compared, the same on both
    sides; values are compared by their text form, long ones by SHA-256. Other columns are ignored, whatever
    their names; an empty snapshot gives inserts or deletes only.
    """
    if not set(content) <= set(columns):
        raise ValueError("content must be among columns")
    spark, kind = earlier.sparkSession, earlier.schema[key].dataType.simpleString()
    digests = [f"_d{i}" for i in range(len(columns))]
    carried = [f"_c{i}" for i in range(len(carry))]
    carry_types = [later.schema[c].dataType.simpleString() for c in carry]

    def side(df: DataFrame, which: int) -> DataFrame:
        own = [F.col(c).alias(n) if which else F.lit(None).cast(t).alias(n) for c, n, t in zip(carry, carried, carry_types, strict=True)]
        df = df.select(F.col(key).cast(kind).alias("_key"), *(_digest(c).alias(d) for c, d in zip(columns, digests, strict=True)), *own)
        df = _numbered(df, digests)
        spread_null = F.xxhash64(*digests, F.monotonically_increasing_id())
        return df.withColumn("_side", F.lit(which)).withColumn("_print", F.when(F.col("_key").isNull(), spread_null).otherwise(F.xxhash64("_key", "_nth")))

    both = side(earlier, 0).unionByName(side(later, 1))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-earlier.count() // partition_rows))
    dealt = both.repartition(n, "_print").sortWithinPartitions("_side")
    left_over = ["_key", "_nth", *digests, *carried]
    schema = ", ".join([f"_state int, _old {kind}, _changed array<int>, _key {kind}, _nth long", *(f"{d} binary" for d in digests), *(f"{c} {t}" for c, t in zip(carried, carry_types, strict=True))])
    changed_type = pa.list_(pa.int32())

    def rows(state: int, old, changed, table) -> pa.RecordBatch:
        size = table.num_rows
        columns_of = [table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c) for c in left_over]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, state, np.int32)), old, changed, *columns_of], names=["_state", "_old", "_changed", *left_over])

    def probe(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        slots = shape = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shape = batch.schema
            is_later = batch.column("_side").to_numpy() == 1
            cut = int(is_later.argmax()) if is_later.any() else batch.num_rows
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            new = batch.slice(cut)
            if slots is None:
                slots = Slots(pa.Table.from_batches(held, schema=shape), "_print", ["_key", "_nth"])
            partner = slots.find(new, "_print")
            paired = np.flatnonzero(partner >= 0)
            if len(paired):
                mine, theirs = new.take(pa.array(paired)), slots.rows.take(pa.array(partner[paired])).combine_chunks()
                differs = np.stack([_differ(mine.column(d), theirs.column(d).combine_chunks()) for d in digests], axis=1)
                values = np.nonzero(differs)[1].astype(np.int32)
                ends = np.append(0, differs.sum(axis=1).cumsum()).astype(np.int32)
                yield rows(2, theirs.column("_key").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), mine)
            alone = new.take(pa.array(np.flatnonzero(partner < 0)))
            if alone.num_rows:
                yield rows(1, pa.nulls(alone.num_rows, alone.column("_key").type), pa.nulls(alone.num_rows, changed_type), alone)
        if held and slots is None:
            slots = Slots(pa.Table.from_batches(held, schema=shape), "_print", ["_key", "_nth"])
        if slots is not None and slots.vacant.any():
            gone = slots.rows.take(pa.array(np.flatnonzero(slots.vacant)))
            yield rows(0, pa.nulls(gone.num_rows, gone.column("_key").type), pa.nulls(gone.num_rows, changed_type), gone)

    found = written(dealt.mapInArrow(tidy(probe), schema), "probed")
    names = F.array(*(F.lit(c) for c in columns))
    named = lambda at: F.transform(at, lambda i: F.element_at(names, i + 1))
    results = lambda df, k, old, op, changed, own: df.select(k.alias("key"), old.alias("old_key"), op.alias("op"), changed.alias("changed"), *(o.alias(c) for c, o in zip(carry, own, strict=True)))
    own = [F.col(c) for c in carried]
    pairs = results(found.where("_state = 2"), F.col("_key"), F.col("_old"), F.when(F.size("_changed") == 0, "same").otherwise("update"), named("_changed"), own)

    # content is equal where its digests are; a null among them is told from every value by its place
    parts = [F.coalesce(F.concat(F.lit(b"+"), F.col(d)), F.lit(b"-")) for d, c in zip(digests, columns, strict=True) if c in content]
    lone = found.where("_state < 2").withColumn("_g", F.unhex(F.sha2(F.concat(*(x for p in parts for x in (F.octet_length(p).cast("string").cast("binary"), F.lit(b":"), p))), 256)) if parts else F.lit(b""))
    lone = lone.withColumn("_values", F.xxhash64(*digests))
    old_rows = ranked(lone.where("_state = 0").select("_g", "_values", *left_over), ["_g"], [F.col("_key").asc_nulls_first(), F.col("_nth"), F.col("_values")], "_i")
    new_rows = ranked(lone.where("_state = 1").select("_g", "_values", *left_over), ["_g"], [F.col("_key").desc_nulls_last(), F.col("_nth").desc(), F.col("_values")], "_i")
    old_rows = old_rows.select(*(F.col(c).alias(f"_e{c}") for c in ["_g", "_i", "_key", *digests]), F.lit(True).alias("_had"))
    joined = old_rows.join(new_rows.withColumn("_has", F.lit(True)), (F.col("_e_g") == F.col("_g")) & (F.col("_e_i") == F.col("_i")), "full_outer")
    pair = F.col("_had") & F.col("_has")
    differs = F.filter(F.array(*(F.when(~F.col(f"_e{d}").eqNullSafe(F.col(d)), F.lit(c)) for d, c in zip(digests, columns, strict=True))), lambda c: c.isNotNull())
    op = F.when(pair, "rekey").when(F.col("_has"), "insert").otherwise("delete")
    empty = F.array().cast("array<string>")
    moved = results(joined, F.when(F.col("_has"), F.col("_key")).otherwise(F.col("_e_key")), F.col("_e_key"), op, F.when(pair, differs).otherwise(empty), own)
    return pairs.unionByName(moved)
