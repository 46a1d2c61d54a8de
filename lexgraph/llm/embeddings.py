"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order of nearness. Two vectors are
candidates if they share at least three of their eight nearest pivots, the nearest one of each among them. So
a vector stands in the inverted lists of the 21 triples that hold its nearest pivot and two others of the
eight, and candidates meet in a list that holds the nearest pivots of both. A pair is taken up in one list only,
that of its lowest further shared pivots. Candidates are verified by their cosine in double precision. Long
lists are dealt to pairs of blocks.

Pivots are picked farthest first from a hash sample, and none lies nearer to another than THIN below the limit:
a large group of near copies holds one of them at most, so that its members agree on their nearest ones.

The number of pivots grows with the cube root of the number of vectors, so that candidates per vector stay about
as many. The more pivots, the less often two near vectors have the nearest one of each among the other's eight; so
with many vectors there are several sets of pivots, each with lists of its own, and a pair is a candidate if it is one
in any set. The tests measure recall against all pairs, and by simulation for up to a billion vectors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aligned, block_pairs, smallest_reachable, tidy, whole_numbers, written
from .components import components

NEAREST, SHARED = 8, 3
LIST_BLOCK = 512
WITHOUT = 512  # different vectors of a length up to which they are one list
SAMPLED = 4  # vectors looked at for each pivot
THIN = 0.1
LONG_LIST = 48  # rows from which a list is verified by matrix products


def n_pivots(n: int) -> int:
    """256 pivots for 50,000 vectors, by the cube root for others, from 64 to the 65,535 that a key can tell (800 billion vectors)."""
    return int(min(65_535, max(64, 256 * (n / 50_000) ** (1 / 3))))


def n_sets(pivots: int) -> int:
    """Sets of pivots: one misses about 3 % of the pairs at the limit with 300 pivots, 18 % with 7,000 and 27 % with 65,535."""
    return 1 if pivots <= 300 else 2 if pivots <= 4000 else 3


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """_id, _vec (the components as bytes; null for a vector that links with nothing) and _dim; and the bytes' type, of the column's precision."""
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            inner = column.flatten()
            flat = inner.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # no negative zeros
            bad = inner.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(flat)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            good, data, width = (sums(bad) == 0) & (sums(flat != 0) > 0), flat.tobytes(), flat.itemsize
            packed = [data[(e - n) * width : e * width] if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], ["_id", "_vec", "_dim"])

    whole_numbers(vectors, id_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("_v"))
    return rows.mapInArrow(tidy(run), "_id long, _vec binary, _dim int"), kind


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as unit rows in double precision."""
    return unit(np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(points: np.ndarray, most: int, nearest: float) -> np.ndarray:
    """Of unit vectors up to `most`, each the farthest from those before it, until all have one at cosine `nearest` or above."""
    picked, near = [0], points @ points[0]
    while len(picked) < most and near[far := int(near.argmin())] < nearest:
        picked.append(far)
        near = np.maximum(near, points @ points[far])
    return points[picked]


def pivot_lists(classes: DataFrame, pivots, kind: str) -> DataFrame:
    """Of each node the keys of its inverted lists and its pivots, nearest first, set by set.

    pivots is a broadcast dict by length of vector of lists of sets; vectors of a length without pivots are in one list.
    """
    sets = max([1, *map(len, pivots.value.values())])
    rest = np.array(list(combinations(range(1, NEAREST), SHARED - 1)))
    triples = np.concatenate([np.zeros((len(rest), 1), np.int64), rest], axis=1)

    def run(batches):
        for batch in batches:
            vectors, dims = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            keys, orders = [None] * len(dims), np.full((len(dims), sets * NEAREST), -1, np.int32)
            for dim in np.unique(dims):
                several, rows = pivots.value.get(int(dim)), np.flatnonzero(dims == dim)
                if several is None:
                    for r in rows:
                        keys[r] = [key_of(int(dim), 0, np.full((1, SHARED), 0xFFFF))[0]]
                    continue
                x, made = matrix([vectors[r] for r in rows], kind), []
                for s, points in enumerate(several):
                    m = min(NEAREST, len(points))
                    order = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :m]
                    orders[rows, s * NEAREST : s * NEAREST + m] = order
                    made.append(key_of(int(dim), s, np.sort(order[:, triples[(triples < m).all(axis=1)]], axis=2)))
                for r, key in zip(rows, np.concatenate(made, axis=1), strict=True):
                    keys[r] = key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(list(orders), pa.list_(pa.int32()))], ["_node", "_keys", "_pivots"])

    return classes.select("_node", "_vec", "_dim").mapInArrow(tidy(run), "_node long, _keys array<long>, _pivots array<int>")


def key_of(dim: int, of_set: int, triples: np.ndarray) -> np.ndarray:
    """A list's key: 16 bits per pivot in ascending order, above them two of the set and the dimension's lowest ones."""
    triples = triples.astype(np.int64)
    return (((dim & 0x1FFF) << 2 | of_set) << 48) | (triples[..., 0] << 32) | (triples[..., 1] << 16) | triples[..., 2]


def lowest_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of pivot orders the key (without dimension) of the one list that takes the pair up: the nearest pivots of both and the lowest others shared; negative if they share too few."""
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0)
    first, second = a[:, 0], b[:, 0]
    others = np.sort(np.where(shared & (a != first[:, None]) & (a != second[:, None]), a.astype(np.int64), 1 << 20), axis=1)
    triple = np.sort(np.stack([first, np.where(first == second, others[:, 1], second), others[:, 0]], axis=1), axis=1)
    known = (triple < 1 << 20).all(axis=1) & (shared & (a == second[:, None])).any(axis=1)
    return np.where(known, key_of(0, 0, triple), -1)


def taken_before(a: np.ndarray, b: np.ndarray, sets: np.ndarray | int) -> np.ndarray:
    """Whether pairs, by their pivots of all sets, are candidates in a set before that named."""
    out = np.zeros(len(a), bool)
    for s in range(int(np.max(sets, initial=0))):
        own = slice(s * NEAREST, (s + 1) * NEAREST)
        out |= (lowest_key(a[:, own], b[:, own]) >= 0) & (s < sets)
    return out


def first_close(x: np.ndarray, orders: np.ndarray, key: int, sides: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's rows (of both sides, if any) at the limit or above that this list takes up."""
    if sides is None:
        a = b = np.arange(len(x))
    else:
        a, b = np.flatnonzero(~sides), np.flatnonzero(sides)
    hit = x[a] @ x[b].T >= limit - 1e-9
    if orders[0, 0] >= 0:
        triple = [key >> 32 & 0xFFFF, key >> 16 & 0xFFFF, key & 0xFFFF]
        low = (orders >= 0) & (orders <= triple[2])
        has = np.zeros((len(x), len(known := np.unique(orders[low]))), np.float32)
        r, c = np.nonzero(low)
        has[r, np.searchsorted(known, orders[r, c])] = 1
        for p in triple:  # rows by their nearest pivots: which further pivots must be the lowest shared ones
            for q in triple:
                pa_, pb_ = np.flatnonzero(orders[a, 0] == p), np.flatnonzero(orders[b, 0] == q)
                if len(pa_) and len(pb_):
                    own = [t for t in triple if t not in (p, q)]
                    there = (known <= max(own)) & (known != p) & (known != q)
                    hit[np.ix_(pa_, pb_)] &= has[a[pa_]][:, there] @ has[b[pb_]][:, there].T < len(own) + 0.5
    ra, rb = np.nonzero(np.triu(hit, 1) if sides is None else hit)
    ra, rb = a[ra], b[rb]
    close = np.einsum("ij,ij->i", x[ra], x[rb]) >= limit
    return ra[close], rb[close]


def verified(postings: DataFrame, limit: float, kind: str) -> DataFrame:
    """(node, root, links) per node and table of lists that has links."""

    def run(batches):
        for table in aligned(batches, 3):
            keys, i, j = (table.column(k).to_numpy() for k in range(3))
            nodes, sides, copies = table.column("_node").to_numpy(), table.column("_side").to_numpy(), table.column("_copies").to_numpy()
            orders = table.column("_pivots").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.int64)
            of_set = keys >> 48 & 3
            vectors = table.column("_vec").to_pylist()
            dims = np.array([len(v) for v in vectors])
            run_start = np.concatenate([[True], (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            group = np.cumsum(run_start) - 1
            long = np.bincount(group) >= LONG_LIST
            ends_a, ends_b = [], []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = matrix([vectors[k] for k in rows], kind)
                own = group[rows]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                    if long[own[start]]:
                        r = rows[start:end]
                        s = int(of_set[r[0]])
                        a, b = first_close(x[start:end], orders[r, s * NEAREST : (s + 1) * NEAREST], int(keys[r[0]]), None if i[r[0]] == j[r[0]] else sides[r], limit)
                        new = ~taken_before(orders[r[a]], orders[r[b]], s)
                        ends_a.append(r[a][new])
                        ends_b.append(r[b][new])
                rest = ~long[own]
                rows, x = rows[rest], x[rest]
                own, step = group[rows], 1
                while step < len(rows):
                    a = np.flatnonzero(own[step:] == own[:-step])
                    if not len(a):
                        break
                    b = a + step
                    ra, rb = rows[a], rows[b]
                    here = (i[ra] == j[ra]) | (sides[ra] != sides[rb])
                    close = np.zeros(len(a), bool)
                    close[here] = np.einsum("ij,ij->i", x[a[here]], x[b[here]]) >= limit
                    ra, rb = ra[close], rb[close]
                    own_set = of_set[ra][:, None] * NEAREST + np.arange(NEAREST)
                    first = lowest_key(np.take_along_axis(orders[ra], own_set, 1), np.take_along_axis(orders[rb], own_set, 1)) == (keys[ra] & 0xFFFFFFFFFFFF)
                    first = (first & ~taken_before(orders[ra], orders[rb], of_set[ra])) | (orders[ra, 0] < 0)
                    ends_a.append(ra[first])
                    ends_b.append(rb[first])
                    step += 1
            if not ends_a or not len(a := np.concatenate(ends_a)):
                continue
            b = np.concatenate(ends_b)
            found, number = np.unique(nodes, return_inverse=True)
            links, many = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            many[number] = copies
            np.add.at(links, number[a], many[number[b]])
            np.add.at(links, number[b], many[number[a]])
            root = smallest_reachable(number[a], number[b], len(found))
            keep = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(found[keep]), pa.array(found[root[keep]]), pa.array(links[keep])], ["node", "root", "links"])

    rows = postings.select("_key", "_i", "_j", "_node", "_side", "_copies", "_pivots", "_vec").repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_node")
    return rows.mapInArrow(tidy(run), "node long, root long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.95) -> DataFrame:
    """Return a row per vector: id_col, n_links, component_id and kept.

    n_links counts the other vectors linked directly (equal ones included), component_id is the smallest id
    reachable by links, kept says that the row has it. No pair below the limit is linked; of those at it or
    above nearly all are found. A vector that is null, empty, zero, or has a null, NaN or infinite component
    links with nothing, and vectors of different lengths don't link. A length with up to WITHOUT different
    vectors is one list; for every other one the driver holds its pivots (a bounded sample). Rows that repeat an id are vectors of
    their own; null ids are allowed. Labels and other columns are ignored; an empty table gives no rows.
    """
    rows, kind = _packed(vectors, id_col, vector_col)
    rows = written(rows, "vectors")
    classes = rows.where("_vec IS NOT NULL").groupBy("_vec", "_dim").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"))
    classes = written(classes.withColumn("_node", F.monotonically_increasing_id()), "vector-classes")
    pivots = {}
    for dim, n in classes.groupBy("_dim").count().where(F.col("count") > WITHOUT).collect():
        for s in range(n_sets(n_pivots(n))):
            order = F.xxhash64("_vec", F.lit(s)) if s else F.xxhash64("_vec")
            taken = classes.where(F.col("_dim") == dim).orderBy(order, "_node").limit(SAMPLED * n_pivots(n)).select("_vec").collect()
            points = spread(matrix([bytes(r[0]) for r in taken], kind), n_pivots(n), limit - THIN)
            if len(points) >= SHARED:
                pivots.setdefault(dim, []).append(points)
    described = written(pivot_lists(classes, vectors.sparkSession.sparkContext.broadcast(pivots), kind), "pivots")
    postings = described.select("_node", F.explode("_keys").alias("_key"))
    lists = postings.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"), F.ceil(F.col("_n") / LIST_BLOCK).cast("long").alias("_blocks"))
    postings = postings.join(lists, F.col("_key") == F.col("_k")).select("_key", "_node", "_blocks")
    data = classes.select("_node", "_copies", "_vec").join(described.select(F.col("_node").alias("_c"), "_pivots"), F.col("_node") == F.col("_c")).drop("_node")
    found = written(verified(block_pairs(postings.join(data, F.col("_node") == F.col("_c")), "_node", "_blocks"), limit, kind), "vector-links")
    groups = components(found, "node", "root").select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    links = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("_far"))
    linked = classes.join(groups, "_node", "left").join(links, "_node", "left")
    linked = written(linked.select(F.col("_vec").alias("_v"), "_rep", F.coalesce("_group", "_node").alias("_group"), (F.coalesce("_far", F.lit(0)) + F.col("_copies") - 1).alias("_links")), "vector-linked")
    first = linked.groupBy("_group").agg(F.min("_rep").alias("_first"))
    linked = linked.join(first, "_group").select("_v", "_links", "_first")
    out = rows.select("_id", "_vec").join(linked, F.col("_vec") == F.col("_v"), "left")
    own = F.when(F.col("_v").isNull(), F.col("_id")).otherwise(F.col("_first"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept"))


#: The rows of near_vectors over all pairs of embeddings, as SQL.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= {limit} * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(low.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""
