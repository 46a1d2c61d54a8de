"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes the set of its five-word shingles, a MinHash signature and band keys. Texts of equal
   sets are one class with a number of copies, and only classes are compared.
2. Classes that share a band key are candidates. Buckets with the same members are kept once. A large bucket
   is dealt to pairs of blocks. In a bucket, signatures are compared a few values at a time: with m of n
   values equal, the posterior probability that the Jaccard similarity reaches the threshold is a binomial
   sum (uniform prior), and a pair goes as soon as it is below the tolerance. What a bucket returns is a
   spanning forest of the pairs that remain, not the pairs.
3. Within the components of those forests, which are near-copies of each other, every pair that passes the
   same pruning is verified on its shingle sets. Each text goes to one block of its component and is compared
   there; between blocks only the signatures and the sets' differences with the set of one member, the
   centre, move, which say exactly how much two sets share. A block returns link counts and a spanning forest
   of verified links; their components are the result.

With 32 bands of 4 values a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8,
and the pruning loses it with probability of the order of the tolerance. Shingles are compared as 64-bit
fingerprints.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, block_pairs, fresh, groups, mix, shingles, tidy, whole_numbers, words, written
from .components import components

BANDS, ROWS = 32, 4
STEP = 16
#: Rows of a bucket's block, rows and bytes of text of a verified block, and rows of a block of differences.
BUCKET_BLOCK, VERIFY_BLOCK, VERIFY_BYTES, ACROSS_BLOCK = 1024, 256, 8 << 20, 1024


@lru_cache
def hash_family(n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set that is not empty."""
    a, b = hash_family()
    x, out = (found >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k : k + 512, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ parts[:, :, k]
    return mix(out)


@lru_cache
def least_matches(n: int, threshold: Fraction, tolerance: float) -> int:
    """The fewest equal values of n with which P(J >= threshold) is not below the tolerance."""
    t, total = float(threshold), 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def survivors(signatures: np.ndarray, one: np.ndarray, others: np.ndarray, threshold: Fraction, tolerance: float) -> np.ndarray:
    """Those of `others` (rows of signatures) that incremental comparison with one signature doesn't prune."""
    equal = np.zeros(len(others), np.int64)
    for n in range(0, signatures.shape[1], STEP):
        equal += (signatures[others, n : n + STEP] == one[n : n + STEP]).sum(axis=1)
        keep = equal >= least_matches(n + STEP, threshold, tolerance)
        others, equal = others[keep], equal[keep]
        if not len(others):
            break
    return others


def forest(signatures: np.ndarray, sides: np.ndarray | None, threshold: Fraction, tolerance: float) -> list[tuple[int, int]]:
    """Edges (row, root) that span the components of the pairs left by pruning; with sides, only of pairs across them."""
    waiting, edges = np.arange(len(signatures)), []
    while len(waiting):
        root, waiting = waiting[0], waiting[1:]
        queue = [root]
        while queue and len(waiting):
            one = queue.pop()
            there = waiting if sides is None else waiting[sides[waiting] != sides[one]]
            found = survivors(signatures, signatures[one], there, threshold, tolerance)
            if len(found):
                edges += [(int(k), int(root)) for k in found]
                queue += found.tolist()
                waiting = np.setdiff1d(waiting, found, assume_unique=True)
    return edges


SIGNED = "_id long, _n int, _set binary, _sig binary, _bands array<long>, _md5 binary"


def signed(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """A row per document: shingle count, 128-bit digest of the set, signature (16 bits a value), band keys, digest of the text."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, sets, rows = [], [], []
                for text in part.column(1):
                    found = shingles(hashes.of(words(text.as_py())), n_words)
                    counts.append(len(found))
                    sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    rows.append(signature(found) if len(found) else np.zeros(BANDS * ROWS, np.uint32))
                signatures = np.stack(rows)
                short = signatures.astype(np.uint16)
                keys = band_keys(signatures).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int32()), pa.array(sets, pa.binary()), pa.array([x.tobytes() if n else None for x, n in zip(short, counts, strict=True)], pa.binary()),
                     pa.array([x if n else [] for x, n in zip(keys, counts, strict=True)], pa.list_(pa.int64())), part.column(2)],
                    ["_id", "_n", "_set", "_sig", "_bands", "_md5"],
                )

    whole_numbers(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_md5"))
    return rows.mapInArrow(tidy(run), SIGNED)


def candidate_forests(classes: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """Edges (a, b) that join classes whose pairs in some bucket are not pruned."""
    bands = classes.select("_node", F.explode("_bands").alias("_key"))
    buckets = bands.groupBy("_key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_node")).alias("_x"), F.min("_node").alias("_low"), F.max("_node").alias("_high"))
    buckets = buckets.where("_n > 1").groupBy("_n", "_x", "_low", "_high").agg(F.min("_key").alias("_k"))  # the same members: one bucket
    blocks = F.ceil(F.col("_n") / BUCKET_BLOCK).cast("long")
    rows = bands.join(buckets.select("_k", blocks.alias("_blocks")), F.col("_key") == F.col("_k")).select("_key", "_node", "_blocks")
    rows = block_pairs(rows.join(classes.select(F.col("_node").alias("_c"), "_sig"), F.col("_node") == F.col("_c")), "_node", "_blocks")

    def run(batches):
        for (_, i, j), rows in groups(batches, 3):
            if rows.num_rows < 2:
                continue
            nodes = rows.column("_node").to_numpy()
            signatures = np.stack([np.frombuffer(x, np.uint16) for x in rows.column("_sig").to_pylist()])
            sides = rows.column("_side").to_numpy() if i != j else None
            if edges := forest(signatures, sides, threshold, tolerance):
                ends = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[ends[:, 0]]), pa.array(nodes[ends[:, 1]])], ["a", "b"])

    rows = rows.select("_key", "_i", "_j", "_node", "_side", "_sig").repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_node")
    return rows.mapInArrow(tidy(run), "a long, b long")


def links_within(nodes: np.ndarray, copies: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, parts: list[np.ndarray], apart: np.ndarray | None, threshold: Fraction, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each node: root of the forest of verified links, and links counted with copies; with apart, only of pairs that differ in it.

    `parts` are the sets themselves, or each set's symmetric difference with one and the same set: two sets differ
    in as many shingles as their parts do, so what they share follows from the sizes.
    """
    lengths = np.array([len(x) for x in parts])
    distinct, ids = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    mark, links, parent = np.zeros(len(distinct), np.int64), np.zeros(len(nodes), np.int64), list(range(len(nodes)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for one in range(len(nodes) - 1):
        there = np.arange(one + 1, len(nodes))
        if apart is not None:
            there = there[apart[there] != apart[one]]
        small, large = np.minimum(sizes[there], sizes[one]), np.maximum(sizes[there], sizes[one])
        there = there[small * threshold.denominator >= large * threshold.numerator]
        there = survivors(signatures, signatures[one], there, threshold, tolerance)
        if not len(there):
            continue
        own = ids[starts[one] : ends[one]]
        mark[own] = 1
        if len(there) < 16:
            same = np.array([mark[ids[starts[k] : ends[k]]].sum() for k in there])
        else:
            upto = np.concatenate([[0], np.cumsum(mark[ids])])
            same = upto[ends[there]] - upto[starts[there]]
        mark[own] = 0
        both = sizes[there] + sizes[one]
        shared = (both - (lengths[there] + lengths[one] - 2 * same)) // 2
        linked = there[shared * threshold.denominator >= (both - shared) * threshold.numerator]
        links[one] += copies[linked].sum()
        links[linked] += copies[one]
        for k in linked.tolist():
            x, y = sorted((root(one), root(k)))
            parent[y] = x
    return nodes[[root(k) for k in range(len(nodes))]], links


FOUND = "node long, root long, links long"
PARTS = "_component long, _block long, _blocks long, _copies long, _size long, _sig binary, _part binary"


def verified_blocks(members: DataFrame, n_words: int, threshold: Fraction, tolerance: float) -> DataFrame:
    """links_within() each block, a row per node; where a component has several blocks, with the node's difference to its centre.

    A block holds its members' texts, each once, and first of all the text of the component's centre, node _x.
    """

    def run(batches):
        hashes = WordHashes()
        for (component, block), rows in groups(batches, 2):
            sets = [shingles(hashes.of(words(t.as_py())), n_words) for t in rows.column("_text")]
            centre = sets.pop(0) if rows.column("_centre")[0].as_py() else None
            rows = rows if centre is None else rows.slice(1)
            nodes, copies, blocks = (rows.column(c).to_numpy() for c in ("_node", "_copies", "_blocks"))
            if not len(nodes):
                continue
            sizes, signatures = np.array([len(s) for s in sets]), np.stack([signature(s) for s in sets]).astype(np.uint16)
            roots, links = links_within(nodes, copies, sizes, signatures, sets, None, threshold, tolerance)
            parts = [None if centre is None else np.setxor1d(s, centre, assume_unique=True).tobytes() for s in sets]
            marks = [None if centre is None else x.tobytes() for x in signatures]
            same = lambda v, n=len(nodes): pa.array(np.full(n, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(roots), pa.array(links), same(component), same(block), pa.array(blocks), pa.array(copies), pa.array(sizes), pa.array(marks, pa.binary()), pa.array(parts, pa.binary())],
                [c.split()[0] for c in f"{FOUND}, {PARTS}".split(", ")],
            )

    own = F.struct(F.pmod(F.xxhash64(F.lit(41), "_node"), "_blocks").alias("b"), F.lit(False).alias("c"))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda k: F.struct(k.alias("b"), F.lit(True).alias("c")))
    places = F.concat(F.array(own), F.when((F.col("_blocks") > 1) & (F.col("_node") == F.col("_x")), everywhere).otherwise(F.array().cast("array<struct<b:bigint,c:boolean>>")))
    rows = members.withColumn("_p", F.explode(places)).select("_component", F.col("_p.b").alias("_block"), "_node", "_copies", "_blocks", "_text", F.col("_p.c").alias("_centre"))
    rows = rows.repartition("_component", "_block").sortWithinPartitions("_component", "_block", F.desc("_centre"), "_node")
    return rows.mapInArrow(tidy(run), f"{FOUND}, {PARTS}")


def verified_across(found: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """links_within() components of several blocks, of nodes in different ones: only signatures and differences move."""

    def run(batches):
        for (_, i, j), rows in groups(batches, 3):
            nodes, copies, sizes = (rows.column(c).to_numpy() for c in ("node", "_copies", "_size"))
            signatures = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column("_sig")])
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("_part")]
            apart = rows.column("_side" if i != j else "_block").to_numpy()
            roots, links = links_within(nodes, copies, sizes, signatures, parts, apart, threshold, tolerance)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some]), pa.array(links[some])], ["node", "root", "links"])

    rows = found.where("_blocks > 1")
    sizes = rows.groupBy("_component").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_part")).alias("_b"))
    wide = F.ceil(F.greatest(F.col("_n") / ACROSS_BLOCK, F.col("_b") / VERIFY_BYTES)).cast("long")
    rows = rows.join(sizes.select(F.col("_component").alias("_c"), wide.alias("_wide")), F.col("_component") == F.col("_c"))
    rows = block_pairs(rows, "node", F.least("_wide", "_blocks"))
    rows = rows.select("_component", "_i", "_j", "node", "_side", "_block", "_copies", "_size", "_sig", "_part").repartition("_component", "_i", "_j").sortWithinPartitions("_component", "_i", "_j", "node")
    return rows.mapInArrow(tidy(run), FOUND)


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """The documents as signed() has them, and the classes with (_set, _class, _links, _group): see near_duplicates."""
    limit = Fraction(str(threshold))
    rows = written(signed(docs, id_col, text_col, n_words), "signed")
    classes = rows.where("_n > 0").groupBy("_set").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"), F.min("_md5").alias("_md5"), F.first("_sig").alias("_sig"), F.first("_bands").alias("_bands"))
    classes = written(classes.withColumn("_node", F.monotonically_increasing_id()), "classes")
    near = written(components(candidate_forests(classes, limit, tolerance)), "near")

    # the text of every class that has a near one, once
    members = near.join(classes.select("_node", "_copies", F.col("_md5").alias("_m")), F.col("node") == F.col("_node")).select("_node", F.col("component").alias("_component"), "_copies", "_m")
    texts = docs.select(F.col(text_col).alias("_text")).where(F.col(text_col).isNotNull()).withColumn("_md5", F.unhex(F.md5(F.col("_text").cast("binary"))))
    members = texts.join(members, F.col("_md5") == F.col("_m"))
    members = written(members.select("_node", "_component", "_copies", "_text", F.octet_length("_text").alias("_bytes")).dropDuplicates(["_node"]), "members")
    # the centre is a shortest text, so that no difference is more than twice its node's set
    sizes = members.groupBy("_component").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_b"), F.min(F.struct("_bytes", "_node")).alias("_least"))
    blocks = F.ceil(F.greatest(F.col("_n") / VERIFY_BLOCK, F.col("_b") / VERIFY_BYTES)).cast("long")
    members = members.join(sizes.select(F.col("_component").alias("_c"), F.least(blocks, F.col("_n")).alias("_blocks"), F.col("_least._node").alias("_x")), F.col("_component") == F.col("_c"))
    within = written(verified_blocks(members, n_words, limit, tolerance), "links-within")
    found = within.select("node", "root", "links").unionByName(written(verified_across(within, limit, tolerance), "links-across"))

    groups_ = components(found, "node", "root").select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    links = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("_far"))
    classes = classes.select("_node", "_set", "_rep", "_copies", "_md5").join(groups_, "_node", "left").join(links, "_node", "left")
    classes = classes.select("_set", "_rep", "_md5", F.coalesce("_group", "_node").alias("_group"), (F.coalesce("_far", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    classes = written(classes, "linked")
    first = classes.groupBy("_group").agg(F.min("_rep").alias("_class"))
    return rows, classes.join(first, "_group").select("_set", "_class", "_links", "_group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """Return a row per document: id_col, class_id, n_links and kept.

    Two documents are linked if the Jaccard similarity of their sets of n_words-word shingles is at least
    threshold; fewer words than that, but not none, are one shingle. n_links counts the other documents linked
    directly, copies included. class_id is the smallest id reachable by links, kept says that the row has it.
    A text without words (null, empty, punctuation) is linked with nothing and is its own class. Rows that
    repeat an id are documents of their own; null ids are allowed, and a class of them alone has a null
    class_id. Other columns are ignored; an empty table gives no rows.
    """
    rows, classes = link_classes(docs, id_col, text_col, n_words, threshold, tolerance)
    classes = classes.withColumnRenamed("_set", "_s")
    out = rows.select("_id", "_set").join(classes, F.col("_set") == F.col("_s"), "left")
    own = F.when(F.col("_s").isNull(), F.col("_id")).otherwise(F.col("_class"))
    return out.select(F.col("_id").alias(id_col), own.alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.col("_id").eqNullSafe(own).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, with one document of each class of near-duplicates.

    It is the one with the smallest id (null last), then with the smallest digest of the text; of rows that
    agree in both, one stays. Documents without words all stay.
    """
    rows, classes = link_classes(docs, id_col, text_col, **how)
    rows = rows.where("_n > 0").join(classes.select(F.col("_set").alias("_s"), "_group"), F.col("_set") == F.col("_s"))
    best = rows.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("_md5").alias("m"))).alias("_best"))
    best = best.select("_group", F.col("_best.i").alias("_i"), F.col("_best.m").alias("_m"))
    many = rows.groupBy("_group", "_id", "_md5").agg(F.count("*").alias("_same")).withColumnRenamed("_group", "_g")
    best = best.join(many, (F.col("_group") == F.col("_g")) & F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_md5")))
    digest, own, its, repeated = (fresh(docs, n) for n in ("_lg_md5", "_lg_id", "_lg_its", "_lg_repeated"))
    best = written(best.select(F.col("_i").alias(own), F.col("_m").alias(its), (F.col("_same") > 1).alias(repeated)), "kept")
    mark = docs.withColumn(digest, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    kept = mark.join(best, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(digest) == F.col(its)))
    once = kept.where(~F.col(repeated)).unionByName(kept.where(F.col(repeated)).dropDuplicates([id_col, digest]))
    bare = docs.where(F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return once.select(*docs.columns).unionByName(bare)
