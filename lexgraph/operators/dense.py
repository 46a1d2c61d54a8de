"""Exact dense search, score fusion, diversification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import saturate
from ..storage import stored, written
from .bm25 import top

#: Query vectors of a block, and bytes of document vectors that are held to meet the blocks one after the other.
BLOCK, HELD = 4096, 64 << 20


def search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The k best (query_id, doc_id, score, rank) of each query by inner product in double precision, exact.

    A join of two tables in blocks: the queries are written in blocks of up to BLOCK rows; each task holds HELD bytes of
    documents at a time, reads the blocks one after the other and keeps k rows per query, so neither side goes through
    the driver, no document is shuffled, and the plan has one size for any number of queries. What is shuffled is k
    rows per query and held part. Null vectors and those of another length than the query's are passed over. Ties
    go to the lower id; a query id that repeats is asked with each of its vectors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    blocks = written(asked.withColumn("n", F.size("v")).sortWithinPartitions("n").mapInArrow(_packed(BLOCK), "n int, ids binary, vectors binary"), "query-blocks")
    return top(rows.mapInArrow(_best(blocks._lexgraph_path, k), "query_id long, doc_id long, score double"), k)


def _packed(most: int):
    """Rows of up to `most` query vectors of one length: their ids and numbers as bytes."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == n)
                for at in range(0, len(here), most):
                    part = here[at : at + most]
                    vectors = flat[(starts[part][:, None] + np.arange(n)).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([vectors.tobytes()])], ["n", "ids", "vectors"])

    return run


def _best(path: str, k: int):
    def scores(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table.column(1).combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        doc_ids, flat = table.column(0).to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for block in stored(path):
            for n, ids, data in zip(*(block.column(c).to_pylist() for c in ("n", "ids", "vectors")), strict=True):
                here = np.flatnonzero(sizes == n)
                if not len(here):
                    continue
                asked, queries = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, n)
                found, near = np.empty((len(asked), 0), np.int64), np.empty((len(asked), 0))
                for at in range(0, len(here), 2048):
                    part = here[at : at + 2048]
                    x = flat[(starts[part][:, None] + np.arange(n)).ravel()].reshape(len(part), n)
                    near = np.concatenate([near, queries @ x.T], axis=1)
                    found = np.concatenate([found, np.broadcast_to(doc_ids[part], (len(asked), len(part)))], axis=1)
                    order = np.lexsort((found, -np.round(near, 6)), axis=1)[:, :k]
                    found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, found.shape[1])), pa.array(found.ravel()), pa.array(near.ravel())], ["query_id", "doc_id", "score"])

    return _in_parts(scores)


def _in_parts(scores):
    """scores of the batches that HELD bytes take at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > HELD:
                yield from scores(held)
                held, size = [], 0
        if held:
            yield from scores(held)

    return run


def mmr_whole(docs: DataFrame, queries: DataFrame, k: int, trade: float = 0.5, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over all documents: (query_id, doc_id, pick), k picks a query.

    The first pick is the document closest to the query; each further one has the best trade * relevance -
    (1 - trade) * likeness to what is taken. A pick is one scan of the documents, which meet the written queries and their picks
    in blocks, as in search(): a held part keeps its best document of each query, so no table of queries by documents is made, and
    neither queries nor picks go through the driver. Ties go to the lower id; null vectors and those of another length are passed over.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL"), "vectors")
    asked = queries.select(F.col("query_id").cast("long"), F.array().cast("array<long>").alias("done"), F.col("query_vector").cast("array<double>").alias("vs")).dropna().where("size(vs) > 0")
    taken, out = written(asked.dropDuplicates(["query_id"]), "taken"), None
    for n in range(1, k + 1):
        best = rows.mapInArrow(_next_pick(taken._lexgraph_path, trade), "query_id long, doc_id long, score double, v array<double>")
        best = best.groupBy("query_id").agg(F.min_by(F.struct("doc_id", "v"), F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b"))
        # a query that found nothing has met all documents and asks no more
        taken = written(taken.join(best, "query_id").select("query_id", F.concat("done", F.array("b.doc_id")).alias("done"), F.concat("vs", "b.v").alias("vs")), "taken")
        picks = taken.select("query_id", F.element_at("done", n).alias("doc_id"), F.lit(n).alias("pick"))
        out = picks if out is None else out.union(picks)
    return out


def _next_pick(path: str, trade: float):
    """The best next document of each query in the table at path (query_id, ids taken, its vector and theirs in one array), for each held part."""

    def scores(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # of equal scores the first is that of the lower id
        ids, vectors = table.column(0).to_numpy(), table.column(1).combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for block in stored(path, BLOCK // 4):
            asked, picks = block.column(0).to_numpy(), len(block.column(1)[0])  # all have as many
            done = block.column(1).flatten().to_numpy().reshape(len(asked), picks)
            lengths = block.column(2).value_lengths().to_numpy() // (picks + 1)
            all_of, firsts = block.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths[:-1] * (picks + 1))])
            for n in np.unique(lengths).tolist():
                here, who = np.flatnonzero(sizes == n), np.flatnonzero(lengths == n)
                if not len(here):
                    continue
                vs = all_of[(firsts[who][:, None] + np.arange(n * (picks + 1))).ravel()].reshape(len(who), picks + 1, n)
                best, at = np.full(len(who), -np.inf), np.zeros(len(who), np.int64)
                for start in range(0, len(here), 2048):
                    part = here[start : start + 2048]
                    x = flat[(starts[part][:, None] + np.arange(n)).ravel()].reshape(len(part), n)
                    score = vs[:, 0] @ x.T
                    if picks:
                        worst = vs[:, 1] @ x.T
                        for p in range(2, picks + 1):
                            np.maximum(worst, vs[:, p] @ x.T, out=worst)
                        score = trade * score - (1 - trade) * worst
                    score = np.round(score, 9)
                    score[np.isnan(score)] = -np.inf
                    low, high = (np.searchsorted(ids[part], done[who], side) for side in ("left", "right"))
                    for q, p in zip(*np.nonzero(high > low), strict=True):
                        score[q, low[q, p] : high[q, p]] = -np.inf
                    top_of = score.argmax(axis=1)
                    found = score[np.arange(len(who)), top_of]
                    better = found > best
                    best[better], at[better] = found[better], part[top_of[better]]
                ok = np.flatnonzero(np.isfinite(best))
                chosen = pa.array(at[ok])
                yield pa.RecordBatch.from_arrays([pa.array(asked[who[ok]]), pa.array(ids[at[ok]]), pa.array(best[ok]), vectors.take(chosen)], ["query_id", "doc_id", "score", "v"])

    return _in_parts(scores)


def min_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each query's hits on the scale from 0 to 1; all 0 where they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(score, F.when(low == high, F.lit(0.0)).otherwise((F.col(score) - low) / (high - low + 1e-12)))


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    one = dense.select("query_id", "doc_id", F.col("score").alias("dense"))
    two = sparse.select("query_id", "doc_id", F.col("score").alias("sparse"))
    return one.join(two, ["query_id", "doc_id"], "full_outer")


def fuse_min_max(dense: DataFrame, sparse: DataFrame, alpha: float = 0.2, k: int = 6) -> DataFrame:
    """(1 - alpha) of the scaled dense score and alpha of the scaled sparse one; a missing side is 0."""
    both = _both(min_max(dense), min_max(sparse))
    return top(both.select("query_id", "doc_id", ((1 - alpha) * F.coalesce("dense", F.lit(0.0)) + alpha * F.coalesce("sparse", F.lit(0.0))).alias("score")), k)


def fuse_saturated(dense: DataFrame, sparse: DataFrame | None, bonus: Column | None = None, share: float = 0.7, k: int = 50, domains: DataFrame | None = None) -> DataFrame:
    """share of the dense score, a bonus on the dense side, and the rest of the saturated sparse score.

    domains is (query_id, doc_id, bonus) if the bonus depends on both. Without sparse scores the dense ones count whole.
    """
    if sparse is None:
        both, share = dense.select("query_id", "doc_id", F.col("score").alias("dense"), F.lit(None).cast("double").alias("sparse")), 1.0
    else:
        both = _both(dense, sparse)
    if domains is not None:
        both, bonus = both.join(domains, ["query_id", "doc_id"], "left"), F.coalesce("bonus", F.lit(0.0))
    extra = F.when(F.col("dense").isNotNull(), bonus if bonus is not None else F.lit(0.0)).otherwise(F.lit(0.0))
    score = share * F.coalesce("dense", F.lit(0.0)) + extra + (1 - share) * F.coalesce(saturate(F.col("sparse")), F.lit(0.0))
    return top(both.select("query_id", "doc_id", score.alias("score")), k, digits=9)


def gate(hits: DataFrame, dense: DataFrame, least: float = 0.25) -> DataFrame:
    """(query_id, ok, reason): whether the raw dense score of each query's first hit reaches `least`."""
    first = hits.where("rank = 1").select("query_id", "doc_id").join(dense.select("query_id", "doc_id", F.col("score").alias("raw")), ["query_id", "doc_id"], "left")
    raw = F.coalesce("raw", F.lit(0.0))
    return first.select("query_id", (raw >= least).alias("ok"), F.when(raw < least, F.concat(F.lit("low-dense="), F.format_string("%.3f", raw))).alias("reason"))


def mmr(candidates: DataFrame, k: int, trade: float = 0.65, start: str = "first") -> DataFrame:
    """Maximal marginal relevance over each query's candidates (query_id, doc_id, rank, query_vector, embedding).

    Starts with the candidate of rank 1, or with start='best' with the one closest to the query; then takes, k
    in all, the one with the best trade * relevance - (1 - trade) * likeness to what is taken. Ties go to the
    lower rank; a candidate without a vector is like nothing (0). A query's candidates must fit in memory: they
    are a top list.
    """

    def one(key, rows):
        rows = rows.sort_values(["rank", "doc_id"]).reset_index(drop=True)
        q = np.array(rows["query_vector"][0], np.float64)
        x = np.array([np.zeros(len(q)) if v is None else v for v in rows["embedding"]], np.float64)
        near = x @ q
        chosen = [0 if start == "first" else int(near.argmax())]
        worst = x @ x[chosen[0]]
        while len(chosen) < min(k, len(x)):
            score = trade * near - (1 - trade) * worst
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
            worst = np.maximum(worst, x @ x[chosen[-1]])
        out = rows.iloc[chosen][["query_id", "doc_id"]].copy()
        out["pick"] = range(1, len(chosen) + 1)
        return out

    return candidates.select("query_id", "doc_id", "rank", "query_vector", "embedding").groupBy("query_id").applyInPandas(one, "query_id long, doc_id long, pick int")
