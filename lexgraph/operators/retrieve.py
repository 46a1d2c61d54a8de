"""Whole retrievals: questions in, contexts out, all questions at once.

Tables: queries (query_id, query, query_vector), chunks (doc_id, id, text, source, extra, embedding) with
extra a struct of domain, articles, techniques and tactics, as domain_meta makes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.predicates import detect_domain, route
from ..functions.vectors import answer_score, token_overlap
from ..providers import reranked
from ..storage import written
from . import bm25, context, dense, law


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 50, tokenizer: str = "d", domain: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Fused hits of each query with a bonus for its domain, and the raw dense scores of all of them."""
    vectors = dense.search(chunks, queries, k)
    terms = bm25.query_terms(queries, tokenizer)
    lexical = bm25.top(bm25.okapi(bm25.Index.build(chunks, tokenizer=tokenizer), terms, most=k), k)
    kinds = chunks.select("doc_id", F.col("extra.domain").alias("_kind"))
    bonus = vectors.join(kinds, "doc_id").join(queries.select("query_id", F.col(domain).alias("_asked")), "query_id")
    bonus = bonus.select("query_id", "doc_id", F.when(F.col("_asked").isin("law", "mitre") & (F.col("_asked") == F.col("_kind")), 0.05).otherwise(0.0).alias("bonus"))
    hits = dense.fuse_saturated(vectors, lexical, k=k, domains=bonus)
    raw = hits.select("query_id", "doc_id").join(queries.select("query_id", "query_vector"), "query_id").join(chunks.select("doc_id", "embedding"), "doc_id")
    from ..functions.vectors import dot

    return hits, raw.select("query_id", "doc_id", dot(F.col("query_vector"), F.col("embedding")).alias("score"))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 3, candidates: int = 50, least: float = 0.25, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, route, ok, reason, context): route, hybrid search, gate on the first hit, optional reranking, diversification, headers with summaries.

    Where the gate is not passed the context is null and the reason says why; without candidates it is 'no-candidate'.
    """
    queries = queries.withColumn("domain", route("query"))
    hits, raw = hybrid(chunks, queries, candidates)
    gate = dense.gate(hits, raw, least)
    ranked = hits.join(gate.where("ok").select("query_id"), "query_id").join(chunks.select("doc_id", "text", "source", "extra", "embedding"), "doc_id").join(queries.select("query_id", "query", "query_vector"), "query_id")
    picks = dense.mmr(reranked(ranked, score), k)
    rows = picks.join(chunks.select("doc_id", "text", "source", "extra"), "doc_id")
    rows = rows.select("query_id", F.col("pick").alias("rank"), "text", context.header_of(F.col("extra"), F.col("source")).alias("header"), context.three_sentences(F.col("text")).alias("summary"))
    out = queries.select("query_id", F.col("domain").alias("route")).join(gate, "query_id", "left").join(context.headed(rows), "query_id", "left")
    return out.select("query_id", "route", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), "no-candidate").otherwise(F.col("reason")).alias("reason"), F.when(F.col("ok"), F.col("context")).alias("context"))


def dual(queries: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], way: str = "soft", options: Column | None = None) -> DataFrame:
    """Hits of two retrievers, tagged law and mitre in column side.

    'soft' asks both for every query; 'hard' asks the one of the query's domain (both if it is unknown), and the
    other where that one finds nothing.
    """
    asked = queries.withColumn("_domain", detect_domain("query", options))
    sides = {"law": first, "mitre": second}
    if way == "soft":
        parts = [fn(asked.drop("_domain")).withColumn("side", F.lit(name)) for name, fn in sides.items()]
        return parts[0].unionByName(parts[1])
    out = None
    for name, fn in sides.items():
        other = next(n for n in sides if n != name)
        mine = fn(asked.where(F.col("_domain").isin(name, "unknown")).drop("_domain"))
        missed = asked.where(F.col("_domain") == name).join(mine.select("query_id").distinct(), "query_id", "left_anti").drop("_domain")
        part = mine.withColumn("side", F.lit(name)).unionByName(sides[other](missed).withColumn("side", F.lit(other)))
        out = part if out is None else out.unionByName(part)
    return out


def best_answer(candidates: DataFrame, bonus: float = 0.1) -> DataFrame:
    """(query_id, side, answer): of candidate answers (query_id, side, query, context, answer, preferred) the one with the best score."""
    overlap = token_overlap(F.regexp_extract_all("query", F.lit("[가-힣A-Za-z0-9]+"), F.lit(0)), F.regexp_extract_all("context", F.lit("[가-힣A-Za-z0-9]+"), F.lit(0)))
    scored = candidates.withColumn("_s", answer_score(overlap, F.length("answer"), F.col("preferred"), bonus))
    return scored.groupBy("query_id").agg(F.max_by(F.struct("side", "answer"), F.struct(F.col("_s"), F.col("side"))).alias("b")).select("query_id", "b.side", "b.answer")


def best_choice(candidates: DataFrame, bonus: float = 0.05) -> DataFrame:
    """(query_id, side, answer): of multiple-choice answers (query_id, side, answer, confidence, overlap) the one with the most confidence and a share of the overlap."""
    total = F.col("confidence") + bonus * F.col("overlap")
    return candidates.groupBy("query_id").agg(F.max_by(F.struct("side", "answer"), F.struct(total, F.col("side"))).alias("b")).select("query_id", "b.side", "b.answer")


def once_per_query(queries: DataFrame, search: Callable[[DataFrame], DataFrame], text_col: str = "query") -> DataFrame:
    """Search results with each distinct text asked once, and given to every query that has it."""
    first = queries.groupBy(text_col).agg(F.min("query_id").alias("_first"))
    asked = queries.join(first, (queries["query_id"] == first["_first"])).drop(first[text_col]).drop("_first")
    found = search(asked).withColumnRenamed("query_id", "_first")
    owners = queries.select("query_id", text_col).join(first, text_col).select("query_id", "_first")
    return owners.join(found, "_first").drop("_first")


def graph_seeds(nodes: DataFrame, queries: DataFrame, k: int = 3, tokenizer: str = "a", encoder=None) -> DataFrame:
    """(query_id, id, rank): the best nodes (id, title, text) of each query, lexically, or by vectors if an encoder is given."""
    rows = nodes.select("id", F.concat_ws("\n", "title", "text").alias("text"), F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 15), 16, 10).cast("long").alias("doc_id"))
    if encoder is None:
        hits = bm25.top(bm25.okapi(bm25.Index.build(rows, tokenizer=tokenizer), bm25.query_terms(queries, tokenizer), most=k), k)
    else:
        hits = dense.search(rows.select("doc_id", encoder(F.col("text")).alias("embedding")), queries.select("query_id", encoder(F.col("query")).alias("query_vector")), k)
    return hits.join(rows.select("doc_id", "id"), "doc_id").select("query_id", "id", "rank")


def graph_query(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 3, hops: int = 1, most: int = 5, chars: int = 120, tokenizer: str = "a", encoder=None) -> DataFrame:
    """(query_id, place, id, hop, title, summary): seeds and what they cite or are cited by, in order of hop, seed's rank and id."""
    seeds = written(graph_seeds(nodes, queries, k, tokenizer, encoder), "ranked-seeds")  # read twice, searched once
    around = law.expand(edges, seeds, hops).join(seeds, ["query_id", "id"], "left")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("hop", F.coalesce("rank", F.lit(1 << 30)), "id")
    rows = around.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).join(nodes.select("id", "title", "text"), "id")
    return rows.select("query_id", "place", "id", "hop", "title", T.truncate("text", chars).alias("summary"))


def graph_context(found: DataFrame) -> DataFrame:
    """(query_id, context) of graph_query's rows: a guide and the nodes in order."""
    return context.joined(found, F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("summary")), guide=fixed.GUIDE_REFERENCE + "\n\n", order="place")
