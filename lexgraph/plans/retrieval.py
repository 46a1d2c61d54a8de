"""Search queries: lexical, dense, fused; the benchmark's items ask, and every twentieth vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, context, dense, nearest
from .registry import query, table

_LEX = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9]+') AS w FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) x GROUP BY term, doc_id),
s AS (SELECT doc_id, len(w) AS dl FROM d), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9]+')) AS term FROM benchmark) x GROUP BY ALL),
"""
_TOP = "ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)\n"
_OKAPI = _LEX + """raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, c),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id),
"""


def _asked(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, bm25.query_terms(queries)


@query(_OKAPI + _TOP + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_okapi_topk(spark, d):
    _, terms = _asked(spark, d)
    return bm25.top(bm25.okapi(bm25.Index.build(table(spark, d, "documents")), terms, most=5), 5)


@query(_LEX + """scored AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id), """ + _TOP + """
SELECT query_id, doc_id, score, rank, substring(text, 1, 80) AS head FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5 AND score > 0""")
def bm25_fallback_topk(spark, d):
    _, terms = _asked(spark, d)
    docs = table(spark, d, "documents")
    hits = bm25.top(bm25.positive(bm25.Index.build(docs, only=terms), terms, most=5), 5)
    return hits.join(docs.select("doc_id", F.substring("text", 1, 80).alias("head")), "doc_id").select("query_id", "doc_id", "score", "rank", "head")


@query(_LEX + """scored AS (SELECT query_id, doc_id, round(sum(qtf * greatest(0, (n - df + 0.5) / (df + 0.5)) * (tf / pow(dl, 0.25))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id), """ + _TOP + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 3 AND score > 0")
def bm25_simple_topk(spark, d):
    _, terms = _asked(spark, d)
    return bm25.top(bm25.simple(bm25.Index.build(table(spark, d, "documents"), only=terms), terms, most=3), 3)


@query(_LEX + """scored AS (SELECT query_id, doc_id, round(sum(tf / dl * ln((n - df + 0.5) / (df + 0.5) + 1)), 9) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id), """ + _TOP + "SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5 AND score > 0")
def sparse_weight_topk(spark, d):
    _, terms = _asked(spark, d)
    index = bm25.Index.build(table(spark, d, "documents"), only=terms)
    weights = index.postings.select("term", "doc_id", (F.col("tf") / F.col("dl")).alias("weight"))
    idf = index.term_stats.crossJoin(F.broadcast(index.corpus)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return bm25.top(bm25.weighted(index, terms, weights, idf), 5, digits=9)


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"""
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE {{which}}) x) y WHERE rank <= {{k}})"""


def _vectors(spark, d, every: int | None = 20):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0) if every else rows.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")
    return rows, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("WITH" + _DENSE.format(which="a.vec_id % 20 = 0", k=6) + " SELECT query_id, doc_id, score, rank FROM dense")
def dense_cosine_topk(spark, d):
    rows, asked = _vectors(spark, d)
    return dense.search(rows, asked, 6, id_col="vec_id")


@query("WITH" + _DENSE.format(which="a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id", k=50) + """
SELECT query_id, score >= 0.25 AS ok, CASE WHEN score < 0.25 THEN 'low-dense=' || printf('%.3f', score) END AS reason FROM dense WHERE rank = 1""")
def dense_gate(spark, d):
    rows, asked = _vectors(spark, d)
    hits = bm25.top(dense.search(rows, asked, 51, id_col="vec_id").drop("rank").where("query_id <> doc_id"), 50)
    return dense.gate(hits, hits)


_FUSED = _OKAPI.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + _TOP.rstrip() + ",\nsparse AS (SELECT * FROM ranked WHERE rank <= {k}), " + _DENSE.format(which="a.vec_id IN (SELECT item_id FROM benchmark)", k="{k}") + ",\n"


def _sides(spark, d, k: int):
    """Dense and lexical hits of the benchmark's items; documents and vectors, and items and vectors, are paired by id, as nothing else pairs them."""
    rows, asked = _vectors(spark, d, None)
    _, terms = _asked(spark, d)
    lexical = bm25.top(bm25.okapi(bm25.Index.build(table(spark, d, "documents")), terms, most=k), k)
    return dense.search(rows, asked, k, id_col="vec_id"), lexical, rows, asked


@query(_FUSED.format(k=24) + """
nd AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) END AS s FROM dense WINDOW w AS (PARTITION BY query_id)),
ns AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) END AS s FROM sparse WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, round(0.8 * coalesce(nd.s, 0) + 0.2 * coalesce(ns.s, 0), 6) AS score FROM nd FULL JOIN ns USING (query_id, doc_id))
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) z WHERE rank <= 6""")
def fusion_minmax(spark, d):
    vectors, lexical, _, _ = _sides(spark, d, 24)
    return dense.fuse_min_max(vectors, lexical, 0.2, 6)


@query(_FUSED.format(k=50) + """
f AS (SELECT query_id, doc_id, round(0.7 * coalesce(d.score, 0) + CASE WHEN d.score IS NOT NULL AND doc_id % 3 = 0 THEN 0.05 ELSE 0 END + 0.3 * coalesce(s.score / (s.score + 10), 0), 9) AS score
  FROM dense d FULL JOIN sparse s USING (query_id, doc_id))
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) z WHERE rank <= 50""")
def fusion_saturation(spark, d):
    """Every third document counts as of the query's domain."""
    vectors, lexical, _, _ = _sides(spark, d, 50)
    return dense.fuse_saturated(vectors, lexical, F.when(F.col("doc_id") % 3 == 0, 0.05).otherwise(0.0))


@query(_LEX + """scored AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN s USING (doc_id), c GROUP BY query_id, doc_id), """ + _TOP + """,
lines AS (SELECT query_id, rank, '[' || rank || '] (' || source || ':0-' || length(text) || ')' || chr(10) || text AS l FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 AND score > 0)
SELECT query_id, md5(string_agg(l, chr(10) || chr(10) ORDER BY rank)) AS context FROM lines GROUP BY query_id""".replace("\n,", ","))
def context_block(spark, d):
    _, terms = _asked(spark, d)
    docs = table(spark, d, "documents")
    hits = bm25.top(bm25.positive(bm25.Index.build(docs, only=terms), terms, most=3), 3)
    rows = hits.join(docs.select("doc_id", "text", "source", F.lit(0).alias("start"), F.length("text").alias("end")), "doc_id")
    return context.passages(rows).select("query_id", F.md5(F.col("context").cast("binary")).alias("context"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}') AS w FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) x GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (term), n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM v),
s AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.term = b.term WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) z WHERE rank <= 10""")
def tfidf_neighbors(spark, d):
    docs = table(spark, d, "documents")
    return nearest.neighbours(docs, docs.where(F.col("doc_id") % 20 == 0).select("doc_id"), 10)


@query("""
SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE text || chr(10) || '1 b' || chr(10) || '2 a' || chr(10) || '1 b' || chr(10) || '2 a' END AS enriched FROM benchmark""")
def query_enrich(spark, d):
    q = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n1 b\n2 a")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.enrich_query(q).alias("enriched"))
