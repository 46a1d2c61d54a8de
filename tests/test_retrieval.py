import numpy as np
import pytest
from lexgraph import providers
from lexgraph.operators import bm25, context, dense
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "c c d e")], "doc_id long, text string")
    return bm25.Index.build(docs)


@pytest.fixture(scope="module")
def terms(spark):
    return bm25.query_terms(spark.createDataFrame([(1, "a b b")], "query_id long, query string"))


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def test_idf(index):
    got = {r.term: round(r.idf, 6) for r in bm25.okapi_idf(index).collect()}
    assert got["a"] == got["d"] == got["e"] == 0.510826 and got["b"] == got["c"] == round(0.25 * 0.102165, 6)


def test_scores(index, terms):
    assert scores(bm25.okapi(index, terms)) == {0: 0.780833, 1: 0.060097}
    assert scores(bm25.positive(index, terms)) == {0: 1.871188, 1: 0.552945}
    assert scores(bm25.simple(index, terms)) == {0: 3.444588, 1: 1.009076}
    filled = bm25.zero_filled(bm25.okapi(index, terms), terms, index.doc_stats, 3)
    assert [(r.doc_id, r.rank) for r in bm25.top(filled, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_only_the_terms_asked_for(spark, index, terms):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "c c d e")], "doc_id long, text string")
    small = bm25.Index.build(docs, only=terms)
    assert small.postings.count() == 3 and scores(bm25.positive(small, terms)) == scores(bm25.positive(index, terms))


def test_written_index(spark, index, terms, tmp_path):
    index.write(str(tmp_path / "i"))
    assert scores(bm25.okapi(bm25.Index.read(spark, str(tmp_path / "i")), terms)) == {0: 0.780833, 1: 0.060097}


def hits(spark, pairs):
    return spark.createDataFrame([(1, d, s) for d, s in pairs], "query_id long, doc_id long, score double")


def test_fusion(spark):
    vec, lex = hits(spark, [(1, 0.9), (2, 0.5), (3, 0.4)]), hits(spark, [(2, 8.0), (4, 2.0)])
    assert {r.doc_id: round(r.score, 6) for r in dense.fuse_min_max(vec, lex).collect()} == {1: 0.8, 2: 0.36, 3: 0.0, 4: 0.0}
    assert {r.doc_id: round(r.score, 6) for r in dense.fuse_saturated(vec, lex).collect()} == {1: 0.63, 2: 0.483333, 3: 0.28, 4: 0.05}
    assert {r.doc_id: r.score for r in dense.fuse_saturated(vec, None).collect()} == {1: 0.9, 2: 0.5, 3: 0.4}
    for alpha, order in ((0.0, [1, 2]), (1.0, [2])):
        ranked = [r.doc_id for r in dense.fuse_min_max(vec, lex, alpha).orderBy("rank").collect()]
        assert ranked[: len(order)] == order
    gate = dense.gate(bm25.top(vec, 3), vec, 0.95).first()
    assert not gate.ok and gate.reason == "low-dense=0.900"


def test_fallback(spark):
    one, two = hits(spark, [(1, 1.0)]), hits(spark, [(2, 2.0)]).union(spark.createDataFrame([(9, 3, 1.0)], "query_id long, doc_id long, score double"))
    assert sorted((r.query_id, r.doc_id) for r in bm25.with_fallback(one, two).collect()) == [(1, 1), (9, 3)]


@pytest.mark.parametrize(("trade", "want"), [(0.65, [0, 1]), (0.3, [0, 2]), (1.0, [0, 1])])
def test_mmr(spark, trade, want):
    rows = [(1, k, k + 1, [1.0, 0.0], v) for k, v in enumerate([[1.0, 0.0], [0.96, 0.28], [0.6, 0.8]])]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, query_vector array<double>, embedding array<double>")
    for start in ("first", "best"):
        assert [r.doc_id for r in dense.mmr(df, 2, trade, start).orderBy("pick").collect()] == want


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0])], "doc_id long, embedding array<double>")
    asked = docs.where("doc_id < 30").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = {q: sorted(range(300), key=lambda k: (-round(float(x[q] @ x[k]), 6), k))[:5] for q in range(30)}
    for size in (4096, 7):
        monkeypatch.setattr(dense, "BLOCK", size)
        got = {}
        for r in dense.search(docs, asked, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == want
    assert dense.search(docs.limit(0), asked, 5).count() == 0 and dense.search(docs, asked.limit(0), 5).count() == 0


def test_contexts(spark):
    df = spark.createDataFrame([(1, 2, "b\nc", "x/f.txt", -1, -1, "T", "", "H"), (1, 1, "a. d. e.", "g.txt", 0, 8, "", "sn", "")], "query_id long, rank int, text string, source string, start int, end int, title string, snippet string, header string")
    df = df.withColumns({"summary": F.lit(""), "file": F.col("source"), "chunk_id": F.lit(3)})
    one = lambda d: d.first().context
    assert one(context.passages(df)) == "[1] (g.txt:0-8)\na. d. e.\n\n[2] (f.txt)\nb\nc"
    assert one(context.snippets(df)).endswith("\n\n(#1) [g.txt:0-8]\nsn\n\n(#2) [f.txt]\nb c")
    assert one(context.titled(df)).endswith("(#1)  a. d. e.\n\n(#2) [T] b\nc") and one(context.headed(df)).endswith("[REF]\na. d. e.\n\nH\nb c")
    assert one(context.bulleted(df)) == "- a. d.\n- b\nc" and one(context.chunked(df, 10)).endswith("\n…(생략)") and one(context.numbered(df)).startswith("1) g.txt\n")
    m = spark.createDataFrame([([("user", "q")], "ctx"), ([("user", "q")], "")], "m array<struct<role:string,content:string>>, c string")
    got = m.select(*(context.inject(F.col("m"), F.col("c"), way).alias(way) for way in ("system", "user", "prefix"))).collect()
    assert [x.role for x in got[0].system] == ["system", "user"] and got[0].user[0].content == "[참고문맥]\nctx" and got[0].prefix[0].content.endswith("ctx\n\nq") and len(got[1].system) == 1


def test_stand_ins(spark):
    df = spark.createDataFrame([("a c",), ("",), (None,)], "t string")
    vectors = [r.v for r in df.select(providers.hashed_encoder(64)(F.col("t")).alias("v")).collect()]
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-6 and vectors[1] == [0.0] * 64
    assert df.select(providers.prefixed(F.col("t"), "query").alias("p")).first().p == "query: a c"
    assert [r.answer for r in providers.generated(df, "t", lambda ps: [p.upper() for p in ps], 2).collect()] == ["A C", "", ""]

    def fails(texts):
        raise RuntimeError

    assert [r.x for r in df.select(providers.translated(F.col("t"), fails).alias("x")).collect()] == ["a c", "", None]
    cands = spark.createDataFrame([(1, 1, 1, "q", "x"), (1, 2, 2, "q", "xx")], "query_id long, doc_id long, rank int, query string, text string")
    assert [r.doc_id for r in providers.reranked(cands, lambda q, t: F.length(t)).orderBy("rank").collect()] == [2, 1] and providers.reranked(cands) is cands


def test_tfidf(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "aa bb"), (2, "cc dd"), (3, None)], "doc_id long, text string")
    got = bm25.neighbours(bm25.tfidf(docs), docs, 5).collect()
    assert sorted((r.query_id, r.doc_id, r.score) for r in got) == [(0, 1, 1.0), (1, 0, 1.0)]


def test_blocked_search_of_two_tables(spark, monkeypatch):
    """Blocks and held parts smaller than the tables, vectors of two lengths, nulls; a plan of one size, no query on the driver."""
    import numpy as np

    rnd = np.random.default_rng(2)
    docs = [(i, None if i % 17 == 0 else rnd.integers(-3, 4, 3 if i % 5 else 2).astype(float).tolist()) for i in range(300)]
    asked = [(i, None if i % 11 == 0 else rnd.integers(-3, 4, 3 if i % 4 else 2).astype(float).tolist()) for i in range(200)]
    frames = spark.createDataFrame(docs, "doc_id long, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    want = []
    for q, v in asked:
        near = sorted((-float(np.dot(v, x)), i) for i, x in docs if v and x and len(x) == len(v))[:4]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(near, 1)]
    for block, held in ((4096, 64 << 20), (7, 500)):
        monkeypatch.setattr(dense, "BLOCK", block)
        monkeypatch.setattr(dense, "HELD", held)
        got = dense.search(*frames, 4)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    few, many = (spark.range(n).selectExpr("id AS query_id", "array(1D, double(id)) AS query_vector") for n in (1, 1_000_000))
    plans = [dense.search(spark.range(10).selectExpr("id AS doc_id", "array(1D, 2D) AS embedding"), q, 1)._jdf.queryExecution().optimizedPlan().toString() for q in (few, many)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert dense.search(frames[0], frames[1].limit(0), 3).collect() == [] and dense.search(frames[0].limit(0), frames[1], 3).collect() == []
