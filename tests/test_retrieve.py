from lexgraph import providers
from lexgraph.functions import structs
from lexgraph.functions import text as T
from lexgraph.functions.predicates import domain_meta
from lexgraph.operators import bm25, records, retrieve
from lexgraph.sources.readers import stopwords
from pyspark.sql import functions as F

ENCODE = providers.hashed_encoder(32)
TEXTS = [(0, "개인정보보호법 제15조 수집 이용 동의 개인정보"), (1, "T1059 command and scripting interpreter 기법"), (2, "개인정보 제3자 제공 동의 법"), (3, "weather report of the day")]


def tables(spark):
    chunks = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"id": F.col("doc_id").cast("string"), "source": F.lit("d/f.txt"), "extra": domain_meta("text"), "embedding": ENCODE(F.col("text"))})
    queries = spark.createDataFrame([(1, "개인정보 수집 동의 제15조"), (2, "T1059 command"), (3, "zzz yyy xxx")], "query_id long, query string").withColumn("query_vector", ENCODE(F.col("query")))
    return chunks, queries


def test_retrieve(spark):
    chunks, queries = tables(spark)
    got = {r.query_id: r for r in retrieve.retrieve(chunks, queries, k=2, candidates=4).collect()}
    assert got[1].ok and got[1].route == "law" and "[LAW] 제15조 | f.txt" in got[1].context and "수집 이용" in got[1].context
    assert got[2].ok and got[2].route == "mitre" and "[ATT&CK]" in got[2].context
    assert not got[3].ok and got[3].reason.startswith("low-dense=") and got[3].context is None


def test_dual_and_picks(spark):
    queries = spark.createDataFrame([(1, "시행령"), (2, "T1059"), (3, "hello")], "query_id long, query string")
    law = lambda q: q.where("query_id <> 1").select("query_id", F.lit("L").alias("x"))
    mitre = lambda q: q.select("query_id", F.lit("M").alias("x"))
    hard = sorted((r.query_id, r.side, r.x) for r in retrieve.dual(queries, law, mitre, "hard").collect())
    assert hard == [(1, "mitre", "M"), (2, "mitre", "M"), (3, "law", "L"), (3, "mitre", "M")]
    assert retrieve.dual(queries, law, mitre).count() == 5
    cands = spark.createDataFrame([(1, "law", "a b", "a b", "x", True), (1, "mitre", "a b", "c", "xy", False)], "query_id long, side string, query string, context string, answer string, preferred boolean")
    assert tuple(retrieve.best_answer(cands).first()) == (1, "law", "x")
    choice = spark.createDataFrame([(1, "law", "2", 0.5, 0.0), (1, "mitre", "3", 0.48, 1.0)], "query_id long, side string, answer string, confidence double, overlap double")
    assert retrieve.best_choice(choice).first().answer == "3"
    seen = []
    again = spark.createDataFrame([(1, "q"), (2, "q"), (3, "p")], "query_id long, query string")
    out = retrieve.once_per_query(again, lambda q: seen.append(q.count()) or q.select("query_id", F.upper("query").alias("hit")))
    assert seen == [2] and sorted(map(tuple, out.collect())) == [(1, "Q"), (2, "Q"), (3, "P")]


def test_graph_query(spark):
    nodes = spark.createDataFrame([("a", "제1조", "목적 개인정보"), ("b", "제2조", "정의 동의"), ("c", "제3조", "벌칙")], "id string, title string, text string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string")
    queries = spark.createDataFrame([(1, "목적 개인정보")], "query_id long, query string")
    for encoder in (None, ENCODE):
        rows = retrieve.graph_query(nodes, edges, queries, k=1, hops=2, encoder=encoder)
        assert [(r.id, r.hop) for r in rows.orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert retrieve.graph_context(rows).first().context.endswith("[제1조] 목적 개인정보\n\n[제2조] 정의 동의\n\n[제3조] 벌칙")


def test_strings_of_nested_rows(spark):
    df = spark.createDataFrame([(1, " a ", [("x ", ["y "])], {"k ": " v"}, None)], "n int, s string, a array<struct<p:string,q:array<string>>>, m map<string,string>, z struct<w:string>")
    row = structs.map_strings(df, T.strip).first()
    assert (row.n, row.s, row.a[0].p, row.a[0].q, row.m, row.z) == (1, "a", "x", ["y"], {"k ": "v"}, None)
    assert len(spark.range(1).select(structs.run_stamp().alias("t")).first().t) == 15


def test_choice_records(spark):
    articles = spark.createDataFrame([("L", f"제{k}조", f"1. 항목 {k}가\n2. 항목 {k}나\n3. 항목 {k}다") for k in range(1, 6)] + [("L", "제9조", "짧다")], "law string, article string, body string")
    rows = records.law_choice_records(articles).collect()
    assert len(rows) == 5
    for r in rows:
        lines = r.messages[1].content.split("\n")
        odd = [x for x in lines[1:5] if f"항목 {r.article[1:-1]}" not in x]
        assert len(odd) == 1 and odd[0].startswith(r.messages[2].content + ")")
    terms = spark.createDataFrame([(k, f"t{k}", f"definition number {k} is here. And {k} more.") for k in range(30)], "doc_id long, term string, definition string")
    out = records.term_choice_records(terms).collect()
    assert len(out) == 30 and all(f"definition number {r.term[1:]} is" in r.messages[1].content.split("\n")[int(r.messages[2].content)] for r in out)
    ranked = bm25.neighbours(bm25.tfidf(terms.select("doc_id", F.concat_ws(" ", "term", "definition").alias("text"))), terms, 12)
    aug = records.augmented_choices(terms, ranked).collect()
    assert len(aug) == 120 and all(len(r.messages[1].content.split("\n")) == 6 for r in aug)
    assert len({r.messages[2].content for r in aug}) == 4


def test_stopword_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("foo\n\n bar \n")
    assert stopwords(spark, str(tmp_path / "s.txt"), ["x"]) == ["bar", "foo", "x"] and stopwords(spark, str(tmp_path / "no"), ["x"]) == ["x"]


def test_routed_retrieval_searches_documents_without_vectors(spark, tmp_path, monkeypatch):
    from lexgraph.operators import retrieve as r
    from lexgraph.plans import answers

    docs = [(1, "alpha beta", "s"), (2, "gamma delta", "s"), (3, "alpha epsilon", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "alpha epsilon"), (9, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, whole = [], r.retrieve
    monkeypatch.setattr(r, "retrieve", lambda chunks, queries, *a: seen.append((chunks, queries)) or whole(chunks, queries, *a))
    got = {x.query_id: x.ok for x in answers.retrieve_routed(spark, str(tmp_path)).collect()}
    assert got == {1: True, 9: False} and seen[0][0].count() == 3
    hits, _ = r.hybrid(seen[0][0], seen[0][1].withColumn("domain", seen[0][1]["query"]))
    assert (1, 3) in {(x.query_id, x.doc_id) for x in hits.collect()}


def test_seeds_of_a_graph_query_are_searched_once(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"title {i}", f"word{i % 3} text") for i in range(9)], "id string, title string, text string")
    edges = spark.createDataFrame([("n0", "n1"), ("n2", "n3")], "src string, dst string")
    queries = spark.createDataFrame([(1, "word1"), (2, "word2")], "query_id long, query string")
    found = retrieve.graph_query(nodes, edges, queries, 2, 1, 5)
    files = found.inputFiles()
    assert any("ranked-seeds" in f for f in files) and not any("-postings" in f for f in files)
    assert found.where("hop = 0").count() == 4
