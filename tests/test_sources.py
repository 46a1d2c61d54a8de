import gzip
import json
import zipfile

import pytest
from lexgraph.register import register
from lexgraph.sources import readers as R
from lexgraph.sources import writers as W
from lexgraph.streaming import ingest
from pyspark.sql import functions as F


def test_text_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("가\r\n나".encode())
    (tmp_path / "b.txt").write_bytes("법령".encode("cp949"))
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "d.md").write_text("no")
    by = lambda e: {r.file: r.text for r in R.text_files(spark, str(tmp_path), encoding=e).collect()}
    assert by("ignore")["a b.txt"] == "가\n나" and by("fallback")["b.txt"] == "법령" and by("bom")["c.txt"] == "x" and len(by("ignore")) == 3
    with pytest.raises(Exception, match="(?i)utf"):
        by("strict")
    (tmp_path / "e.jsonl").write_text("{}")
    assert [r.file for r in R.mixed_sources(spark, str(tmp_path)).collect()] == ["a b.txt", "b.txt", "c.txt", "e.jsonl"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\nbroken\n{"a":2}\n')
    assert sorted(r.a for r in R.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        R.json_lines(spark, str(p), "a int", "strict").collect()
    assert R.json_lines(spark, str(tmp_path / "none"), "a int", missing_ok=True).collect() == []
    assert R.count_lines(spark, str(p)) == 3 and R.count_lines(spark, str(tmp_path / "none")) == 0 and R.first_record(spark, str(p), "a int").count() == 1


def test_nested_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "law": "L"}], "edges": [{"src": "a", "dst": "b"}]}))
    nodes, edges = R.graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().law == "L" and edges.first().relation == "참조"
    (tmp_path / "s.json").write_text(json.dumps({"objects": [{"type": "attack-pattern", "name": "n", "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "p"}]}]}))
    assert R.attack_objects(spark, str(tmp_path / "s.json")).first().kill_chain_phases[0].phase_name == "p"
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"paragraphs": [{"qas": [{"id": "1", "answers": [{"text": "x"}, {"text": "y"}]}]}]}, {"qas": [{"id": "2", "answer": {"text": "z"}}]}]}))
    assert {r.id: r.answers for r in R.squad(spark, str(tmp_path / "q.json")).collect()} == {"1": ["x", "y"], "2": ["z"]}
    (tmp_path / "q.csv").write_text('ID,Question\n1,"Q?\n1 ""a""\n2 b"\n')
    assert R.questions(spark, str(tmp_path / "q.csv")).first().Question == 'Q?\n1 "a"\n2 b'


def test_columns_are_guessed():
    assert R.question_column(["x", "prompt"]) == "prompt" and R.question_column(["x"]) == "x"
    assert R.question_and_options(["id", "My Question", "option10", "option2", "보기"]) == ("My Question", ["option2", "option10", "보기"])


@pytest.mark.parametrize(("name", "body", "want"), [
    ("a.json", '[{"text":"x","title":"T"},{"body":"y"},"plain"]', [("T", "x"), (None, "y"), (None, "plain")]), ("b.json", '{"items":[{"content":"x"}]}', [(None, "x")]), ("c.json", '{"text":"only","name":"N"}', [("N", "only")]),
    ("d.jsonl", '{"text":"x"}\n\n{"doc":"y"}\n', [(None, "x"), (None, "y")]), ("e.txt", "l1\n\nl2", [(None, "l1"), (None, "l2")]),
])
def test_meta_in_any_form(spark, tmp_path, name, body, want):
    (tmp_path / name).write_text(body)
    with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
        f.write(body)
    for p in (name, f"{name}.gz"):
        assert [(r.title, r.text) for r in R.meta_rows(spark, str(tmp_path / p)).orderBy("ord").collect()] == want


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert {r.file: r.text for r in R.docx_files(spark, str(tmp_path)).collect()} == {"a.docx": "One two\nthree", "b.docx": None}


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "o")
    df = spark.createDataFrame([(1, "가"), (2, "b")], "id int, text string")
    W.json_lines(df, out)
    assert "가" in "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    W.concat_lines(spark, [out, str(tmp_path / "none")], str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 2
    assert W.append_new(df, str(tmp_path / "n")) == 2 and W.append_new(df.union(df).union(spark.createDataFrame([(3, "c")], "id int, text string")), str(tmp_path / "n")) == 1
    calls = []
    build = lambda: calls.append(1) or df
    assert W.build_once(spark, str(tmp_path / "b"), build).count() == W.build_once(spark, str(tmp_path / "b"), build).count() == 2 and calls == [1]
    chunks = df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    assert W.vector_index(chunks, str(tmp_path / "v"), "m", 900, 200).first().embed_dim == 2
    assert R.vector_index(spark, str(tmp_path / "v/chunks"), 2).count() == 2
    with pytest.raises(Exception, match="expected 3 numbers"):
        R.vector_index(spark, str(tmp_path / "v/chunks"), 3).collect()
    W.terms(spark.createDataFrame([("t", 'd "q"')], "term string, definition string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t/csv"), header=True, escape='"').first().definition == 'd "q"' and spark.read.text(str(tmp_path / "t/txt")).first().value == 't / d "q"'
    W.graph(df, df, str(tmp_path / "g"))
    W.submission(spark.createDataFrame([("T1", None)], "ID string, Answer string"), str(tmp_path / "s"))
    W.token_lines(df, F.split("text", " "), str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().ID == "T1" and spark.read.text(str(tmp_path / "l")).count() == 2


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a.txt", 1000), ("b.txt", 10)):
        (folder / name).write_text("x" * n)
        ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    ids = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ids == ["a.txt:::0", "a.txt:::1", "b.txt:::0"]


def test_registered_functions(spark):
    assert "lex_nfkc" in register(spark) and spark.sql("SELECT lex_nfkc('Ａ')").first()[0] == "A"


def test_small_tables_are_dealt_to_all_cores(spark):
    from lexgraph.session import spread

    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(50)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many).rdd.getNumPartitions() == 50
    assert spread(one).count() == 100


def test_table_functions(spark):
    """The same rows as the column functions; nothing of an empty text; a range without bound stands for its ends."""
    from lexgraph.functions import text as T
    from lexgraph.operators import law

    register(spark)
    texts = ["", None, "x" * 40, "제5조의2 및 제 7 조 제2항, 제12조부터 제9조까지", "제1조부터 제99999999999999999999999조까지", "제3조, 제3조", "없음"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = spark.sql("SELECT id, c.start, c.end, c.text FROM {df}, LATERAL lex_chunks(t, 12, 4) c", df=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.selectExpr("id", "t").select("id", F.inline(T.chunks("t", 12, 4))).collect()))
    cited = spark.sql("SELECT id, c.article FROM {df}, LATERAL lex_citations(t) c", df=df).collect()
    assert sorted(map(tuple, cited)) == sorted(map(tuple, df.select("id", F.explode(law.reference_keys("t"))).collect())) and len(cited) > 6


def test_a_late_matrix_file_is_as_short_as_its_part():
    import io

    import numpy as np
    import pandas as pd
    from lexgraph.plans.exchange import _compressed_rows

    part = pd.DataFrame({"r": [4_000_150, 4_000_003], "e": [[{"col": 5, "tf": 2}], [{"col": 1, "tf": 1}, {"col": 7, "tf": 3}]]})
    with np.load(io.BytesIO(_compressed_rows(part, 4_000_000))) as found:
        assert len(found["indptr"]) == 152 and found["indices"].tolist() == [1, 7, 5] and found["data"].tolist() == [1, 3, 2]
        assert np.flatnonzero(np.diff(found["indptr"])).tolist() == [3, 150]
