import os

import pytest
from lexgraph.operators import bm25
from lexgraph.sources import readers
from lexgraph.streaming import ingest


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 7) for i in range(5000)]
    os.mkdir(tmp_path / "f")
    (tmp_path / "f" / "part-0.txt").write_text("\n".join(lines[:3200]) + "\n")
    (tmp_path / "f" / "part-1.txt").write_text("\n".join(lines[3200:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert [tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "f")).orderBy("line").collect()] == list(enumerate(lines))
        (tmp_path / "short").write_text("a\n\nc\n")
        (tmp_path / "same").write_text("\n".join(map(str, range(5000))))
        got = readers.zipped_lines(spark, {"a": str(tmp_path / "f"), "b": str(tmp_path / "same")}).collect()
        assert sorted((r.line, r.a, r.b) for r in got) == [(i, x, str(i)) for i, x in enumerate(lines)]
        padded = {r.line: (r.a, r.b) for r in readers.zipped_lines(spark, {"a": str(tmp_path / "f"), "b": str(tmp_path / "short")}, "pad").collect()}
        assert len(padded) == 5000 and [padded[i] for i in range(4)] == [(lines[0], "a"), (lines[1], ""), (lines[2], "c"), (lines[3], None)]
        with pytest.raises(ValueError, match="'a': 5000, 'b': 3"):
            readers.zipped_lines(spark, {"a": str(tmp_path / "f"), "b": str(tmp_path / "short")})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_once_by_key_over_restarts(spark, tmp_path):
    """Overlapping arrivals, and a stream that was stopped after its batch was written and before that was noted."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[1, 2, 2, None], [2, 3], [3, 4, None, 1]]
    for n, ids in enumerate(parts):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        ingest.once_by_key(stream, out, state).awaitTermination()
        if n == 1:
            last = max((p for p in os.listdir(f"{state}/commits") if p.isdigit()), key=int)
            os.remove(f"{state}/commits/{last}")
            crc = f"{state}/commits/.{last}.crc"
            if os.path.exists(crc):
                os.remove(crc)
            ingest.once_by_key(spark.readStream.schema("id long").parquet(source), out, state).awaitTermination()
        got = [r.id for r in spark.read.parquet(out).collect()]
        want = {i for p in parts[: n + 1] for i in p}
        assert len(got) == len(want) and set(got) == want


def test_questions_that_arrive_get_the_rows_of_the_batch_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "delta"), (4, None)], "doc_id long, text string")
    index = bm25.Index.build(docs)
    index.write(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "beta"), (3, "none of them")], "query_id long, query string")
    folders = [str(tmp_path / n) for n in ("in", "index", "out", "checkpoint")]
    for k in (1, 2, 3):
        asked.where(asked["query_id"] == k).coalesce(1).write.mode("append").json(folders[0])
        ingest.answered(spark, *folders, k=2).awaitTermination()
    ingest.answered(spark, *folders, k=2).awaitTermination()
    got = spark.read.parquet(folders[2]).select("query_id", "doc_id", "score", "rank").collect()
    want = bm25.top(bm25.positive(index, bm25.query_terms(asked)), 2).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
