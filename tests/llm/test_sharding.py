import hashlib
import zlib
from collections import Counter

from lexgraph.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, source string, shard string, _id string, _place string"


def test_law_slots_and_mixture(spark):
    rows = [(i if i % 50 else None, None if i % 31 == 0 else f"text {i % 400} é", None if i % 17 == 0 else f"s{min(i % 5, 2)}", "x", "x", "x") for i in range(4000)]
    rows += [rows[1]] * 500
    for bucket in (20_000, 37):
        got = assign_shards(spark.createDataFrame(rows, SCHEMA), 40, carry=("source",), bucket_rows=bucket).collect()
        counts = Counter(r.shard for r in got)
        assert len(got) == 4500 and set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
        for k in range(40):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
        whole = Counter(r.source for r in got)
        for k in range(40):
            for source, n in Counter(r.source for r in got if r.shard == k).items():
                assert abs(n - whole[source] * counts[k] / 4500) <= 2, (k, source)
        sizes = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got)
        assert sizes == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t, *_ in rows)


def brute(rows, n_shards, seed=17):
    marked = []
    for i, t, source, *_ in rows:
        data = (t or "").encode()
        hashed = int(hashlib.md5(f"{seed}|{'' if i is None else i}|".encode() + data).hexdigest()[:15], 16)
        marked.append(((source is not None, source or ""), (hashed, (i is not None, i or 0), zlib.crc32(data), len(data) + 16), i))
    totals, seen, order = Counter(m[0] for m in marked), Counter(), []
    for source, key, i in sorted(marked, key=lambda m: m[:2]):
        order.append(((seen[source] + 0.5) / totals[source], source, key, i))
        seen[source] += 1
    n, out = len(rows), []
    for place, (_, _, key, i) in enumerate(sorted(order, key=lambda o: o[:3])):
        shard = place * n_shards // n
        out.append((i, key[3], key[2], shard, place - -(-shard * n // n_shards)))
    return sorted(out, key=repr)


def test_against_brute_force_with_many_repeated_rows(spark):
    rows = [(i % 700 if i % 50 else None, None if i % 31 == 0 else f"text {i % 400} é", None if i % 17 == 0 else f"s{min(i % 5, 2)}", "x", "x", "x") for i in range(2000)]
    rows += [rows[1]] * 10_000
    got = assign_shards(spark.createDataFrame(rows, SCHEMA), 7, bucket_rows=100).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=repr) == brute(rows, 7)


def test_order_within_a_source_is_shuffled_and_stable(spark):
    rows = [(i, f"t{i}", "s", "x", "x", "x") for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = ({r.doc_id: (r.shard, r.slot) for r in assign_shards(d, 8).collect()} for d in (df, df.orderBy("text").repartition(5)))
    assert one == two and sum(one[i][0] == i // 100 for i in range(800)) < 300


def test_empty_and_small_tables(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    got = assign_shards(spark.createDataFrame([(1, None, None, "x", "x", "x")], SCHEMA)).collect()
    assert [(r.shard, r.slot, r.size, r.text_crc32) for r in got] == [(0, 0, 16, 0)]


def test_a_shard_is_written_by_several_tasks(spark, tmp_path):
    from lexgraph.llm.sharding import write_shards
    from pyspark.sql import functions as F

    rows = [(i, f"text {i}", f"s{i % 3}", "x", "x", "x") for i in range(4000)]
    docs, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "shards")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_shards(docs, path, 4, file_rows=100)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    back = spark.read.parquet(path)
    got = back.collect()
    assert sorted(r.doc_id for r in got) == list(range(4000)) and {r.shard for r in got} == {"x"}
    assert sorted((r.shard_, r.slot) for r in got) == [(k // 1000, k % 1000) for k in range(4000)]
    files = back.select("shard_", F.input_file_name().alias("f")).distinct().groupBy("shard_").agg(F.count("*").alias("n")).collect()
    assert len(files) == 4 and min(r.n for r in files) > 2
