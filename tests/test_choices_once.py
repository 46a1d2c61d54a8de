"""Choice questions whose rows and options are computed once."""

from lexgraph.functions import text as T
from lexgraph.operators import records
from pyspark.sql import functions as F


def test_rows_to_place_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def options(k):
        seen.add(1)
        return 3 + k % 2

    df = spark.range(200).select(F.col("id").alias("k"), options("id").alias("n"))
    got = {r.k: r.position for r in records.balanced_position(df, "n", "k").collect()}
    assert got == {k: k // 2 % (3 + k % 2) + 1 for k in range(200)}
    assert seen.value == 200


def test_options_of_a_choice_are_computed_once(spark):
    df = spark.createDataFrame([("Q", "r", ["a", "b", "a"]), ("Q", "r", ["r", "b"]), ("Q", "r", [])], "q string, r string, w array<string>")
    out = df.select(records.choice_record(F.col("q"), F.col("r"), F.col("w"), F.lit(2)).alias("m"))
    assert [(r.m[1].content, r.m[2].content) for r in out.collect()] == [("Q\n1) a\n2) r\n3) b\n정답:", "2"), ("Q\n1) b\n2) r\n정답:", "2"), ("Q\n1) r\n정답:", "1")]
    assert out._jdf.queryExecution().analyzed().toString().count("array_distinct") == 1
    cut = df.select(T.crop("q", F.lit(1)))._jdf.queryExecution().analyzed().toString()
    assert cut.count("split(") == df.select(T.sentences(T.collapse(F.col("q")), law=True))._jdf.queryExecution().analyzed().toString().count("split(")


def test_no_noise_leaves_texts_alone(spark):
    df = spark.createDataFrame([("그리고  은 는 ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.surface_noise("t", F.lit(1), 0.0)).collect()] == ["그리고  은 는 ", ""]
