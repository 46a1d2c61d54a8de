from lexgraph.functions import fixed
from lexgraph.operators import blocks, corpus, evaluate, records
from pyspark.sql import functions as F


def test_character_scores(spark):
    q = spark.createDataFrame([("a", ["전자금융거래", "x"]), ("b", ["xyz"]), ("c", ["abb"]), ("d", ["q"]), ("e", ["A b!"]), ("f", None)], "id string, answers array<string>")
    p = spark.createDataFrame([("a", "전자 금융"), ("b", "abc"), ("c", "aab"), ("e", "a  B"), ("f", "x")], "id string, prediction string")
    got = {r.id: (r.exact_match, round(r.f1, 6)) for r in evaluate.scores(q, p).collect()}
    assert got == {"a": (0.0, 0.8), "b": (0.0, 0.0), "c": (0.0, 0.666667), "d": (0.0, 0.0), "e": (1.0, 1.0), "f": (0.0, 0.0)}
    total = evaluate.evaluate(q, p).first()
    assert total.n == 6 and abs(total.exact_match - 100 / 6) < 1e-9
    assert tuple(evaluate.evaluate(q.limit(0), p).first()) == (0, 0.0, 0.0)


def test_perplexity(spark):
    row = evaluate.perplexity(spark.createDataFrame([(1.0, 10, 2.0), (3.0, 30, 2.0)], "loss double, tokens int, seconds double")).first()
    assert row.loss == 2 and abs(row.perplexity - 7.389056) < 1e-5 and row.tokens_per_second == 10


def test_prompts_and_conversions(spark):
    df = spark.createDataFrame([("Q?\n1 a\n2 b",), ("Why?",)], "t string").select(records.prompt("t").alias("m")).collect()
    assert df[0].m[0].content == fixed.SYSTEM_CHOICE and df[0].m[1].content.endswith("질문: Q?\n선택지:\n1 a\n2 b\n\n답변:") and df[1].m[1].content.endswith("질문: Why?\n\n답변:")
    rows = records.convert(spark.createDataFrame([("i", "n", " o ", 7), ("", "n", None, 8), ("i", None, "o", 9)], "instruction string, input string, output string, keep int")).collect()
    assert [(r.keep, [m.content for m in r.messages][1:]) for r in rows] == [(7, ["i\nn", "o"]), (8, ["n", ""]), (9, ["i", "o"])]
    have = spark.createDataFrame([([("user", " x "), ("", "y")], "i")], "messages array<struct<role:string,content:string>>, instruction string")
    assert [tuple(m) for m in records.convert(have).first().messages] == [("user", "x")]
    assert [records.schema_of(c) for c in (["messages"], ["conversations"], ["instruction", "output"], ["prompt", "completion"], ["x"])] == ["messages", "conversations", "alpaca", "prompt_completion", "messages"]
    seed = spark.createDataFrame([("MCQ", "Q", "1 a|2 b", "1"), ("open", "Q", "x", "y")], "type string, question string, options string, answer string").select(records.seed_messages(F.col("type"), F.col("question"), F.col("options"), F.col("answer")).alias("m")).collect()
    assert [r.m[0].content for r in seed] == ["Q\n1 a|2 b", "Q"]
    full = spark.createDataFrame([("Q", "a", None, "c")], "q string, o1 string, o2 string, o3 string").select(records.full_question(F.col("q"), [F.col("o1"), F.col("o2"), F.col("o3")]).alias("x")).first().x
    assert full == "Q\n1 a\n3 c"


def test_label_balance_and_choice(spark):
    df = spark.createDataFrame([(k, 4) for k in range(6)], "ord int, n int")
    assert [r.position for r in records.balanced_position(df, "n", "ord").orderBy("ord").collect()] == [1, 2, 3, 4, 1, 2]
    row = spark.createDataFrame([("Q", "r", ["a", "b", "a"])], "q string, r string, w array<string>").select(records.choice_record(F.col("q"), F.col("r"), F.col("w"), F.lit(2)).alias("m")).first()
    assert row.m[1].content == "Q\n1) a\n2) r\n3) b\n정답:" and row.m[2].content == "2"


def test_distractors_are_others(spark):
    df = spark.createDataFrame([(k, f"v{k % 40}", f"g{k % 3}") for k in range(500)], "k int, v string, g string")
    got = records.distractors(df, "k", "v", 3).collect()
    assert len(got) == 500 and all(len(set(r.others)) == 3 and f"v{r.k % 40}" not in r.others for r in got)


def test_distractors_are_found_where_few_fit(spark):
    rows = [(k, f"v{k}", "big") for k in range(300)] + [(300, "v300", "small"), (301, "v301", "small"), (302, None, "small"), (303, "v0", "other")]
    got = {r.k: r.others for r in records.distractors(spark.createDataFrame(rows, "k int, v string, g string"), "k", "v", 2, group="g").collect()}
    assert set(got) == set(range(304))
    for k in range(1, 300):
        assert len(got[k]) == 2 and set(got[k]) <= {"v300", "v301", "v0"}  # v0 is also of another group
    assert all(len(got[k]) == 2 and not set(got[k]) & {"v300", "v301"} for k in (300, 301, 302))
    assert records.distractors(spark.createDataFrame([(1, None)], "k int, v string"), "k", "v").collect() == []


def test_places_go_round_whatever_the_partitions(spark):
    rows = [(k, 3 + k % 2) for k in range(2000)]
    got = {r.k: r.position for r in records.balanced_position(spark.createDataFrame(rows, "k int, n int").repartition(7), "n", "k").collect()}
    seen = {3: 0, 4: 0}
    for k, n in rows:
        assert got[k] == seen[n] % n + 1
        seen[n] += 1


def test_split_counts(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = ({r.k: r.part for r in records.split(x, "k").collect()} for x in (df, df.repartition(7)))
    assert one == two and sum(p == "train" for p in one.values()) == 900
    assert [r.part for r in records.split(spark.range(1), "id").collect()] == ["train"] and records.split(spark.range(0), "id").count() == 0


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2), (None, 3), (None, 4)], "t string, ord int")
    assert sorted(r.ord for r in records.exact_dedup(df, F.col("t"), ["ord"]).collect()) == [0, 1, 3]


def test_submission_keeps_all_ids(spark):
    s = spark.createDataFrame([("T2",), ("T1",), ("T3",)], "ID string")
    p = spark.createDataFrame([("T1", "a"), ("T2", "b"), ("T9", "c")], "ID string, Answer string")
    assert [tuple(r) for r in records.submission(s, p).collect()] == [("T1", "a"), ("T2", "b"), ("T3", None)]


def test_rationale_and_terms(spark):
    df = spark.createDataFrame([("옳지 않은 것은?\n선택지:\n1 가\n2 나", "2"), ("Q", "1")], "instruction string, output string")
    assert [r.output.split("\n")[-1] for r in records.rationale(df).collect()] == ["정답: 2"] and records.rationale(df, True).count() == 2
    terms = spark.createDataFrame([("용어", "정의함. 예: 사과 배. 끝임", "1.1"), ("bad", "x <|endoftext|>", None)], "term string, definition string, section string")
    for form, column in (("messages", "messages"), ("conversations", "conversations"), ("alpaca", "output"), ("prompt_completion", "completion")):
        out = records.term_records(terms, form, "S")
        assert out.count() == 1 and column in out.columns
    assert records.term_records(terms, "alpaca", "S").first().output.startswith("[정의] 정의합니다.") and records.define_records(terms, 3).count() == 6
    law = spark.createDataFrame([("L", "제1조", "다만 벌금에 처한다. 둘째 문장. 셋째 문장.")], "l string, a string, b string").select(records.law_record(F.col("l"), F.col("a"), F.col("b")).alias("m")).first().m
    assert law[2].content.endswith("[예외·벌칙] 벌칙/제재 포함 · 예외 규정 존재\n[근거] L 제1조")


def plain_blocks(rows, size):
    ids = [x for r in rows for x in r]
    cut = [ids[k : k + size] for k in range(0, len(ids), size)]
    return cut[:-1] if cut and len(cut[-1]) < size // 2 else cut


def test_token_blocks(spark):
    rows = [[1, 2, 3], [], [4] * 9, [5, 6], [7] * 4]
    df = spark.createDataFrame([(0, k, r, r) for k, r in enumerate(rows)] + [(1, 0, [9], [9])], "batch int, ord int, input_ids array<int>, labels array<int>")
    got = [r.input_ids for r in blocks.token_blocks(df, 4).where("batch = 0").orderBy("block").collect()]
    assert got == plain_blocks(rows, 4) and blocks.token_blocks(df, 4).where("batch = 1").count() == 0
    sup = records.supervised(spark.createDataFrame([([1, 2], [3])], "prompt_ids array<int>, answer_ids array<int>")).first()
    assert sup.input_ids == [1, 2, 3, 2] and sup.labels == [-100, -100, 3, 2] and sup.attention_mask == [1] * 4


def test_negatives(spark):
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 51)], "query_id int, doc_id int, rank int")
    got = records.mix_negatives(ranked, 10, 0.7).collect()
    assert len(got) == 10 and {r.rank for r in got} >= set(range(1, 8)) and all(r.rank <= 16 for r in got)


def test_chunks_of_files_and_records(spark):
    files = spark.createDataFrame([("법.txt", "제3조 " + "가" * 1000), ("none.txt", None)], "file string, text string")
    rows = corpus.text_chunks(files, domain="law").orderBy("start").collect()
    assert [(r.id, r.start, r.end, r.extra.domain) for r in rows] == [("법.txt:::0", 0, 900, "law"), ("법.txt:::1", 700, 1004, "law")] and rows[0].extra.articles == ["제3조"]
    recs = spark.createDataFrame([(1, "", "p", 5), (2, "t", "p", 6), (3, None, "", 7)], "k int, text string, passage string, x int")
    got = corpus.record_chunks(recs, "s", "k", "mitre").orderBy("id").collect()
    assert [(r.id, r.text, r.start, r.extra["x"], r.extra["domain"]) for r in got] == [("s:::1", "p", -1, "5", "mitre"), ("s:::2", "t", -1, "6", "mitre")]
    assert corpus.line_corpus(spark.createDataFrame([("a.txt", "x\n\n y"), ("TTA_a.txt", "z")], "file string, text string")).count() == 2


def test_shared_characters_of_many_kinds(spark):
    """Texts of many distinct characters take one look each; characters beyond 16 bits count once."""
    import time

    many = "".join(chr(0x4E00 + k % 20000) for k in range(60000))
    rows = spark.createDataFrame([(1, many, many[::-1] + "x"), (2, "aab😀😀", "a😀b😁a"), (3, "", "a"), (4, None, "a")], "id long, a string, b string")
    began = time.monotonic()
    got = {r.id: r.n for r in rows.select("id", evaluate.common_characters(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {1: 60000, 2: 4, 3: 0, 4: None}
    assert time.monotonic() - began < 15
