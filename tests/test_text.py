import pytest
from lexgraph.functions import predicates as P
from lexgraph.functions import text as T
from lexgraph.functions import vectors as V
from lexgraph.operators import blocks, law
from pyspark.sql import functions as F

LAW = "제2조 (정의) 제5조의2 및 제7조에 따른다. 개인정보보호법 제28조의2에 의한다. 제10조부터 제12조까지의 규정을 준용한다."
CASES = [
    (law.reference_keys, LAW, ["10", "11", "12", "2", "28의2", "5의2", "7"]), (law.reference_keys, "제9조부터 제7조까지", ["7", "8", "9"]), (law.reference_keys, "", []),
    (T.is_multiple_choice, "Q?\n1 a\n2 b", True), (T.is_multiple_choice, "Q?\n1 a", False), (T.is_multiple_choice, "Q?\n1 a|2 b", False), (T.is_multiple_choice, "Q?\n1\n2", False),
    (T.question_of, "Q?\n 1 a\n2 b", "Q?"), (T.options_of, "Q?\n 1 a\n2 b", ["1 a", "2 b"]),
    (P.relation, "다만, 그러하지 아니하다", "예외"), (P.relation, "벌금에 처한다", "벌칙"), (P.relation, "제3조를 준용한다", "적용"), (P.relation, "유형", "벌칙"), (P.relation, "없음", "참조"),
    (T.normalize, " ＡＢ　Ｃ​ d\n e ", "AB C d e"), (T.clean, "a　　 b\t\tc\n\n\n\nd ", "a b c\n\nd"), (T.clean_law, "제1조 <개정 2020> ① 목적[본조신설] ⑳", "제1조 1 목적 20"),
    (T.clean_catalogue, "a (b: (c: d)) [e] {f：g} (h) ★", "a [e] (h)"), (T.clean_catalogue, "((((x:y))))", "(((" + ")))"), (T.clean_catalogue, "(a (b: c) : d) z", "z"),
    (T.clean_markup, "<b>x</b> [t](https://a.b/c) `q` **z** https://u.v w\n\n y", "x t q z w\ny"), (lambda c: T.clean_markup(c, True), "a &amp; b", "a & b"),
    (lambda c: T.cut(c, 5), "abcd efgh", "abcd"), (T.apply_glossary, "Initial Access by RAT, rather C2", "초기 침투 by RAT, rather C2"), (T.normalize_korean, "a \n b   c ", "a b c"),
    (T.tokens_kept_case, "Ab-c, 가나!d", ["Ab", "c", "가나", "d"]), (T.tokens_stripped, "_Ab_ c! 가나_", ["ab", "c", "가나"]), (T.tokens_lower, "Ab-c 가나1", ["ab", "c", "가나1"]), (T.tokens_circled, "① x", ["1", "x"]), (T.tokens_blank, " A  b　c ", ["A", "b", "c"]), (T.tokens_lower, "", []),
    (T.corpus_tokens, "법령의 123 a 가 데이터, 또는 (보안)", ["법령의", "데이터", "보안"]),
    (lambda c: F.transform(T.chunks(c, 10, 3), lambda x: F.array(x["start"], x["end"])), "", []), (lambda c: F.transform(T.chunks(c, 10, 3), lambda x: F.array(x["start"], x["end"])), "x" * 10, [[0, 10]]),
    (lambda c: F.transform(T.chunks(c, 10, 3), lambda x: F.array(x["start"], x["end"])), "x" * 11, [[0, 10], [7, 11]]), (lambda c: F.transform(T.chunks(c, 10, 3), lambda x: F.array(x["start"], x["end"])), "x" * 25, [[0, 10], [7, 17], [14, 24], [21, 25]]),
    (T.first_sentences, "One. Two! Three?", "One. Two!"), (lambda c: T.truncate(c, 4), "abc def", "abc…"), (lambda c: T.shorten(c, 4), "ab  def", "ab…"),
    (lambda c: T.snippet(c, F.array(F.lit("zz"), F.lit("B")), 1, 3), "xaabcc", "…abc…"), (lambda c: T.snippet(c, F.array(F.lit("zz")), 1, 3), "xaabcc", "xaa…"), (lambda c: T.snippet(c, F.array().cast("array<string>"), 1, 3), "", ""),
    (T.squash_repetition, "A b. A b. C d.", "A b. C d."), (T.clean_answer, "〈a〉  b... ", "a b…"), (T.compress_answer, "One. Two. Three.", "One. Two."),
    (lambda c: T.extract_answer(c, F.lit("Q\n1 a\n2 b")), "x 답변: 12번", "12"), (lambda c: T.extract_answer(c, F.lit("Q\n1 a\n2 b")), "답변: 없음", "0"), (lambda c: T.extract_answer(c, F.lit("Q")), "답변: ", "미응답"), (lambda c: T.extract_answer(c, F.lit("Q")), "a <b>", "a b"),
    (lambda c: T.strip_leads(T.options_of(c)), "Q\n1 가) x\n2 y", ["가) x", "y"]), (lambda c: T.option_numbers(T.options_of(c)), "Q\n3 x\n2 y", ["2", "3"]), (lambda c: F.transform(T.parse_choices(c), lambda x: x["text"]), "q\n선택지:\n1 a\n2 b c ", ["a", "b c"]), (lambda c: T.parse_choices(c), "q\n선택지:\n1 a\nb", None),
    (T.enumerated, "1. 하나입니다.\n가) 둘째 항목;\nx\n- ab", ["하나입니다", "둘째 항목"]), (T.bullets, "(1) 첫째 항목\n• 둘째", ["첫째 항목"]), (T.bullets, "Long one. Short. Another long.", ["Long one.", "Short.", "Another long."]),
    (T.bullets_three, "- aa\n- AA\n- bb", ["aa", "bb", "핵심 사항 3"]), (T.bullets_three, "보호 조치, 정보를 제공한다, 근거 자료", ["근거 자료", "정보를 제공한다", "보호 조치"]),
    (T.definition, "정의함. 둘째임", "정의합니다. 둘째입니다."), (T.examples, "예: 사과 배. 끝", ["사과 배"]), (T.contrast, "다른 것과 구분한다. 둘.", "다른 것과 구분한다."), (T.contrast, "x", None),
    (T.normalize_compared, "'A, 《b》 (c)!'", "a b c"), (lambda c: T.normalize_compared(c, True), "<p>A b</p>", "ab"), (T.noisy_output, "ok ****** x", True), (T.noisy_output, "한국어 답변입니다", False),
    (P.route, "T1059 is", "mitre"), (P.route, "제 5 조", "law"), (P.route, "hello", "auto"), (P.detect_domain, "시행령의 T1059", "mitre"), (P.detect_domain, "제 5 조 T1059", "law"), (P.detect_domain, "hi", "unknown"),
    (P.triggers_law, "공부 방법 제3조", False), (P.triggers_law, "개인정보보호법 위반", True), (P.triggers_law, "관성 법칙", False), (P.is_negative, "옳지 않은 것은?", True), (P.is_broken, "a <|endoftext|>", True), (P.is_number_answer, " 12 ", True), (P.is_number_answer, "123", False),
    (P.clause_flags, "다만 과태료를 부과한다", ["벌칙/제재 포함", "예외 규정 존재"]), (P.mostly_korean, "한글 123!", True), (P.mostly_korean, "한글 a", False),
    (lambda c: blocks.pack_lines(F.split(c, ", "), 9), "aaaa, bbb, cc, dddddd", ["aaaa bbb", "cc dddddd"]), (lambda c: blocks.pack_sentences(c, 12), "Aaa bbb. Ccc. Ddddddd eeeee ffff. G.", ["Aaa bbb.", "Ccc.", "Ddddddd eeeee ffff.", "G."]),
    (lambda c: V.grouped(T.tokens_blank(c), 2), "a b c", ["a b", "c"]), (lambda c: V.grouped(T.tokens_blank(c), 2), "", []), (law.law_name, "전자 금융 – 법", "전자금융-법"),
    (lambda c: F.transform(law.split_articles(c), lambda x: x["title"]), "머리 제1조 목적 제 2 조의 2 정의", ["제1조", "제 2 조의 2"]), (lambda c: law.article_id(c, F.lit("L")), "제 5조의2 x", "L_5의2"), (lambda c: law.article_id(c, F.lit("L")), "부칙", "L_unknown"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    fn, text, want = CASES[k]
    got = spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]
    assert got == want


def test_null_is_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for fn in (T.normalize, T.clean, T.clean_law, T.clean_catalogue, T.tokens_lower, T.chunks, T.first_sentences, T.enumerated, T.bullets_three, T.normalize_compared, T.normalize_corpus, law.reference_keys, P.relation, P.domain_meta):
        rows = df.select(fn("t").alias("x")).collect()
        assert rows[0] == rows[1], fn.__name__


def test_brackets_without_end_take_few_passes(spark):
    import time

    text = "(" * 3 + "x (a: b) " * 20_000
    start = time.perf_counter()
    got = spark.createDataFrame([(text,)], "t string").select(T.clean_catalogue("t")).first()[0]
    assert got == "(((" + " ".join(["x"] * 20_000) and time.perf_counter() - start < 60


def test_law_names_of_any_length(spark):
    name = "가나다라 " * 60 + "에 관한 법"
    row = spark.createDataFrame([(f"앞 문장이다. {name} 제3조의2 및 「짧은 법」 제5조",)], "t string").select(law.cross_law_refs("t").alias("r")).first().r
    assert [(r.law, r.article) for r in row] == [(name.replace(" ", ""), "3의2"), ("짧은법", "5")]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], ["전자", "금융", "거래"], ["전자", "금융", "법"])], "a array<double>, b array<double>, x array<string>, y array<string>")
    row = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.unit(F.col("b")).alias("u"), V.token_overlap(F.col("x"), F.col("y")).alias("o"), V.place_at(F.col("x"), F.lit("거래"), F.lit(1)).alias("p"), V.saturate(F.lit(-10.0)).alias("s"), V.masked_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7))).alias("m"), V.pad_to_multiple(F.array(F.lit(1)), 4).alias("pad")).first()
    assert row.d == 11 and row.u == [0.6, 0.8] and abs(row.o - 0.666666) < 1e-5 and row.p == ["거래", "금융", "전자"] and row.s == 0 and row.m == [-100, -100, 7] and row.pad == [1, 0, 0, 0]


def test_chunks_rebuild_the_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(5003))
    spans = spark.createDataFrame([(text,)], "t string").select(T.chunks("t").alias("c")).first().c
    assert spans[0].text + "".join(s.text[200:] for s in spans[1:]) == text
    with pytest.raises(ValueError):
        T.chunks("t", 10, 10)
