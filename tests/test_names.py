import random
import time

from lexgraph.functions import predicates
from lexgraph.operators import names
from pyspark.sql import functions as F


def brute(text, words):
    out = [(i, i + len(w), w) for w in words if w for i in range(len(text or "") - len(w) + 1) if text[i : i + len(w)] == w]
    kept, at = [], 0
    for s, e, w in sorted(out, key=lambda h: (h[0], -h[1])):
        if s >= at:
            kept.append((s, e, w))
            at = e
    return sorted(out), kept


def test_against_brute_force(spark, monkeypatch):
    """In one part and in several; names within names, that overlap, repeat or are empty; null and empty texts."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ab가") for _ in range(rnd.randint(1, 4))) for _ in range(30)]
    texts = [None, "", *("".join(rnd.choice("ab가 ") for _ in range(rnd.randint(1, 60))) for _ in range(60))]
    frames = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "n string")
    for part in (8 << 20, 10):
        monkeypatch.setattr(names, "PART", part)
        for longest in (False, True):
            got = sorted((r.doc_id, r.start, r.end, r.name) for r in names.mentions(*frames, longest=longest).collect())
            assert got == sorted((i, *h) for i, t in enumerate(texts) for h in brute(t, set(words))[longest])
    assert names.mentions(frames[0], frames[1].limit(0)).collect() == [] and names.mentions(frames[0].limit(0), frames[1]).collect() == []


def test_a_hundred_thousand_names_in_a_megabyte(spark):
    """Time in proportion to the text: a text without punctuation and many names that it nearly holds."""
    many = spark.range(100_000).selectExpr("concat('가나다라마', id, '법') AS name")
    text = "가나다라마 " * 170_000 + "가나다라마77법"
    docs = spark.createDataFrame([("k", text)], "doc_id string, text string")
    began = time.time()
    assert [tuple(r) for r in names.mentions(docs, many).collect()] == [("k", "가나다라마77법", len(text) - 8, len(text))]
    assert time.time() - began < 60


def test_titles_as_the_column_function_has_them(spark):
    asked = ["개인정보보호법 위반", "개인정보보호법위반", "", None, "공부 방법 개인정보보호법", "신용법 과 개인정보보호법", " "]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, normal string")
    words = ["개인정보보호법", "신용법"]
    got = {r.doc_id: r.title_asked for r in names.asked_titles(rows, spark.createDataFrame([(w,) for w in words], "k string")).collect()}
    want = {r.doc_id: bool(r.t) for r in rows.select("doc_id", predicates.triggers_title(F.col("normal"), F.array(*map(F.lit, words))).alias("t")).collect()}
    assert got == want and any(got.values())
