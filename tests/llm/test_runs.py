import hashlib
import random
import zlib

import pytest

from lexgraph.llm import queries, runs

SCHEMA = "doc_id long, text string, _runs string, _bytes string"


def brute(words, shortest=12):
    """Every maximal run, by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(shortest, 2 * q) and i > start and not any(all(words[start + k] == words[start + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_against_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        n, k = rnd.randint(0, 50), rnd.choice([1, 2, 2, 3, 4])
        words = [b"%d" % rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.4 and n > 4:
            p = rnd.randint(1, 7)
            words = [words[i % p] for i in range(n)]
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(n)] = b"z"
        shortest = rnd.choice([2, 5, 12])
        assert runs.runs(words, shortest) == brute(words, shortest), words


class Counted:
    """Codes that count how often they are looked at."""

    def __init__(self, codes):
        self.codes, self.looks = codes, 0

    def __getitem__(self, i):
        self.looks += 1
        return self.codes[i]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("kind", ["one word", "fibonacci", "thue-morse", "random", "long period", "rising"])
def test_arrays_take_linear_time(kind):
    rnd, n = random.Random(1), 30_000
    x = {"one word": [0] * n, "fibonacci": fibonacci(n), "thue-morse": [i.bit_count() & 1 for i in range(n)], "random": [rnd.randrange(2) for _ in range(n)], "long period": [rnd.randrange(4) for _ in range(1000)] * 30, "rising": list(range(n))}[kind]
    for order in (x, [max(x[:2000]) + n - v for v in x]):
        counted = Counted([*order, -1])
        runs.next_smaller(counted, n)
        assert counted.looks <= 10 * n


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(found), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_on_hard_texts(spark, tmp_path):
    rnd = random.Random(2)
    texts = [None, "", " \t\n ", "one", "a " * 40, "a b " * 30 + "c", "é ß é ß é ß é ß é ß é ß é", "a b " * 12, " ".join(rnd.choice("ab") for _ in range(200)), "x\x0by\x0cz\r\n" * 9, " ".join(f"w{i % 50}" for i in range(300))]
    rows = [(i, texts[i % len(texts)], "x", "y") for i in range(120)] + [(3, texts[4], "x", "y")] * 3 + [(None, texts[5], "x", "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(i, t) for i, t, *_ in rows), key=repr)


def test_operator_keeps_columns_and_collapses(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b a b a b a b end", "mine", "too"), (2, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    assert (got[1]._runs, got[1]._bytes, got[1]._n_words, got[1]._collapsed) == ("mine", "too", 15, "a b end")
    assert [tuple(r) for r in got[1]._runs_] == [(0, 14, 2)] and got[2]._runs_ == [] and got[2]._collapsed == ""
    assert runs.find_runs(docs.limit(0)).collect() == []
