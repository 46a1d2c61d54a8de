import hashlib
import random

import numpy as np
import pytest

from lexgraph.llm import queries, suffixes

SCHEMA = "doc_id long, text string, _kept string, _o string"


def brute(rows, length):
    """(id, bytes, removed, spans, sha256 of what is left), by looking every string of `length` bytes up."""
    texts = sorted({(i, (t or "").encode()) for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for i, data in texts:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out[i, data] = (i, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return sorted((out[i, (t or "").encode()] for i, t, *_ in rows), key=repr)


def test_suffix_ranks():
    rnd = random.Random(1)
    for _ in range(400):
        x = np.array([rnd.randint(1, rnd.choice([1, 2, 5, 300])) for _ in range(rnd.randint(0, 40))], np.int64)
        ranks = suffixes.suffix_ranks(x)
        assert ranks.tolist() == np.argsort(sorted(range(len(x)), key=lambda i: x[i:].tolist())).tolist()
    x = np.ones(5000, np.int64)
    assert suffixes.suffix_ranks(x).tolist() == list(range(4999, -1, -1))


@pytest.mark.parametrize("seed", range(suffixes.ROUNDS + 1))
def test_anchors_depend_on_the_prefix_alone(seed):
    rnd = np.random.default_rng(seed)
    for length in (1, 7, 31, 32, 33, 100):
        data = rnd.integers(0, 3, 400).astype(np.uint8)
        found, leaves = suffixes.anchors(data, length, seed)
        assert len(found) == len(leaves) == 401 - length
        for i in range(0, len(found), 13):
            assert [a.tolist() for a in suffixes.anchors(data[i : i + length], length, seed)] == [[found[i]], [leaves[i]]]
        assert not len(suffixes.anchors(data[: length - 1], length, seed)[0])


def passages(rnd, n):
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.randint(12, 40))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 3))]
        parts += rnd.sample(shared, rnd.randint(0, 2))
        rnd.shuffle(parts)
        text = " ".join(parts)
        if out and rnd.random() < 0.3:  # a near copy
            text = rnd.choice(out)
            at = rnd.randint(0, len(text))
            text = text[:at] + rnd.choice(["", "x", "inserted words "]) + text[at:]
        out.append(text)
    return [*out, "", None, "a" * 700, "ab" * 300, "b" + "a" * 500, "é" * 200]


@pytest.mark.parametrize("hot", [suffixes.HOT, 2000])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, hot):
    """With a small HOT, deals are dealt again down to whole prefixes."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rnd = random.Random(7)
    texts = passages(rnd, 120)
    rows = [(i, t, "x", "y") for i, t in zip(rnd.sample(range(-500, 500), len(texts)), texts, strict=True)] + [(None, texts[3], "x", "y")]
    rows += [(1000 + i, texts[5], "x", "y") for i in range(40)] + [(2000, texts[0], "x", "y")] * 3
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_suffix_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 100)


def test_blocks_and_arrays_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 50)
    monkeypatch.setattr(suffixes, "MOST", 3000)
    rnd = random.Random(9)
    rows = [(i, t, "mine", "too") for i, t in enumerate(passages(rnd, 40))]
    for length in (9, 40):
        out = suffixes.drop_repeated(spark.createDataFrame(rows, SCHEMA), length)
        assert out.columns == ["doc_id", "text", "_kept", "_o", "_n_bytes", "_spans", "_kept_"]
        got = sorted(((r.doc_id, r._n_bytes, sum(s.length for s in r._spans), len(r._spans), hashlib.sha256(r._kept_).hexdigest()) for r in out.collect()), key=repr)
        assert got == brute(rows, length)


def test_empty_table_and_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.drop_repeated(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.drop_repeated(empty, id_col="text")
