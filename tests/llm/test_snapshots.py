import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from lexgraph.llm import queries, snapshots

SCHEMA = "doc_id long, text string, lang string, source string, _key string, _print string, op string"


def brute(earlier, later, key_order=lambda k: (k is not None, k if k is not None else 0)):
    """(key, old_key, op, changed, later row) of every pair and lone row; rows are (key, text, lang, source)."""
    out, lone = [], (defaultdict(list), defaultdict(list))
    text = lambda r: tuple((v is not None, v or "") for v in r[1:])
    by = tuple(defaultdict(list) for _ in range(2))
    for which, rows in enumerate((earlier, later)):
        for r in rows:
            by[which][r[0]].append(r)
    for k in by[0].keys() | by[1].keys():
        a, b = (sorted(x[k], key=text) for x in by)
        n = min(len(a), len(b)) if k is not None else 0
        for x, y in zip(a[:n], b[:n], strict=True):
            changed = [c for c, u, v in zip(("text", "lang", "source"), x[1:], y[1:], strict=True) if u != v]
            out.append((k, k, "update" if changed else "same", ",".join(changed), y))
        for which, rest in enumerate((a[n:], b[n:])):
            for nth, r in enumerate(rest, n):
                lone[which][r[1:3]].append((r, nth))
    for g in lone[0].keys() | lone[1].keys():
        a = sorted(lone[0][g], key=lambda r: (key_order(r[0][0]), r[1], text(r[0])))
        b = sorted(lone[1][g], key=lambda r: (key_order(r[0][0]), r[1]), reverse=True)
        n = min(len(a), len(b))
        out += [(y[0], x[0], "rekey", "source" if x[3] != y[3] else "", y) for (x, _), (y, _) in zip(a, b, strict=False)]
        out += [(x[0], x[0], "delete", "", None) for x, _ in a[n:]] + [(y[0], None, "insert", "", y) for y, _ in b[n:]]
    return sorted(out, key=repr)


def row_hash(r):
    return r and hashlib.sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest()


def test_minimal_perfect_hash():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        h = snapshots.PerfectHash(keys)
        assert h.slots == len(keys) and sorted(h.of(keys).tolist()) == list(range(len(keys)))
        others = h.of(rnd.integers(0, 2**63, 1000).astype(np.uint64))
        assert ((others >= -1) & (others < max(1, h.slots))).all()


def test_query_with_hot_content_nulls_and_broken_rows(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, None if i % 37 == 0 else "one" if i % 3 == 0 else f"text {rnd.randrange(300)}", rnd.choice(["en", None, "de"]), rnd.choice(["s", "t", None]), "x", "y", "z") for i in range(-1500, 1500)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    later = []
    for i, text, lang, source, *_ in rows:
        r = zlib.crc32(str(i).encode()) % 25
        if r == 1:
            later.append((i, (text or "") + "+", lang, source))
        elif r == 2:
            later.append((i, text, source, lang))
        elif r in (3, 4):
            later.append((-1 - i, text, lang, None if r == 4 else source))
        elif r:
            later.append((i, text, lang, source))
            later += [(-1 - i, text, lang, source)] * (r == 5)
    got = queries.op13_snapshot_diff(spark, str(tmp_path))
    assert got.columns == ["key", "old_key", "op", "changed", "row_sha256"]
    want = [(*w[:4], row_hash(w[4])) for w in brute([r[:4] for r in rows], later)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def run(spark, earlier, later, kind="long", **how):
    frames = [spark.createDataFrame(rows, f"k {kind}, text string, lang string, source string") for rows in (earlier, later)]
    found = snapshots.difference(*frames, "k", ["text", "lang", "source"], ["text", "lang"], **how).collect()
    return sorted(((r.key, r.old_key, r.op, ",".join(r.changed)) for r in found), key=repr)


def test_null_and_repeated_keys(spark):
    """Rows that repeat pair one by one; null keys pair by content."""
    rnd = random.Random(6)
    for _ in range(3):
        rows = [[(rnd.choice([None, 1, 2, 3, 4, 5, 6]), rnd.choice(["a", "b", None]), rnd.choice(["x", None]), "s") for _ in range(60)] for _ in range(2)]
        assert run(spark, *rows) == sorted((w[:4] for w in brute(*rows)), key=repr)


def test_other_keys_and_empty_tables(spark):
    a, b = [("k1", "t", "l", "s"), ("", "u", "l", "s"), ("gone", "v", None, None)], [("k1", "t2", "l", "s"), ("new", "v", None, "q"), ("", "u", "l", "s")]
    assert run(spark, a, b, "string") == [("", "", "same", ""), ("k1", "k1", "update", "text"), ("new", "gone", "rekey", "source")]
    assert run(spark, [], b, "string") == sorted([(k, None, "insert", "") for k, *_ in b], key=repr)
    assert run(spark, a, [], "string") == sorted([(k, k, "delete", "") for k, *_ in a], key=repr)
    assert run(spark, [], []) == []
    # values that only join to the same bytes are different content
    assert [r[2] for r in run(spark, [(1, "a", None, "s")], [(2, "a", "", "s")])] == ["delete", "insert"]
