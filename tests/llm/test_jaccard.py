import random
import re
from fractions import Fraction

import numpy as np
from lexgraph.llm import jaccard as j

SCHEMA = "doc_id long, text string, _id string, _set string, class_id string"


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [grams(r[1]) for r in rows]
    near = [[k for k in range(len(rows)) if k != i and sets[i] and sets[k] and 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k])] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for k in near[queue.pop()]:
                if k not in seen:
                    seen.add(k)
                    queue.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((r[0], low, len(near[i]), r[0] == low))
    return sorted(out, key=repr)


def made():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for g in range(12):
        base = text(rng.choice((6, 30, 80, 200)))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice((" ", ", ", "\n")).join(w), "x", "x", "x"))
    rows += [(500, "A b", "x", "x", "x"), (501, "a B!", "x", "x", "x"), (502, "a", "x", "x", "x"), (503, None, "x", "x", "x"), (504, "", "x", "x", "x"), (505, "...", "x", "x", "x"), (506, "...", "x", "x", "x"), (None, "only null here twice ok", "x", "x", "x"), (None, "only null here twice ok", "x", "x", "x")]
    rows += [(507, rows[0][1], "x", "x", "x"), (507, rows[0][1], "x", "x", "x"), (508, " ".join(text(40000)), "x", "x", "x"), (None, rows[0][1], "x", "x", "x")]
    return rows


def test_against_brute_force(spark):
    rows = made()
    got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(j, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(j, "VERIFY_BLOCK", 3)
    monkeypatch.setattr(j, "ACROSS_BLOCK", 4)
    got = j.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_differences_to_a_centre_tell_what_two_sets_share():
    rng, limit = np.random.default_rng(8), Fraction(4, 5)
    base = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < keep], rng.integers(0, 1 << 63, more, np.uint64)])) for keep in (1, 0.97, 0.93, 0.9, 0.8) for more in (0, 3, 20, 60) for _ in range(3)]
    sets += [base, base, base[:1], rng.integers(0, 1 << 63, 900, np.uint64)]
    nodes, sizes, copies = np.arange(len(sets)), np.array([len(s) for s in sets]), rng.integers(1, 4, len(sets))
    marks, blocks = np.stack([j.signature(s) for s in sets]).astype(np.uint16), nodes % 3
    for centre in (base, base[:1], sets[-1]):
        parts = [np.setxor1d(s, centre, assume_unique=True) for s in sets]
        for apart in (None, blocks):
            got = j.links_within(nodes, copies, sizes, marks, parts, apart, limit, 1e-7)
            want = j.links_within(nodes, copies, sizes, marks, sets, apart, limit, 1e-7)
            assert all((x == y).all() for x, y in zip(got, want, strict=True))
    near = [sum(int(copies[k]) for k in nodes if k != i and 5 * len(np.intersect1d(sets[i], sets[k])) >= 4 * len(np.union1d(sets[i], sets[k]))) for i in nodes]
    assert j.links_within(nodes, copies, sizes, marks, sets, None, limit, 1e-7)[1].tolist() == near
    assert len(set(near)) > 4


def test_what_moves_between_blocks_is_small(spark, monkeypatch):
    monkeypatch.setattr(j, "VERIFY_BLOCK", 10)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = []
    for k in range(60):
        texts.append(list(base))
        texts[-1][rng.randrange(2000)] = f"other{k}"
    members = spark.createDataFrame([(k, 0, 1, 6, 7, " ".join(t)) for k, t in enumerate(texts)], "_node long, _component long, _copies long, _blocks long, _x long, _text string")
    found = j.verified_blocks(members, 5, Fraction(4, 5), 1e-7).cache()
    rows = found.collect()
    assert len(rows) == 60 and all(len(r["_part"]) <= 8 * 20 < len(" ".join(base)) / 50 for r in rows)
    across = j.verified_across(found, Fraction(4, 5), 1e-7)
    links = {r["node"]: r["links"] for r in rows}
    for r in across.collect():
        links[r["node"]] += r["links"]
    assert set(links.values()) == {59}


def test_one_document_of_each_class_stays(spark):
    rows = made()
    kept = [tuple(r) for r in j.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = {low for _, low, _, _ in brute([r for r in rows if grams(r[1])])}
    assert sorted((r[0] for r in kept if grams(r[1])), key=repr) == sorted(want, key=repr)
    assert sorted(map(repr, (r for r in kept if not grams(r[1])))) == sorted(map(repr, (r for r in rows if not grams(r[1]))))
    assert set(kept) <= set(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert j.near_duplicates(df).collect() == [] and j.deduplicate(df).collect() == []


def test_pruning_is_lossless_at_the_threshold_and_cuts_below():
    rng, limit = np.random.default_rng(3), Fraction(4, 5)
    lost, passed = 0, 0
    for _ in range(400):
        base = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
        one, two = j.signature(base[:850]), j.signature(base[45:])
        share = (len(base) - 45 - (len(base) - 850)) / len(base)
        assert share > 0.8
        lost += not len(j.survivors(np.stack([one, two]).astype(np.uint16), one.astype(np.uint16), np.array([1]), limit, 1e-7))
        far = j.signature(base[500:])
        passed += len(j.survivors(np.stack([one, far]).astype(np.uint16), one.astype(np.uint16), np.array([1]), limit, 1e-7))
    assert lost == 0 and passed < 8


def test_ids_that_are_no_numbers_are_refused_early(spark):
    import pytest
    from lexgraph.llm import packing, warc

    docs = spark.createDataFrame([("k", "t", "t")], "doc_id string, text string, html string")
    for run in (j.near_duplicates, lambda d: packing.pack(d, packing.default_tokenizer()), lambda d: warc.write_warc(d, id_col="doc_id", url_col="text")):
        with pytest.raises(ValueError, match="whole numbers"):
            run(docs)
