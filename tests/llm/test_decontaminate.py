import hashlib
import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from lexgraph.llm import decontaminate as d

DOCS = "doc_id long, text string, terms string, segment string"
TESTS = "item_id long, text string, segment string"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, tests, slack=2):
    out = []
    for doc, text, *_ in docs:
        w, hit, items, near = plain_words(text), set(), set(), set()
        where = {}
        for k, x in enumerate(w):
            where.setdefault(x, set()).add(k)
        for item, t, *_ in tests:
            v = plain_words(t)
            if not v:
                continue
            for x in [v[k : k + 10] for k in range(max(1, len(v) - 9))]:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        items.add(item)
                starts = [{p - k + s for p in where.get(y, ()) for s in range(-slack, slack + 1)} for k, y in enumerate(x)]
                if set.intersection(*starts):
                    near.add(item)
        items, near = items - {None}, near - {None}
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "γάμμα", "d3", "e", "f", "été"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", " - "]) for _ in range(n))
    tests = [(i, text(rng.randint(1, 25)), "x") for i in range(12)] + [(None, "alpha beta", "x"), (20, None, "x"), (21, "", "x"), (22, "...", "x"), (3, text(14), "x"), (100, "e F d3", "x")]
    docs = [(i, text(rng.randint(0, 60)), "x", "x") for i in range(30)] + [(None, "e f d3", "x", "x"), (40, None, "x", "x"), (41, "", "x", "x"), (1, text(30), "x", "x")]
    docs += [(50 + i, text(20) + " " + (tests[i][1]) + text(20), "x", "x") for i in range(12)] + [(50, docs[0][1], "x", "x")] * 2
    docs.append((99, text(30000) + tests[4][1], "x", "x"))
    return docs, tests


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near) for r in found.collect()), key=repr)


def test_against_brute_force(spark):
    docs, tests = made()
    got = d.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS))
    assert rows(got) == brute(docs, tests)


def test_without_slack_near_is_exact(spark):
    docs, tests = made()
    got = d.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS), slack=0)
    assert rows(got) == brute(docs, tests, 0)
    assert all(r.near_ids == r.item_ids and sum(x.e - x.s for x in r.hit_spans) == r.n_hit for r in got.collect())


def test_empty_tables(spark):
    docs, tests = spark.createDataFrame([], DOCS), spark.createDataFrame([], TESTS)
    assert d.contamination(docs, tests).collect() == []
    some = d.contamination(spark.createDataFrame([(1, "a b", "", "")], DOCS), tests).collect()
    assert [(r.doc_id, r.n_words, r.contaminated) for r in some] == [(1, 2, False)]


def test_rows_are_dropped_by_their_text_not_their_id(spark):
    passage = " ".join(f"w{k}" for k in range(10))
    docs = [(None, f"x {passage} y", "a", "s"), (None, "clean words here", "a", "s"), (5, passage, "a", "s"), (5, "clean too", "a", "s"), (5, None, "a", "s"), (7, "", "a", "s"), (7, "clean too", "a", "s")]
    tests = spark.createDataFrame([(None, passage, "x"), (1, "never met anywhere", "x")], TESTS)
    left = d.drop_contaminated(spark.createDataFrame(docs, DOCS.replace("terms", "_lg_key").replace("segment", "_LG_bad")), tests)
    assert left.columns == ["doc_id", "text", "_lg_key", "_LG_bad"]
    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted((r for r in docs if passage not in (r[1] or "")), key=repr)


@given(st.lists(st.lists(st.integers(0, (1 << 35) - 1), max_size=30), max_size=20))
def test_packed_lists_round_trip(lists):
    flat = np.array([x for one in lists for x in one], np.int64)
    data, ends = d.packed(flat, np.array([len(x) for x in lists], np.int64))
    starts = [0, *ends][: len(lists)]
    assert [np.diff(d.unpacked(data[a:b]), prepend=0).tolist() if b > a else [] for a, b in zip(starts, ends, strict=True)] == lists


def test_documents_of_a_segment_are_kept_apart():
    seg = d.Segment([5, 2])
    found, counts, data, ends = d.postings([d.words("one two x three four"), d.words("five one")])
    seg.packed = {t.as_py().decode(): (int(n), data[e0:e1]) for t, n, e0, e1 in zip(found, counts, [0, *ends[:-1]], ends, strict=True)}
    window = "one two three four".split()
    assert len(seg.find(window)[1]) == 0 and seg.find(window, 1)[1].tolist() == [0]
    assert len(seg.find("four five".split(), 2)[1]) == 0
    assert seg.find("x three".split())[0].tolist() == [2]


def test_items_with_string_ids(spark):
    docs = spark.createDataFrame([("d1", "one two three"), ("d2", "four")], "doc_id string, text string")
    items = spark.createDataFrame([("b", "two three"), ("a", "one two"), (None, "four")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in d.contamination(docs, items).collect()}
    assert got == {"d1": (3, ["a", "b"]), "d2": (1, [])}
