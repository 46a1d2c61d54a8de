"""Hops of many queries with like seeds, and citations at a text's end."""

import random
import re

from pyspark.sql import functions as F

from lexgraph.operators import law


def test_queries_with_like_seeds_share_a_front(spark, monkeypatch):
    """Two hubs with 60 neighbours each, 64 seeds beside each, their ids in turn: a front has a node once for each hub's queries."""
    edges = [(f"s{q}", f"h{q % 2}", "r") for q in range(128)] + [(f"n{h}-{k}", f"h{h}", "r") for h in (0, 1) for k in range(60)]
    edges, seeds = spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame([(q, f"s{q}") for q in range(128)], "query_id long, id string")
    fronts, written = [], law.written
    monkeypatch.setattr(law, "written", lambda df, name, **o: (out := written(df, name, **o), name == "front" and fronts.append(out))[0])
    got = {(r.query_id, r.id): r.hop for r in law.expand(edges, seeds, 2).collect()}
    want = {}
    for q in range(128):
        near = {f"n{q % 2}-{k}" for k in range(60)} | {f"s{p}" for p in range(128) if p % 2 == q % 2}
        want |= {(q, x): 2 for x in near} | {(q, f"h{q % 2}"): 1, (q, f"s{q}"): 0}
    assert got == want
    assert fronts[1].count() == 2 * (60 + 64)


def test_cut_after_the_last_article_changes_nothing(spark):
    rng, bits = random.Random(3), ["제", "조", "의", " ", "5", "12", "항", "부터", "까지", "이상", "이하", "법", "x", "。", "\n"]
    texts = [""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", "t", law.reference_keys("t").alias("keys"), F.size(law.cross_law_refs("t")).alias("n")).collect()
    assert len(rows) == 601 and any(r.n for r in rows)
    for r in rows:
        t = re.sub(r"\s+", " ", r.t).strip()
        single = re.findall(r"(?:제 ?)?([0-9]+) ?조(?: ?의 ?([0-9]+))?(?: ?제 ?[0-9]+ ?항)?", t)
        keys = {n + (f"의{m}" if m else "") for n, m in single}
        for a, b in re.findall(r"(?:제 ?)?([0-9]+) ?조 ?(?:부터|이상) ?(?:제 ?)?([0-9]+) ?조 ?(?:까지|이하)", t):
            low, high = sorted((int(a), int(b)))
            keys |= {str(k) for k in range(low, high + 1)} if high - low <= law.LONGEST_RANGE else {a, b}
        assert set(r["keys"]) == keys, r.t
