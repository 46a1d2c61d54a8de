"""Trees whose nodes are brought together once and parsed several levels at a time."""

import json

from lexgraph.operators import trees


def test_texts_move_once_and_levels_are_parsed_together(spark, monkeypatch):
    chain = [("t", k, k - 1 if k else None, k, f"n{k}") for k in range(20)]
    deep = spark.createDataFrame(chain, "law string, node_id int, parent_id int, level int, name string")
    made = trees.nested(deep, fields="name string", levels=list(range(20)))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rounds, written = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: rounds.append(name) or written(df, name))
    back = trees.flat(made, fields="name string")
    assert len(rounds) == 3  # eight levels each
    assert sorted((r.law, r.node_id, r.parent_id, r.depth, r.name) for r in back.collect()) == [(t, k, p, k, name) for t, k, p, _, name in chain]


def test_trees_longer_than_a_batch_and_with_several_roots(spark):
    """Siblings keep the order of their ids wherever their levels are; a tree may be cut by Arrow batches."""
    rows = [("wide", 0, None, 0, "r")] + [("wide", k, 0 if k % 7 else max(0, k - 1), 1 + (k % 7 == 0 and k > 1), f'"{k}"\\') for k in range(1, 2500)]
    rows += [("two", 1, None, 0, None), ("two", 2, 9, 0, "b"), ("two", 3, 2, 5, "c"), (None, 1, None, 0, "no key")]
    nodes = spark.createDataFrame(rows, "law string, node_id long, parent_id long, level int, name string")
    found = trees.nested(nodes.repartition(5), fields="name string").collect()
    assert sorted(str(r.law) for r in found) == ["None", "two", "two", "wide"]
    below = {}
    for law, node, parent, level, name in sorted(rows, key=lambda r: r[1]):
        below.setdefault((law, parent) if level else (law, "root"), []).append((node, name))
    whole = lambda law, node, name: {"node_id": node, "name": name, "children": [whole(law, *c) for c in below.get((law, node), [])]}
    want = {law: [whole(law, *c) for c in below[law, "root"]] for law in ("wide", "two", None)}
    for law in want:
        assert sorted((json.loads(r.tree) for r in found if r.law == law), key=lambda t: t["node_id"]) == want[law]
    back = trees.flat(spark.createDataFrame(found, "law string, tree string"), fields="name string")
    assert sorted(map(str, ((r.law, r.node_id, r.name) for r in back.collect()))) == sorted(str((r[0], r[1], r[4])) for r in rows)
    assert trees.flat(spark.createDataFrame([("x", None)], "law string, tree string")).count() == 1
