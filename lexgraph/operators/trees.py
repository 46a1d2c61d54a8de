"""Trees: a flat table of nodes to one nested JSON object a tree, and back.

A tree is a document: its JSON is one row. Its depth need not be known.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..storage import written

FIELDS = "label string, title string, text string, deleted boolean"
#: Levels of a tree that are parsed at once; what is below them is parsed in further rounds.
AT_ONCE = 8


def _trees(name, nodes: list[tuple[int, int | None, int, str]], top: int) -> list[str]:
    """The JSON of each tree among nodes (node_id, parent_id, level, own JSON), sorted by node_id; roots stand at the level `top`."""
    place = {n[0]: k for k, n in enumerate(nodes)}
    below, roots = [[] for _ in nodes], []
    for k, (node, parent, level, _) in enumerate(nodes):
        if place[node] != k:
            raise ValueError(f"{name}: node {node} is there twice")
        if level == top:
            roots.append(k)
        elif parent not in place or nodes[place[parent]][2] >= level:
            raise ValueError(f"{name}: node {parent} is missing or not above its child, node {node}")
        else:
            below[place[parent]].append(k)
    found = []
    for root in roots:
        parts, stack = [], [(root, 1)]  # a node, and how many objects end with it if it has no children
        while stack:
            k, ends = stack.pop()
            parts += nodes[k][3][:-1], ',"children":['
            if not below[k]:
                parts.append("]}" * ends + ("," if stack else ""))
            stack.extend((c, 1 if n else ends + 1) for n, c in enumerate(reversed(below[k])))
        found.append("".join(parts))
    return found


def nested(nodes: DataFrame, key: str = "law", fields: str = FIELDS, levels: list[int] | None = None) -> DataFrame:
    """(key, tree): nodes (key, node_id, parent_id, level and the fields) as an object with its children inside, in order of node_id.

    The nodes of a tree are brought together and sorted once, so a text moves once however deep it stands. A node's level is
    above its parent's. `levels` are those that occur, found in a written copy of the nodes if they are not given. All trees
    start at the lowest level. A node whose parent is missing or no higher, or that stands there twice, is an error. Null
    fields stay in the JSON as null.
    """
    if levels is None:
        nodes = written(nodes, "nodes")
        levels = [r[0] for r in nodes.select("level").distinct().collect()]
    top = min(levels, default=0)
    own = F.to_json(F.struct("node_id", *(f.split()[0] for f in fields.split(","))), {"ignoreNullFields": "false"})
    rows = nodes.select(key, F.col("node_id").cast("long"), F.col("parent_id").cast("long"), F.col("level").cast("long"), own.alias("own"))

    def run(batches):
        name, held = None, []  # the tree that may go on in the next batch
        for batch in batches:
            names, made = [], []
            for tree, *node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and tree != name:
                    made += (found := _trees(name, held, top))
                    names += [name] * len(found)
                    held = []
                name = tree
                held.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column(0).type), pa.array(made, pa.string())], [key, "tree"])
            kind = batch.column(0).type
        if held:
            found = _trees(name, held, top)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), kind), pa.array(found, pa.string())], [key, "tree"])

    schema = T.StructType([rows.schema[key], T.StructField("tree", T.StringType())])
    return rows.repartition(key).sortWithinPartitions(key, "node_id").mapInArrow(run, schema)


def parsed_type(fields: str = FIELDS) -> str:
    """The type of a tree whose first AT_ONCE levels are parsed; children below them are text."""
    kind = "string"
    for _ in range(AT_ONCE):
        kind = f"struct<node_id int, {fields}, children array<{kind}>>"
    return kind


def _listed(tree: Column, parent: Column, names: list[str], depth: int) -> Column:
    """The nodes of a parsed tree as one array, level after level; those of the last parsed level have their children's text."""

    def from_level(here: Column, k: int) -> Column:
        last = k == AT_ONCE - 1
        children = lambda n: n["x"]["children"] if last else F.lit(None).cast("array<string>")
        nodes = F.transform(here, lambda n: F.struct(n["x"]["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"), *(n["x"][f].alias(f) for f in names), F.lit(depth + k).alias("depth"), children(n).alias("children")))
        if last:
            return nodes
        above = F.filter(here, lambda n: n["x"]["children"].isNotNull())
        below = F.flatten(F.transform(above, lambda n: F.transform(n["x"]["children"], lambda c: F.struct(n["x"]["node_id"].alias("parent_id"), c.alias("x")))))
        return F.concat(nodes, let(below, lambda level: from_level(level, k + 1)))

    return let(F.array(F.struct(parent.alias("parent_id"), tree.alias("x"))), lambda level: from_level(level, 0))


def flat(trees: DataFrame, key: str = "law", fields: str = FIELDS) -> DataFrame:
    """(key, node_id, parent_id, the fields, depth) of nested trees (key, tree), AT_ONCE levels at a time until there are no more; depth is 0 at the root.

    A tree is text, or of parsed_type(fields). The nodes of each round are written, so that no text is parsed twice. Text
    that is no JSON object is an error.
    """
    names, kind = [f.split()[0] for f in fields.split(",")], parsed_type(fields)
    front, found = trees.select(key, F.lit(None).cast("int").alias("parent_id"), "tree"), []
    while True:
        tree = F.from_json("tree", kind, {"mode": "FAILFAST"}) if front.schema["tree"].dataType.typeName() == "string" else F.col("tree")
        here = written(front.select(key, F.inline(_listed(tree, F.col("parent_id"), names, AT_ONCE * len(found)))), "levels")
        found.append(here.drop("children"))
        front = here.where(F.size("children") > 0).select(key, F.col("node_id").alias("parent_id"), F.explode("children").alias("tree"))
        if front.isEmpty():
            break
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out
