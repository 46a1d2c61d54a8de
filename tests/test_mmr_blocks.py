"""Diversification over all documents: as a plain loop, with queries and picks that never reach the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lexgraph.operators import dense


def test_as_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = {i: rng.normal(size=4 if i % 4 else 3) for i in range(40)} | {50 + i: np.eye(4)[i % 2] for i in range(6)}
    asked = {1: rng.normal(size=4), 2: np.eye(4)[0], 3: rng.normal(size=3), 4: rng.normal(size=5)}
    frame = lambda rows, kind: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], kind).repartition(3)
    rows, queries = frame(docs, "doc_id long, embedding array<double>"), frame(asked, "query_id long, query_vector array<double>")
    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows went to the driver"))
    found = dense.mmr_whole(rows, queries, 12)
    monkeypatch.undo()
    got = {(r.query_id, r.pick): r.doc_id for r in found.where(F.col("doc_id").isNotNull()).collect()}
    want = {}
    for q, v in asked.items():
        left, taken = {i: x for i, x in sorted(docs.items()) if len(x) == len(v)}, []
        for n in range(1, 13):
            score = {i: round(float(x @ v if not taken else 0.5 * (x @ v) - 0.5 * max(x @ t for t in taken)), 9) for i, x in left.items()}
            if score:
                want[q, n] = best = max(score, key=lambda i: (score[i], -i))
                taken.append(left.pop(best))
    assert got == want and sum(q == 3 for q, _ in got) == 10 and not any(q == 4 for q, _ in got)
