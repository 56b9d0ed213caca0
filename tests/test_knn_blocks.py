"""Nearest neighbours of as many queries as vectors: no pair is a row of a plan, and blocks lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn
from tessera.plans import catalog


@pytest.mark.parametrize("name", ["knn_cosine", "knn_cosine_join", "knn_dot", "knn_per_label", "lsh_knn"])
def test_no_pairs_in_the_plan(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def _rows(spark, n, width, seed):
    m = np.random.default_rng(seed).standard_normal((n, width))
    m[n // 2] = 0
    m[-5:] = m[:5]  # ties
    rows = [(f"k{i:03d}", [float(x) for x in v], i % 3 or None) for i, v in enumerate(m)]
    return m, rows, spark.createDataFrame(rows, "key string, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("cosine", [True, False])
def test_blocks_against_brute_force(spark, monkeypatch, cosine):
    for name, value in (("_CELLS", 500), ("_CHUNK", 60), ("SLICE", 70), ("_PIECE", 16), ("_ENTRIES", 300)):
        monkeypatch.setattr(knn, name, value)
    m, rows, df = _rows(spark, 200, 8, 1)
    u = knn._units(m) if cosine else m
    expected = []
    for i, (q, *_) in enumerate(rows):
        for label in {r[2] for r in rows}:
            found = sorted(((round(float(u[i] @ u[j]), 9), r[0]) for j, r in enumerate(rows) if r[2] == label), reverse=True)[:4]
            expected += [(q, label, key, n, score) for n, (score, key) in enumerate(found, 1)]
    found = knn.knn(df, df.withColumnRenamed("key", "query_id"), 4, by="label", cosine=cosine).collect()
    assert sorted((r.query_id, str(r.label), r.key, r["rank"]) for r in found) == sorted((q, str(label), key, n) for q, label, key, n, _ in expected)


def test_hashing_keeps_pairs_that_share_a_code(spark, monkeypatch):
    monkeypatch.setattr(knn, "_CHUNK", 60)
    m, rows, df = _rows(spark, 200, 8, 2)
    planes = np.random.default_rng(7).standard_normal((6, 8))
    codes = (((m @ planes.T) > 0).reshape(200, 2, 3) @ (1 << np.arange(3)))
    u, expected = knn._units(m), []
    for i, (q, *_) in enumerate(rows):
        meets = [j for j in range(200) if (codes[i] == codes[j]).any()]
        expected += [(q, key, n) for n, (_, key) in enumerate(sorted(((round(float(u[i] @ u[j]), 9), rows[j][0]) for j in meets), reverse=True)[:90], 1)]
    found = knn.lsh_knn(df.drop("label"), df.select(F.col("key").alias("query_id"), "embedding"), 90, tables=2, bits=3).collect()
    assert sorted((r.query_id, r.key, r["rank"]) for r in found) == sorted(expected)
