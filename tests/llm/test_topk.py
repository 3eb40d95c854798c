import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgeframe.llm import topk

FORM = "vec_id long, embedding array<float>, label int, id string, v string, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], FORM)


def brute(rows, k=5):
    items = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            items.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for i, own in items.items():
        if i % 50 == 0:
            best = {}
            for q in own:
                for j, others in items.items():
                    for v in others:
                        if j != i and len(v) == len(q):
                            best[j] = max(best.get(j, -(1 << 60)), sum(a * b for a, b in zip(q, v)))
            for rank, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:k], 1):
                out.append((i, rank, j, -s))
    return sorted(out)


@pytest.mark.parametrize("parts", [(8192, 4096), (40, 2)])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(topk, "CANDIDATES_AT_ONCE", parts[0])
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", parts[1])
    monkeypatch.setattr(topk, "_STEP", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=10).astype(np.float32).tolist()) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(9)]  # ties
    rows += [(400, None), (450, [1.0, None]), (500, [math.nan, 1.0]), (550, [math.inf, 0.0]), (600, []), (601, []), (650, [2.0, 3.0]), (651, [1.0, 1.0])]
    rows += [rows[3], rows[3], (3, [9.0] * 10), rows[100], (None, [5.0] * 10), (700, [0.0] * 10), (750, [1e6] * 10), (751, [-1e6] * 10)]
    found = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(-300, 300, (400, 8)), 8, axis=1) + rng.integers(-3, 4, (400, 64))
    for m in topk.LEVELS:
        f = topk._segments(x.astype(float), m)
        assert (f @ f.T >= x @ x.T - 1e-6 * np.abs(x @ x.T)).all()
    scores, names, computed = topk.search(x[:1], np.array([-1]), np.tile(x, (20, 1)), np.arange(8000), 5)
    assert computed < 8000


def test_empty(spark):
    assert topk.exact_top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.exact_top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
