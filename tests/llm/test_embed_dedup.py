import math

import numpy as np
import pytest
from conftest import TESTDATA

from lodgeframe.llm import embed_dedup, queries
from oracle import compare, connect

FORM = "vec_id long, embedding array<double>, label int, id string, v string, node string, copies string, pivots string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], FORM)


def brute(rows):
    fine = [
        i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for i, v, label in rows
    ]

    def near(a, b):
        (_, v, la), (_, w, lb) = rows[a], rows[b]
        if a == b or not fine[a] or not fine[b] or la != lb or len(v) != len(w):
            return False
        return float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))) >= 0.93

    links = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    component = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a, others in enumerate(links):
            low = min([component[a], *[component[b] for b in others]]) if others else component[a]
            changed |= low != component[a]
            component[a] = low
    return sorted(
        (i is None, i or 0, len(n), c or 0, c is None or c == i) for (i, _, _), n, c in zip(rows, links, component)
    )


def sorted_rows(df):
    return sorted((r["id"] is None, r["id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in df.collect())


@pytest.mark.parametrize("slice_rows", [1024, 7])
def test_equals_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(embed_dedup, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = rng.normal(size=12)
        rows.append((i, v.tolist(), int(rng.integers(2))))
        if i % 3 == 0:
            rows.append((1000 + i, (v + rng.normal(size=12) * 0.05).tolist(), rows[-1][2]))
    rows += [(2000 + k, (np.array(rows[0][1]) + rng.normal(size=12) * 0.02).tolist(), rows[0][2]) for k in range(25)]
    rows += [(3000, rows[0][1], rows[0][2]), (3001, rows[0][1], rows[0][2]), (3002, rows[0][1], 1 - rows[0][2]), (3003, rows[0][1], None)]
    rows += [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 12, 0), (4003, [math.nan] + [1.0] * 11, 0), (4004, [None] + [1.0] * 11, 0), (4005, [math.inf] * 12, 0)]
    rows += [(5000, [1.0, 2.0], 0), (5001, [1.0, 2.1], 0), (None, rows[0][1], rows[0][2]), (6000, [x * 1e6 for x in rows[0][1]], rows[0][2])]
    assert sorted_rows(embed_dedup.near_duplicates(frame(spark, rows))) == brute(rows)


def test_recall_close_to_the_threshold(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(k, v, 0) for k, v in enumerate(np.vstack([a, 0.932 * a + math.sqrt(1 - 0.932**2) * b]).tolist())]
    found = embed_dedup.near_duplicates(frame(spark, rows)).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * 3000 <= found <= 3000


def test_equals_sql(spark):
    assert compare(queries.op9_embedding_dedup(spark, TESTDATA), connect(TESTDATA), queries.OP9_SQL) is None
    assert compare(queries.op4_topk(spark, TESTDATA), connect(TESTDATA), queries.OP4_SQL) is None


def test_empty(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert embed_dedup.near_duplicates(frame(spark, [(1, None, 0)])).count() == 1
