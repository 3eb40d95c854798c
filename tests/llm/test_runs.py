"""Periodic runs against brute force over all periods, and the whole query against Python."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import doc_rows, docs_frame

from lodgeframe.llm import queries, runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words):
    """All (start, length, period), stretch by stretch of equal words q apart."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(6, 4 * q) and smallest_period(words[start : start + 3 * q]) == q:
                found.append((start, length, q))
            start = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_equal_brute_force(words):
    assert [tuple(r) for r in runs.find_runs(np.array(words, dtype=np.int64)).tolist()] == brute_runs(words)


@st.composite
def repetitive(draw):
    """Nested repetitions, so that blocks have periods of their own."""
    out = draw(st.lists(st.integers(0, 2), min_size=1, max_size=6))
    for _ in range(draw(st.integers(1, 3))):
        out = out * draw(st.integers(1, 7)) + draw(st.lists(st.integers(0, 2), max_size=5))
    return out[:700]


@settings(max_examples=300, deadline=None)
@given(repetitive())
def test_nested_runs_equal_brute_force(words):
    assert [tuple(r) for r in runs.find_runs(np.array(words, dtype=np.int64)).tolist()] == brute_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=8))
def test_documents_do_not_touch(documents):
    found = runs.find_in_texts([b" ".join(d) for d in documents])
    assert [[tuple(r) for r in f.tolist()] for _, f in found] == [brute_runs(d) for d in documents]


def test_fibonacci_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert [tuple(r) for r in runs.find_runs(np.array(b)).tolist()] == brute_runs(b)
    rng = np.random.default_rng(3)
    for period in (1, 2, 3, 31, 32, 33, 100):
        words = [*rng.integers(0, 900, 50), *([*rng.integers(0, 900, period)] * 5), *rng.integers(0, 900, 57)]
        assert [tuple(r) for r in runs.find_runs(np.array(words)).tolist()] == brute_runs([int(w) for w in words])


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = runs.WaveletTree(values)
    low = rng.integers(0, 300, 500)
    high = low + rng.integers(1, 50, 500).clip(max=300 - low)
    limit = rng.integers(0, 301, 500)
    assert tree.below(low, high, limit).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, limit)]
    number = (rng.random(500) * (high - low)).astype(np.int64)
    assert tree.pick(low, high, number).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, number)]


def expected(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return (
        key, len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in doc_rows(90) if len(r[1] or "") < 20000]
    rows += [[2000, "a b " * 400, None], [2001, "x " * 5, None], [2002, "x " * 6, None], [2003, "a  b\ta\x0bb a b a b", None]]
    docs_frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert in_order(map(tuple, got)) == in_order(expected(r[0], r[1]) for r in rows)


def test_query_on_given_documents(spark):
    texts = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, TESTDATA).select(*COLUMNS).collect()}
    assert len(got) == len(texts)
    for key, text in texts:
        if len(text or "") < 6000:
            assert got[key] == expected(key, text)


def test_long_text_and_empty_table(spark):
    words = [b"w%d" % (i % 9973) for i in range(60_000)]
    ((_, found),) = runs.find_in_texts([b" ".join(words)])
    assert found.tolist() == [[0, 60_000, 9973]]
    ((_, found),) = runs.find_in_texts([b"same " * 60_000])
    assert found.tolist() == [[0, 60_000, 1]]
    empty = spark.createDataFrame([], "doc_id long, text string, id long, runs int")
    assert runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, dtype=np.int64), periods=3)
