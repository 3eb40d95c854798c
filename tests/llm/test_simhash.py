import numpy as np
import pytest
import xxhash
from llm_rows import doc_rows, docs_frame

from lodgeframe.llm import components, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, near):
    parent = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if near(a, b) and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    return parent


def test_fingerprint():
    for text in (None, "", "a", "A b C", "a b c d", "a b c d e f g" * 9, "É x\x0by\x1cz", "q " * 5000):
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes_find_exactly_the_close_pairs(radius):
    rng = np.random.default_rng(radius)
    marks = rng.integers(0, 2**64, 700, dtype=np.uint64)
    for k in range(350, 700):
        flips = rng.choice(64, rng.integers(0, 9), replace=False).astype(np.uint64)
        marks[k] = marks[k - 350] ^ np.bitwise_or.reduce(np.uint64(1) << flips) if len(flips) else marks[k - 350]
    marks = rng.permutation(marks)
    groups = np.sort(rng.integers(0, 3, 700))
    edge = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
    ends = edge[np.searchsorted(edge, np.arange(700), side="right")]
    found = {p for a, b in simhash.close_pairs(marks, ends, radius) for p in zip(a.tolist(), b.tolist())}
    far = np.bitwise_count(marks[:, None] ^ marks[None, :])
    a, b = np.nonzero((far <= radius) & (groups[:, None] == groups[None, :]))
    assert found == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}


@pytest.mark.parametrize("slice_rows", [4096, 3])
def test_components_equal_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(simhash, "SLICE_ROWS", slice_rows)
    rows = doc_rows()
    base = rows[5][1] + " " + rows[7][1]
    rows += [[2000 + k, base + " tail" * k, "en"] for k in range(12)]
    found = simhash.near_duplicates(docs_frame(spark, rows)).collect()
    assert len(found) == len(rows)
    marks = sorted({plain_fingerprint(r[1]) for r in rows})
    parent = plain_components(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, text, _ in rows:
        root = parent[plain_fingerprint(text)]
        if i is not None:
            least[root] = min(least.get(root, i), i)
    expected = sorted(
        ((i if i is not None else -1), plain_fingerprint(t), least.get(parent[plain_fingerprint(t)], -1)) for i, t, _ in rows
    )
    actual = sorted((r["id"] if r["id"] is not None else -1, r["fp"] % 2**64, -1 if r["component_id"] is None else r["component_id"]) for r in found)
    assert actual == expected


def test_keep_one_keeps_one_row_of_each_component(spark):
    rows = doc_rows()
    docs = docs_frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    marks = [plain_fingerprint(t) for _, t in found]
    parent = plain_components(sorted({plain_fingerprint(r[1]) for r in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
    assert len({parent[m] for m in marks}) == len(marks) == len(set(parent.values()))
    assert (1010, rows[1][1]) not in found and (1, rows[1][1]) in found


def test_no_column_name_matters(spark):
    names = ["__no", "__id", "__key", "own_id", "own_key", "row", "w", "a.b"]
    rows = [(i, f"text number {i % 3} of a few", *[100 * i + k for k in range(len(names))]) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[:3]


def test_empty_table(spark):
    docs = docs_frame(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_connected_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 301)]
    found = dict(components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect())
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
