import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import doc_rows, docs_frame
from pyspark.sql import functions as F

from lodgeframe.llm import lm_scoring


def lower(text):
    return (text or "").encode().lower()


class PlainModel:
    """Prediction by partial matching, byte by byte."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(lm_scoring.ORDER + 1)]
        for text in texts:
            s = b"\xff" * lm_scoring.ORDER + text + b"\xff"
            for p in range(lm_scoring.ORDER, len(s)):
                for k in range(lm_scoring.ORDER + 1):
                    self.counts[k][s[p - k : p]][s[p]] += 1

    def score(self, text):
        s, total = b"\xff" * lm_scoring.ORDER + text + b"\xff", 0.0
        for p in range(lm_scoring.ORDER, len(s)):
            k = 0
            while k < lm_scoring.ORDER and s[p - k - 1 : p] in self.counts[k + 1]:
                k += 1
            out, chance = set(), 1.0
            while k >= 0:
                own = {x: n for x, n in self.counts[k][s[p - k : p]].items() if x not in out}
                total_own = sum(own.values())
                if s[p] in own:
                    chance *= own[s[p]] / (total_own + len(own))
                    break
                if own:
                    chance *= len(own) / (total_own + len(own))
                out |= set(self.counts[k][s[p - k : p]])
                k -= 1
            else:
                chance /= 256 - len(out)
            total += math.log10(chance)
        return total


@pytest.mark.parametrize("at_once", [lm_scoring.GRAMS_AT_ONCE, 50])
def test_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(lm_scoring, "GRAMS_AT_ONCE", at_once)
    rows = [r for r in doc_rows(24) if r[0] != 1007]
    learned = [r for r in rows if r[0] is not None and r[0] % 7 != 2]
    found = lm_scoring.score_documents(docs_frame(spark, rows), F.col("doc_id") % 7 != 2).collect()
    assert len(found) == len(rows)
    counts = Counter(w for _, t, _ in learned for w in lower(t).split())
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    model = PlainModel([lower(t) for _, t, _ in learned])
    expected = []
    for i, text, _ in rows:
        words = lower(text).split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(learned) + 1) / (n + v + 1))
        expected.append((i is None, i or 0, len(words) + 1, 1 + sum(counts[w] > 0 for w in words), n, base, model.score(lower(text))))
    actual = sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    for mine, other in zip(actual, sorted(expected)):
        assert mine[:5] == other[:5]
        assert mine[5:] == pytest.approx(other[5:], rel=1e-5)


def test_probabilities_of_each_context_add_up_to_one():
    grams, counts = lm_scoring.count_grams([b"abab", b"abba", b"", b"bab"])
    pairs = np.zeros((256, 256), dtype=np.int64)
    np.add.at(pairs, (grams >> 8 & 255, grams & 255), counts)
    unseen = [int.from_bytes(c, "big") for c in (b"zzab", b"qqqq", b"bbbb", b"xbab")]
    contexts = np.unique(np.concatenate([grams >> 8, unseen]))
    asked = (contexts[:, None] << 8 | np.arange(256)).ravel()
    held = dict(zip(grams.tolist(), counts.tolist()))
    scores = lm_scoring.gram_scores(asked, np.array([held.get(g, 0) for g in asked.tolist()]), pairs)
    assert np.allclose((10.0**scores).reshape(-1, 256).sum(axis=1), 1)


def test_lookup_finds_each_key():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, size))
        rng.shuffle(keys)
        wanted = rng.integers(0, max(1, len(keys)), 3 * len(keys))
        assert (lm_scoring.Lookup(keys)(keys[wanted]) == wanted).all()


def test_more_texts_give_more_contexts(spark):
    """A context seen once in a large corpus still counts."""
    rows = [[i, "common words again and again " * 40, None] for i in range(200)] + [[1000, "zyx", None], [1001, "zyx", None]]
    found = {r["id"]: r["score"] for r in lm_scoring.score_documents(docs_frame(spark, rows), F.col("doc_id") <= 1000).collect()}
    without = {r["id"]: r["score"] for r in lm_scoring.score_documents(docs_frame(spark, rows), F.col("doc_id") < 1000).collect()}
    assert found[1001] > without[1001] + 3


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1000)
    rows = doc_rows(30)
    small = lm_scoring.score_documents(docs_frame(spark, rows), F.col("doc_id") % 7 != 2).collect()
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1 << 30)
    large = lm_scoring.score_documents(docs_frame(spark, rows), F.col("doc_id") % 7 != 2).collect()
    key = lambda r: (r["id"] is None, r["id"] or 0, r["n_tokens"], r["score"])
    for a, b in zip(sorted(small, key=key), sorted(large, key=key)):
        assert tuple(a)[:5] == tuple(b)[:5] and tuple(a)[5:] == pytest.approx(tuple(b)[5:], rel=1e-6)


def test_nothing_to_learn(spark):
    assert lm_scoring.score_documents(docs_frame(spark, []), F.lit(True)).count() == 0
    found = lm_scoring.score_documents(docs_frame(spark, [[1, "ab", None]]), F.lit(False)).first()
    assert found["n_known"] == 0 and found["train_tokens"] == 0 and found["score"] == pytest.approx(3 * -math.log10(256), rel=1e-6)
