import random
from itertools import combinations

import numpy as np
import pytest
from conftest import TESTDATA
from llm_rows import INSULTS, doc_rows, docs_frame, sentence

from lodgeframe.llm import queries, toxicity


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(5)
    texts = []
    for k in range(300):
        words = sentence(rng, rng.choice(["en", "de"]), 25).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, 25), rng.choice(INSULTS))
        texts.append((" ".join(words), int(k % 3 == 0)))
    return toxicity.fit(texts)


def plain_kernel(a, b):
    def features(word):
        codes = [30, *[c for c in (ord(x) - 96 for x in word)], 31]
        out = {}
        for size in (3, 4):
            for place in combinations(range(len(codes)), size):
                span = place[-1] - place[0] + 1
                if span <= 6:
                    key = tuple(codes[p] for p in place)
                    out[key] = out.get(key, 0) + toxicity.DECAY**span
        return out

    f, g = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return dot(f, g) / np.sqrt(dot(f, f) * dot(g, g))


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "clown", "other", "banana"]
    found = toxicity._kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert found[i, j] == pytest.approx(plain_kernel(a, b))


def test_folded_weights_equal_the_landmark_expansion():
    rng = np.random.default_rng(0)
    marks, beta = ["idiot", "clown", "other"], rng.normal(size=3)
    r, c, v = toxicity.subsequences(marks)
    features, place = np.unique(c, return_inverse=True)
    scorer = toxicity.Scorer(toxicity.Machine(features, np.bincount(place, v * beta[r]), 0.5, np.zeros(3), np.zeros(2)))
    words = ["idiots", "cloown", "nothing"]
    assert np.allclose(scorer.decisions(words), toxicity._kernel(words, marks) @ beta + 0.5, atol=1e-5)


def test_gapped_and_inserted_insults(machine):
    scorer = toxicity.Scorer(machine)
    clean = scorer.decisions(["there", "people", "zwischen", "which"]).max()
    assert scorer.decisions(["id.iot", "i-d-i-o-t", "IDIOT!".lower(), "idxiot", "moroon", "clow_n", "losser"]).min() > clean
    assert scorer.probabilities(["you i d i o t and c l o w n here"])[0] >= 0.7
    assert scorer.probabilities(["", None, "the people would think about this", "... --- !"]).max() < 0.3


def test_odd_rows(spark, machine):
    rows = doc_rows()
    docs = docs_frame(spark, rows)
    found = toxicity.predict(docs, machine).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    toxic = {i for i in range(60) if i % 4 == 0}
    assert {r["id"] for r in found if r["score"] >= 0.7} == toxic
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(toxic)
    assert toxicity.predict(docs_frame(spark, []), machine).count() == 0


def test_nothing_to_learn(spark):
    docs = docs_frame(spark, [[1, "a text", None], [2, None, None]])
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert {r["score"] for r in toxicity.predict(docs, None).collect()} == {0.0}
    assert toxicity.keep_clean(docs, None).count() == 2
    assert toxicity.train(docs, labels.where("false")) is None


def test_held_out_labels(spark):
    sf = TESTDATA.replace("sf0.001", "sf0.01")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op7_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    assert right >= 0.93 * len(held)
