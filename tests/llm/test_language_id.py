import random

import numpy as np
from conftest import TESTDATA
from llm_rows import WORDS, doc_rows, docs_frame, sentence

from lodgeframe.llm import language_id, queries


def small_net():
    rng = random.Random(3)
    return language_id.fit([(sentence(rng, lang, 12).encode()[:80], lang) for lang in sorted(WORDS) for _ in range(60)], steps=120)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    weights = [w.astype(np.float64) for w in language_id._initial(3, 2, rng)]
    runs, _ = language_id.in_runs([b"abca", b"cab"], 4)
    labels = np.array([0, 1])

    def loss(weights):
        net = language_id.Network(["a", "b"], weights)
        total = 0.0
        for n, (text, label) in enumerate(((b"abca", 0), (b"cab", 1))):
            for t in range(len(text)):
                only = runs[:, n : n + 1]
                states = []
                for d, order in ((0, range(t + 1)), (1, range(3, t - 1, -1))):
                    w, u, b = net.weights[3 * d : 3 * d + 3]
                    state = np.zeros((3, 1))
                    for s in order:
                        state = language_id._step(np.take(w, only[s], axis=1), state, u, b, 3)[0]
                    states.append(state)
                logits = net.weights[6] @ np.concatenate(states) + net.weights[7]
                total -= (logits[label] - np.log(np.exp(logits).sum()))[0]
        return total / 7

    grads = language_id._gradients(weights, runs, labels)
    for k in range(8):
        for place in [tuple(rng.integers(0, s) for s in weights[k].shape) for _ in range(6)] + ([(4, 97)] if k in (0, 3) else []):
            if k in (0, 3) and place[1] == 256:
                continue
            moved = [w.copy() for w in weights]
            moved[k][place] += 1e-4
            up = loss(moved)
            moved[k][place] -= 2e-4
            assert abs((up - loss(moved)) / 2e-4 - grads[k][place]) < 1e-4


def test_padding_and_batches_change_nothing():
    net = small_net()
    texts = [b"a", b"the people " * 40, b"der nicht", b"x" * 127, b"y" * 129]
    together = language_id.classify(net, texts)
    for text, row in zip(texts, together):
        assert np.allclose(language_id.classify(net, [text])[0], row, atol=1e-4)


def test_odd_rows(spark):
    rows = doc_rows()
    found = language_id.predict(docs_frame(spark, rows), small_net()).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r for r in found}
    for i in (1000, 1001, 1002, 1003, 1004):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found)
    right = [by_id[i]["lang_pred"] == lang for i, text, lang in rows[:60]]
    assert sum(right) >= 57 and by_id[1007]["lang_pred"] == "en"
    kept = language_id.keep_known(docs_frame(spark, rows), small_net())
    assert kept.columns == docs_frame(spark, rows).columns
    assert not {1000, 1001, 1002, 1003, 1004} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn(spark):
    docs = docs_frame(spark, [[1, "text", None], [2, None, "en"]])
    assert language_id.train(docs) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs_frame(spark, []), None).count() == 0


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    held = [r for r in queries.op3_language_id(spark, TESTDATA).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
