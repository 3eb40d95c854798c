"""Language of a text: a bidirectional gated recurrent network over its bytes.

Trained here in numpy by backpropagation through time. It labels every byte position; a text's
probabilities are the mean over its positions.

Bad and odd input: a null or empty text, or one without a letter, is ``und`` with score 0, as is
every text if no row could be learned from. Texts are read whole, in runs of RUN_BYTES; very long
ones only take more runs. Repeated rows come back once each, an empty table gives an empty one,
extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.samples import drawn_per_class

UNKNOWN = "und"
HIDDEN = 8
#: Bytes the network reads before its state starts afresh.
RUN_BYTES = 128
#: Runs computed side by side.
RUNS_AT_ONCE = 2048
#: Learning: rows of each language, and characters of the window taken from each, at most.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 96
#: A text whose best language has a lower mean probability is rejected.
LEAST_SCORE = 0.3
_STEPS, _BATCH, _RATE = 160, 96, 0.03
_PAD = 256
_HAS_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights. Of each direction: bytes to gates, state to gates, candidate's own bias; then the output."""

    languages: list[str]
    weights: list[np.ndarray]  # [Wf, Uf, bf, Wb, Ub, bb, V, c]


def _initial(hidden: int, classes: int, rng) -> list[np.ndarray]:
    out = []
    for _ in range(2):
        table = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
        table[:, _PAD] = 0
        table[:hidden, _PAD] = 30  # padding keeps the state as it is
        out += [
            table,
            rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32),
            np.zeros((hidden, 1), np.float32),
        ]
    return [*out, rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32), np.zeros((classes, 1), np.float32)]


def _step(inputs: np.ndarray, state: np.ndarray, u: np.ndarray, bias: np.ndarray, hidden: int):
    """One step of a gated unit for many runs; features are rows. Gates go through tanh(x / 2)."""
    back = u @ state
    gates = np.tanh(0.5 * (inputs[: 2 * hidden] + back[: 2 * hidden]))
    gates *= 0.5
    gates += 0.5
    keep, reset = gates[:hidden], gates[hidden:]
    inner = back[2 * hidden :] + bias
    candidate = np.tanh(inputs[2 * hidden :] + reset * inner)
    return candidate + keep * (state - candidate), keep, reset, inner, candidate


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def run_probabilities(net: Network, runs: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities: runs (length, n) of byte values, 256 where padded; (classes, n)."""
    wf, uf, bf, wb, ub, bb, v, c = net.weights
    hidden = uf.shape[1]
    length, n = runs.shape
    forward = np.empty((length, hidden, n), np.float32)
    state = np.zeros((hidden, n), np.float32)
    for t in range(length):
        state = _step(np.take(wf, runs[t], axis=1), state, uf, bf, hidden)[0]
        forward[t] = state
    total = np.zeros((len(c), n), np.float32)
    state = np.zeros((hidden, n), np.float32)
    for t in range(length - 1, -1, -1):
        state = _step(np.take(wb, runs[t], axis=1), state, ub, bb, hidden)[0]
        found = _softmax(v[:, :hidden] @ forward[t] + v[:, hidden:] @ state + c)
        found *= runs[t] != _PAD
        total += found
    return total


def _gradients(weights: list[np.ndarray], runs: np.ndarray, labels: np.ndarray):
    """Backpropagation through time of the mean position cross-entropy; gradients in the order of weights."""
    v, c = weights[6], weights[7]
    hidden = weights[1].shape[1]
    length, n = runs.shape
    grads = [np.zeros_like(w) for w in weights]
    kept, states = [], []
    for d, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        w, u, b = weights[3 * d : 3 * d + 3]
        state = np.zeros((hidden, n), np.float32)
        record, own = [], np.empty((length, hidden, n), np.float32)
        for t in order:
            new, keep, reset, inner, candidate = _step(np.take(w, runs[t], axis=1), state, u, b, hidden)
            record.append((t, state, keep, reset, inner, candidate))
            own[t] = state = new
        kept.append(record)
        states.append(own)
    inside = runs != _PAD
    both = np.concatenate(states, axis=1)
    logits = np.einsum("ch,thn->tcn", v, both) + c
    logits -= logits.max(axis=1, keepdims=True)
    error = np.exp(logits)
    error /= error.sum(axis=1, keepdims=True)
    error[:, labels, np.arange(n)] -= 1
    error *= inside[:, None, :] / inside.sum()
    grads[6] += np.einsum("tcn,thn->ch", error, both)
    grads[7][:, 0] += error.sum(axis=(0, 2))
    outer = np.einsum("ch,tcn->thn", v, error)
    for d in (0, 1):
        u = weights[3 * d + 1]
        gw, gu, gb = grads[3 * d : 3 * d + 3]
        flow = np.zeros((hidden, n), np.float32)
        for t, before, keep, reset, inner, candidate in reversed(kept[d]):
            flow = flow + outer[t, d * hidden : (d + 1) * hidden]
            to_candidate = flow * (1 - keep) * (1 - candidate**2)
            to_keep = flow * (before - candidate) * keep * (1 - keep)
            to_reset = to_candidate * inner * reset * (1 - reset)
            gates = np.concatenate([to_keep, to_reset, to_candidate])
            to_inner = to_candidate * reset
            back = np.concatenate([to_keep, to_reset, to_inner])
            np.add.at(gw.T, runs[t], gates.T)
            gu += back @ before.T
            gb[:, 0] += to_inner.sum(axis=1)
            flow = flow * keep + u.T @ back
        gw[:, _PAD] = 0
    return grads


def fit(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = _STEPS, seed: int = 0) -> Network:
    """Learns from (window of a text, language)."""
    rng = np.random.default_rng(seed)
    samples = sorted(samples)
    languages = sorted({lang for _, lang in samples})
    number = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([number[lang] for _, lang in samples], dtype=np.int64)
    runs = in_runs([text for text, _ in samples], max([1, *(len(t) for t, _ in samples)]))[0]
    weights = _initial(hidden, len(languages), rng)
    shares = (1 / np.bincount(labels, minlength=len(languages)))[labels]
    shares /= shares.sum()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        drawn = rng.choice(len(labels), _BATCH, p=shares)
        rate = _RATE * min(1, 2 * (1 - (step - 1) / steps))
        for w, g, a, b in zip(weights, _gradients(weights, runs[:, drawn], labels[drawn]), first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Network(languages, weights)


def in_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as columns of padded runs, and the text that each run belongs to."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.full(int(counts.sum()) * length, _PAD, dtype=np.int16)
    starts = (np.cumsum(counts) - counts) * length
    place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    flat[place] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, length).T), owner


def classify(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean position probabilities of non-empty texts."""
    pooled = np.zeros((len(texts), len(net.languages)))
    at = 0
    while at < len(texts):
        # Whole texts up to about RUNS_AT_ONCE runs; a longer text comes alone and is cut below.
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= RUN_BYTES * RUNS_AT_ONCE):
            held += len(texts[end])
            end += 1
        runs, owner = in_runs(texts[at:end], RUN_BYTES)
        for k in range(0, runs.shape[1], RUNS_AT_ONCE):
            found = run_probabilities(net, runs[:, k : k + RUNS_AT_ONCE])
            np.add.at(pooled, at + owner[k : k + RUNS_AT_ONCE], found.T.astype(np.float64))
        at = end
    return pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-12)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from ``rows`` rows of each language at most, one window of SAMPLE_CHARS from anywhere in each.

    None if no row has both a language and text.
    """
    usable = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    key = F.xxhash64("text")
    start = F.pmod(key, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    window = F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS))
    drawn = drawn_per_class(usable.select(window.alias("text"), "lang"), "lang", rows).collect()
    return fit([(r["text"].encode(), r["lang"]) for r in drawn]) if drawn else None


def label_texts(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text; ``und`` and 0 without a network or a letter."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if net and t and _HAS_LETTER.search(t)]
    if rows:
        pooled = classify(net, [texts[i].encode() for i in rows])
        for i, best, p in zip(rows, pooled.argmax(axis=1), pooled.max(axis=1)):
            langs[i], scores[i] = net.languages[best], float(min(1.0, p))
    return langs, scores


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, lang_pred, score) per row; text_key is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = model.value
        for batch in batches:
            langs, scores = label_texts(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "text_key", "lang_pred", "score"],
            )

    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    ).mapInArrow(run, f"id {kind}, text_key long, lang_pred string, score double")


def keep_known(
    docs: DataFrame, net: Network | None, text_col: str = "text", least_score: float = LEAST_SCORE
) -> DataFrame:
    """The rows of docs, as they are, whose language is known: not ``und`` and of at least that score."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            langs, scores = label_texts(model.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and b >= least_score for a, b in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
