"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

A text is a bag of words, and its score is that of its two worst words, so that insults in a long
text count in full and a clean word that looks like one does little alone. Two words are alike by the subsequences of three and four characters they share,
gaps included; a gap costs DECAY per character. Hence ``id.iot`` or ``idxiot`` stays close to
``idiot``. Letters standing alone one after the other (``i d i o t``) also make a word.

The machine works on each word's kernel values with landmark words, whitened by the landmarks' own
kernel matrix. Its decision is linear in kernel values with the landmarks, and these are linear in
subsequence weights, so after training the decision is folded into one weight per subsequence
(at most 32 ** 4 + 32 ** 3): exactly the same numbers, without a pass over the landmarks per word.

Bad and odd input: a null or empty text, or one without words, gets the score of a text without any
suspicious word. Repeated rows come back once each, an empty table gives an empty one, extra
columns don't matter. Texts are read whole; so are words, whatever their length.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.samples import drawn_per_class, first_per_class

LENGTHS = (3, 4)
#: Characters from the first to the last of a subsequence, at most.
SPAN = 6
DECAY = 0.8
LANDMARKS = 160
#: Learning: labelled rows of each class that are read, at most; words kept of each side.
SAMPLE_ROWS = 2000
SAMPLE_WORDS = 1500
#: Beginnings of words from this many characters on are counted beside whole words.
PREFIX = 4
THRESHOLD = 0.7
REMEMBERED_WORDS = 200_000
#: Telling words that are also learned with a letter put in, and such forms of each.
GAPPED_WORDS, GAPPED_FORMS = 100, 3
_ROUNDS, _PENALTY, _FLOOR = 4, 1e-4, -3.0
_DIGIT, _ACUTE, _GRAVE, _OTHER_LETTER, _START, _END, _MARK = 0, 27, 28, 29, 30, 31, 32


def _code_table() -> np.ndarray:
    """Codes of the characters below 0x250: letters 1 to 26, and classes for accented ones and the rest."""
    table = np.full(0x250, _MARK, dtype=np.int64)
    for c in range(0x250):
        parts = unicodedata.normalize("NFD", chr(c).lower())
        if len(parts) == 1 and "a" <= parts <= "z":
            table[c] = ord(parts) - 96
        elif chr(c).isalpha():
            table[c] = {"\u0301": _ACUTE, "\u0300": _GRAVE}.get(parts[-1], _OTHER_LETTER)
        elif chr(c).isdigit():
            table[c] = _DIGIT
    return table


_CODES = _code_table()


def _shapes() -> list[tuple[tuple[int, ...], float]]:
    """Offsets of each subsequence shape, and its weight."""
    return [
        ((0, *inner, last), DECAY ** (last + 1))
        for size in LENGTHS
        for last in range(size - 1, SPAN)
        for inner in combinations(range(1, last), size - 2)
    ]


_SHAPES = _shapes()
_BASE = {3: 32**4, 4: 0}
FEATURES = 32**4 + 32**3


def words_of(text: str) -> set[str]:
    """Distinct words between white space, and words spelled as single characters apart."""
    parts = text.split()
    out = set(parts)
    if sum(len(w) == 1 for w in out) > 2:
        run: list[str] = []
        for part in [*parts, "  "]:
            if len(part) == 1:
                run.append(part)
            else:
                if len(run) > 2:
                    out.add("".join(run))
                run = []
    return out


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words without punctuation, each between a start and an end sign; the word of each code."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], _OTHER_LETTER)
    solid = codes != _MARK
    sizes = np.bincount(np.repeat(np.arange(len(words)), sizes)[solid], minlength=len(words))
    codes = codes[solid]
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    ends = np.cumsum(sizes + 2)
    flat = np.zeros(len(owner), dtype=np.int64)
    flat[ends - sizes - 2], flat[ends - 1] = _START, _END
    flat[np.arange(len(codes)) + np.repeat(2 * np.arange(len(words)) + 1, sizes)] = codes
    return flat, owner


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), once for each pair, scaled to length one per word."""
    flat, owner = _characters(words)
    rows, cols, vals = [], [], []
    for shape, weight in _SHAPES:
        n = len(flat) - shape[-1]
        if n <= 0:
            continue
        inside = owner[:n] == owner[shape[-1] :]
        code = np.zeros(n, dtype=np.int64)
        for offset in shape:
            code = code << 5 | flat[offset : offset + n]
        rows.append(owner[:n][inside])
        cols.append(code[inside] + _BASE[len(shape)])
        vals.append(np.full(len(rows[-1]), weight))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(rows) * FEATURES + np.concatenate(cols)
    key, inverse = np.unique(key, return_inverse=True)
    vals = np.bincount(inverse, np.concatenate(vals))
    rows, cols = np.divmod(key, FEATURES)
    norm = np.sqrt(np.bincount(rows, vals**2, minlength=len(words)))
    return rows, cols, vals / norm[rows]


@dataclass
class Machine:
    """Weights of subsequences and a bias; the curves turn a text's two worst words, and the worst
    one alone, into probabilities, of which the higher counts."""

    features: np.ndarray
    values: np.ndarray
    bias: float
    curve: np.ndarray
    alone: np.ndarray


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of each word with each landmark."""
    lr, lc, lv = subsequences(landmarks)
    used = np.unique(lc)
    dense = np.zeros((len(used), len(landmarks)))
    dense[np.searchsorted(used, lc), lr] = lv
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 500):
        r, c, v = subsequences(words[at : at + 500])
        place = np.minimum(np.searchsorted(used, c), len(used) - 1)
        hit = used[place] == c
        block = np.zeros((len(words[at : at + 500]), len(used)))
        block[r[hit], place[hit]] = v[hit]
        out[at : at + 500] = block @ dense
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    w = ahead = np.zeros(x.shape[1])
    rate = 1 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + _PENALTY)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (_PENALTY * ahead - 2 * x.T @ (weight * slack * y))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def _suspect_words(bags: list[tuple[list[str], int]]) -> tuple[dict[str, int], dict[str, int]]:
    """Toxic texts' words that chance does not explain, and all words of clean texts, with text counts.

    Counted are words and their beginnings; a unit is telling if its split over toxic and clean
    texts has a likelihood ratio that, over all units, chance would hardly give once.
    """
    seen: tuple[dict, dict] = ({}, {})
    for bag, y in bags:
        units = {w[:k] + "*" for w in bag for k in range(PREFIX, min(len(w), 9))}.union(bag)
        side = seen[y]
        for unit in units:
            side[unit] = side.get(unit, 0) + 1
    clean, toxic = seen
    share = sum(y for _, y in bags) / len(bags)
    least = np.log(len(clean.keys() | toxic.keys()))

    def telling(unit: str) -> bool:
        n, c = toxic.get(unit, 0), clean.get(unit, 0)
        if n / (n + c) <= max(0.5, share):
            return False
        ratio = n * np.log(n / (share * (n + c)))
        return ratio + (c * np.log(c / ((1 - share) * (n + c))) if c else 0) > least

    marked = {u for u in toxic if telling(u)}
    suspects = {
        w: n for w, n in toxic.items()
        if w[-1] != "*" and clean.get(w, 0) < n
        and (w in marked or any(w[:k] + "*" in marked for k in range(PREFIX, min(len(w), 9))))
    }
    return suspects, {w: n for w, n in clean.items() if w[-1] != "*" and w not in suspects}


def fit(texts: list[tuple[str, int]], landmarks: int = LANDMARKS, seed: int = 0) -> Machine | None:
    """Learns from labelled texts (sentences or documents); None without both classes or a telling word.

    A toxic text says only that some word of it is toxic: the telling words stand for the toxic
    texts. All words of clean texts are clean; in each round those that the machine ranks too high
    join the sample of clean words.
    """
    rng = np.random.default_rng(seed)
    bags = [(sorted(words_of((t or "").lower())), int(y)) for t, y in texts]
    bags.sort()
    if len({y for _, y in bags}) < 2:
        return None
    suspects, clean = _suspect_words(bags)
    if not suspects or not clean:
        return None
    words = sorted(suspects, key=lambda w: (-suspects[w], w))[:SAMPLE_WORDS]
    pool = sorted(clean, key=lambda w: (-clean[w], w))
    others = set(pool[: SAMPLE_WORDS // 3])
    others.update(pool[i] for i in rng.choice(len(pool), min(len(pool), SAMPLE_WORDS), replace=False))
    marks = words[: landmarks // 2]
    marks = marks + [pool[i] for i in rng.choice(len(pool), min(len(pool), landmarks - len(marks)), replace=False)]
    size, turn = np.linalg.eigh(_kernel(marks, marks))
    held = size > 1e-6
    whiten = turn[:, held] / np.sqrt(size[held])
    r, c, v = subsequences(marks)
    features, place = np.unique(c, return_inverse=True)
    gapped = [
        w[:cut] + chr(97 + int(rng.integers(26))) + w[cut:]
        for w in words[:GAPPED_WORDS] for cut in sorted(rng.integers(1, max(2, len(w)), GAPPED_FORMS).tolist())
    ]
    rows: dict[str, np.ndarray] = {}

    def whitened(wanted: list[str]) -> np.ndarray:
        new = [w for w in wanted if w not in rows]
        rows.update(zip(new, _kernel(new, marks) @ whiten))
        return np.array([rows[w] for w in wanted])

    for _ in range(_ROUNDS):
        both = words + gapped + sorted(others)
        y = np.array([1.0] * (len(words) + len(gapped)) + [-1.0] * len(others))
        weight = np.array([float(suspects[w]) for w in words] + [1.0] * (len(gapped) + len(others)))
        weight = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum())
        w = _svm(whitened(both), y, weight)
        beta = whiten @ w[:-1]
        machine = Machine(features, np.bincount(place, v * beta[r]), float(w[-1]), np.zeros(3), np.zeros(2))
        scorer = Scorer(machine, remembered=1 << 30)
        worst = np.array([scorer.worst_two(bag) for bag, _ in bags])
        high = sorted((w for w in clean if scorer.known[w] > -0.5), key=lambda w: (-scorer.known[w], w))
        others.update(high[:SAMPLE_WORDS])
    label = np.array([y for _, y in bags], dtype=float)
    machine.curve, machine.alone = _logistic(worst, label), _logistic(worst[:, :1], label)
    return machine


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (not negative) and shift of a logistic curve over the columns of x, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    held = list(range(x.shape[1]))
    out = np.zeros(x.shape[1])
    while True:
        part, w = x[:, held], np.zeros(len(held))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            s = p * (1 - p) + 1e-9
            step = np.linalg.solve((part * s[:, None]).T @ part + 0.01 * np.eye(len(held)), part.T @ (p - y) + 0.01 * w)
            w = w - step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        wrong = [h for h, v in zip(held, w) if v < 0 and h != x.shape[1] - 1]
        if not wrong:
            out[held] = w
            return out
        held = [h for h in held if h not in wrong]


class Scorer:
    """Decisions and probabilities of a machine, with remembered words."""

    def __init__(self, machine: Machine, remembered: int = REMEMBERED_WORDS):
        self.machine, self.remembered = machine, remembered
        self.table = np.zeros(FEATURES, dtype=np.float32)
        self.table[machine.features] = machine.values
        self.known: dict[str, float] = {}

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each lower-cased word."""
        if not words:
            return np.zeros(0)
        rows, cols, vals = subsequences(words)
        return np.bincount(rows, vals * self.table[cols], minlength=len(words)) + self.machine.bias

    def learn(self, bags: list[set[str]]) -> None:
        """Decides all words of the bags that are not remembered."""
        if len(self.known) > self.remembered:
            self.known.clear()
        unknown: set[str] = set()
        for bag in bags:
            unknown.update(bag.difference(self.known))
        fresh = list(unknown)
        at = 0
        while at < len(fresh):
            end, held = at, 0
            while end < len(fresh) and (end == at or held + len(fresh[end]) < 20_000):
                held += len(fresh[end]) + 2
                end += 1
            self.known.update(zip(fresh[at:end], self.decisions(fresh[at:end]).tolist()))
            at = end

    def worst_two(self, bag) -> tuple[float, float]:
        """Decisions of the bag's two worst words."""
        self.learn([set(bag)])
        return self._two(bag)

    def _two(self, bag) -> tuple[float, float]:
        found = list(map(self.known.__getitem__, bag))
        first = max(found, default=_FLOOR)
        if len(found) > 1:
            found.remove(first)
        second = max(found, default=_FLOOR)
        return min(max(first, _FLOOR), -_FLOOR), min(max(second, _FLOOR), -_FLOOR)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        bags = [words_of((t or "").lower()) for t in texts]
        self.learn(bags)
        worst = np.array([self._two(bag) for bag in bags]).reshape(-1, 2)
        curve, alone = self.machine.curve, self.machine.alone
        odds = np.maximum(worst @ curve[:2] + curve[2], worst[:, 0] * alone[0] + alone[1])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", rows: int = SAMPLE_ROWS,
) -> Machine | None:
    """A machine from ``rows`` labelled rows of each class at most; their ids are joined with docs.

    Rows with a null label or id teach nothing. Of several labels of one id all count. An id that many
    documents share brings no more than ``rows`` texts of a class either.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    drawn = drawn_per_class(known, "y", rows)  # two classes, so 2 * rows pairs of numbers are broadcast at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(drawn), "id").select("text", "y")
    found = first_per_class(joined, "y", F.xxhash64("text"), rows).collect()
    return fit([(r["text"], r["y"]) for r in found])


_SCORERS: dict[int, Scorer] = {}


def _scorer(model) -> Scorer | None:
    """The worker's scorer of a broadcast machine."""
    if model.value is None:
        return None
    key = hash((model.value.features.tobytes(), model.value.values.tobytes(), model.value.bias, model.value.curve.tobytes(), model.value.alone.tobytes()))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model.value)
    return _SCORERS[key]


def _scores(scorer: Scorer | None, texts: list[str | None]) -> np.ndarray:
    if scorer is None or not texts:
        return np.zeros(len(texts))
    return np.concatenate([scorer.probabilities(texts[at : at + 500]) for at in range(0, len(texts), 500)])


def predict(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; 0 for all rows without a machine."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            scores = _scores(scorer, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double"
    )


def keep_clean(
    docs: DataFrame, machine: Machine | None, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of docs, as they are, whose score is below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            scores = _scores(scorer, batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
