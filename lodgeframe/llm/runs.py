"""Periodic runs of words, by internal pattern matching on dyadic blocks.

A run of smallest period q that is at least four periods long holds, in its first 2q - 1 words, an
aligned block of B words, B the power of two with B <= q < 2B, and again one and two periods later.
So each block of B words asks where it occurs between B and 2B - 1 words further on. A suffix array
puts the occurrences of a block side by side, and a wavelet tree over the array finds the first one
behind a place (range successor). One or two occurrences are candidate periods. Three or more form
an arithmetic progression whose difference p is the block's own period; then the words around the
block and around the occurrence are two stretches of period p, and as a shift by q maps the end of
the one to the end of the other, the distance of the ends is the only candidate. Candidates are
extended to both sides by common extensions and kept if they are long enough.

The words of many documents stand in one array, each document with words of its own, so that nothing
matches across documents. All blocks of a size are asked at once in numpy.

Bad and odd input: a null text has no words, and neither has an empty one. Repeated rows and
repeated or null ids are documents of their own. An empty table gives an empty table. Only the named
columns are read, so extra columns don't matter. Texts are taken whole; one document's words, some 200
bytes each, must fit in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.packing import in_portions

PERIODS = 4
LEAST_WORDS = 6
#: Words of documents that are looked at together.
_TEXT_AT_ONCE = 1 << 20


class Words:
    """Ranks of all blocks of 1, 2, 4 ... words at each place, and the suffix array.

    rank[k][i] is the number of places whose 2^k words are smaller than those from i on, so equal
    ranks mean equal words. Past the end there is a symbol of its own. Ranks are refined until no
    2^k words occur three times; a run's blocks occur so often.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.rank = [self._starts(symbols[order], np.arange(n), order, np.empty(n, dtype=np.int32))]
        self.size = [np.bincount(self.rank[0], minlength=n).astype(np.int32)]
        self.array, step = order, 1
        while n and self.size[-1].max() >= 3:
            rank, size = self.rank[-1], self.size[-1]
            slots = np.flatnonzero(size[rank[self.array]] > 1)
            open_ = self.array[slots]
            behind = open_ + step
            key = rank[open_].astype(np.int64) * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
            sorted_ = np.argsort(key, kind="stable")
            self.array = self.array.copy()
            self.array[slots] = open_[sorted_]
            self.rank.append(self._starts(key[sorted_], slots, open_[sorted_], rank.copy()))
            self.size.append(np.bincount(self.rank[-1], minlength=n).astype(np.int32))
            step *= 2

    @staticmethod
    def _starts(keys: np.ndarray, slots: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Gives each place the first slot of its group of equal keys."""
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[places] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        return rank

    def extend(self, left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from left on equal those from right on (or, backward, up to left and up to right), left < right."""
        n = len(self.array)
        found = np.zeros(len(left), dtype=np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            step, rank = 1 << k, self.rank[k]
            active = np.arange(len(left))
            while len(active):
                a, b = left[active], right[active]
                if forward:
                    a, b = a + found[active], b + found[active]
                    inside = b + step <= n
                else:
                    a, b = a - found[active] - step + 1, b - found[active] - step + 1
                    inside = a >= 0
                active, a, b = active[inside], a[inside], b[inside]
                active = active[rank[a] == rank[b]]
                found[active] += step
                if k < len(self.rank) - 1:
                    break  # the next larger size did not fit, so this one fits once at most
        return found


class WaveletTree:
    """Counts and picks the values of a range of an array, by its bits from the highest one down."""

    def __init__(self, values: np.ndarray):
        self.bits = range(max(1, int(len(values)).bit_length()) - 1, -1, -1)
        self.zeros: list[np.ndarray] = []
        for bit in self.bits:
            zero = (values >> bit & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of values[low:high] are less than limit."""
        out = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            a, b, one = zeros[low], zeros[high], (limit >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out

    def pick(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The value with that many smaller ones in values[low:high]."""
        out = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(self.bits, self.zeros):
            a, b = zeros[low], zeros[high]
            one = number >= b - a
            number = np.where(one, number - (b - a), number)
            out |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out


def candidates(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): each run has such a place with its smallest period; others may be no runs."""
    n = len(words.array)
    tree = WaveletTree(words.array)
    places, periods = [], []
    for k, (rank, size) in enumerate(zip(words.rank, words.size)):
        block = 1 << k
        start = np.arange(0, n, block)
        start = start[size[rank[start]] >= 3]
        low = rank[start]
        high = low + size[low]
        limit = np.minimum(start + 2 * block, n)
        before = tree.below(low, high, np.minimum(start + block, n))
        count = tree.below(low, high, limit) - before
        hit = np.flatnonzero(count)
        start, low, high, before, count = start[hit], low[hit], high[hit], before[hit], count[hit]
        first = tree.pick(low, high, before)
        one = count < 3
        places.append(start[one])
        periods.append((first - start)[one])
        more = np.flatnonzero(count > 1)
        second = tree.pick(low[more], high[more], before[more] + 1)
        two = count[more] == 2
        places.append(start[more[two]])
        periods.append(second[two] - start[more[two]])
        many = more[~two]
        own = second[~two] - first[many]
        here = start[many] + words.extend(start[many], start[many] + own, True)
        there = first[many] + words.extend(first[many], first[many] + own, True)
        told = there > here
        places.append(start[many][told])
        periods.append((there - here)[told])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(symbols: np.ndarray, periods: int = PERIODS, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period), in that order, of all runs with at least ``periods`` periods and ``least`` symbols.

    Symbols are integers; ``periods`` is at least four, as the blocks rely on it.
    """
    if periods < 4:
        raise ValueError("runs of less than four periods may hold no block three times")
    if not len(symbols):
        return np.zeros((0, 3), dtype=np.int64)
    words = Words(symbols)
    place, period = candidates(words)
    length = period + words.extend(place, place + period, True)
    back = np.zeros(len(place), dtype=np.int64)
    inner = np.flatnonzero(place > 0)
    back[inner] = words.extend(place[inner] - 1, place[inner] + period[inner] - 1, False)
    start, length = place - back, length + back
    enough = length >= np.maximum(least, periods * period)
    # A stretch of four periods has its multiples as periods, too: of equal stretches the smallest period counts.
    found = np.unique(np.stack([start, length, period], axis=1)[enough], axis=0)
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def find_in_texts(texts: list[bytes], periods: int = PERIODS, least: int = LEAST_WORDS) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text and its runs, numbered by words."""
    split = [t.split() for t in texts]
    symbols, base = [], 0
    for own in split:
        names = dict.fromkeys(own)
        numbered = dict(zip(names, range(base, base + len(names))))
        symbols.append(np.fromiter(map(numbered.__getitem__, own), np.int64, len(own)))
        base += len(names)
    runs = find_runs(np.concatenate([*symbols, np.zeros(0, dtype=np.int64)]), periods, least)
    edges = np.cumsum([0] + [len(s) for s in split])
    cut = np.searchsorted(runs[:, 0], edges)
    out = []
    for own, first, a, b in zip(split, edges, cut, cut[1:]):
        found = runs[a:b].copy()
        found[:, 0] -= first
        out.append((own, found))
    return out


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    periods: int = PERIODS,
    least: int = LEAST_WORDS,
) -> DataFrame:
    """(id, n_words, runs, greatest, collapsed) per row of docs.

    runs is the array of (start, length, period), by start and period; greatest is the one of most
    periods, or null; collapsed is the text of the words that no run repeats, joined by one space.
    Words stand between ASCII white space.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = "struct<start:long,length:long,period:long>"

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for portion in in_portions(texts, _TEXT_AT_ONCE):
                found = find_in_texts([texts[i] for i in portion], periods, least)
                best = [greatest(runs) for _, runs in found]
                every = np.concatenate([runs for _, runs in found])
                listed = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(portion.start, len(portion)),
                        pa.array([len(words) for words, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0] + [len(runs) for _, runs in found]), pa.int32()), listed
                        ),
                        pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], _RUN),
                        pa.array([b" ".join(without_repeats(*f)) for f in found], pa.binary()),
                    ],
                    names=["id", "n_words", "runs", "greatest", "collapsed"],
                )

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, runs array<{run_type}>, greatest {run_type}, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
