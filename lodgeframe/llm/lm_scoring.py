"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The byte model is the trie of all contexts of up to ORDER bytes that the corpus has, whole: nothing
is pruned, so it grows with the corpus and stays a distributed table. A symbol not seen after a
context escapes to the next shorter one, with method C's estimate, and the symbols already ruled out
are excluded there. What a text asks of the model are its grams, a context of ORDER bytes and the
byte after it. Each distinct gram's probability is worked out once, beside all grams that end their
contexts in the same two bytes; only the counts of pairs of bytes, 65,536 at most, go to every task.

The base needs each word's count over the whole corpus. Documents are dealt into blocks; a block's
distinct words and grams, not its tokens, fetch their values and come back to the block. Words go by
a 64-bit hash. (Two of a billion different words share one with a chance of about 3 percent.)

Bad and odd input: a null text is an empty one and has its end alone. Rows without an id are scored
and not learned from. Repeated rows are learned and scored as often as they occur. An empty table
gives an empty one; without training rows the byte model is uniform. Extra columns don't matter.
Texts are scored whole.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.packing import in_portions
from lodgeframe.session import shared_folder

ORDER = 4
#: Text of a block, at most about.
BLOCK_BYTES = 32 << 20
#: Distinct grams whose probabilities are worked out in one task, about.
GRAMS_AT_ONCE = 250_000
_PAD = b"\xff" * ORDER  # no UTF-8 text holds this byte: it begins and ends a text
_TEXT_AT_ONCE = 2 << 20


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with padding around each, and the place of each text's first byte."""
    flat = np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + ORDER for t in texts], dtype=np.int64)
    return flat, ORDER + np.cumsum(sizes) - sizes


def _scored(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places count: a text's bytes and one end sign."""
    out = flat != 0xFF
    out[np.append(starts[1:], len(flat)) - ORDER] = True
    return out


def _grams(flat: np.ndarray) -> np.ndarray:
    """The context of ORDER bytes before each place from ORDER on with the byte there, packed in an integer."""
    grams = np.zeros(len(flat) - ORDER, dtype=np.int64)
    for k in range(ORDER + 1):
        grams = grams << 8 | flat[k : len(flat) - ORDER + k]
    return grams


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of lower-cased texts, and how often each occurs."""
    flat, starts = _stream(texts)
    return np.unique(_grams(flat)[_scored(flat, starts)[ORDER:]], return_counts=True)


def _spread(keys: np.ndarray, counts: np.ndarray, parents: np.ndarray):
    """Of keys (a context and a byte): their distinct ones, and what each key's context and own count are.

    Returns per key its count, its context's total, symbols, and the shorter context's counts of these symbols.
    """
    own, first, place = np.unique(keys, return_index=True, return_inverse=True)
    n = np.bincount(place, counts, len(own))
    _, context = np.unique(own >> 8, return_inverse=True)
    total, kinds = np.bincount(context, n), np.bincount(context, n > 0)
    shorter = np.bincount(context, np.where(n > 0, parents[first], 0))
    return n[place], total[context][place], kinds[context][place], shorter[context][place]


def gram_scores(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.

    Grams are distinct, with how often training texts have each; with one gram come all others of
    the corpus whose contexts end in the same two bytes. pairs[x, y] counts y after x in training texts.
    """
    symbol, before = grams & 255, grams >> 8 & 255
    single = pairs.sum(axis=0).astype(np.float64)
    seen = pairs > 0
    n, total, kinds = single[symbol], np.full(len(grams), single.sum()), np.full(len(grams), (single > 0).sum())
    escaped = np.full(len(grams), -np.log10(max(1, 256 - (single > 0).sum())))

    def share(n, total, kinds, further):
        """What a context gives: its own share, else its escape and what follows from it; nothing seen, no escape."""
        all_in = np.maximum(total + kinds, 1)
        escape = np.log10(np.maximum(kinds, 1) / all_in)
        return np.where(n > 0, np.log10(np.maximum(n, 1) / all_in), np.where(kinds > 0, escape, 0) + further)

    for k in range(1, ORDER + 1):
        if k == 1:
            deeper = (
                pairs[before, symbol].astype(np.float64), pairs.sum(axis=1)[before].astype(np.float64),
                seen.sum(axis=1)[before], np.where(seen, single, 0).sum(axis=1)[before],
            )
        else:
            deeper = _spread(grams & (1 << 8 * (k + 1)) - 1, counts, n)
        own_n, own_total, own_kinds, shorter = deeper
        # Symbols seen after the longer context are excluded from the shorter one; they are among its own.
        escaped = share(n, total - shorter, kinds - own_kinds, escaped)
        n, total, kinds = own_n, own_total, own_kinds
    return share(n, total, kinds, escaped)


class Lookup:
    """Where each of many integers stands among distinct ones: an open hash table of array slots."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            open_ = self.slots[at] != left
            left, at = left[open_], at[open_] + 1 & len(self.slots) - 1

    def _start(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Indices of integers that are all there."""
        at = self._start(wanted)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != wanted)
        while len(wrong):
            at[wrong] = at[wrong] + 1 & len(self.slots) - 1
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != wanted[wrong]]
        return found


def text_scores(texts: list[bytes], known: Lookup, values: np.ndarray) -> np.ndarray:
    """log10 probability of each lower-cased text with its end; values belong to the grams known."""
    if not texts:
        return np.zeros(0)
    flat, starts = _stream(texts)
    counted = _scored(flat, starts)[ORDER:]
    scores = np.zeros(len(counted))
    scores[counted] = values[known(_grams(flat)[counted])]
    return np.add.reduceat(scores, starts - ORDER)


def _hash(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype=">u8").astype(np.uint64).view(np.int64)


class _Asked:
    """A block's distinct words and grams, and how often its training texts have them."""

    def __init__(self):
        self.words: Counter = Counter()
        self.grams, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, texts: list[bytes], learn: bool) -> None:
        for text in texts:
            words = text.split()
            if learn:
                self.words.update(words)
            else:
                dict.update(self.words, dict.fromkeys([w for w in words if w not in self.words], 0))
        for portion in in_portions(texts, _TEXT_AT_ONCE):
            new, n = count_grams([texts[i] for i in portion])
            self.grams, place = np.unique(np.concatenate([self.grams, new]), return_inverse=True)
            self.counts = np.bincount(place, np.concatenate([self.counts, n * learn])).astype(np.int64)

    def rows(self, block: int) -> pa.RecordBatch:
        words = len(self.words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(words + len(self.grams), block, dtype=np.int32)),
                pa.array(np.arange(words + len(self.grams)) < words),
                pa.array(np.concatenate([_hash(list(self.words)), self.grams])),
                pa.array(np.concatenate([np.fromiter(self.words.values(), np.int64, words), self.counts])),
            ],
            names=["block", "word", "key", "n"],
        )


def _asked_of_blocks(batches):
    """(block, word, key, n) of rows that come sorted by block."""
    current, asked = None, _Asked()
    for batch in batches:
        groups: dict[tuple[int, bool], list[bytes]] = defaultdict(list)
        for block, learn, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            groups[block, learn].append((text or b"").lower())
        for (block, learn), texts in sorted(groups.items()):
            if current not in (None, block):
                yield asked.rows(current)
                asked = _Asked()
            current = block
            asked.add(texts, learn)
    if current is not None:
        yield asked.rows(current)


def _scores_of_grams(pairs: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        grams = table.column("key").to_numpy()
        scores = gram_scores(grams, table.column("n").to_numpy(), pairs)
        return pa.table({"key": pa.array(grams), "value": pa.array(scores, pa.float64())})

    return run


def _written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a third of a checkpoint's size."""
    path = f"{shared_folder(df.sparkSession)}/lm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) per row.

    Rows where ``learn`` is true train both models. Tokens are lower-cased words and one end per
    text; base_score is the sum of log10((c + 1) / (N + V + 1)), score the byte model's log10
    probability of the lower-cased text with its end.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(learn & F.col(id_col).isNotNull(), F.lit(False)).alias("learned"),
        F.col(text_col).cast("binary").alias("text"),
    )
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("learned").alias("texts")).first()
    blocks = max(1, -(-(sizes["bytes"] or 0) // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    asked = _written(
        dealt.select("block", "learned", "text").repartition("block").sortWithinPartitions("block")
        .mapInArrow(_asked_of_blocks, "block int, word boolean, key long, n long")
    )
    totals = _written(asked.groupBy("word", "key").agg(F.sum("n").alias("n")))
    grams = totals.where("not word").select("key", "n")
    known = totals.where("word and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = int(sizes["texts"])
    n, v = int(known["n"] or 0) + texts, int(known["v"]) + (texts > 0)

    pairs = np.zeros((256, 256), dtype=np.int64)
    for r in grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    parts = max(1, -(-grams.count() // GRAMS_AT_ONCE))
    of_ending = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(parts))
    scored = grams.groupBy(of_ending.alias("ending")).applyInArrow(_scores_of_grams(pairs), "key long, value double")
    values = totals.where("word").select("word", "key", F.col("n").cast("double").alias("value")).union(
        scored.select(F.lit(False).alias("word"), "key", "value")
    )
    fetched = asked.select("block", "word", "key").join(values, ["word", "key"])

    def score(_, own: pa.Table, fetched: pa.Table) -> pa.Table:
        whole = [(t or b"").lower() for t in own.column("text").to_pylist()]
        keys, found = fetched.column("key").to_numpy(), fetched.column("value").to_numpy()
        is_word = fetched.column("word").to_numpy()
        of_word, counts = Lookup(keys[is_word]), found[is_word]
        of_gram, gram_values = Lookup(keys[~is_word]), found[~is_word]
        place: dict[bytes, int] = {}
        logs, seen = np.zeros(0), np.zeros(0, dtype=bool)
        tokens, knowns, bases, scores = [], [], [], []
        for part in in_portions(whole, _TEXT_AT_ONCE):
            split = [whole[i].split() for i in part]
            fresh = list(set().union(*split).difference(place))
            if fresh:
                own_counts = counts[of_word(_hash(fresh))]
                place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
                logs, seen = np.append(logs, np.log10(own_counts + 1.0)), np.append(seen, own_counts > 0)
            for own_words in split:
                at = np.fromiter(map(place.__getitem__, own_words), np.int64, len(own_words))
                tokens.append(len(at) + 1)
                knowns.append(int(seen[at].sum()) + (texts > 0))
                bases.append(float(logs[at].sum() + np.log10(texts + 1.0) - (len(at) + 1) * np.log10(n + v + 1.0)))
            scores += text_scores([whole[i] for i in part], of_gram, gram_values).tolist()
        return pa.table(
            {
                "id": own.column("id"), "learned": own.column("learned"), "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(knowns, pa.int64()), "train_tokens": pa.array([n] * len(tokens), pa.int64()),
                "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64()),
            }
        )

    return (
        dealt.groupBy("block")
        .cogroup(fetched.groupBy("block"))
        .applyInArrow(
            score,
            f"id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
