"""Packs token streams into training windows: bounded-space online packing, best fit.

Each partition keeps a fixed number of open windows. What is left of a document after its full
windows goes where it fits best; when it fits nowhere, the fullest window is topped up with its
first tokens, leaves, and the rest is placed anew. Windows still open at a partition's end are
merged in groups of partitions and cut at the window size; a group's last rest is cut into powers of
two, which need no padding.

Bad and odd input: a null or empty text is the end token alone. Repeated rows and repeated or null
ids are documents of their own. An empty table gives an empty table. Only the named columns are
read. Very long texts are cut like any other; one document's ids must fit in memory. A task holds
the words and ids of ``_TEXT_ENCODED_AT_ONCE`` bytes of texts, or of one longer text.
"""

from __future__ import annotations

import codecs
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.session import cut_lineage

WINDOW = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: Partitions whose open windows are merged together: at most 64 * 16 windows in a task.
MERGED_PARTITIONS = 64
#: Words whose ids a worker remembers before it forgets those it did not meet lately.
REMEMBERED_WORDS = 200_000
_TEXT_AT_ONCE = 4 << 20
#: Bytes of texts whose distinct words a worker looks for together.
_TEXT_ENCODED_AT_ONCE = 16 << 20

_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Remembered(dict):
    """Values computed on demand. Once ``most`` are held, those not asked for again are forgotten."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def tidy(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


#: Words that take all the tokenizer's steps: empty ones, and words with controls, names of special tokens, letters
#: that grow in lower case, or anything beyond ASCII but the letters from U+00C0 to U+02AF.
_ODD = r"^$|[^!-~\x{C0}-\x{2AF}]|<\||[\x{D7}\x{F7}\x{130}\x{23A}\x{23E}]"
#: The splitting pattern's pieces of all other words in lower case.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{C0}-\x{2AF}]+|[0-9]|[^a-z0-9\x{C0}-\x{2AF}]+)"
_PIECES_AT_ONCE = 10_000


def _joined(words: pa.Array) -> bytes:
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, " ").view(pa.binary())[0].as_py()


def _in_turn(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray):
    """The pool's stretches of these numbers one after the other, and where each ends."""
    n = sizes[which]
    ends = np.cumsum(n)
    return pool[np.repeat(starts[which] - ends + n, n) + np.arange(n.sum())], ends


class WordEncoder:
    """Ids of texts as a tokenizer file gives them.

    The tokenizer must drop white space, so that words between white space are encoded alone, split
    them as ``_PIECE`` does and mark the ends of words. The distinct pieces of all words given
    together go to the model many at a time; odd words take all the tokenizer's steps and are
    remembered. The names of special tokens within a text give those tokens, as by the library's
    defaults.
    """

    def __init__(self, spec: bytes, remembered: int = REMEMBERED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = WhitespaceSplit()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = ["\ufffe"] * 256  # undefined, for bytes that no piece holds
        shown[32] = " "
        for b in range(33, 127):
            shown[b] = level.pre_tokenize_str(chr(b))[0][0]
        for b in range(128, 192):  # second bytes of two-byte letters, then their first bytes
            shown[b] = level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1]
        for b in range(0xC3, 0xCB):
            shown[b] = level.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0]
        self.shown = "".join(shown)
        suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.pieces.get_vocab()
        if not suffix:
            raise ValueError("the tokenizer's model must mark the ends of words")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.ids = Remembered(self._of_odd, remembered)

    def _of_odd(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and where each piece's end."""
        found = [np.zeros(0, dtype="<u4")]
        for at in range(0, len(pieces), _PIECES_AT_ONCE):
            text = codecs.charmap_decode(_joined(pieces.slice(at, _PIECES_AT_ONCE)), "strict", self.shown)[0]
            found.append(np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.ends[ids]) + 1  # a piece's last token, and no other, ends a word
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer's model must mark the ends of words")
        return ids, ends

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each word's start and how many they are."""
        odd = pc.match_substring_regex(words, _ODD)
        spaced = pc.replace_substring_regex(pc.utf8_lower(words.filter(pc.invert(odd))), _PIECE, r"\1 ")
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        pieces = split.flatten().dictionary_encode()
        ids, ends = self._of_pieces(pieces.dictionary)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        ids, ends = _in_turn(ids, starts, ends - starts, pieces.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        own = list(map(self.ids.__getitem__, words.filter(odd).to_pylist()))
        first, size = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        odd = odd.to_numpy(zero_copy_only=False)
        first[~odd], size[~odd] = bounds[:-1], np.diff(bounds)
        n = np.array(list(map(len, own)), dtype=np.int64) // 4
        first[odd], size[odd] = len(ids) + np.cumsum(n) - n, n
        return np.concatenate([ids, np.frombuffer(b"".join(own), dtype="<u4")]), first, size

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.ids.tidy()
        # Names of special tokens, which hold "<|", are told apart by case.
        texts = [t.lower() if t.isascii() and b"<|" not in t else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = split.flatten().dictionary_encode()
        pool, starts, sizes = self._of_words(words.dictionary)
        which, firsts = words.indices.to_numpy(), split.offsets.to_numpy()
        out: list[bytes] = []
        for portion in in_portions(texts):
            bounds = firsts[portion.start : portion.stop + 1]
            ids, ends = _in_turn(pool, starts, sizes, which[bounds[0] : bounds[-1]])
            cuts = np.concatenate([[0], ends])[bounds - bounds[0]].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return out


def encoder(spec: bytes) -> WordEncoder:
    """The worker's encoder for this tokenizer file. It outlives the task, as this module may not."""
    kept = vars(sys).setdefault("_word_encoders", {})
    key = zlib.crc32(spec)
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(spec)
    return kept[key]


def in_portions(texts: list[bytes], most: int = _TEXT_AT_ONCE):
    """Runs of indices whose texts hold about that many bytes."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield range(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


class OpenWindows:
    """The open windows of one partition. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.open: list[list] = []  # [tokens held, pieces]
        self.full: list[list[tuple]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.full.append([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        while at < total:
            need = total - at
            fits = [w for w in self.open if w[0] + need <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
            taken = min(need, self.window - best[0])
            best[1].append((doc, at, ids[at : at + taken], total))
            best[0] += taken
            at += taken
            if best[0] == self.window:
                self.open.remove(best)
                self.full.append(best[1])

    def take_full(self) -> list[list[tuple]]:
        done, self.full = self.full, []
        return done


def _row(piece: tuple, sequence: int, offset: int) -> tuple:
    doc, start, ids, total = piece
    return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset


def _rows(sequences: list[list[tuple]], first: int):
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for piece in pieces:
            yield _row(piece, number, offset)
            offset += len(piece[2])


def cut_stream(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """The pieces one after the other in full windows; the last rest in falling powers of two."""
    total = sum(len(p[2]) for p in pieces)
    rest = total % window
    sizes = [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    out: list[list[tuple]] = []
    queue = iter(pieces)
    doc, start, ids, tokens = None, 0, np.zeros(0, dtype="<u4"), 0
    for size in sizes:
        own: list[tuple] = []
        while size:
            if not len(ids):
                doc, start, ids, tokens = next(queue)
            taken = min(size, len(ids))
            own.append((doc, start, ids[:taken], tokens))
            start, ids, size = start + taken, ids[taken:], size - taken
        out.append(own)
    return out


def pack(
    docs: DataFrame,
    spec: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    spec is the tokenizer file's content. The packed pieces are written to the checkpoint folder
    once, so that texts are encoded once though the leftovers are merged afterwards; leftovers
    carry their ids until then.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, {_PIECES}, part long, ids binary"
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encode = encoder(shared.value).encode
        part = TaskContext.get().partitionId()
        windows, made, id_type = OpenWindows(window, open_windows), part << 32, None

        def batch_of(rows, ids, id_type):
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type)]
                + [pa.array(c, pa.int64()) for c in cols[1:]]
                + [pa.array([part] * len(rows), pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            names = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for portion in in_portions(texts, _TEXT_ENCODED_AT_ONCE):
                found = encode([texts[i] for i in portion])
                for i, ids in zip(portion, found):
                    windows.add(names[i], np.frombuffer(ids + tail, dtype="<u4"))
                full = windows.take_full()
                rows = list(_rows(full, made))
                made += len(full)
                yield batch_of(rows, [None] * len(rows), id_type)
        if id_type is not None:
            left = [w[1] for w in windows.open]
            rows = list(_rows(left, 0))
            yield batch_of(rows, [p[2].tobytes() for w in left for p in w], id_type)

    packed = cut_lineage(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, columns)
    )

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in ("part", "sequence_id", "offset")])
        columns = [table.column(name).to_pylist() for name in ("start", "ids", "doc_tokens")]
        pieces = [
            (i, start, np.frombuffer(ids, dtype="<u4"), tokens) for i, (start, ids, tokens) in enumerate(zip(*columns))
        ]
        first = table.column("part")[0].as_py() // MERGED_PARTITIONS
        rows = list(zip(*_rows(cut_stream(pieces, window), (1 << 62) + (first << 32))))
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table(
            {"id": table.column("id").take(pa.array(rows[0], pa.int64()))}
            | {name: pa.array(values, pa.int64()) for name, values in zip(names, rows[1:])}
        )

    merged = (
        packed.where("ids is not null")
        .groupBy(F.floor(F.col("part") / MERGED_PARTITIONS).alias("team"))
        .applyInArrow(merge, f"id {kind}, {_PIECES}")
    )
    return packed.where("ids is null").drop("part", "ids").union(merged)
