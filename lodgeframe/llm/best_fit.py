"""Best-fit packing planned on a histogram of lengths.

Documents longer than a window are cut into full windows, of which the first may be shorter. What
is packed are lengths, not documents: the histogram has at most ``window`` rows whatever the
corpus's size, and best fit in falling order of length works on counts of equal bins, so its steps
grow with the window alone. The plan is a list of slots: so many pieces of one length, so many to a
sequence, from this sequence on. A piece takes the slot of its rank among the pieces of its length.
Ranks come from counts per length and task, so no task orders the pieces of a frequent length.

Bad and odd input: a null or empty text is the end token alone. Repeated rows and repeated or null
ids are documents of their own. An empty table gives an empty table. Only the named columns are
read, so extra columns don't matter. A very long text is cut like any other; one document's ids
must fit in memory.
"""

from __future__ import annotations

import os
import re
import string
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.llm.packing import Remembered, in_portions
from lodgeframe.session import cut_lineage

WINDOW = 1024
END_ID = 2
#: Segments whose ids a worker remembers before it forgets those it did not meet lately.
REMEMBERED_SEGMENTS = 400_000
#: Letters up to Latin Extended-B, ASCII without its separators: texts of these alone are cut bytewise.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNCOMMON = re.compile(f"[^\\t-\\r -~{_LATIN}]")
_LETTERS = re.compile(f" ?[{_LATIN}]+")
_FIRST = frozenset(" " + string.ascii_letters)
_LONGEST = 24  # bytes of a segment that is compared as three integers
_TEXT_AT_ONCE = 8 << 20


def _byte_class(chars: bytes) -> np.ndarray:
    own = np.zeros(256, dtype=bool)
    own[list(chars)] = True
    return own


_SPACE, _MARK = _byte_class(b" \t\n\v\f\r"), _byte_class(b" .,;:!?\n\0")
_LETTER = _byte_class(string.ascii_letters.encode() + bytes(range(128, 256)))
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for k in range(3)] for n in range(_LONGEST + 1)], dtype="<u8")


def cuts(flat: np.ndarray) -> np.ndarray:
    """Where segments start in zero-separated common texts (flat begins and ends with zero).

    The tokenizer's splitting rule cuts at each of these places, whatever stands around: before white
    space behind anything else, between letters and a common mark, and behind a lone line end.
    """
    space, letter, zero = _SPACE[flat], _LETTER[flat], flat == 0
    start = zero.copy()
    start[1:] |= zero[:-1] | space[1:] & ~space[:-1] | letter[:-1] & _MARK[flat[1:]]
    start[2:] |= (flat[1:-1] == 10) & ~space[:-2] & ~space[2:]
    return np.flatnonzero(start)


class SegmentEncoder:
    """Ids of texts as a byte-level tokenizer file gives them by the library's defaults, with remembered segments.

    Common texts are cut where the tokenizer's splitting rule always cuts, and the distinct segments
    of many texts are looked up once. A word of plain letters is one piece for that rule and goes to
    the model directly; other segments, and texts with uncommon characters, take the library's way.
    """

    def __init__(self, spec: bytes, remembered: int = REMEMBERED_SEGMENTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(32, 127)}
        for b in range(0xC3, 0xCA):  # first bytes of the two-byte letters, and all second bytes
            for second in range(128, 192):
                shown[b], shown[second] = level.pre_tokenize_str(bytes([b, second]).decode())[0][0]
        self.shown = shown
        self.ids = Remembered(self._of_segment, remembered)

    def _of_segment(self, segment: bytes) -> bytes:
        text = segment.decode()
        if segment.isascii() and text[0] in _FIRST and text[1:].isalpha():
            shown = "Ġ" + text[1:] if text[0] == " " else text
        elif _LETTERS.fullmatch(text):
            shown = segment.decode("latin-1").translate(self.shown)
        else:
            return self.whole(text)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def whole(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, by the library alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _distinct(self, blob: bytes, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each start's segment among the distinct segments, and these."""
        sizes = np.diff(starts, append=len(flat) - 1)
        at_each_byte = np.ndarray(len(flat) - 1, dtype="<u8", buffer=blob + bytes(32), strides=(1,))
        short = np.minimum(sizes, _LONGEST)
        words = [at_each_byte[np.minimum(starts + 8 * k, len(flat) - 2)] & _MASKS[short, k] for k in range(3)]
        mixed = (words[0] * np.uint64(0x9E3779B97F4A7C15) ^ words[1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[2]
        mixed[sizes > _LONGEST] = 0  # told apart one by one below
        order = np.argsort(mixed)
        ordered = [w[order] for w in words]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([w[1:] != w[:-1] for w in ordered], axis=0)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        found = [blob[s : s + n] for s, n in zip(starts[first].tolist(), sizes[first].tolist())]
        other: dict[bytes, int] = {}
        for i in np.flatnonzero(sizes > _LONGEST).tolist():
            segment = blob[starts[i] : starts[i] + sizes[i]]
            number[i] = other.setdefault(segment, len(found) + len(other))
        return number, found + list(other)

    def _encode_common(self, texts: list[bytes]) -> list[bytes]:
        blob = b"\0" + b"".join(t + b"\0" for t in texts)
        flat = np.frombuffer(blob, dtype=np.uint8)
        starts = cuts(flat)[:-1]
        number, distinct = self._distinct(blob, flat, starts)
        of = self.ids.__getitem__
        ids = [of(s) if s[0] else b"" for s in distinct]
        sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        count = sizes[number]
        ends = np.cumsum(count)
        source = np.repeat((np.cumsum(sizes) - sizes)[number] - ends + count, count)
        tokens = pool[source + np.arange(len(source))]
        edges = np.append(ends - count, ends[-1])[np.append(np.flatnonzero(flat[starts] == 0), len(starts))]
        return [tokens[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        self.ids.tidy()
        out = [b"" if t == "" else self.whole(t) if _UNCOMMON.search(t) else None for t in texts]
        common = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(common, self._encode_common([texts[i].encode() for i in common]) if common else ()):
            out[i] = ids
        return out


def encoder(spec: bytes) -> SegmentEncoder:
    """The worker's encoder for this tokenizer file. It outlives the task, as this module may not."""
    kept = vars(sys).setdefault("_segment_encoders", {})
    key = zlib.crc32(spec)
    if key not in kept:
        kept.clear()
        kept[key] = SegmentEncoder(spec)
    return kept[key]


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, pieces, pieces a sequence, first sequence, offset) for that many pieces of each length.

    Best fit, longest first: a piece goes to the fullest sequence with room for it. Sequences of
    equal room are handled together. Filling one leaves less than half of its room, so a group is
    used at most log2(window) times, and a length splits at most one group in three.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
    made = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(room: int, first: int, sequences: int, each: int) -> None:
            nonlocal rank, left
            slots.append((length, rank, sequences * each, each, first, window - room))
            rank, left = rank + sequences * each, left - sequences * each
            if room > each * length:
                free.setdefault(room - each * length, []).append((first, sequences))

        for room in sorted(r for r in free if r >= length):
            most = room // length
            groups, free[room] = free.pop(room), []
            for first, sequences in groups:
                full = min(sequences, left // most)
                if full:
                    fill(room, first, full, most)
                if full < sequences and left:
                    fill(room, first + full, 1, left)
                    full += 1
                if full < sequences:
                    free[room].append((first + full, sequences - full))
            if not free[room]:
                del free[room]
            if not left:
                break
        most = window // length
        for sequences, each in ((left // most, most), (1, left % most)):
            if sequences and each:
                fill(window, made, sequences, each)
                made += sequences
    return sorted(slots)


def cut_up(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows behind a first piece that may be shorter."""
    first = total % window or window
    return [(0, first)] + [(at, window) for at in range(first, total, window)]


def pack(
    docs: DataFrame,
    spec: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    spec is the tokenizer file's content. Texts are encoded once; the pieces, without their ids, are
    written to the checkpoint folder, counted, and get their places from the plan.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32", "part", "own_rank"]
    declared = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, own_rank long"

    def pieces(batches):
        encode = encoder(shared.value)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for portion in in_portions([t or "" for t in texts], _TEXT_AT_ONCE):
                place, rows = [], []
                for i, ids in zip(portion, encode.encode([texts[i] or "" for i in portion])):
                    ids += tail
                    for number, (start, length) in enumerate(cut_up(len(ids) // 4, window)):
                        own = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        place.append(i)
                        rows.append((number, start, length, own, part, seen[length]))
                        seen[length] += 1
                table = np.array(rows, dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(place, pa.int64())), pa.array(table[:, 0], pa.int32())]
                    + [pa.array(table[:, k]) for k in range(1, len(names))],
                    names=["id", *names],
                )

    made = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, declared))
    of_task = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(plan(histogram, window), dtype=np.int64).reshape(-1, 6)
    planned = docs.sparkSession.sparkContext.broadcast(slots)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = of_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own_rank")).alias("rank")
    )

    def places(batches):
        lengths, firsts, _, each, sequences, offsets = planned.value.T
        edges = np.searchsorted(lengths, np.arange(window + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = np.zeros(len(rank), dtype=np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                low, high = edges[own], edges[own + 1]
                slot[at] = low + np.searchsorted(firsts[low:high], rank[at], side="right") - 1
            inside = rank - firsts[slot]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:5]
                + [pa.array(sequences[slot] + inside // each[slot]), pa.array(offsets[slot] + inside % each[slot] * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        places, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
