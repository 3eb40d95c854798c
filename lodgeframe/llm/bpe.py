"""Byte-level byte-pair encoding by ranks, and decoding.

Each piece that the split pattern finds is merged alone. A segment tree over its byte positions
holds, at the root, the leftmost lowest pair rank; a merge changes three leaves (the pair, the part
that vanishes, the live neighbour before it) and their paths to the root. Short pieces go through
many trees side by side, one numpy column each; a long piece has a tree of its own.

Bad and odd input: a null or empty text has no tokens. Control strings are ordinary text. Repeated
rows come back once each, an empty table gives an empty one, extra columns don't matter. Very long
texts and pieces are encoded whole, in time n log n.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.packing import in_portions

#: Pieces up to this many bytes are merged side by side.
SHORT_BYTES = 64
PIECES_AT_ONCE = 4096
#: Pieces whose ids a worker remembers before it forgets those it did not meet lately.
REMEMBERED_PIECES = 200_000
_TEXT_AT_ONCE = 1 << 20
_NONE = np.int64(1) << 62


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class PairRanks:
    """Rank of two neighbouring tokens' joint bytes, by the tokens' ids: an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.exact = dict(zip(keys, values))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        open_keys, open_values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        place = self._home(open_keys)
        while len(open_keys):
            free = self.keys[place] == -1
            self.keys[place[free]] = open_keys[free]
            placed = self.keys[place] == open_keys
            self.values[place[placed]] = open_values[placed]
            open_keys, open_values = open_keys[~placed], open_values[~placed]
            place = place[~placed] + 1 & len(self.keys) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or _NONE; negative ids have no rank."""
        keys = left << 32 | right
        real = (left >= 0) & (right >= 0)
        place = self._home(keys)
        found = self.keys[place]
        hit = real & (found == keys)
        out = np.where(hit, self.values[place], _NONE)
        open_ = np.flatnonzero(real & ~hit & (found != -1))
        place = place[open_]
        while len(open_):
            place = place + 1 & len(self.keys) - 1
            found = self.keys[place]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[place[hit]]
            more = ~hit & (found != -1)
            open_, place = open_[more], place[more]
        return out


def _merge_side_by_side(pairs: PairRanks, ids: np.ndarray) -> np.ndarray:
    """ids: (width, n), a piece's token ids from the top, -1 below its end. Merged in place; gone tokens are -1."""
    width, n = ids.shape
    bits = width.bit_length()
    before = np.repeat(np.arange(-1, width - 1)[:, None], n, axis=1)
    after = np.repeat(np.arange(1, width + 1)[:, None], n, axis=1)
    after[ids < 0] = width
    tree = np.full((2 * width, n), _NONE, dtype=np.int64)
    for p in range(width - 1):
        rank = pairs.look_up(ids[p], ids[p + 1])
        tree[width + p] = np.where(rank < _NONE, rank << bits | p, _NONE)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])

    def put(column, place, rank):
        node = place + width
        tree[node, column] = np.where(rank < _NONE, rank << bits | place, _NONE)
        for _ in range(bits - 1):
            node = node >> 1
            tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])

    column = np.flatnonzero(tree[1] < _NONE)
    while len(column):
        top = tree[1, column]
        place = top & (1 << bits) - 1
        ids[place, column] = top >> bits
        gone = after[place, column]
        then = after[gone, column]
        ids[gone, column] = -1
        after[place, column] = then
        put(column, gone, np.full(len(column), _NONE))
        inner = then < width
        before[then[inner], column[inner]] = place[inner]
        right = np.full(len(column), -1, dtype=np.int64)
        right[inner] = ids[then[inner], column[inner]]
        put(column, place, pairs.look_up(ids[place, column], right))
        first = before[place, column]
        has = first >= 0
        own, first = column[has], first[has]
        put(own, first, pairs.look_up(ids[first, own], ids[place[has], own]))
        column = column[tree[1, column] < _NONE]
    return ids


def _merge_alone(pairs: dict[int, int], ids: list[int]) -> list[int]:
    """The same for one long piece."""
    n = len(ids)
    size = 1 << (n - 1).bit_length()
    none = 1 << 100
    tree = [none] * (2 * size)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    get = pairs.get
    for p in range(n - 1):
        rank = get(ids[p] << 32 | ids[p + 1])
        if rank is not None:
            tree[size + p] = rank * size + p
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(place, left, right):
        rank = None if right is None else get(left << 32 | right)
        node = size + place
        tree[node] = none if rank is None else rank * size + place
        while node > 1:
            node >>= 1
            low, high = tree[2 * node], tree[2 * node + 1]
            tree[node] = low if low < high else high

    while tree[1] < none:
        rank, place = divmod(tree[1], size)
        gone = after[place]
        then = after[gone]
        ids[place], ids[gone], after[place] = rank, -1, then
        put(gone, 0, None)
        if then < n:
            before[then] = place
        put(place, rank, ids[then] if then < n else None)
        if before[place] >= 0:
            put(before[place], ids[before[place]], rank)
    return [i for i in ids if i >= 0]


class _Spelling:
    """A byte string for each id, and the joint bytes of many ids."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes one after the other, and where each id's bytes end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0)
        index += np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[index], ends


class BytePairCodec:
    """Encodes and decodes texts by a rank file and a split pattern."""

    def __init__(self, content: bytes, pattern: str, remembered: int = REMEMBERED_PIECES):
        self.ranks = read_ranks(content)
        self.pairs = PairRanks(self.ranks)
        self.split = regex.compile(pattern).findall
        self.bytes_to_id = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self.bytes_to_id[b] = self.ranks[bytes([b])]
        parts = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            parts[rank] = token
        self.tokens = _Spelling(parts)
        self.decimals = _Spelling([b"%d," % i for i in range(len(parts))])
        self.remembered, self.known, self.older = remembered, {}, {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT_BYTES:
                ids = _merge_alone(self.pairs.exact, self.bytes_to_id[list(piece)].tolist())
                out[i] = np.array(ids, dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), PIECES_AT_ONCE):
                own = rows[at : at + PIECES_AT_ONCE]
                block = np.zeros((len(own), width), dtype=np.uint8)
                sizes = np.array([len(pieces[i]) for i in own])
                inside = np.arange(width) < sizes[:, None]
                block[inside] = np.frombuffer(b"".join(pieces[i] for i in own), dtype=np.uint8)
                ids = np.where(inside, self.bytes_to_id[block], -1).T.copy()
                merged = _merge_side_by_side(self.pairs, ids).T
                live = merged >= 0
                flat = merged[live].astype("<u4").tobytes()
                ends = np.cumsum(live.sum(axis=1)) * 4
                for i, start, end in zip(own, [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = flat[start:end]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        split = [self.split(t) for t in texts]
        unknown: set[str] = set()
        for pieces in split:
            unknown.update(set(pieces).difference(self.known))
        fresh = []
        for piece in unknown:
            ids = self.older.get(piece)
            if ids is None:
                fresh.append(piece)
            else:
                self.known[piece] = ids
        self.known.update(zip(fresh, self.merge([p.encode() for p in fresh])))
        of = self.known.__getitem__
        return [b"".join(map(of, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.of(ids)[0].tobytes()


_CODECS: dict[tuple[int, str], BytePairCodec] = {}


def codec(content: bytes, pattern: str) -> BytePairCodec:
    """The worker's codec for this rank file and pattern."""
    key = (zlib.crc32(content), pattern)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(content, pattern)
    return _CODECS[key]


def _digests(codec: BytePairCodec, texts: list[str], with_ids: bool):
    """Per text: tokens, digest of the decimal ids joined by commas, digest of the decoded bytes, ids."""
    coded = codec.encode(texts)
    ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int64)
    decimals, decimal_ends = codec.decimals.of(ids)
    decoded, decoded_ends = codec.tokens.of(ids)
    decimals, decoded = memoryview(decimals), memoryview(decoded)
    at = d = t = 0
    for own in coded:
        n = len(own) // 4
        to_d, to_t = (int(decimal_ends[at + n - 1]), int(decoded_ends[at + n - 1])) if n else (d, t)
        yield (
            n,
            hashlib.sha256(decimals[d : max(d, to_d - 1)]).hexdigest(),
            hashlib.sha256(decoded[t:to_t]).hexdigest(),
            own if with_ids else None,
        )
        at, d, t = at + n, to_d, to_t


def encode_documents(
    docs: DataFrame,
    content: bytes,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) per row; ids (little-endian 32-bit) only if asked for.

    content is the rank file's content. The digests are of the decimal ids joined by commas, and of
    the bytes that decoding those ids gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = codec(shared.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for portion in in_portions(texts, _TEXT_AT_ONCE):
                rows += _digests(own, [texts[i] for i in portion], with_ids)
            n, ids_digest, decoded_digest, ids = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string())]
                + [pa.array(decoded_digest, pa.string()), pa.array(ids, pa.binary())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    )
