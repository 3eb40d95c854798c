"""SimHash near-duplicates, compared on vertical bit planes with carry-save counters.

Bad and odd input: a null text counts as an empty one, and texts without words share the
fingerprint zero. A null ``doc_id`` never becomes a component's id unless the whole component has
none. Repeated rows come back once each. An empty table gives an empty table. Only the named
columns are read, so extra columns don't matter.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.components import connected_components, join_sets
from lodgeframe.session import cut_lineage

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
#: Rows of one bucket that are compared in one piece; larger buckets are cut into slices that meet pairwise.
SLICE_ROWS = 4096
#: Rows held by a task at a time.
CHUNK_ROWS = 16384
#: 64-lane words whose counters are advanced together.
WORDS_AT_ONCE = 32768
_HASHES_AT_ONCE = 100_000


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority of each bit over the hashes of all word shingles, ASCII-lower-cased; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    if len(words) <= size:
        pairs = [(0, len(joined))]
    else:
        pairs = zip([0, *ends[:-size]], (e - 1 for e in ends[size - 1 :]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in pairs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at : at + _HASHES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp): the fingerprint as a signed long, and a hash that tells rows of one id apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            marks = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks)], names=["id", "text_key", "fp"]
            )

    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(run, f"id {kind}, text_key long, fp long")


def planes(marks: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of row b is bit b of the i-th mark. Two zero words stand at the end."""
    room = -(-len(marks) // 64) * 64
    padded = np.zeros(room, dtype="<u8")
    padded[: len(marks)] = marks
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.concatenate([packed, np.zeros((64, 2), dtype="<u8")], axis=1)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than the radius."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def close_pairs(marks: np.ndarray, ends: np.ndarray, radius: int = RADIUS):
    """Yields (i, j), i < j < ends[i], of marks that differ in at most radius bits.

    ends[i] is the end of i's bucket. A word of 64 neighbours is compared with the word some shift
    away, one bit plane after the other: the differing bits of all 64 pairs go through full adders
    into bit-sliced counters, and a word is abandoned once each of its pairs is beyond the radius.
    """
    n = len(marks)
    table = planes(marks)
    reach = np.zeros(table.shape[1] * 64 - 128, dtype=np.int64)
    reach[:n] = ends - np.arange(n)
    reach = reach.reshape(-1, 64)
    shifts = np.maximum(reach.max(axis=1) - 1, 0)
    starts = np.cumsum(shifts) - shifts
    total = int(shifts.sum())
    depth = max(4, (radius + 8).bit_length())
    for at in range(0, total, WORDS_AT_ONCE):
        index = np.arange(at, min(at + WORDS_AT_ONCE, total))
        word = np.searchsorted(starts, index, side="right") - 1
        shift = index - starts[word] + 1
        alive = np.packbits(reach[word] > shift[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        far, by = word + (shift >> 6), (shift & 63).astype(np.uint64)
        counter = [np.zeros(len(word), dtype=np.uint64) for _ in range(depth)]

        def differ(b):
            row = table[b]
            return row[word] ^ (row[far] >> by | row[far + 1] << (np.uint64(64) - by))

        for b in range(0, 64, 2):
            one, two = differ(b), differ(b + 1)
            half = counter[0] ^ one
            carry = counter[0] & one | half & two
            counter[0] = half ^ two
            for k in range(1, depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if b % 8 == 6:
                alive &= ~_above(counter, radius)
                left = np.flatnonzero(alive)
                if len(left) < len(alive):
                    word, far, by, shift, alive = word[left], far[left], by[left], shift[left], alive[left]
                    counter = [c[left] for c in counter]
                if not len(left):
                    break
        if len(alive):
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(lanes)
            left = word[which] * 64 + lane
            yield left, left + shift[which]


def _forest(marks: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs: each mark that has a smaller-indexed root, and that root."""
    parent = np.arange(len(marks))
    for left, right in close_pairs(marks, ends, radius):
        parent = join_sets(parent, left, right)
    hung = np.flatnonzero(parent != np.arange(len(marks)))
    return marks[hung], marks[parent[hung]]


def _links_in_buckets(radius: int):
    def run(frames):
        names = ["src", "dst"]

        def links(group, mark):
            edge = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
            ends = edge[np.searchsorted(edge, np.arange(len(mark)), side="right")]
            src, dst = _forest(mark.view(np.uint64), ends, radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=names)

        group = np.zeros(0, dtype=np.int64)
        mark = np.zeros(0, dtype=np.int64)
        for batch in frames:
            group = np.append(group, batch.column(0).to_numpy())
            mark = np.append(mark, batch.column(1).to_numpy())
            while len(group) >= CHUNK_ROWS and group[0] != group[-1]:
                cut = int(np.searchsorted(group, group[min(CHUNK_ROWS, len(group)) - 1]))
                cut = cut or int(np.searchsorted(group, group[0], side="right"))
                yield links(group[:cut], mark[:cut])
                group, mark = group[cut:], mark[cut:]
        if len(group):
            yield links(group, mark)

    return run


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): spanning links of all pairs of distinct marks (column fp) within the radius.

    A pair within the radius agrees on one of radius + 1 bit ranges, so each mark goes to one bucket
    per range. Buckets with more than SLICE_ROWS marks are cut into slices, and each pair of slices
    is a group of its own. Within a group only a spanning forest leaves the task, never all pairs.
    """
    ranges = radius + 1
    cuts = [64 * k // ranges for k in range(ranges + 1)]
    keys = [
        F.struct(
            F.lit(k).alias("range"),
            F.shiftrightunsigned("fp", cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1).alias("key"),
        )
        for k in range(ranges)
    ]
    dealt = marks.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.range", "b.key")
    large = (
        dealt.groupBy("range", "key").count().where(F.col("count") > SLICE_ROWS)
        .select("range", "key", F.ceil(F.col("count") / SLICE_ROWS).cast("int").alias("slices"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    grouped = (
        dealt.join(large, ["range", "key"], "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .where("slices = 1 or own <> other")
        .select(
            F.xxhash64("range", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"),
            "fp",
        )
    )
    return (
        grouped.repartition("bucket").sortWithinPartitions("bucket", "fp")
        .mapInArrow(_links_in_buckets(radius), "src long, dst long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(id, text_key, fp, component, component_id) per row of docs.

    component_id is the smallest id reachable over fingerprints that differ in at most radius bits.
    Copies share a fingerprint and are compared once.
    """
    rows = cut_lineage(with_fingerprints(docs, id_col, text_col))
    marks = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    found = connected_components(near_links(marks.select("fp"), radius))
    named = marks.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("id", "text_key", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest id stays.

    Rows without an id only stay where no row of the component has one; rows equal in id and text
    count as one.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("text_key"))).alias("w"))
    first = first.select(F.col("w.id").alias("id"), F.col("w.text_key").alias("text_key"))
    # The whole row is one column here, so no name of docs meets one of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_key"))
    kept = rows.join(first, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_key"]).select("row.*")
