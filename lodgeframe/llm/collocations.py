"""Phrase collocations from a weighted de Bruijn graph of words.

Pieces of text are walks through a graph whose edges are the longest phrases (five words) and whose
nodes are the phrases of one word less. Only edges are counted, and how often a walk ends with each
shorter phrase. A node occurs as often as its edges to longer phrases plus the walks that end with
it; with the same two terms the counts of nodes give those of the phrases one word shorter, down to
single words. Unary paths, on which every occurrence of a node comes in by one edge and leaves by
one, are kept as one row with one count.

A phrase that occurs ``least`` times has no rarer part. Pairs, and then the longer phrases whose pairs
passed, are first counted in hashed buckets, and a walk ends before the first word that
makes its phrase one of a bucket below ``least``: that changes no count of a phrase that occurs often
enough, as each place of the text still counts once, for the longest phrase that begins there. The
bits of frequent buckets, 32 MB a table at most whatever the corpus's size, are broadcast.

Bad and odd input: a null or empty text has no pieces, a null language is ``und``. Repeated rows
count as often as they occur. An empty table, or one without a phrase that is frequent enough, gives
an empty table. Only the named columns are read, so extra columns don't matter. Texts are taken whole.
"""

from __future__ import annotations

import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.llm.packing import in_portions
from lodgeframe.session import cut_lineage

LEAST = 100
LONGEST = 5
FIRST = 2000
UNKNOWN = "und"
#: Bytes of text per bucket of phrases, and how many bits number the buckets at least and at most.
BYTES_PER_BUCKET = 64
BUCKET_BITS = (16, 28)
_TEXT_AT_ONCE = 8 << 20
#: Rows of the graph that are compacted together.
_ROWS_AT_ONCE = 1 << 16
_BREAK = b"\xff"  # no UTF-8 text holds this byte
_FOLD = bytes.maketrans(
    string.ascii_uppercase.encode() + b".,;:!?\n\v\f\r\t", string.ascii_lowercase.encode() + _BREAK * 10 + b" "
)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Walk:
    """Words of many pieces in one array: their numbers (-1 between pieces), names and hashes."""

    def __init__(self, lang: str, texts: list[bytes]):
        words = _BREAK.join(texts).translate(_FOLD).replace(_BREAK, b" " + _BREAK + b" ").split()
        self.names = list(dict.fromkeys(words))
        numbers = dict(zip(self.names, range(len(self.names))))
        self.at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        digest, salt = xxhash.xxh64_intdigest, lang.encode() + b"\0"
        self.hashes = np.array([digest(salt + w) for w in self.names], dtype=np.uint64)
        if _BREAK in numbers:
            self.at[self.at == numbers[_BREAK]] = -1

    def phrases(self, longest: int):
        """For each size: the hash of the phrase at each place, and whether it stands in one piece."""
        words, inside = self.hashes[self.at], self.at >= 0
        own, whole = words, inside
        yield own, whole
        for size in range(2, longest + 1):
            own, added = own[:-1], words[size - 1 :]
            own = (own * _ODD[0] ^ added >> np.uint64(29)) * _ODD[1] + added
            own = (own ^ own >> np.uint64(32)) * _ODD[0]
            whole = whole[:-1] & inside[size - 1 :]
            yield own, whole


def _walks(batch):
    """The batch's texts by language, in portions."""
    by_lang: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            by_lang[lang].append(text)
    for lang, texts in by_lang.items():
        for portion in in_portions(texts, _TEXT_AT_ONCE):
            yield lang, Walk(lang, [texts[i] for i in portion])


def _held(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the hashes' buckets are frequent."""
    bucket = hashes >> np.uint64(64 - bits)
    return (table[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63)) & np.uint64(1)).astype(bool)


def _paired(table: np.ndarray, walk: Walk, bits: int, longest: int):
    """For each size its hashes, and the places where all pairs of the phrase are in frequent buckets."""
    reached = pairs = None
    for size, (own, whole) in enumerate(walk.phrases(longest), 1):
        if size == 1:
            reached = whole
        elif size == 2:
            reached = pairs = whole & _held(table, own, bits)
        else:
            reached = reached[:-1] & pairs[size - 2 :]
        yield own, reached


def _frequent_buckets(rows: DataFrame, bits: int, least: int, longest: int, pairs: np.ndarray | None) -> np.ndarray:
    """One bit per bucket of phrases: of pairs, or of longer phrases, given the table of pairs.

    At most 4,194,304 longs are collected.
    """
    known = rows.sparkSession.sparkContext.broadcast(pairs)

    def count(batches):
        for batch in batches:
            for _, walk in _walks(batch):
                if known.value is None:
                    found = [own[whole] for own, whole in walk.phrases(2)][1:]
                else:
                    found = [own[reached] for own, reached in _paired(known.value, walk, bits, longest)][2:]
                for own in found:
                    bucket, n = np.unique(own >> np.uint64(64 - bits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n)], names=["bucket", "n"])

    often = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    longs = (
        often.groupBy(F.shiftright("bucket", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bucket & 63 AS INT))")).alias("own"))
        .toPandas()
    )
    table = np.zeros(max(1, (1 << bits) // 64), dtype=np.int64)
    table[longs["at"].to_numpy()] = longs["own"].to_numpy()
    return table.view(np.uint64)


def _grams(walk: Walk, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A start of each distinct phrase of that many words, and how often it occurs."""
    code = walk.at[starts]
    for k in range(1, size):
        code = np.unique(code * len(walk.names) + walk.at[starts + k], return_inverse=True)[1]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return starts[first], n


def _graph_rows(walk: Walk, tables: tuple[np.ndarray, np.ndarray], bits: int, longest: int):
    """Columns k, key, gram, last and n: how often the longest phrase at a place is each of k words.

    Those of ``longest`` words are edges, by their first node and last word; shorter ones are ends of
    walks. key is the least pair hash of a node, which neighbouring nodes often share.
    """
    size_at = np.zeros(len(walk.at), dtype=np.int64)
    pairs = np.zeros(0, dtype=np.uint64)
    for size, (own, reached) in enumerate(_paired(tables[0], walk, bits, longest), 1):
        if size == 2:
            pairs = own
        place = np.flatnonzero(reached & (size_at[: len(reached)] == size - 1))
        if size > 2:
            place = place[_held(tables[1], own[place], bits)]
        size_at[place] = size
    text = walk.names
    for k in range(1, longest + 1):
        starts, n = _grams(walk, np.flatnonzero(size_at == k), k)
        ids = [walk.at[starts + j].tolist() for j in range(k)]
        grams = [b" ".join([text[i] for i in own]) for own in zip(*ids[: longest - 1])]
        key = np.zeros(len(starts), dtype=np.uint64)
        if k >= longest - 1:
            key = np.min([pairs[starts + j] for j in range(longest - 2)], axis=0)
        yield k, key.view(np.int64), grams, [text[i] for i in ids[-1]] if k == longest else [None] * len(starts), n


_ROW = "k int, key long, lang string, gram binary, last binary, n long"


def _count_edges(rows: DataFrame, least: int, longest: int) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    low, high = BUCKET_BITS
    bits = min(high, max(low, (size // BYTES_PER_BUCKET).bit_length()))
    short = _frequent_buckets(rows, bits, least, longest, None)
    long = _frequent_buckets(rows, bits, least, longest, short)
    shared = rows.sparkSession.sparkContext.broadcast((short, long))

    def count(batches):
        for batch in batches:
            for lang, walk in _walks(batch):
                for k, key, grams, last, n in _graph_rows(walk, shared.value, bits, longest):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), k, dtype=np.int32)), pa.array(key), pa.array([lang] * len(n), pa.string()),
                            pa.array(grams, pa.binary()), pa.array(last, pa.binary()), pa.array(n),
                        ],
                        names=["k", "key", "lang", "gram", "last", "n"],
                    )

    counted = rows.mapInArrow(count, _ROW).groupBy("k", "key", "lang", "gram", "last").agg(F.sum("n").alias("n"))
    return counted.withColumns({c: F.col(c).cast("string") for c in ("gram", "last")})


def compact(edges: list[tuple[str, str, str | None, int]]) -> list[tuple[str, str, int, int]]:
    """Rows (lang, words, edges, count) for edges and piece ends (lang, node, last word or None, count).

    A row with edges is a unary path; one with none is a node that isn't inside a path, with its
    count: all edges from it plus the pieces that end with it.
    """
    total: dict[tuple[str, str], int] = defaultdict(int)
    sole: dict[tuple[str, str], int | None] = {}
    for i, (lang, node, last, n) in enumerate(edges):
        total[lang, node] += n
        sole[lang, node] = i if last is not None and (lang, node) not in sole else None

    def joint(i: int) -> int | None:
        """The edge that takes on every occurrence of edge i and no other one."""
        lang, node, last, n = edges[i]
        ahead = (lang, f"{node.partition(' ')[2]} {last}")
        return sole.get(ahead) if total.get(ahead) == n else None

    paths = [i for i, e in enumerate(edges) if e[2] is not None]
    following = {i: after for i in paths if (after := joint(i)) is not None}
    inner = set(following.values())
    out = []
    for i in paths:
        if i not in inner:
            lang, node, last, n = edges[i]
            words, at = [node, last], i
            while (at := following.get(at)) is not None:
                words.append(edges[at][2])
            out.append((lang, " ".join(words), len(words) - 1, n))
    hidden = {edges[i][:2] for i in inner}
    return out + [(*node, 0, n) for node, n in total.items() if node not in hidden]


def _compacted(edges: DataFrame) -> DataFrame:
    """Paths and nodes of the whole graph: a task sees the complete nodes of a stretch of keys at a time."""

    def run(batches):
        held: list[tuple] = []

        def flush(rows):
            lang, words, size, n = zip(*compact(rows)) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(words, pa.string()), pa.array(size, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "words", "edges", "n"],
            )

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)))
            if len(held) >= _ROWS_AT_ONCE and held[0][:2] != held[-1][:2]:
                cut = len(held) - 1
                while held[cut - 1][:2] == held[-1][:2]:
                    cut -= 1
                yield flush(held[:cut])
                held = held[cut:]
        if held:
            yield flush(held)

    ordered = edges.repartition("key").sortWithinPartitions("key", "lang", "gram")
    return ordered.select("lang", "gram", "last", "n").mapInArrow(run, "lang string, words string, edges long, n long")


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, words) in all."""
    if longest < 3 or least < 1:
        raise ValueError("a node of the graph needs two words, and a count one occurrence")
    rows = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counted = cut_lineage(_count_edges(rows, least, longest))
    graph = cut_lineage(_compacted(counted.where(F.col("k") >= longest - 1)))
    node = longest - 1
    nodes = graph.where("edges = 0").select("lang", F.col("words").alias("phrase"), "n")
    path = graph.where("edges > 0").withColumn("w", F.split("words", " "))

    def windows(size: int, first: int, last: str) -> DataFrame:
        at = F.explode(F.expr(f"transform(sequence({first}, CAST({last} AS INT)), i -> array_join(slice(w, i, {size}), ' '))"))
        return path.where(f"{last} >= {first}").select("lang", at.alias("phrase"), "n")

    found = {longest: windows(longest, 1, "edges").where(F.col("n") >= least)}
    found[node] = windows(node, 2, "edges").union(nodes)
    for k in range(node - 1, 0, -1):
        flow = found[k + 1].select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "n")
        ends = counted.where(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), "n")
        found[k] = flow.union(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    listed = [df.where(F.col("n") >= least).select("lang", F.lit(k).alias("k"), "phrase", "n") for k, df in found.items()]
    every = listed[0]
    for df in listed[1:]:
        every = every.union(df)
    return cut_lineage(every), counted.groupBy("lang").agg(F.sum("n").alias("words"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    first: int = FIRST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    a, l and r count the phrase and its two parts at the cut of the lowest score, n all words;
    score is floor(1000 * a * n / (l * r)) in exact decimals. A phrase inside a longer one that
    occurs as often is left out.
    """
    known, totals = phrase_counts(docs, text_col, lang_col, least, longest)
    phrases = known.where("k > 1")
    part = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("own"))
    cut = phrases.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cut = cut.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")}
    )
    scored = (
        cut.join(part.select("lang", F.col("part").alias("left"), F.col("own").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("part").alias("right"), F.col("own").alias("r")), ["lang", "right"])
        .join(totals.withColumnRenamed("words", "n"), "lang")
        .withColumn(
            "score",
            F.expr("CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000BD DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"),
        )
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    )
    inside = F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = (
        known.where("k > 2").select("lang", "n", F.explode(inside).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    )
    left = scored.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (
        left.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
