"""Best-fit packing against one-at-a-time best fit, and against the tokenizer on whole texts."""

from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from conftest import TESTDATA
from tokenizers import Tokenizer

from lodgeframe.llm import best_fit

SPEC = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()


def one_by_one(lengths, window):
    """Rooms left after best fit in falling order, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(window - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit(counts):
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, pieces, each, first, offset in best_fit.plan(counts, 32):
        for i in range(pieces):
            held[first + i // each].append((offset + i % each * length, length))
            ranks[length].append(rank + i)
    assert {k: list(range(n)) for k, n in counts.items()} == {k: sorted(v) for k, v in ranks.items()}
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 32
    assert sorted(32 - sum(p[1] for p in v) for v in held.values()) == one_by_one(
        [k for k, n in counts.items() for _ in range(n)], 32
    )


def test_plan_grows_with_the_window_only():
    rng = np.random.default_rng(5)
    small = {k: int(n) for k, n in zip(range(1, 1025), rng.integers(1, 50, 1024))}
    large = {k: n * 1_000_003 for k, n in small.items()}
    assert len(best_fit.plan(large)) < 20_000
    used = max(first + -(-pieces // each) for _, _, pieces, each, first, _ in best_fit.plan(large))
    assert used <= 1.02 * sum(k * n for k, n in large.items()) / 1024 + 1


def test_encoder_equals_the_library():
    plain = Tokenizer.from_str(SPEC.decode())
    own = best_fit.SegmentEncoder(SPEC, 50)
    texts = [
        "", " ", "  two  spaces ", "tab\tand\nlines\r\n\n end\n", "it's we'll 'tis don't", "été déjà œuvre ſt ǅ",
        "hello <|endoftext|> there <|endoftext|>", "a b   c d", "x\x1cy \x1f z!\x1c", "Hi, you. (no) 12a b3, ...ok",
        "漢字 かな 한국어 привет", "👍🏽 ok​ zero", "\x00\x85 a\x85b", "word,word; word: 7.5% naïve. ĐIỂM ị",
    ]
    texts += ["x" * 5000 + " " + "y" * 25, "Zwölf\nNeue\n\nZeilen \n ende\n", "a" * 24 + " " + "a" * 25, "tail \n"]
    for text, ids in zip(texts, own.encode(texts)):
        assert list(np.frombuffer(ids, dtype="<u4")) == plain.encode(text, add_special_tokens=False).ids, text
    assert own.encode([]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 'sté.,\n\t \r-9")), max_size=30), max_size=4), st.text(max_size=9))
def test_encoder_on_odd_texts(texts, odd):
    own = best_fit.encoder(SPEC)
    assert own.encode([*texts, odd]) == [own.whole(t) for t in [*texts, odd]]


def check(rows, texts, window):
    plain = Tokenizer.from_str(SPEC.decode())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    lengths = []
    for key, text in texts.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        own = sorted(pieces[key], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == best_fit.cut_up(len(ids), window)
        assert [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            lengths.append(r["length"])
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= window
    assert len(sequences) == len(one_by_one(lengths, window))


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").repartition(5)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = best_fit.pack(docs, SPEC).collect()
    check(rows, texts, 1024)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(2**53 + 1, None, 1, "x"), (1, "", 2, "y"), (2, "word " * 300, 3, "z"), (3, "same", 4, "z"), (4, "same", 5, "z")],
        "doc_id long, text string, length int, part string",
    )
    check(best_fit.pack(docs, SPEC, window=64).collect(), {2**53 + 1: None, 1: "", 2: "word " * 300, 3: "same", 4: "same"}, 64)
    again = docs.where("doc_id = 3").union(docs.where("doc_id = 3")).withColumn("doc_id", docs.doc_id * None)
    rows = best_fit.pack(again, SPEC).collect()
    assert [r["id"] for r in rows] == [None, None] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 2
    assert best_fit.pack(docs.limit(0), SPEC).collect() == []


@pytest.mark.parametrize("total,expected", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_first_piece_is_the_short_one(total, expected):
    assert best_fit.cut_up(total, 8) == expected
