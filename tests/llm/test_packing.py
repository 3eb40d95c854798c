import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from llm_rows import doc_rows, docs_frame
from tokenizers import Tokenizer

from lodgeframe.llm import packing

SPEC = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_str(SPEC.decode())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_words_alone_give_the_same_ids(library):
    encoder = packing.WordEncoder(SPEC, remembered=5)
    texts = [t or "" for _, t, _ in doc_rows()] + [
        "a\x0bb", "J̌ x", "İA", "Σας ΟΔΟΣ", "don't 's 12 3,4 it's.", "x<|endoftext|>y", "a b a\x1fb a\x85b", "é, ́e", "ſ. ß.", "'m. abc., a.b,", "naïve, É,t",
    ]
    for text in texts:
        assert np.frombuffer(encoder.encode([text.encode()])[0], dtype="<u4").tolist() == library(text)


def test_plain_words_skip_the_tokenizers_steps(library):
    """Marks, digits, accents and apostrophes are told apart without the whole tokenizer; each distinct odd word takes it once."""
    encoder = packing.WordEncoder(SPEC)
    whole, sent = encoder.tokenizer, []

    class Counting:
        def encode(self, text, **options):
            sent.append(text)
            return whole.encode(text, **options)

    encoder.tokenizer = Counting()
    texts = ["theatition### well.*** don't l'été, ÉTÉ! 3rd 'twas", "étionnevi.%%% üung, a-b (c) çoupa&&& theatition###"]
    ids = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in ids] == [library(t) for t in texts]
    assert sent == []
    ids = encoder.encode(["— a — b".encode(), "c —".encode()]) + encoder.encode(["—".encode()])
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in ids] == [library(t) for t in ("— a — b", "c —", "—")]
    assert sent == ["—"]


def test_every_letter_gives_the_tokenizers_ids(library):
    texts = [t for c in map(chr, range(0x400)) for t in (c, f"a{c}b É{c},", f"N{c}1 .{c} '{c}")]
    found = packing.WordEncoder(SPEC).encode([t.encode() for t in texts])
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in found] == [library(t) for t in texts]


@pytest.mark.parametrize("window, open_windows", [(2048, 16), (64, 3), (1, 1)])
def test_each_token_is_in_one_piece(spark, library, window, open_windows):
    rows = [r for r in doc_rows() if window > 1 or r[0] != 1007]
    docs = docs_frame(spark, rows).repartition(5)
    found = packing.pack(docs, SPEC, window=window, open_windows=open_windows).collect()
    expected = defaultdict(list)
    for i, text, _ in rows:
        expected[i].append([*library(text or ""), 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(expected)
    for i, texts in expected.items():
        pieces = by_doc[i]
        assert sum(r["length"] for r in pieces) == sum(map(len, texts))
        for r in pieces:
            crcs = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for t in texts if len(t) == r["doc_tokens"]}
            assert r["ids_crc32"] in crcs and 0 < r["length"] <= window
        if len(texts) == 1:
            assert [r["start"] for r in sorted(pieces, key=lambda r: r["start"])] == np.cumsum([0] + [r["length"] for r in sorted(pieces, key=lambda r: r["start"])])[:-1].tolist()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == ends[:-1].tolist()
        assert ends[-1] <= window and ends[-1] & (ends[-1] - 1) == 0  # no sequence needs padding


def test_best_fit():
    windows = packing.OpenWindows(10, 2)
    size = lambda n: np.zeros(n, dtype="<u4")
    windows.add("a", size(6))
    windows.add("b", size(7))
    windows.add("c", size(3))  # fits best with b
    assert [[p[0] for p in w] for w in windows.take_full()] == [["b", "c"]]
    windows.add("d", size(8))
    windows.add("e", size(5))  # fits nowhere: tops up d, the fullest, and goes on with a
    assert [[(p[0], len(p[2])) for p in w] for w in windows.take_full()] == [[("d", 8), ("e", 2)]]
    assert sorted(w[0] for w in windows.open) == [9]


def test_large_ids_beside_a_null_stay_whole(spark):
    rows = [[2**53 + 1, "one two", "en"], [None, "three", "en"], [2**53 + 3, None, None]]
    found = packing.pack(docs_frame(spark, rows).coalesce(1), SPEC).collect()
    assert {r["id"] for r in found} == {2**53 + 1, 2**53 + 3, None}


def test_empty_table_and_window(spark):
    assert packing.pack(docs_frame(spark, []), SPEC).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_frame(spark, []), SPEC, window=100)
