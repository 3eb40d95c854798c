import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_rows import doc_rows, docs_frame

from lodgeframe.llm import bpe

CONTENT = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
SIGNS = list("ab'stre ll\n\t\r\x0b\x0c\x1c\x1f\x85 　​09٣½²éñß漢한\U0001f600❤️́,.!?-_#<|>İſ") + [
    "<|endoftext|>", "   ", "'ll", "'RE", "\r\n",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(CONTENT, public_tokenizers.PATTERN, remembered=500)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(CONTENT), special_tokens={})


def ids(codec, texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(texts)]


def test_equals_the_library(codec, library):
    rng = random.Random(0)
    for size in (0, 5, 40, 200):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, size))) for _ in range(400)]
        found = ids(codec, texts)
        assert found == [library.encode_ordinary(t) for t in texts]
        assert [codec.decode(np.array(x, dtype=np.int64)).decode() for x in found] == texts


def test_long_pieces(codec, library):
    rng = random.Random(1)
    texts = ["a" * 3000, "x" * 64, "x" * 65, "abc" * 2000, "é" * 200, " " * 900, "".join(rng.choice("abcdefgh") for _ in range(4000))]
    assert ids(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_side_by_side_equals_alone(codec):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("etaonrish ") for _ in range(rng.randint(1, 64))).encode() for _ in range(300)]
    for piece, found in zip(pieces, codec.merge(pieces)):
        alone = bpe._merge_alone(codec.pairs.exact, codec.bytes_to_id[list(piece)].tolist())
        assert np.frombuffer(found, dtype="<u4").tolist() == alone


def test_odd_rows(spark, library):
    rows = doc_rows()
    found = bpe.encode_documents(docs_frame(spark, rows), CONTENT, public_tokenizers.PATTERN, with_ids=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, text, _ in rows:
        own = library.encode_ordinary(text or "")
        expected.append((i is None, i or 0, len(own), sha(",".join(map(str, own)).encode()), sha((text or "").encode())))
    assert sorted((r["id"] is None, r["id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(expected)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    assert bpe.encode_documents(docs_frame(spark, []), CONTENT, public_tokenizers.PATTERN).count() == 0
