"""Phrase collocations against counters over all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import TESTDATA
from oracle import compare, connect

from lodgeframe.llm import collocations, queries

PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
FORM = "text string, lang string, k int, key long, gram string, n int, phrase string"


def counts(rows, longest):
    found = Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in PIECES.split(lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                found.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def expected(rows, least, longest=5, first=2000):
    found = counts(rows, longest)
    total = Counter()
    for (lang, *phrase), n in found.items():
        total[lang] += n if len(phrase) == 1 else 0
    often = {p: n for p, n in found.items() if n >= least}
    hidden = set()
    for (lang, *phrase), n in often.items():
        for m in range(2, len(phrase)):
            hidden.update(
                own for i in range(len(phrase) - m + 1) if found[own := (lang, *phrase[i : i + m])] == n
            )
    out = []
    for (lang, *phrase), a in often.items():
        if len(phrase) > 1 and (lang, *phrase) not in hidden:
            cuts = []
            for k in range(1, len(phrase)):
                l, r = found[(lang, *phrase[:k])], found[(lang, *phrase[k:])]
                cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            out.append((lang, " ".join(phrase), a, l, r, total[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    listed = []
    for lang, phrase, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= first:
            listed.append((lang, ranks[lang], phrase, *rest))
    return listed


def frame(spark, rows):
    return spark.createDataFrame([(t, l, 1, 2, "g", 3, "p") for t, l in rows], FORM)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed, texts=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "cat", "sat", "on", "mat", "é", "中", "x y", "Ünd", "ab\x1cc", "new", "york", "city"]
    line = "a long line that many texts share with no change at all, and its tail"
    rows = []
    for i in range(texts):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "!? "]) for _ in range(rng.randint(0, 60)))
        rows.append((text + rng.choice(["", " " + line + " ", line, "new york city new york city new york"]), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" .. ,", "de"), ("one", "fr"), (rows[0][0], rows[0][1]), ("b b b b b b b b b b b b", "en")]


@pytest.mark.parametrize("least,longest,first", [(1, 5, 2000), (5, 5, 2000), (5, 3, 2000), (8, 4, 7), (30, 5, 2000)])
def test_equals_counters(spark, least, longest, first):
    rows = sample(least)
    got = found(collocations.collocations(frame(spark, rows).repartition(3), least=least, longest=longest, first=first))
    assert got == sorted(expected(rows, least, longest, first)) and got


def test_small_chunks_change_nothing(spark, monkeypatch):
    rows = sample(7, 120)
    monkeypatch.setattr(collocations, "_ROWS_AT_ONCE", 3)
    monkeypatch.setattr(collocations, "_TEXT_AT_ONCE", 100)
    monkeypatch.setattr(collocations, "BUCKET_BITS", (3, 3))
    assert found(collocations.collocations(frame(spark, rows), least=4)) == sorted(expected(rows, 4))


def test_paths_are_compacted():
    edges = [("en", "a b c d", "e", 3), ("en", "b c d e", "f", 3), ("en", "c d e f", None, 3), ("en", "a b c d", None, 1)]
    assert sorted(collocations.compact(edges)) == [
        ("en", "a b c d", 0, 4), ("en", "a b c d e f", 2, 3), ("en", "c d e f", 0, 3)
    ]
    apart = [("en", "a b c d", "e", 3), ("en", "b c d e", "f", 2), ("en", "b c d e", None, 1)]
    assert sorted(collocations.compact(apart)) == [
        ("en", "a b c d", 0, 3), ("en", "a b c d e", 1, 3), ("en", "b c d e", 0, 3), ("en", "b c d e f", 1, 2)
    ]


def test_counts_beyond_64_bits(spark):
    """The score's products pass 64 bits when counts do not."""
    rows = [("big deal", "en")] * 7
    known = collocations.phrase_counts(frame(spark, rows), least=1)[0].collect()
    assert sorted((r["k"], r["phrase"], r["n"]) for r in known) == [(1, "big", 7), (1, "deal", 7), (2, "big deal", 7)]
    a, n, l, r = 3_000_000_000_000, 40_000_000_000_000, 3_000_000_000_001, 5_000_000_000_003
    text = f"CAST({a} AS DECIMAL(19, 0)) * CAST({n} AS DECIMAL(19, 0)) * 1000BD DIV (CAST({l} AS DECIMAL(19, 0)) * CAST({r} AS DECIMAL(19, 0)))"
    assert spark.sql(f"SELECT {text} AS s").first()["s"] == 1000 * a * n // (l * r)


def test_empty(spark):
    assert found(collocations.collocations(frame(spark, []))) == []
    assert found(collocations.collocations(frame(spark, [("a b", "en"), (None, None)]))) == []
    with pytest.raises(ValueError):
        collocations.phrase_counts(frame(spark, []), longest=2)


def test_equals_sql(spark):
    assert compare(queries.op13_collocations(spark, TESTDATA), connect(TESTDATA), queries.OP13_SQL) is None
