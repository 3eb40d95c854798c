"""Small tables with every odd case: nulls, empty and long texts, repeats, clashing extra columns."""

import random

FORM = "doc_id long, text string, lang string, source string, n_chars long, id long, text_key string, fp string, score string, v string, component string, ids string, part string, block string"

WORDS = {
    "en": "the of and thing other with from would people about there which because".split(),
    "de": "der die und nicht schön über müssen zwischen größer wieder können".split(),
    "es": "el unos que más año también señor ningún después corazón".split(),
}
INSULTS = ["idiot", "moron", "clown", "loser"]


def sentence(rng, lang, count):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "ing", "er", ","]) for _ in range(count))


def doc_rows(count=60, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        lang = rng.choice(sorted(WORDS))
        text = sentence(rng, lang, rng.randint(5, 60))
        if i % 4 == 0:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
            text = " ".join(words)
        rows.append([i, text, lang])
    rows += [
        [1000, None, "en"], [1001, "", "de"], [1002, None, None], [1003, " \t\n\x0b ", "en"], [1004, "12 345 ,.!", None],
        [1005, "one", "en"], [1006, "one two three", None], [1007, sentence(rng, "en", 30000), "en"],
        [1008, "x" * 5000, None], [1009, "\u00e9\u4e2d\u6587 \U0001f600 \u0130\u017f", None],
        rows[1][:], rows[1][:], [1010, rows[1][1], "en"], [None, rows[2][1], "en"], [None, None, None], [None, "alone here now", "en"],
        [1005, "another text under a used id", "en"],
    ]
    return rows


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, None, len(r[1] or ""), 7, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows], FORM)
