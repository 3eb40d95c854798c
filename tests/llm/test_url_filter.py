import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodgeframe.llm import queries, url_filter

URLS = [
    (1, "HTTP://Shop.Example.NET/en/1?x=2#y"), (2, "http://example.net/de/1"), (3, "http://example.com/de/"), (4, "http://example.com/de"),
    (5, "x://www.org/fr/ab"), (6, "x://notexample.com/de/a"), (7, None), (8, ""), (9, "no scheme/de/"), (10, "a://b://example.com/de/"),
    (11, "http://net"), (12, "http://net/"), (13, "http://a.net?/x"), (14, "x://WWW.EXAMPLE.COM/DE/"), (15, "://h.net/p#?"), (15, "://h.net/p#?"),
    (None, "http://a.org/fr/"), (16, "x" * 20000 + "://long.net/" + "p/" * 5000), (17, "http://a\nb.net/q"), (18, "http://ÄB.net/Ä"),
]


def plain(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    best = None
    for rule, verdict in queries.URL_RULES:
        of_host, _, of_path = rule.partition("/")
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_rules_equal_a_plain_reading(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("key", F.lit("x")).withColumn("token", F.lit("y"))
    mined = url_filter.mine(spark.createDataFrame([], "url string, label string"))
    found = url_filter.judge(pages, queries.URL_RULES, mined).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(((i, *plain(u)) for i, u in URLS), key=key)


def test_mined_rules_have_their_support_and_confidence(spark):
    rows = [(f"http://{'spam' if i % 3 == 0 else 'good'}{i % 7}.x-{'pills' if i % 3 == 0 else 'news'}.com/{'a' if i % 2 else 'b'}/{i}", "block" if i % 3 == 0 and i % 30 else "allow") for i in range(600)]
    labelled = spark.createDataFrame([*rows, (None, "block"), ("x", None), ("y", "other")], "url string, label string")
    rules = url_filter.mine(labelled, min_confidence=0.8).collect()
    have = [(set(r[0]), r[1]) for r in labelled.where("label in ('block','allow')").select(url_filter.tokens(F.col("url")), "label").collect()]
    assert any(r["verdict"] == "block" for r in rules)
    for r in rules:
        fits = [label for tokens, label in have if set(r["tokens"]) <= tokens]
        assert fits.count(r["verdict"]) == r["rows"] >= 20 and r["confidence"] == pytest.approx(r["rows"] / len(fits)) and r["confidence"] >= 0.8
        assert r["rarest"] in r["tokens"]
    pages = spark.createDataFrame([(1, "http://new.my-pills.org/z"), (2, "http://new.my-news.org/z"), (3, "http://else.org/")], "page_id long, url string")
    found = {r["id"]: r["verdict"] for r in url_filter.judge(pages, [], url_filter.mine(labelled, min_confidence=0.8)).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}


def test_empty_pages(spark):
    mined = url_filter.mine(spark.createDataFrame([("http://a.b/c", "block")], "url string, label string"))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, mined).count() == 0


def test_long_paths_end(spark):
    words = "/".join(f"w{i}" for i in range(30)).replace("w", "abcdefgh")
    path = "/".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * (2 + i // 26) for i in range(30))
    rows = [(f"http://bad.org/{path}/{i}", "block") for i in range(40)] + [(f"http://fine.org/{words}/{i}", "allow") for i in range(60)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, label string")).collect()
    assert {tuple(r["tokens"]) for r in rules if r["verdict"] == "block"} >= {("host:bad",), ("path:aa",), ("path:ddd",)}


def test_support_is_a_number_of_rows(spark):
    """Twenty bad rows make a rule, however many others there are."""
    rows = [(f"http://shop{i}.com/a", "allow") for i in range(12000)] + [("http://shop.bad.com/a", "block")] * 20 + [("http://shop.odd.com/a", "block")] * 19
    labelled = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(1, "http://x.bad.com/q"), (2, "http://x.odd.com/q"), (3, "http://shop7.com/a")], "page_id long, url string")
    found = {r["id"]: r["verdict"] for r in url_filter.judge(pages, [], url_filter.mine(labelled)).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}


def test_verdicts_equal_brute_force(spark):
    """Rules of one and two tokens, from all combinations counted one by one."""
    rng = random.Random(3)
    rows = []
    for _ in range(900):
        a, b, c = (rng.choice(names) for names in (["pills", "news", "shop"], ["win", "read", "sale"], ["x", "y"]))
        bad = a == "pills" and b == "win" or b == "sale" and c == "x"
        rows.append((f"http://{a}.org/{b}/{c}", "block" if bad != (rng.random() < 0.05) else "allow"))
    labelled = spark.createDataFrame(rows, "url string, label string")
    shapes = [(frozenset(r[0]), r[1]) for r in labelled.select(url_filter.tokens(F.col("url")), "label").collect()]
    total, base = len(shapes), {x: sum(label == x for _, label in shapes) / len(shapes) for x in ("block", "allow")}
    in_rows = lambda key: [label for have, label in shapes if key <= have]
    def telling(token):
        mine, all_block = in_rows({token}), base["block"] * total
        n, a = len(mine), mine.count("block")
        room = n * (total - n) * all_block * (total - all_block)
        return n >= 20 and room > 0 and total * (total * a - n * all_block) ** 2 / room >= url_filter.MIN_CHI_SQUARE
    items = sorted(t for t in frozenset().union(*(have for have, _ in shapes)) if telling(t))
    rules = {}
    for size in (1, 2, 3):
        for key in map(frozenset, itertools.combinations(items, size)):
            fits = in_rows(key)
            for label in ("block", "allow"):
                if fits.count(label) >= 20 and fits.count(label) / len(fits) >= 0.75 and fits.count(label) / len(fits) > base[label]:
                    rules[key, label] = (fits.count(label) / len(fits), fits.count(label))
    def verdict(have):
        best = max(((*score, label) for (key, label), score in rules.items() if key <= have), default=(0, 0, "allow"))
        return best[2]
    urls = [f"http://{a}.org/{b}/{c}" for a in ("pills", "news", "shop", "else") for b in ("win", "read", "sale") for c in "xy"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    have = {r[0]: frozenset(r[1]) for r in pages.select("page_id", url_filter.tokens(F.col("url"))).collect()}
    found = {r["id"]: r["verdict"] for r in url_filter.judge(pages, [], url_filter.mine(labelled)).collect()}
    assert found == {i: verdict(h) for i, h in have.items()}
    assert "block" in found.values() and "allow" in found.values()


def test_rules_beyond_the_most_telling_tokens(spark):
    """With two tokens of a URL for FP-growth, the rules still decide as if it had combined them all."""
    rng = random.Random(5)
    names = [("pills", "news"), ("win", "read"), ("red", "blue"), ("up", "down"), ("x", "y")]
    rows = []
    for _ in range(1500):
        a, b, c, d, e = words = [rng.choice(pair) for pair in names]
        bad = (a == "pills") + (b == "win") + (c == "red") + (d == "up") + (e == "x") >= 4
        rows.append((f"http://{a}.org/{'/'.join(words[1:])}", "block" if bad != (rng.random() < 0.1) else "allow"))
    labelled = spark.createDataFrame(rows, "url string, label string")
    mined = lambda most: {(tuple(sorted(r["tokens"])), r["verdict"], r["rows"], r["confidence"]) for r in url_filter.mine(labelled, most_combined=most).collect()}
    every = mined(10)
    assert max(len(r[0]) for r in every if r[1] == "block") >= 4
    pages = spark.createDataFrame([(i, f"http://{'/'.join([w[0] + '.org', *w[1:]])}") for i, w in enumerate(itertools.product(*names))], "page_id long, url string")
    judged = lambda most: {r["id"]: r["verdict"] for r in url_filter.judge(pages, [], url_filter.mine(labelled, most_combined=most)).collect()}
    assert mined(2) == every and judged(2) == judged(10)
