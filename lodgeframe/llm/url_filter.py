"""URL filter: hand-written host and path rules first, then association rules mined by FP-growth.

Spark's FP-growth mines combinations of URL tokens with a label. Support is a number of labelled URLs,
whatever their total. Only tokens that tell something about the label by themselves (chi-square) are
mined; tokens that stand in the same labelled URLs count as one. A labelled URL brings its most
telling ones to FP-growth; combinations of URLs that have more are found level by level, leaving out only those
that a shorter part makes needless, so that a long path does not make itemsets without end. A combination blocks (or
allows) if the label follows it with at least the confidence asked for, counted over all labelled
URLs and all their tokens, more often than over all of them, and no shorter part of it does as well. Each mined rule is indexed under its rarest token; a URL
looks up its tokens there, and a rule fires if all its tokens are in the URL. The rule of the
highest confidence decides, then support, then block; a URL that no rule fits is allowed.

Bad and odd input: a null url, or one without ``://``, has an empty host and path, fits no
hand-written rule, and is still judged by its tokens. Repeated rows come back once each. Empty
tables and no labels give no mined rules, so that only hand-written ones block. Extra columns don't
matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.session import cut_lineage

BLOCK, ALLOW = "block", "allow"
MIN_CONFIDENCE = 0.75
#: Labelled URLs with the label that a combination must occur in.
MIN_ROWS = 20
#: Chi-square of a token against the label from which it is mined: one of a thousand gets there by chance.
MIN_CHI_SQUARE = 10.83
#: Tokens of a labelled URL that FP-growth combines, the most telling ones: 2 ** 10 combinations at most.
#: Those of URLs with more tokens are combined by :func:`_longer_sets`, all of them.
MOST_COMBINED = 10
_LABEL = "label:"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule is written host/path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of_host, slash, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels and the words within, path words without their digits' values, query keys."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    tagged = lambda tag, parts: F.transform(parts, lambda t: F.concat(F.lit(tag), t))
    return F.coalesce(
        F.array_distinct(
            F.concat(
                tagged("host:", F.filter(F.split(host, r"\."), lambda t: t != "")),
                tagged("word:", F.filter(F.split(host, r"[.-]"), lambda t: t != "")),
                tagged("path:", F.filter(F.split(F.regexp_replace(_lower(path), r"[0-9]+", "0"), r"[/._-]"), lambda t: t != "")),
                tagged("key:", F.filter(F.transform(F.split(_lower(query), "&"), lambda t: F.split(t, "=")[0]), lambda t: t != "")),
            )
        ),
        F.array().cast("array<string>"),
    )


def _telling_tokens(shapes: DataFrame, min_rows: int, min_chi_square: float) -> DataFrame:
    """(token, same, chi) of the tokens to mine; ``same`` is the first token that stands in the same URLs."""
    block = F.when(F.col("label") == BLOCK, F.col("n")).otherwise(0)
    every = shapes.agg(F.sum("n").alias("all_n"), F.sum(block).alias("all_block"))
    a, both = F.col("block").cast("double"), F.col("n").cast("double")
    total, blocked = F.col("all_n").cast("double"), F.col("all_block").cast("double")
    off = total * a - both * blocked
    room = both * (total - both) * blocked * (total - blocked)
    tested = (
        shapes.select("key", "n", block.alias("block"), F.explode("items").alias("token"))
        .groupBy("token")
        .agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.bit_xor("key").alias("rows"),
             F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("more"))
        .where(F.col("n") >= min_rows)
        .join(F.broadcast(every))  # one row
        .withColumn("chi", F.when(room > 0, total * off * off / room).otherwise(0.0))
        .where(F.col("chi") >= min_chi_square)
    )
    first = tested.groupBy("n", "block", "rows", "more").agg(F.min("token").alias("same"))
    return tested.join(first, ["n", "block", "rows", "more"]).select("token", "same", "chi")


def _longer_sets(shapes: DataFrame, most_combined: int, min_rows: int) -> DataFrame:
    """(key, label) of the combinations in URLs with more than ``most_combined`` tokens that can be rules.

    ``shapes`` has ``label, n`` and ``have``, the sorted tokens to combine. Sets grow by a token a level and are
    counted over all shapes. A set goes on while the label has ``min_rows`` of its rows, it has fewer rows than
    each of its parts, and none of these is sure of the label already: otherwise it, and any larger set, is no surer
    than a part of its own.
    """
    known = cut_lineage(shapes.select("have", "label", "n", (F.size("have") > most_combined).alias("long")))
    if known.where("long").isEmpty():
        return known.select(F.col("have").alias("key"), "label").limit(0)
    found, grown = [], known.select("have", "label", "n", "long", F.explode("have").alias("token"))
    grown = grown.select("label", "n", "long", F.array("token").alias("key"))
    while True:
        counted = grown.groupBy("key").agg(
            F.bool_or("long").alias("long"), F.sum("n").alias("all_rows"),
            *[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x) for x in (BLOCK, ALLOW)],
        ).where("long")
        sides = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("rows")) for x in (BLOCK, ALLOW)]))
        level = counted.select("key", "all_rows", sides.alias("of")).select("key", "all_rows", "of.*").where(F.col("rows") >= min_rows)
        if found:
            part = F.explode(F.transform("key", lambda t: F.array_remove(F.col("key"), t))).alias("part")
            parts = found[-1].where("rows < all_rows").select(F.col("key").alias("part"), "label", F.col("all_rows").alias("part_rows"))
            whole = (
                level.select("*", part).join(parts, ["part", "label"]).where("part_rows > all_rows")
                .groupBy("key", "label").agg(F.count("*").alias("parts"))
                .where(F.col("parts") == F.size("key"))
            )
            level = level.join(whole, ["key", "label"], "left_semi")
        level = cut_lineage(level)
        if level.isEmpty():
            return reduce(DataFrame.union, [x.select("key", "label") for x in found or [level]])
        found.append(level)
        growing = level.where("rows < all_rows").select("key", F.element_at("key", -1).alias("token")).distinct()
        after = F.filter("have", lambda t: t > F.col("token"))
        grown = (
            known.select("*", F.explode("have").alias("token")).join(growing, "token")
            .where(F.size(F.array_except("key", "have")) == 0)
            .select("label", "n", "long", "key", F.explode(after).alias("next"))
            .select("label", "n", "long", F.concat("key", F.array("next")).alias("key"))
        )


def mine(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "label",
    min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE,
    min_chi_square: float = MIN_CHI_SQUARE,
    most_combined: int = MOST_COMBINED,
) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, rows, rarest) of urls labelled block or allow.

    rarest is the token of the rule that fewest labelled URLs have. A rule of one token is there for
    each token that stands in the same URLs; longer ones name the first of such tokens.
    """
    spark = labelled.sparkSession
    form = "rule_id long, tokens array<string>, verdict string, confidence double, rows long, rarest string"
    shapes = cut_lineage(
        labelled.where(F.col(label_col).isin(BLOCK, ALLOW))
        .select(F.array_sort(tokens(F.col(url_col))).alias("items"), F.col(label_col).alias("label"))
        .groupBy("items", "label").agg(F.count("*").alias("n"))
        .select(F.xxhash64("items", "label").alias("key"), "items", "label", "n")
    )
    counts = {r["label"]: r["n"] for r in shapes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    telling = cut_lineage(_telling_tokens(shapes, min_rows, min_chi_square)) if total else None
    if telling is None or telling.isEmpty():
        return spark.createDataFrame([], form)
    by_chi = F.sort_array(F.collect_set(F.struct("chi", "same")), asc=False)
    combined = cut_lineage(
        shapes.select("key", F.explode("items").alias("token"))
        .join(telling, "token").groupBy("key").agg(by_chi.alias("every"))
        .join(shapes.select("key", "label", "n"), "key")
        .select("label", "n", F.slice("every", 1, most_combined).alias("best"), F.array_sort("every.same").alias("have"))
    )
    baskets = combined.select(
        F.concat(F.col("best.same"), F.array(F.concat(F.lit(_LABEL), F.col("label")))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"),
    ).select("items")
    in_baskets = baskets.count()
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / in_baskets)).fit(baskets)
    is_label = lambda t: t.startswith(_LABEL)
    sets = found.freqItemsets.select("items").where(F.exists("items", is_label) & (F.size("items") > 1)).select(
        F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("key"),
        F.substring(F.filter("items", is_label)[0], len(_LABEL) + 1, 100).alias("label"),
    )
    sets = sets.union(_longer_sets(combined, most_combined, min_rows)).distinct()
    single = sets.where(F.size("key") == 1).withColumn("same", F.col("key")[0]).join(telling, "same")
    sets = cut_lineage(
        sets.where(F.size("key") > 1).union(single.select(F.array("token").alias("key"), "label"))
        .withColumn("rule_id", F.xxhash64("key", "label"))
    )
    # Rows and confidence are counted over whole labelled URLs, by the rarest token of each set.
    of_token = shapes.select("n", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n").alias("token_rows"))
    rarest = sets.select("rule_id", F.explode("key").alias("token")).join(of_token, "token").groupBy("rule_id").agg(
        F.min(F.struct("token_rows", "token"))["token"].alias("rarest")
    )
    sets = sets.join(rarest, "rule_id")
    counted = (
        shapes.select(F.col("items").alias("have"), F.col("label").alias("own"), "n", F.explode("items").alias("rarest"))
        .join(sets, "rarest")
        .where(F.size(F.array_except("key", "have")) == 0)
        .groupBy("rule_id")
        .agg(F.sum("n").alias("all_rows"), F.sum(F.when(F.col("own") == F.col("label"), F.col("n")).otherwise(0)).alias("rows"))
    )
    base = F.when(F.col("label") == BLOCK, counts.get(BLOCK, 0) / total).otherwise(counts.get(ALLOW, 0) / total)
    rules = cut_lineage(
        sets.join(counted, "rule_id")
        .withColumn("confidence", F.col("rows") / F.col("all_rows"))
        .where((F.col("rows") >= min_rows) & (F.col("confidence") >= min_confidence) & (F.col("confidence") > base))
    )
    # A rule that is no surer than one of its parts says nothing new.
    smaller = rules.select(
        "rule_id", "label", "confidence",
        F.explode(F.transform("key", lambda t: F.array_remove(F.col("key"), t))).alias("part"),
    ).join(rules.select(F.col("key").alias("part"), "label", F.col("confidence").alias("of_part")), ["part", "label"])
    needless = smaller.where("of_part >= confidence").select("rule_id").distinct()
    return rules.join(needless, "rule_id", "left_anti").select(
        "rule_id", F.col("key").alias("tokens"), F.col("label").alias("verdict"), "confidence", "rows", "rarest"
    )


def match(urls: DataFrame, rules: DataFrame, key_col: str, url_col: str = "url") -> DataFrame:
    """(key, mined_verdict) of the keys that a mined rule fits; one row per distinct key."""
    own = urls.select(F.col(key_col).alias("key"), tokens(F.col(url_col)).alias("have"))
    postings = rules.select(F.col("rarest").alias("token"), "tokens", "verdict", "confidence", "rows")
    return (
        own.withColumn("token", F.explode("have"))
        .join(postings, "token")
        .where(F.size(F.array_except("tokens", "have")) == 0)
        .groupBy("key")
        .agg(F.max(F.struct("confidence", "rows", "verdict"))["verdict"].alias("mined_verdict"))
    )


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) per row of pages.

    Each distinct token set is matched once: hosts with very many pages repeat few of them.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host_of(url).alias("host"), path_of(url).alias("path"),
        F.xxhash64(F.array_sort(tokens(url))).alias("key"), "url",
    )
    shapes = rows.groupBy("key").agg(F.min("url").alias("url"))
    found = match(shapes, mined, "key")
    hand = longest_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.drop("url")
        .join(found, "key", "left")
        .select(
            "id", "host", "path", hand["rule"].alias("rule"),
            F.coalesce(hand["verdict"], "mined_verdict", F.lit(ALLOW)).alias("verdict"),
        )
    )
