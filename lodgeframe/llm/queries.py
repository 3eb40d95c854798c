"""The dealt queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.llm import best_fit, bpe, chat, collocations, embed_dedup, language_id, lm_scoring, packing, runs, simhash, topk
from lodgeframe.llm import toxicity, url_filter
from lodgeframe.llm.samples import is_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> bytes:
    """The word tokenizer's file, read where the job is started and sent to the tasks."""
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose document is labelled poor or toxic teach block, other labelled ones allow."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), url_filter.BLOCK)
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), url_filter.ALLOW)
        .alias("label"),
    )
    mined = url_filter.mine(pages.join(labels, "page_id"))
    return url_filter.judge(pages, URL_RULES, mined).withColumnRenamed("id", "page_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~is_fold("doc_id", 4, 2)))
    return language_id.predict(docs, net).select(
        F.col("id").alias("doc_id"), is_fold("id", 4, 2).alias("held_out"), "lang_pred", "score"
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.c, v.c)]) AS BIGINT) AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.c) = len(q.c)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score_documents(_table(spark, sf_dir, "documents"), ~is_fold("doc_id", 7, 2))
    return found.select(
        F.col("id").alias("doc_id"), is_fold("id", 7, 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.drop("ids").withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~is_fold("doc_id", 3, 1))
    machine = toxicity.train(docs, labels)
    return toxicity.predict(docs, machine).select(
        F.col("id").alias("doc_id"),
        is_fold("id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], own.schema)
    return chat.digests(chat.format_conversations(own.union(extra))).withColumnRenamed("id", "conv_id")


OP8_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(regexp_replace(role, '[\\<>#]', 'xx', 'g')) + length(regexp_replace(text, '[\\<>#]', 'xx', 'g'))
              + length('<turn ' || '>' || chr(10) || chr(10) || '</turn>' || chr(10)) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP9_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a
), component AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
    SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings AS e JOIN component AS c ON c.a = e.vec_id LEFT JOIN degree AS d ON d.a = e.vec_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes()
    return best_fit.pack(_table(spark, sf_dir, "documents"), spec).withColumnRenamed("id", "doc_id")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the texts the words from one on repeat themselves, as the contract says."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)
    )
    g, n = F.expr("h DIV 10"), F.size("words")
    placed = marked.withColumn("a", F.when(n > 0, F.pmod(g, n)).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    repeated = F.expr("transform(sequence(a, size(words) - 1), i -> words[a + (i - a) % p])")
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), repeated)
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "greatest.*",
        F.expr("greatest.length * 1000 DIV greatest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), worded AS (
    SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces
), sized AS (
    SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS k FROM worded
), placed AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized
), f AS (
    SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS n FROM placed GROUP BY ALL
), total AS (
    SELECT lang, sum(n) AS words FROM f WHERE k = 1 GROUP BY lang
), often AS (
    SELECT * FROM f WHERE n >= 100
), inside AS (
    SELECT lang, p[i:i + m - 1] AS p, max(n) AS most
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM often WHERE k > 2))
    GROUP BY ALL
), cut AS (
    SELECT lang, p, n AS a, unnest(range(1, k)) AS c, k FROM often WHERE k > 1
), scored AS (
    SELECT cut.lang, cut.p, cut.a, c, x.n AS l, y.n AS r, t.words AS n,
           CAST((1000 * CAST(cut.a AS HUGEINT) * CAST(t.words AS HUGEINT)) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
    FROM cut JOIN often AS x ON x.lang = cut.lang AND x.p = cut.p[1:c]
             JOIN often AS y ON y.lang = cut.lang AND y.p = cut.p[c + 1:cut.k]
             JOIN total AS t ON t.lang = cut.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
), kept AS (
    SELECT b.*, array_to_string(b.p, ' ') AS phrase
    FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.p = b.p WHERE i.most IS NULL OR i.most < b.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
WHERE rank <= 2000
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_topk": op4_topk,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_packing": op10_packing,
    "op11_best_fit": op11_best_fit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op4_topk": OP4_SQL,
    "op8_chat": OP8_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op13_collocations": OP13_SQL,
}
