"""Bounded samples: exact sizes, repeated rows and repeated ids."""

from collections import Counter

from pyspark.sql import functions as F

from lodgeframe.llm import language_id, samples, toxicity


def test_sizes_are_exact(spark):
    rows = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("y"), "id").union(
        spark.range(7).select(F.lit(2).alias("y"), F.col("id"))
    )
    rows = rows.union(rows.limit(3).select(F.lit(None).cast("int"), "id"))
    found = samples.drawn_per_class(rows, "y", 500).collect()
    assert Counter(r["y"] for r in found) == {0: 500, 1: 500, 2: 7}
    assert len({(r["y"], r["id"]) for r in found}) == len(found)
    assert 5_000 < sum(r["id"] for r in found if r["y"] == 1) / 500 < 25_000
    assert samples.drawn_per_class(rows.limit(0), "y", 5).count() == 0


def test_a_text_that_fills_a_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", seen.append)
    for text in ("the same words", "one more text", "and a third one"):
        rows = spark.range(20_000).select(F.lit(text).alias("text"), F.lit("en").alias("lang"))
        others = spark.range(50).select(F.concat(F.lit("other "), "id").alias("text"), F.lit("en").alias("lang"))
        few = spark.range(30).select(F.concat(F.lit("autre "), "id").alias("text"), F.lit("fr").alias("lang"))
        language_id.train(rows.union(others).union(few), rows=400)
        assert Counter(lang for _, lang in seen[-1]) == {"en": 400, "fr": 30}
        assert (text.encode(), "en") in seen[-1]


def test_ids_that_many_documents_share_bring_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", seen.append)
    docs = spark.range(80_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels, rows=300)
    assert Counter(y for _, y in seen[-1]) == {0: 300, 1: 300}
