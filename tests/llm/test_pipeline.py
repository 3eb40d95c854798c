from collections import Counter

import corpus_pipeline
import pytest
from conftest import TESTDATA
from llm_rows import doc_rows, docs_frame

from lodgeframe.llm import language_id, packing, simhash, toxicity


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = language_id.train(docs)
    named = language_id.label_texts(net, list(rows.values()))
    known = [i for i, lang, score in zip(rows, *named) if lang != "und" and score >= language_id.LEAST_SCORE]
    machine = toxicity.train(docs.where(docs.doc_id.isin(known)), labels)
    scores = toxicity._scores(toxicity.Scorer(machine) if machine else None, [rows[i] for i in known])
    clean = [i for i, p in zip(known, scores) if p < toxicity.THRESHOLD]
    marks = {i: simhash.fingerprint((rows[i] or "").encode()) for i in clean}
    root = {i: i for i in clean}
    changed = True
    while changed:
        changed = False
        for a in clean:
            for b in clean:
                if root[a] > root[b] and (marks[a] ^ marks[b]).bit_count() <= 4:
                    root[a], changed = root[b], True
    single = [i for i in clean if root[i] == i]
    encoder = packing.WordEncoder(corpus_pipeline.word_tokenizer())
    sizes = {i: len(encoder.encode([(rows[i] or "").encode()])[0]) // 4 + 1 for i in single}
    got = Counter()
    for r in corpus_pipeline.run(spark, TESTDATA).collect():
        got[r["doc_id"]] += r["length"]
    assert got == sizes
    assert len(known) >= 0.98 * len(rows)


@pytest.mark.parametrize("rows", [doc_rows(), []], ids=["odd", "empty"])
def test_odd_rows_go_through(spark, tmp_path, rows):
    docs = docs_frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (1000, None)]
    spark.createDataFrame([(*r, 1, "t") for r in labels], "doc_id long, toxic int, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        if name != "packing":
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r["doc_id"] for r in before.collect()}
    if rows:
        assert 1000 not in left and 1007 in left and not {i for i in range(60) if i % 4 == 0} & left
        assert {2, 3, 5} <= left
    else:
        assert not left
