"""The stages one by one against plain rules, and the queries of the subpackage against their SQL."""

import pytest
from duck import assert_same

import corpus_pipeline
from lodestone.llm import decontam, registry, secrets, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, first = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, FOLDER).cache()
        if k < 4:
            assert docs.columns == first.columns
        rows, old = docs.collect(), {r.doc_id: r for r in before.collect()} if k < 4 else {}
        ids = {r.doc_id for r in rows}
        if k == 0:
            model = toxicity.learn(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert ids == {r.doc_id for r in toxicity.toxicity(before, model).collect() if r.score < toxicity.THRESHOLD}
        elif k == 1:
            assert ids == {r.component_id for r in simhash.near_duplicates(before).collect()}
        elif k == 2:
            found = decontam.contaminated_spans(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
            assert ids == {r.doc_id for r in found if not r.spans}
        elif k == 3:
            assert ids == set(old) and all(r.text == secrets.masked(old[r.doc_id].text) and r.n_chars == len(r.text) for r in rows)
        else:
            assert ids == {r.doc_id for r in before.collect()}
        if k < 3:
            assert all(r == old[r.doc_id] for r in rows) and len(rows) == len(ids)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    assert assert_same(registry.QUERIES[name](spark, FOLDER), registry.ORACLES[name], FOLDER)
