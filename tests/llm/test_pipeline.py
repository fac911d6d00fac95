"""The pipeline: stages by name, each stage's decisions by its operator's brute force, the whole on given tables."""

import collections

import corpus_pipeline
import helpers as H
from test_near_dedup import classes
from test_tokens_mix import contaminated

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination",
                                                      "mixing to target weights", "token-ID output"]


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    first = kept[0]
    want = classes([(r["doc_id"], r["text"]) for r in first])
    assert {r["doc_id"] for r in kept[1]} == set(want.values()) and len(kept[1]) == len(set(want.values()))
    items = H.rows_of(SF, "benchmark", "item_id, text")
    bad = {d for d, _ in contaminated([(r["doc_id"], r["text"]) for r in kept[1]], items)}
    assert {r["doc_id"] for r in kept[2]} == {r["doc_id"] for r in kept[1]} - bad and bad
    times = collections.Counter(r["doc_id"] for r in kept[3])
    assert set(times) <= {r["doc_id"] for r in kept[2]} and max(times.values()) <= 3
    assert collections.Counter(r["doc_id"] for r in kept[4]) == times
    # the whole run gives what the stages gave
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in ran) == sorted(tuple(r) for r in kept[4])


def test_awkward_rows_pass_through(spark, tmp_path):
    docs = H.documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = H.documents(spark, [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
