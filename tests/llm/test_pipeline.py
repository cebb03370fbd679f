import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard_join, toxicity
from tidemark.session import cut

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding",
    ]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        found.append(docs)
    return found


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert steps[5].columns == [*steps[0].columns, "shard", "slot"]


def test_each_decision_takes_effect(spark, steps):
    start, clean, single, safe, mixed, sharded = steps
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic = toxicity.report(start, labels).where("predicted = 1")
    assert clean.count() == start.count() - toxic.count() and clean.join(toxic, "doc_id").count() == 0
    near = {"n": corpus_pipeline.NEAR_WORDS, "percent": corpus_pipeline.NEAR_PERCENT}
    assert near == {"n": 5, "percent": 80}
    assert jaccard_join.report(clean, **near).select("component_id").distinct().count() == single.count()
    assert jaccard_join.report(single, **near).where("component_id <> doc_id").count() == 0
    assert decontaminate.report(safe, benchmark).where("contaminated").count() == 0
    untouched = decontaminate.report(single, benchmark).where("not contaminated").select("doc_id")
    assert single.join(untouched, "doc_id").select("doc_id", "text").exceptAll(safe.select("doc_id", "text")).isEmpty()
    copies = mixed.groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 2 and copies.join(safe, "doc_id", "left_anti").isEmpty()
    assert sharded.count() == mixed.count()


def test_run_is_the_stages_one_after_the_other(spark, steps):
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, found.collect())) == sorted(map(str, steps[5].collect()))


def test_awkward_documents_pass_all_stages(spark, awkward, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows, other columns, and no rows at all."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for docs in (awkward.withColumnRenamed("size", "shard_"), nothing.withColumnRenamed("size", "shard_")):
        there, found = docs.count(), docs
        for _, stage in corpus_pipeline.STAGES:
            found = cut(stage(spark, found, str(tmp_path)))
        assert found.columns == [*docs.columns, "shard", "slot"]
        assert (found.count() > 0) == (there > 0)
        assert found.where("text is null or trim(text) = ''").isEmpty()
        ids = [r.doc_id for r in found.collect()]
        assert all(ids.count(x) <= 2 for x in ids) and len({6, 7} & set(ids)) <= 1
