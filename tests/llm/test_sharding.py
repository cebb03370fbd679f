import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def check(found, docs, shards=40):
    rows = found.collect()
    texts = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert 0 <= shard < shards and slots == list(range(len(slots)))
    return rows


def test_given_documents(documents):
    rows = check(sharding.report(documents), documents)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


@pytest.mark.parametrize("copies", [0, 4000])
def test_near_equal_bytes_also_with_a_large_group_of_copies(spark, copies):
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")))
    text = F.when(F.col("id") < copies, F.lit("same text " * 5)).otherwise(text)
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = sharding.report(docs, shards=10, slices=50).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(10)]
    mean = sum(sizes) / 10
    assert max(abs(s - mean) for s in sizes) <= 0.01 * mean + 113


def test_equal_texts_stay_together_when_they_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"))
    found = sharding.report(docs, shards=4, slices=8, tolerance=0.01)
    split = found.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1")
    assert split.count() == 0


def test_reruns_and_other_partitions_agree(documents):
    one = sharding.report(documents).collect()
    assert sorted(one, key=str) == sorted(sharding.report(documents.repartition(9)).collect(), key=str)


def test_awkward_rows(awkward, nothing):
    rows = check(sharding.report(awkward), awkward)
    assert next(r for r in rows if r.doc_id == 2).size == 16
    found = sharding.shard(awkward, shards=3)
    assert found.columns == [*awkward.columns, "shard", "slot"] and found.count() == awkward.count()
    assert sharding.report(nothing).count() == 0 and sharding.shard(nothing).count() == 0


def test_main_path_is_native(documents):
    plan = sharding.report(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
