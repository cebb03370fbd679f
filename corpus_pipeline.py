"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
in the columns it was given; the last adds each document's shard and slot.

Documents without a text or without words are neither toxic, near duplicates nor
contaminated; the mix takes none of them, as it takes words. Rows of a null
``doc_id`` or source are documents like others. Repeated rows are one class of
near duplicates. Columns of any other name pass through. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from tidemark.llm.rows import ship
from tidemark.session import cut

#: Words of a shingle and similarity, in percent, from which documents are near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: No SQL: the stages learn, search and select by hash.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    ship(spark)
    return toxicity.remove_toxic(docs, _table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of ``NEAR_PERCENT`` over shingles of ``NEAR_WORDS`` words, one stays."""
    ship(spark)
    return jaccard_join.keep_one(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    ship(spark)
    return decontaminate.remove_contamination(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    ship(spark)
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
