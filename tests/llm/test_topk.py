import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: min(v for j, v in good if j == i) for i, _ in good if i % 50 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def rows(seed, n=300, dim=8):
    rng = random.Random(seed)
    found = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, rng.random()]) for _ in range(dim)]) for i in range(n)]
    found += [(1000, None), (1050, [None] * dim), (1100, [float("nan")] * dim), (1150, [float("inf")] * dim), (None, [1.0] * dim)]
    return found + [(2000, [1.0, 2.0]), (2001, [0.5, 0.5]), (2050, []), (2051, [])]


@pytest.mark.parametrize("settings", [{}, {"tile": 16, "fan_in": 2}, {"tile": 7, "k": 40}, {"tile": 3, "group": 2, "fan_in": 3}])
def test_against_brute_force(spark, settings):
    data = rows(1)
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = topk.search(vectors, F.col("vec_id") % 50 == 0, **settings)
    assert {tuple(r) for r in found.collect()} == brute(data, settings.get("k", 5))


def test_large_components_stay_exact(spark):
    data = [(0, [1.0e6, 1.0]), (1, [1.0e6, 2.0]), (2, [1.0e6, 1.00390625]), (3, [-1.0, 0.0])]
    found = topk.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert {tuple(r) for r in found.collect()} == {t for t in brute(data) if t[0] == 0}
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.report(huge).orderBy("rank").collect()] == [(1 << 63) - 1, -(1 << 63)]


def test_repeated_rows_and_no_rows(spark):
    data = [(0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [2.0]), (6, [2.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, score string")
    found = topk.report(vectors).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 5), (0, 2, 5), (0, 3, 6)]
    assert topk.report(vectors.where("1 = 0")).count() == 0


def test_products_are_dealt_over_a_grid_of_tasks(spark):
    rows = spark.range(4097 * 20).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vector"))
    asked = rows.where("vec_id % 50 = 0")
    cells = topk.grid(asked, rows, topk.TILE, topk.GROUP)
    per_task = cells.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("dim", "q_tile", "c_group").alias("cells"))
    assert [r.cells for r in per_task.collect()] == [1] * 3
    # 41 tiles of queries and 103 groups of candidates
    fine = topk.grid(asked, rows, 40, 20, tasks=64)
    per_task = fine.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("dim", "q_tile", "c_group").alias("cells"))
    found = [r.cells for r in per_task.collect()]
    assert len(found) == 64 and sum(found) == 41 * 103 and max(found) - min(found) <= 1


def test_lengths_share_the_grid(spark):
    data = [(i, [1.0 * (i % 5)] * (1 + i % 3)) for i in range(200)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = topk.search(vectors, F.col("vec_id") % 50 == 0, tile=16, group=2)
    assert {tuple(r) for r in found.collect()} == brute(data)
