import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import joins, ranking
from tidemark.functions.medians import group_median
from tidemark.operators.customers import score_tiles


def plain_ntile(n, k):
    """Tile sizes by the standard rule: the first n mod k tiles hold one more."""
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [i + 1 for i, size in enumerate(sizes) for _ in range(size)]


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows: one group holds two thirds, keys are heavily tied, some are NULL."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        g = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", "c", None])
        v = None if rng.random() < 0.05 else rng.choice([1, 1, 1, 1, 2, 3, rng.randrange(100)])
        rows.append((f"K{rng.randrange(10**6):06d}-{i}", g, v, rng.randrange(50)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id string, g string, v int, w int").repartition(8).cache()


@pytest.mark.parametrize("group", [(), ("g",)])
def test_number_rows_equals_window(skewed, group):
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    w = Window.partitionBy(*group).orderBy(*order)
    want = skewed.select("id", F.row_number().over(w).alias("row_no"), F.count("*").over(Window.partitionBy(*group)).alias("n"))
    got = ranking.number_rows(skewed, order, group).select("id", "row_no", F.col("group_rows").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tile_formula_for_all_small_sizes(spark):
    for k in (1, 2, 3, 4, 10):
        df = spark.range(1, 41).select(F.col("id").alias("group_rows")).select(
            F.explode(F.sequence(F.lit(1).cast("long"), "group_rows")).alias("row_no"), "group_rows"
        )
        got = {}
        for r in df.select("group_rows", "row_no", ranking.tile(k).alias("t")).collect():
            got.setdefault(r["group_rows"], []).append((r["row_no"], r["t"]))
        for n, pairs in got.items():
            assert [t for _, t in sorted(pairs)] == plain_ntile(n, k)


def test_number_rows_edge_sizes(spark):
    empty = spark.createDataFrame([], "id long, v int")
    assert ranking.number_rows(empty, [F.asc("v"), F.asc("id")]).collect() == []
    single = spark.createDataFrame([(7, 1)], "id long, v int")
    assert [tuple(r) for r in ranking.number_rows(single, [F.asc("v"), F.asc("id")]).collect()] == [(7, 1, 1, 1)]


def test_running_totals_equal_window(skewed):
    order = [F.asc_nulls_first("v"), F.asc("id")]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("id", F.coalesce(F.sum("w").over(w), F.lit(0)).alias("b"))
    got = ranking.running_totals(skewed, order, ["w"]).select("id", F.col("before_w").alias("b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [0, 1, 3, 6000])
def test_score_tiles_equal_ntile(skewed, rows):
    df = skewed.orderBy("id").limit(rows).cache()
    keys = {"v": ("v", 1.0), "w": ("w", -1.0)}
    by_v = Window.orderBy(F.asc_nulls_first("v"), "id")
    by_w = Window.orderBy(F.desc("w"), "id")
    want = df.select("id", F.ntile(4).over(by_v), F.ntile(4).over(by_w))
    got = score_tiles(df, keys, "id").select("id", "v_score", "w_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_group_median_is_exact(spark, skewed):
    rng = random.Random(9)
    rows = [("hot", round(rng.uniform(-5, 5000), 2)) for _ in range(40_001)]
    rows += [("even", 1.0), ("even", 2.0), ("one", 3.5), ("none", None), ("gap", None), ("gap", 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r["g"]: r["m"] for r in group_median(df, "g", "v", "m").collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    # a group without values has no median, and neither has the NULL group
    assert {g: m for g, m in got.items() if m is not None} == {"hot": hot[20_000], "even": 1.5, "one": 3.5, "gap": 4.0}
    exact = df.select("g", F.col("v").cast("decimal(12,2)").alias("v"))
    again = {r["g"]: r["m"] for r in group_median(exact, "g", "v", "m", spread_by="v").collect()}
    assert {g: m if m is None else float(m) for g, m in again.items()} == got


@pytest.mark.parametrize("n", range(1, 14))
def test_group_median_small_groups(spark, n):
    df = spark.range(n).select(F.lit("x").alias("g"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    vals = sorted(float(i * i) for i in range(n))
    want = (vals[(n - 1) // 2] + vals[n // 2]) / 2
    assert group_median(df, "g", "v", "m").first()["m"] == want


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    from tidemark.functions import medians

    real, tried = medians._bracketed_median, []

    def misses(df, group, value, out, spread_by, margin):
        tried.append(margin)
        lost = (F.col(group) == "a") & F.lit(margin < 0.4)
        return real(df, group, value, out, spread_by, margin).withColumn(out, F.when(~lost, F.col(out)))

    monkeypatch.setattr(medians, "_bracketed_median", misses)
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(10**6))) for g in "ab" for _ in range(5001)] + [("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    got = {r["g"]: r["m"] for r in group_median(df, "g", "v", "m").collect()}
    assert {g: got[g] for g in "ab"} == {g: sorted(v for k, v in rows if k == g)[2500] for g in "ab"}
    assert got.get("none") is None and got.get(None) is None and tried == [0.001, 0.02, 0.4]


@pytest.mark.parametrize("threshold", [-1, 10_000_000])
def test_group_join_either_way(spark, conf, skewed, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold, spark__sql__adaptive__autoBroadcastJoinThreshold=threshold)
    per_group = skewed.groupBy("g").agg(F.count("*").alias("n"))
    got = joins.group_join(skewed, per_group, "g")
    sizes = {r["g"]: r["n"] for r in per_group.collect()}
    assert got.count() == 6000
    assert {(r["g"], r["n"]) for r in got.select("g", "n").distinct().collect()} == set(sizes.items())


def test_offset_tables_may_be_joined_by_shuffle(conf, skewed):
    conf(spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1)
    order = [F.asc_nulls_first("v"), F.asc("id")]
    numbered = ranking.number_rows(skewed, order, ["g"])
    want = skewed.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(tuple, numbered.select("id", "row_no").collect())) == sorted(map(tuple, want.collect()))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = skewed.select("id", F.coalesce(F.sum("w").over(before), F.lit(0)))
    got = ranking.running_totals(skewed, order, ["w"]).select("id", "before_w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums.collect()))
