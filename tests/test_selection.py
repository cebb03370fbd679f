import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import selection
from tidemark.functions.selection import rows_at, tile_ends


def null_first(x):
    return (x is not None, x if x is not None else 0)


def brute(rows, wanted):
    out = []
    for g, rank in wanted:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (null_first(r[1]), null_first(r[2])))
        if 1 <= rank <= len(mine):
            out.append((g, rank, *mine[rank - 1][1:3]))
    return sorted(out, key=str)


def at(wanted):
    """The wanted ranks of each group as a column."""
    ranks = F.array().cast("array<long>")
    for g in {g for g, _ in wanted}:
        mine = F.array(*[F.lit(r).cast("long") for h, r in wanted if h == g])
        ranks = F.when(F.col("g").eqNullSafe(F.lit(g)), mine).otherwise(ranks)
    return ranks


def table(spark, rows, kinds="g string, v double, id string"):
    return spark.createDataFrame(rows, kinds).repartition(7).cache()


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_ranks_of_tied_groups(spark, small):
    """One group holds two thirds of the rows, one value nine rows of ten, ids share a long beginning."""
    rng = random.Random(small)
    rows = []
    for i in range(4000):
        g = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        v = None if rng.random() < 0.02 else 7.0 if rng.random() < 0.9 else rng.choice([-1.5, float(rng.randrange(1000))])
        rows.append((g, v, f"CUSTOMER-{rng.randrange(10**6):07d}-{i}"))
    wanted = [(g, r) for g in ("hot", "a", "b", None, "absent") for r in (0, 1, 2, 17, 400, 1300, 2600, 10**6)]
    found = rows_at(table(spark, rows), at(wanted), ["g"], "v", "id", small)
    assert sorted(found, key=str) == brute(rows, wanted)


@pytest.mark.parametrize("kind", ["long", "decimal(30,4)", "string", "date"])
def test_kinds_of_keys(spark, kind):
    rng = random.Random(1)
    df = spark.range(600).select(
        F.lit("g").alias("g"),
        F.when(F.col("id") % 50 != 0, F.date_add(F.lit("2020-01-01"), (F.col("id") * 7919 % 101).cast("int")) if kind == "date" else (F.col("id") * 7919 % 101).cast(kind)).alias("v"),
        (F.col("id") * 31 % 600).alias("id"),
    ).cache()
    rows = [tuple(r) for r in df.collect()]
    wanted = [("g", rng.randrange(1, 601)) for _ in range(12)]
    wanted = sorted(set(wanted))
    found = rows_at(df, at(wanted), ["g"], "v", "id", 3)
    assert sorted(found, key=lambda r: r[1]) == sorted(brute(rows, wanted), key=lambda r: r[1])


@pytest.mark.parametrize("k", [1, 4, 10])
def test_tile_ends_are_those_of_ntile(spark, k):
    rng = random.Random(k)
    sizes = (1, 2, 3, 4, 5, 9, 10, 11, 37)
    rows = [(f"g{n}", float(rng.randrange(5)), f"id{i}") for n in sizes for i in range(n)]
    found = tile_ends(table(spark, rows), k, ["g"], "v", "id")
    for n in sizes:
        parts = [n // k + (i < n % k) for i in range(k)]
        assert sorted(r[1] for r in found if r[0] == f"g{n}") == sorted({sum(parts[: i + 1]) for i in range(k - 1)} - {0, n})
    one = [r for r in rows if r[0] == "g37"]
    assert sorted(tile_ends(table(spark, one).drop("g"), k, [], "v", "id")) == sorted(r[1:] for r in found if r[0] == "g37")
    assert tile_ends(table(spark, one).drop("g").where("false"), k, [], "v", "id") == []


def test_a_grid_that_misses_is_mended(spark, monkeypatch):
    rows = [("g", float(i), f"{i:05d}") for i in range(3000)]
    real, tried = selection._counted, []

    def counted(rows, keys, asked):
        tried.append(len(asked))
        return {} if len(tried) == 1 else real(rows, keys, asked)

    monkeypatch.setattr(selection, "_counted", counted)
    assert rows_at(table(spark, rows), at([("g", 1500)]), ["g"], "v", "id") == [("g", 1500, 1499.0, "01499")]
    assert tried == [1, 1]


def test_rows_are_not_sorted_or_written(spark, monkeypatch):
    """Scores and deciles need no sorted copy of the customers."""
    from tidemark.functions import ranking
    from tidemark.plans import registry

    monkeypatch.setattr(ranking, "_sliced", lambda *_: pytest.fail("sorted"))
    sf = "/root/testdata/sf0.001"
    for name in ("customer_rfm", "pareto_customers", "attrition_by_income_quartile", "stratified_split"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(customer_id" not in plan and "rangepartitioning(employee_id" not in plan
