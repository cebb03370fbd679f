"""Hypothesis tests on the label, computed from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import round_away, rows
from tidemark.functions.pvalues import chi_square_tail, one_sided_twice, with_p
from tidemark.functions.ranking import running_totals
from tidemark.operators.workforce import left

# The tests reported together, in order, and their titles.
TESTED = ("overtime", "department", "job_satisfaction")
CHI_SQUARE_TITLE = "Chi-square: attrition vs "
MANN_WHITNEY_TITLE = "Mann-Whitney U: income, leavers vs stayers"


def contingency(employees: DataFrame, features: Sequence[str] = TESTED) -> DataFrame:
    """(feature, level, gone, stayed): one row per level, so an empty cell is a zero.

    The table is read once: rows shrink to combinations of all the features first.
    """
    has_label = employees.where("attrition IS NOT NULL")
    cells = has_label.groupBy(*features).agg(rows().alias("n"), F.count_if(left()).alias("gone"))
    pair = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in features]
    return (
        cells.select(F.explode(F.array(*pair)).alias("p"), "n", "gone")
        .where("p.level IS NOT NULL")
        .groupBy(F.col("p.feature").alias("feature"), F.col("p.level").alias("level"))
        .agg(F.sum("gone").alias("gone"), F.sum(F.col("n") - F.col("gone")).alias("stayed"))
    )


def chi_square(table: DataFrame) -> DataFrame:
    """(feature, statistic, dof) from (feature, level, gone, stayed).

    With one degree of freedom each cell's distance from its expectation is
    reduced by up to one half (Yates).
    """
    # one row per level by now, so a feature's window is as small as its level list
    of_feature = Window.partitionBy("feature")
    with_margins = table.withColumns(
        {
            "all_gone": F.sum("gone").over(of_feature),
            "all_stayed": F.sum("stayed").over(of_feature),
            "free_levels": F.count("level").over(of_feature) - 1,
        }
    )
    n = (F.col("all_gone") + F.col("all_stayed")).cast("double")
    dof = F.col("free_levels") * F.when((F.col("all_gone") > 0) & (F.col("all_stayed") > 0), 1).otherwise(0)

    def cell(observed: str, margin: str) -> Column:
        expected = (F.col("gone") + F.col("stayed")) * F.col(margin) / n
        gap = F.abs(F.col(observed) - expected)
        gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))

    return (
        with_margins.withColumn("dof", dof)
        .groupBy("feature", "dof")
        .agg(F.sum(cell("gone", "all_gone") + cell("stayed", "all_stayed")).alias("statistic"))
        .select("feature", "statistic", "dof")
    )


def chi_square_test(employees: DataFrame, features: Sequence[str] = TESTED) -> DataFrame:
    return (
        chi_square(contingency(employees, features))
        .select("feature", round_away("statistic", 2).alias("statistic"), "dof")
        .orderBy("feature")
    )


def chi_square_p_values(employees: DataFrame, features: Sequence[str] = TESTED) -> DataFrame:
    table = chi_square(contingency(employees, features)).orderBy("feature")
    return with_p(table, lambda row: chi_square_tail(row["statistic"], row["dof"]))


def rank_sums(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """One row with n1, n2, ``u`` of the first sample, and the tie sum of t^3 - t.

    Rows shrink to one per distinct value; running counts over the distinct
    values then give mid-ranks. All sums are exact integers (twice the ranks).
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("v"))
        .agg(F.count_if(in_first).alias("a"), F.count_if(~in_first).alias("b"))
    )
    ranked = running_totals(counts, [F.asc("v")], ["b"])
    big = "decimal(19,0)"
    a, b, t = F.col("a").cast(big), F.col("b").cast(big), (F.col("a") + F.col("b")).cast("decimal(12,0)")
    twice_u = a * (F.col("before_b").cast(big) * 2 + b)
    return ranked.agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        (F.sum(twice_u).cast("double") / 2).alias("u"),
        F.sum(t * t * t - t).cast("double").alias("ties"),
    )


def mann_whitney_u(df: DataFrame, value: str = "monthly_income", in_first: Column | None = None) -> DataFrame:
    """(n1, n2, u, z): two-sided rank test with tie and continuity correction, leavers first."""
    one = rank_sums(df, value, left() if in_first is None else in_first)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - F.try_divide(F.col("ties"), n * (n - 1.0))))
    larger = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    return one.select("n1", "n2", "u", F.try_divide(larger - n1 * n2 / 2.0 - 0.5, spread).alias("z"))


def mann_whitney_test(employees: DataFrame) -> DataFrame:
    return mann_whitney_u(employees).select("n1", "n2", "u", round_away("z", 6).alias("z"))


def rank_test_p(employees: DataFrame) -> DataFrame:
    return with_p(mann_whitney_u(employees), lambda row: one_sided_twice(row["z"]))


def wilcox_w(employees: DataFrame) -> DataFrame:
    """The same test told from the other sample: W counts for those who stayed."""
    w = F.col("n1").cast("double") * F.col("n2").cast("double") - F.col("u")
    return rank_test_p(employees).select(w.alias("w"), "p_value")


def statistical_tests(employees: DataFrame, features: Sequence[str] = TESTED) -> DataFrame:
    """(test, statistic, p_value, significant_at_5pct) with p as scientific text."""
    chi = chi_square_p_values(employees, features).select(
        F.array_position(F.lit(list(features)), F.col("feature")).alias("no"),
        F.concat(F.lit(CHI_SQUARE_TITLE), "feature").alias("test"),
        F.bround("statistic", 2).alias("statistic"),
        "p_value",
    )
    rank = rank_test_p(employees).select(
        F.lit(len(features) + 1).cast("long").alias("no"),
        F.lit(MANN_WHITNEY_TITLE).alias("test"),
        F.bround("u", 0).alias("statistic"),
        "p_value",
    )
    return (
        chi.unionByName(rank)
        .orderBy("no")
        .select(
            "test",
            "statistic",
            F.format_string("%.2e", "p_value").alias("p_value"),
            (F.col("p_value") < 0.05).alias("significant_at_5pct"),
        )
    )
