"""Exact medians per group that do not hold a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SALTS = 64
_ACCURACY = 10_000
_MARGIN = 0.001  # ten times the error bound of the sketch at that accuracy
_WIDER = 20  # by how much the bracket grows when it has missed


def group_median(
    df: DataFrame, group: str, value: str, out: str = "median", spread_by: str | None = None
) -> DataFrame:
    """(group, out): the exact median of the non-NULL values of each group; NULL for the NULL group.

    A mergeable quantile sketch brackets the middle of each group; only the
    values inside the bracket are then counted one by one, everything below it
    is one number. A group of n rows thus sends about 0.002 n counted values to
    its window instead of all of them. Rows meet their bracket by (group, salt),
    so a dominant group is spread over ``SALTS`` tasks there too; ``spread_by``
    names the column to salt by, best a key. The ranks counted show whether the
    bracket held the middle; groups where it did not are done again with a wider
    one, in the end the whole range.

    NULLs are not filtered out up front and the join is null-safe: such filters
    would slip below the caller's own steps, and Spark could then no longer
    reuse their shuffle for this and for the caller's other reads of ``df``.
    """
    found = _bracketed_median(df, group, value, out, spread_by, _MARGIN)
    margin, done = _MARGIN, None
    while margin < 0.5:
        found = cut(found)
        held = found.where(~_missed(out)).drop("_n")
        done = held if done is None else done.unionByName(held)
        missed = found.where(_missed(out)).select(group)
        if missed.isEmpty():
            return done
        margin = min(0.5, margin * _WIDER)
        found = _bracketed_median(df.join(missed, group, "left_semi"), group, value, out, spread_by, margin)
    return found.drop("_n") if done is None else done.unionByName(found.drop("_n"))


def _missed(out: str) -> Column:
    return F.col(out).isNull() & (F.col("_n") > 0)


def _bracketed_median(df: DataFrame, group: str, value: str, out: str, spread_by: str | None, margin: float) -> DataFrame:
    """(group, out, _n): the median where the bracket holds it, and how many values there are (0 for the NULL group)."""
    salt = F.pmod(F.hash(spread_by or value), F.lit(SALTS))
    slim = df.select(F.col(group).alias("_g"), F.col(value).alias("_v"), salt.alias("_s"))
    bracket = (
        slim.groupBy(F.col("_g").alias("_bg"))
        .agg(
            F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], _ACCURACY).alias("_b"),
            F.count("_v").alias("_n"),
        )
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_bs"))
    )
    counted = (
        slim.join(bracket, F.col("_g").eqNullSafe(F.col("_bg")) & F.col("_s").eqNullSafe(F.col("_bs")))
        .where(F.coalesce(F.col("_v") <= F.col("_b")[1], F.lit(False)))
        .groupBy("_g", "_n", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first())
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, c, end = F.col("_n"), F.col("_c"), F.col("_end")

    def holds(rank):
        return F.max(F.when((rank > end - c) & (rank <= end), F.col("_v")))

    low, high = holds(F.floor((n + 1) / 2)), holds(F.floor(n / 2) + 1)
    half = F.lit(0.5) if dict(df.dtypes)[value] == "double" else F.expr("0.5BD")
    known = F.col("_g").isNotNull()
    return (
        counted.withColumn("_end", F.sum("_c").over(upto))
        .groupBy("_g")
        .agg(((low + high) * half).alias("_m"), F.max("_n").alias("_n"))
        .select(F.col("_g").alias(group), F.when(known, F.col("_m")).alias(out), F.when(known, F.col("_n")).otherwise(0).alias("_n"))
    )
