"""Row numbers, tiles and running totals over a whole table without a one-task window.

A window with no (or one dominant) PARTITION BY key puts its rows into one
task. Here the rows are range-sorted on the full, unique sort key, so a hot key
is spread over many slices; the sorted rows are written to a table, which fixes
the slice of every row even when executors are lost; and only one small line
per slice is needed to turn positions within a slice into positions overall.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

_SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def _sliced(df: DataFrame, sort: Sequence[Column]) -> DataFrame:
    """Sort over the cluster, then keep each row's slice and place in it."""
    at = F.col("_at")
    placed = cut(df.orderBy(*sort).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumns(
        {"_slice": F.shiftright(at, _SLICE_BITS), "_at": at.bitwiseAND(F.lit((1 << _SLICE_BITS) - 1))}
    )


def number_rows(df: DataFrame, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Add ``row_no`` (1-based) and ``group_rows``; ``order`` must end in a unique key."""
    placed = _sliced(df, [F.col(g).asc_nulls_first() for g in group] + list(order))
    per_slice = placed.groupBy(*group, "_slice").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # one line per (group, slice): at most the slice count for any one group
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = per_slice.select(
        *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_ks"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    on = reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_ks"))
    return placed.join(cut(spans), on).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias("row_no"), "group_rows"
    )


def tile(k: int, row_no: str = "row_no", total: str = "group_rows") -> Column:
    """NTILE(k) from a row number: the low tiles take the remainder."""
    rn, n = F.col(row_no), F.col(total)
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    return (
        F.when(rn <= wide, F.ceil(rn / (q + 1)))
        .otherwise(r + F.ceil(F.try_divide(rn - wide, q)))
        .cast("int")
    )


def running_totals(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Add ``before_<c>``: the sum of ``c`` over all earlier rows, for each c in ``sums``."""
    placed = _sliced(df, order)
    per_slice = placed.groupBy("_slice").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col("_slice").alias("_ks"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    inside = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(cut(offsets), F.col("_slice") == F.col("_ks")).select(
        *df.columns,
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_off_{c}")).alias(f"before_{c}")
            for c in sums
        ],
    )
