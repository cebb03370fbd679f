"""Calendar table and measures that compare a month with other calendar months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.operators.fact import DELIVERED, delivered


def date_dim(first: Column, last: Column, spark_one_row: DataFrame) -> DataFrame:
    """One row per day from ``first`` to ``last``; both are columns of a one-row frame."""
    day = F.col("date")
    return spark_one_row.select(F.explode(F.sequence(first, last)).alias("date")).select(
        "date",
        F.year(day).alias("year"),
        F.month(day).alias("month_no"),
        F.date_format(day, "MMM yy").alias("month"),
        F.concat(F.lit("Q"), F.quarter(day).cast("string")).alias("quarter"),
    )


def date_dim_for(orders: DataFrame, day: str = "order_date") -> DataFrame:
    """The whole calendar years that ``orders`` touches."""
    span = orders.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return date_dim(F.trunc("lo", "year"), F.date_sub(F.add_months(F.trunc("hi", "year"), 12), 1), span)


def months_with_revenue(fact: DataFrame) -> DataFrame:
    """Every month of the calendar years in the fact; revenue is NULL in empty months.

    The fact is read once: the span of its dates comes from the same monthly sums.
    Empty months come from filling the gap up to the next month seen.
    """
    all_states = fact.groupBy(F.trunc("order_date", "month").alias("month_start")).agg(
        F.sum(F.when(F.col("status") == DELIVERED, F.col("revenue"))).alias("revenue")
    )
    seen = all_states.where("month_start IS NOT NULL")
    in_order = Window.orderBy("month_start")
    filled = seen.select(
        "month_start",
        "revenue",
        F.lag("month_start").over(in_order).alias("before"),
        F.lead("month_start").over(in_order).alias("after"),
    )
    start = F.when(F.col("before").isNull(), F.trunc("month_start", "year")).otherwise(F.col("month_start"))
    end = F.coalesce(F.add_months("after", -1), F.add_months(F.trunc("month_start", "year"), 11))
    month = F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("m")
    return filled.select(month, "month_start", "revenue").select(
        F.col("m").alias("month_start"),
        F.when(F.col("m") == F.col("month_start"), F.col("revenue")).alias("revenue"),
    )


def _with_earlier(monthly: DataFrame, months: int, name: str) -> DataFrame:
    """Revenue so many calendar months earlier; no month is missing, so rows back are months back."""
    return monthly.withColumn(name, F.lag("revenue", months).over(Window.orderBy("month_start")))


def _growth(now: str, then: str) -> Column:
    """Change over ``then``; an empty month counts as zero once there is a base."""
    zero = F.lit(0)
    return ratio(F.coalesce(F.col(now), zero) - F.col(then), then)


def revenue_yoy(fact: DataFrame) -> DataFrame:
    """Revenue, the same month last year, and the growth over it."""
    both = _with_earlier(months_with_revenue(fact), 12, "revenue_ly")
    return both.select(
        _key("month_start"), "revenue", "revenue_ly", _growth("revenue", "revenue_ly").alias("yoy_growth")
    ).orderBy("order_month")


def revenue_mom_calendar(fact: DataFrame) -> DataFrame:
    """Growth over the previous calendar month, which may be empty."""
    both = _with_earlier(months_with_revenue(fact), 1, "prev_revenue")
    return both.select(
        _key("month_start"), "revenue", "prev_revenue", _growth("revenue", "prev_revenue").alias("mom_growth")
    ).orderBy("order_month")


def revenue_ytd(fact: DataFrame) -> DataFrame:
    """Running revenue within each year, carried through empty months."""
    so_far = (
        Window.partitionBy(F.year("month_start"))
        .orderBy("month_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        months_with_revenue(fact)
        .withColumn("revenue_ytd", F.sum("revenue").over(so_far))
        .select(_key("month_start"), "revenue", "revenue_ytd")
        .orderBy("order_month")
    )


def annual_growth(fact: DataFrame) -> DataFrame:
    """Revenue per year and its growth over the year before."""
    yearly = delivered(fact).groupBy(F.year("order_date").alias("year")).agg(F.sum("revenue").alias("revenue"))
    by_year = Window.orderBy("year").rangeBetween(-1, -1)
    return (
        yearly.withColumn("prev_revenue", F.max("revenue").over(by_year))
        .select(
            "year",
            "revenue",
            "prev_revenue",
            ratio(F.col("revenue") - F.col("prev_revenue"), "prev_revenue").alias("growth"),
        )
        .orderBy("year")
    )


def _key(month_start: str) -> Column:
    return F.substring(F.col(month_start).cast("string"), 1, 7).alias("order_month")
