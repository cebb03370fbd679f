"""Sales reports over the fact.

Distinct orders are counted by first grouping to one row per (report key,
order), which needs no further shuffle of the lines behind the fact's join on
orders; the second step counts rows instead of carrying every order id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import percent, ratio, round_away
from tidemark.operators.fact import RETURNED, delivered

_SUMS = ("revenue", "profit")


def per_order(fact: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct (keys, order_id) with exact revenue and profit sums."""
    return fact.groupBy(*keys, "order_id").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _per_customer(fact: DataFrame, *keys: str) -> DataFrame:
    """One row per (keys, customer_id): exact sums, and the orders counted at this customer.

    Lines are grouped by order, which is how the fact's last join left them, so
    only orders move. An order is counted, with its sums, at one of its
    customers, should it name several.
    """
    orders = fact.groupBy(*keys, "order_id").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.collect_set("customer_id").alias("customers")
    )
    counted = F.coalesce(F.col("place"), F.lit(0)) == 0
    return (
        orders.select(*keys, *_SUMS, F.posexplode_outer("customers").alias("place", "customer_id"))
        .groupBy(*keys, "customer_id")
        .agg(*[F.sum(F.when(counted, F.col(c))).alias(c) for c in _SUMS], F.count_if(counted).alias("orders"))
    )


def _total(name: str):
    return F.sum(name).alias(name)


def kpi_summary(fact: DataFrame) -> DataFrame:
    total = _per_customer(delivered(fact)).agg(
        _total("revenue"),
        _total("profit"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count("customer_id").alias("active_customers"),
    )
    return total.select(
        round_away("revenue").alias("total_revenue"),
        round_away("profit").alias("total_profit"),
        percent("profit", "revenue").alias("profit_margin_pct"),
        "orders",
        "active_customers",
        round_away(ratio("revenue", "orders")).alias("avg_order_value"),
    )


def monthly_revenue_mom(fact: DataFrame) -> DataFrame:
    """Monthly sums are rounded first; growth and running total use the rounded values.

    The unpartitioned windows see one row per calendar month.
    """
    monthly = (
        delivered(fact)
        .groupBy("order_month")
        .agg(round_away(F.sum("revenue")).alias("revenue"), round_away(F.sum("profit")).alias("profit"))
    )
    by_month = Window.orderBy("order_month")
    return (
        monthly.withColumn("prev_month_revenue", F.lag("revenue").over(by_month))
        .withColumn("running_revenue", F.sum("revenue").over(by_month))
        .select(
            "order_month",
            "revenue",
            "profit",
            "prev_month_revenue",
            percent(F.col("revenue") - F.col("prev_month_revenue"), "prev_month_revenue").alias("mom_growth_pct"),
            "running_revenue",
        )
        .orderBy("order_month")
    )


def category_profitability(fact: DataFrame) -> DataFrame:
    by_category = delivered(fact).groupBy("category").agg(_total("revenue"), _total("profit"))
    everything = Window.partitionBy()
    return (
        by_category.withColumn("all_revenue", F.sum("revenue").over(everything))
        .select(
            "category",
            round_away("revenue").alias("revenue"),
            round_away("profit").alias("profit"),
            percent("profit", "revenue").alias("margin_pct"),
            percent("revenue", "all_revenue").alias("revenue_share_pct"),
        )
        .orderBy(F.desc("profit"), "category")
    )


def top_products_per_category(fact: DataFrame, k: int = 3) -> DataFrame:
    """The k best products by profit in each category; ties share a rank and are all kept."""
    best_first = Window.partitionBy("category").orderBy(F.desc("exact"))
    return (
        delivered(fact)
        .groupBy("category", "product_name")
        .agg(F.sum("profit").alias("exact"))
        .withColumn("rnk", F.rank().over(best_first))
        .where(F.col("rnk") <= k)
        .select("category", "rnk", "product_name", round_away("exact").alias("profit"))
        .orderBy("category", "rnk", "product_name")
    )


def regional_performance(fact: DataFrame) -> DataFrame:
    return (
        _per_customer(delivered(fact), "region")
        .groupBy("region")
        .agg(
            F.count("customer_id").alias("customers"),
            _total("orders"),
            _total("revenue"),
            _total("profit"),
        )
        .select(
            "region",
            "customers",
            "orders",
            round_away("revenue").alias("revenue"),
            round_away(ratio("revenue", "orders")).alias("avg_order_value"),
            percent("profit", "revenue").alias("margin_pct"),
        )
        .orderBy(F.desc("revenue"), "region")
    )


def discount_impact(fact: DataFrame) -> DataFrame:
    return (
        per_order(delivered(fact), "discount_pct")
        .groupBy("discount_pct")
        .agg(F.count("order_id").alias("orders"), _total("revenue"), _total("profit"))
        .select(
            "discount_pct",
            "orders",
            round_away("revenue").alias("revenue"),
            round_away("profit").alias("profit"),
            percent("profit", "revenue").alias("margin_pct"),
        )
        .orderBy("discount_pct")
    )


def _order_returns(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys, "order_id").agg(F.bool_or(F.col("status") == RETURNED).alias("returned"))


def return_rate_by_category(fact: DataFrame) -> DataFrame:
    """All states count; an order counts in each category it touches."""
    return (
        _order_returns(fact, "category")
        .groupBy("category")
        .agg(
            F.count("order_id").alias("orders"),
            F.count_if(F.col("returned") & F.col("order_id").isNotNull()).alias("returned_orders"),
        )
        .withColumn("return_rate_pct", percent("returned_orders", "orders"))
        .orderBy(F.desc("return_rate_pct"), "category")
    )


def return_rate_overall(fact: DataFrame) -> DataFrame:
    return (
        _order_returns(fact)
        .agg(
            F.count("order_id").alias("orders"),
            F.count_if(F.col("returned") & F.col("order_id").isNotNull()).alias("returned_orders"),
        )
        .withColumn("return_rate", ratio("returned_orders", "orders"))
    )


def loss_making_revenue(fact: DataFrame) -> DataFrame:
    """Revenue of delivered lines that lost money; NULL when there is none."""
    at_loss = F.when(F.col("profit") < 0, F.col("revenue"))
    return delivered(fact).agg(F.sum(at_loss).alias("loss_making_revenue"))


def top_customers(fact: DataFrame, k: int = 10) -> DataFrame:
    return (
        delivered(fact)
        .groupBy("customer_id")
        .agg(_total("revenue"))
        .orderBy(F.desc("revenue"), "customer_id")
        .limit(k)
        .select("customer_id", round_away("revenue", 2).alias("revenue"))
    )


def customer_order_detail(fact: DataFrame, k: int = 10) -> DataFrame:
    """Delivered lines of the k top customers.

    The k ids are fetched first: as literals they filter customers and orders
    at the scan, before any line is joined.
    """
    chosen = [row["customer_id"] for row in top_customers(fact, k).select("customer_id").collect()]
    return (
        delivered(fact)
        .where(F.col("customer_id").isin(chosen))
        .select(
            "customer_id", "order_id", "order_date", "product_id", "product_name",
            "category", "quantity", "discount_pct", "revenue", "profit",
        )
    )


def sliced_kpis(
    fact: DataFrame,
    years: Sequence[int] | None = None,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """The headline measures under optional slicers; no slicer means all rows."""
    kept = delivered(fact)
    if years is not None:
        kept = kept.where(F.year("order_date").isin(*years))
    if regions is not None:
        kept = kept.where(F.col("region").isin(*regions))
    if categories is not None:
        kept = kept.where(F.col("category").isin(*categories))
    return (
        per_order(kept)
        .agg(_total("revenue"), _total("profit"), F.count("order_id").alias("orders"))
        .select(
            "revenue",
            "profit",
            ratio("profit", "revenue").alias("margin"),
            "orders",
            ratio("revenue", "orders").alias("avg_order_value"),
        )
    )


def sales_cube_monthly(fact: DataFrame) -> DataFrame:
    """Month x category x region, the table that the summary blocks and pivots read."""
    cells = ("order_month", "category", "region")
    return (
        per_order(delivered(fact), *cells)
        .groupBy(*cells)
        .agg(F.count("order_id").alias("orders"), _total("revenue"), _total("profit"))
        .select(
            F.col("order_month").alias("month"),
            F.substring("order_month", 1, 4).cast("int").alias("year"),
            "category",
            "region",
            "orders",
            round_away("revenue").alias("revenue"),
            round_away("profit").alias("profit"),
        )
        .orderBy("month", "category", "region")
    )


def summary_blocks(cube: DataFrame) -> DataFrame:
    """(block, key, revenue, profit, margin, revenue_share) with a Total row per block.

    Reads the small cube, so the grouping sets expand cells, not order lines.
    """
    blocks = ("category", "region", "year")
    long = cube.select(
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).cast("string").alias("key")) for b in blocks])
        ).alias("b"),
        "revenue",
        "profit",
    ).select("b.block", "b.key", "revenue", "profit")
    sums = (
        long.groupingSets([["block", "key"], ["block"]], "block", "key")
        .agg(F.grouping("key").alias("is_total"), _total("revenue"), _total("profit"))
        .withColumn("all_revenue", F.max(F.when(F.col("is_total") == 1, F.col("revenue"))).over(Window.partitionBy("block")))
    )
    return sums.select(
        "block",
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("key")).alias("key"),
        "revenue",
        "profit",
        F.coalesce(ratio("profit", "revenue"), F.lit(0.0)).alias("margin"),
        F.coalesce(ratio("revenue", "all_revenue"), F.lit(0.0)).alias("revenue_share"),
    ).orderBy("block", "is_total", "key")


def category_by_year(
    cube: DataFrame, regions: Sequence[str] | None = None, months: Sequence[str] | None = None
) -> DataFrame:
    """A row per category and year: revenue, profit, margin, and the category's revenue over all years."""
    kept = cube
    if regions is not None:
        kept = kept.where(F.col("region").isin(*regions))
    if months is not None:
        kept = kept.where(F.col("month").isin(*months))
    yearly = kept.groupBy("category", "year").agg(_total("revenue"), _total("profit"))
    all_years = F.sum("revenue").over(Window.partitionBy("category"))
    return yearly.select(
        "category",
        "year",
        "revenue",
        "profit",
        ratio("profit", "revenue").alias("margin"),
        round_away(all_years).alias("total_revenue"),
    ).orderBy(F.desc("total_revenue"), "category", "year")


def category_year_pivot(
    cube: DataFrame, regions: Sequence[str] | None = None, months: Sequence[str] | None = None
) -> DataFrame:
    """Categories by year, one column each for revenue, profit and margin of every year in the data.

    The years are read first (a handful of rows), so pass a cube that is already computed.
    """
    rows = category_by_year(cube, regions, months)
    years = [r["year"] for r in rows.select("year").distinct().orderBy("year").collect()]
    shown = ["revenue", "profit", "margin"]
    wide = rows.groupBy("category", "total_revenue").pivot("year", years).agg(*[F.first(c).alias(c) for c in shown])
    # with no year at all, pivot makes no column
    columns = [F.col(f"{y}_{c}").alias(f"{c}_{y}") for y in years for c in shown]
    return wide.select("category", *columns, "total_revenue").orderBy(F.desc("total_revenue"), "category")
