"""The totals that the sales reports add up, from one pass over the fact.

Reports sum revenue and profit, count orders and customers, and look at states,
days and groups; none but the product ranking asks which line a sum came from.
So one aggregate over two grouping sets holds all they need: a row per order and
category, and a row per product. Both keep the fact's column names, and a report
over the level it needs returns what it returns over the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What reports group, filter and count by; lines of one order differ in the category alone.
ORDER_KEYS = (
    "order_id", "order_date", "order_month", "status", "discount_pct",
    "customer_id", "region", "category",
)
PRODUCT_KEYS = ("status", "category", "product_name")

ORDERS, PRODUCTS = "orders", "products"


def report_totals(fact: DataFrame) -> DataFrame:
    """Both levels in one table, told apart by ``level``; keys that a level lacks are NULL.

    Sums are taken before the shuffle, so a hot product or order moves as one
    row a task.
    """
    keys = [*ORDER_KEYS, "product_name"]
    sums = fact.groupingSets([list(ORDER_KEYS), list(PRODUCT_KEYS)], *keys).agg(
        F.grouping("order_id").alias("no_order"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit")
    )
    # grouping() and not a NULL test: keys may be NULL themselves
    level = F.when(F.col("no_order") == 1, F.lit(PRODUCTS)).otherwise(F.lit(ORDERS))
    return sums.select(*keys, "revenue", "profit", level.alias("level"))


def save_totals(fact: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the totals with a folder for each level; the order level and the product level, read back."""
    totals = report_totals(fact)
    totals.write.partitionBy("level").parquet(path)
    saved = fact.sparkSession.read.schema(totals.schema).parquet(path)
    return (
        saved.where(F.col("level") == ORDERS).select(*ORDER_KEYS, "revenue", "profit"),
        saved.where(F.col("level") == PRODUCTS).select(*PRODUCT_KEYS, "revenue", "profit"),
    )
