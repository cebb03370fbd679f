"""The denormalised sales fact: one row per order line."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import MONEY, month_key
from tidemark.operators import cleaning
from tidemark.sources.readers import RawSales

# The order states the measures refer to.
DELIVERED = "Delivered"
RETURNED = "Returned"

COLUMNS = (
    "order_id", "order_date", "order_month", "status", "ship_mode", "discount_pct",
    "customer_id", "city", "state", "region", "segment", "signup_date",
    "product_id", "product_name", "category", "sub_category",
    "quantity", "revenue", "cost", "profit",
)


def _money(amount: Column) -> Column:
    return F.round(amount, 2).cast(MONEY)


def sales_fact(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Join the clean tables and price every line in exact decimals.

    Customers join at order grain, before the lines multiply the rows. Products
    join the lines first and orders last, so that grouping the result by order
    finds its lines together and moves none again. No join is forced to
    broadcast: Spark does so below its own size threshold and otherwise splits
    hot keys at run time (adaptive skew join).
    """
    placed = orders.join(customers, "customer_id")
    lines = items.join(products, "product_id").join(placed, "order_id")
    kept_share = F.lit(1) - F.col("discount_pct").cast("decimal(5,0)") * F.lit(Decimal("0.01"))
    units = F.col("quantity").cast("decimal(10,0)")
    gross = units * F.col("unit_price").cast("decimal(18,4)") * kept_share
    cost = units * F.col("unit_cost").cast("decimal(18,4)")
    return lines.withColumns(
        {
            "order_month": month_key("order_date"),
            "revenue": _money(gross),
            "cost": _money(cost),
            "profit": _money(gross - cost),
        }
    ).select(*COLUMNS)


def clean_and_join(raw: RawSales) -> DataFrame:
    return sales_fact(
        cleaning.clean_order_items(raw.order_items),
        cleaning.clean_orders(raw.orders),
        cleaning.clean_customers(raw.customers),
        cleaning.clean_products(raw.products),
    )


def delivered(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("status") == DELIVERED)
