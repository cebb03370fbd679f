"""Writers: plain tables, the star-schema export and saved query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, Observation
from pyspark.sql import functions as F


def _csv(writer: DataFrameWriter, fmt: str) -> DataFrameWriter:
    """A header, and quotes doubled inside quoted fields, as CSV readers commonly expect."""
    return writer.options(header=True, escape='"') if fmt == "csv" else writer


def save(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Overwrite ``path`` with ``df`` and return the row count seen by the write itself."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite").format(fmt)
    _csv(writer, fmt).save(path)
    return int(seen.get["rows"])


def save_fact(fact: DataFrame, path: str, fmt: str = "parquet") -> int:
    """The sales fact in one folder per month, ordered by customer within files.

    ``rebalance`` lets Spark split a heavy month over many files and merge the
    light ones; readers then skip months by folder and, in Parquet, customers by
    file statistics.
    """
    seen = Observation()
    writer = (
        fact.observe(seen, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", "order_month")
        .sortWithinPartitions("order_month", "customer_id")
        .write.mode("overwrite")
        .partitionBy("order_month")
        .format(fmt)
    )
    _csv(writer, fmt).save(path)
    return int(seen.get["rows"])


def star_export(
    fact: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    folder: str,
    fact_fmt: str = "parquet",
    dims_fmt: str = "csv",
) -> dict[str, int]:
    """Fact and both dimensions as files; returns rows written per table."""
    return {
        "sales_fact": save_fact(fact, f"{folder}/sales_fact", fact_fmt),
        "dim_customers": save(customers, f"{folder}/dim_customers", dims_fmt),
        "dim_products": save(products, f"{folder}/dim_products", dims_fmt),
    }
