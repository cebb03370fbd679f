"""From raw to clean tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import blank_to, iso_date, proper_first, rows, title_words
from tidemark.functions.joins import group_join
from tidemark.functions.medians import group_median
from tidemark.session import cut

# Spellings and codes that the cleaned tables must carry.
UNKNOWN_SHIP_MODE = "Unknown"
DEPARTMENT_SPELLINGS = {"Hr": "HR"}
OVERTIME_CODES = {"Y": "Yes", "N": "No"}


def clean_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_name",
        proper_first("city").alias("city"),
        "state",
        "region",
        "segment",
        iso_date("signup_date").alias("signup_date"),
    )


def clean_products(raw: DataFrame) -> DataFrame:
    return raw.select("product_id", "category", "sub_category", "product_name", "unit_cost", "unit_price")


def standard_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        iso_date("order_date").alias("order_date"),
        blank_to("ship_mode", UNKNOWN_SHIP_MODE).alias("ship_mode"),
        "discount_pct",
        proper_first("status").alias("status"),
    )


def clean_orders(raw: DataFrame) -> DataFrame:
    """Standardise, then drop rows that became identical.

    ``distinct`` pre-aggregates before its shuffle, so a record repeated any
    number of times leaves each task once.
    """
    return standard_orders(raw).distinct()


def clean_order_items(raw: DataFrame) -> DataFrame:
    return raw.select("order_id", "product_id", "quantity")


def _copies(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of times each occurs."""
    return df.groupBy(*df.columns).agg(rows().alias("copies"))


def dedup_report(standardised: DataFrame) -> DataFrame:
    """One row, one pass: rows before, rows after, rows removed by ``distinct``."""
    return (
        _copies(standardised)
        .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"), rows().alias("rows_after"))
        .select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))
    )


def lookup_enrich(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Add the attributes of ``lookup`` by ``key``; NULL where the key is not listed."""
    return df.join(lookup, key, "left")


def clamp_dates(df: DataFrame, day: str, earliest: str | Column, latest: date | Column) -> DataFrame:
    """Move ``day`` up to ``earliest`` and then down to ``latest``; NULL if any bound is NULL."""
    low = F.col(earliest) if isinstance(earliest, str) else earliest
    high = latest if isinstance(latest, Column) else F.lit(latest)
    d = F.col(day)
    moved = F.least(F.greatest(d, low), high)
    return df.withColumn(day, F.when(d.isNotNull() & low.isNotNull() & high.isNotNull(), moved))


def recode(value: Column, codes: dict[str, str]) -> Column:
    """Replace the listed values, keep all others."""
    out = value
    for code, meaning in codes.items():
        out = F.when(value == code, F.lit(meaning)).otherwise(out)
    return out


def _standardise(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "department": title_words("department", DEPARTMENT_SPELLINGS),
            "overtime": recode(F.col("overtime"), OVERTIME_CODES),
        }
    )


def employee_records(raw: DataFrame, dedup_stage: str = "after") -> DataFrame:
    """Standardised employees without repeated rows; incomes may still be missing.

    ``dedup_stage="before"`` drops only rows that were identical in the raw
    table; ``"after"`` also drops copies that differ in spelling alone.
    """
    if _dedup_first(dedup_stage):
        return _standardise(raw.distinct())
    return _standardise(raw).distinct()


def _dedup_first(dedup_stage: str) -> bool:
    if dedup_stage not in ("before", "after"):
        raise ValueError(f"dedup_stage must be 'before' or 'after', not {dedup_stage!r}")
    return dedup_stage == "before"


def impute_income(records: DataFrame) -> DataFrame:
    """Fill missing incomes with the median income of the same job role.

    ``records`` is read three times and therefore written first; its rows do not
    move again as long as the medians can be broadcast.
    """
    records = cut(records)
    medians = group_median(records, "job_role", "monthly_income", "role_median", spread_by="employee_id")
    filled = F.coalesce(F.col("monthly_income"), F.col("role_median"))
    return (
        group_join(records, medians, "job_role")
        .withColumn("monthly_income", filled)
        .select(*records.columns)
    )


def clean_employees(raw: DataFrame, dedup_stage: str = "after") -> DataFrame:
    return impute_income(employee_records(raw, dedup_stage))


def cleaning_log(raw: DataFrame, dedup_stage: str = "after") -> DataFrame:
    """(metric, value): rows read, copies removed, incomes missing after that; one pass."""
    compared = raw if _dedup_first(dedup_stage) else _standardise(raw)
    return (
        _copies(compared)
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_raw"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
            F.count_if(F.col("monthly_income").isNull()).alias("missing_income"),
        )
        .unpivot([], ["rows_raw", "duplicates_removed", "missing_income"], "metric", "value")
    )
