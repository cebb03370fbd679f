"""Integrity checks; each returns counts that should be zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import rows


class DataQualityError(ValueError):
    """A cleaned table still breaks one of its rules."""


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct key values, counted per key first so that copies collapse early."""
    per_key = df.groupBy(key).agg(rows().alias("n"))
    return per_key.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(key)).alias("duplicate_keys"),
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that name no parent."""
    return child.select(key).join(parent.select(key), key, "left_anti").agg(rows().alias("orphans"))


def require_none(**checks: DataFrame) -> None:
    """Raise unless every check, a frame of one count, finds nothing."""
    found = {name: check.first()[0] for name, check in checks.items()}
    broken = {name: n for name, n in found.items() if n}
    if broken:
        raise DataQualityError(f"integrity checks found problems: {broken}")


def null_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, repeated keys, and a ``null_<column>`` count for every column.

    The NULL counts need no shuffle and only the keys are grouped, so the
    columns never travel.
    """
    repeated = duplicate_keys(df, key).scalar()
    return df.agg(
        rows().alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    ).select("rows", repeated.alias("repeated_keys"), *[f"null_{c}" for c in df.columns])


def require_valid(df: DataFrame, key: str, optional: Sequence[str] = ()) -> dict[str, int]:
    """Raise unless ``key`` is unique and no column but the optional ones holds a NULL."""
    found = null_counts(df, key).first().asDict()
    skip = {"rows", *[f"null_{c}" for c in optional]}
    broken = {name: n for name, n in found.items() if n and name not in skip}
    if broken:
        raise DataQualityError(f"cleaning left problems: {broken}")
    return found
