"""Readers for raw tables kept as CSV or Parquet files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import schemas

# The text tokens that the usual CSV readers take as "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class RawSales:
    """The four raw sales tables, with the column names of ``schemas``."""

    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame


class MissingColumns(ValueError):
    """A file lacks columns of its table."""


def _text_columns(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, whole: bool = False) -> DataFrame:
    """Every column of the file as text, found by its name in the header, and the text of broken rows.

    The parser skips columns that are not asked for and then cannot tell broken
    rows; ``whole`` makes it read them all.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}
    if whole:
        options["columnPruning"] = False
    header = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise MissingColumns(f"{path} has no column {', '.join(missing)}")
    as_text = T.StructType([T.StructField(name, T.StringType(), True) for name in (*header, CORRUPT)])
    # not enforced: every file's own header must agree with the first
    return spark.read.schema(as_text).options(**options, enforceSchema=False, columnNameOfCorruptRecord=CORRUPT).csv(path)


def _typed(value: Column, kind: T.DataType) -> Column:
    """``value`` as ``kind``, NULL where that cannot be; whole numbers may be written with decimals."""
    if isinstance(kind, T.IntegerType):
        number = value.try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast("int"))
    return value.try_cast(kind)


def _given(column: str, fmt: str) -> Column:
    value = F.col(column)
    return F.when(~value.isin(*NULL_TOKENS), value) if fmt == "csv" else value


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str, multi_line: bool, whole: bool = False) -> DataFrame:
    if fmt == "csv":
        return _text_columns(spark, path, schema, multi_line, whole)
    table = spark.read.format(fmt).load(path)
    missing = [name for name in schema.fieldNames() if name not in table.columns]
    if missing:
        raise MissingColumns(f"{path} has no column {', '.join(missing)}")
    return table


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False, multi_line: bool = False
) -> DataFrame:
    """CSV with a header, its columns bound by name and held to a schema.

    Fields are read as text, missing tokens become NULL, and values are then
    cast with ``try_cast``: one bad number costs one NULL, not the row. A quote
    inside a quoted field is doubled. With ``keep_corrupt`` the text of rows with
    a wrong field count is kept beside them. ``multi_line`` allows line breaks in
    quoted fields; such files cannot be split between tasks.
    """
    raw = _text_columns(spark, path, schema, multi_line)
    typed = [_typed(_given(f.name, "csv"), f.dataType).alias(f.name) for f in schema.fields]
    return raw.select(*typed, *([CORRUPT] if keep_corrupt else []))


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """A raw table in the types of its schema, whatever those of the file are."""
    raw = _load(spark, path, schema, fmt, multi_line)
    return raw.select(*[_typed(_given(f.name, fmt), f.dataType).alias(f.name) for f in schema.fields])


def read_problems(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """``metric, value``: rows, rows with a wrong number of fields, and for each column the values no cast could keep."""
    raw = _load(spark, path, schema, fmt, multi_line, whole=True)
    broken = F.count_if(F.col(CORRUPT).isNotNull()) if fmt == "csv" else F.lit(0).cast("long")
    lost = {
        f"lost_{f.name}": F.count_if(_given(f.name, fmt).isNotNull() & _typed(_given(f.name, fmt), f.dataType).isNull())
        for f in schema.fields
        if not isinstance(f.dataType, T.StringType)
    }
    counted = raw.agg(F.count(F.lit(1)).alias("rows"), broken.alias("broken_rows"), *[c.alias(n) for n, c in lost.items()])
    return counted.unpivot([], ["rows", "broken_rows", *lost], "metric", "value")


def read_sales(spark: SparkSession, folder: str, fmt: str = "csv", multi_line: bool = False) -> RawSales:
    """The four sales tables from ``folder``: customers, products, orders, order_items."""
    folder = folder.rstrip("/")
    return RawSales(
        **{
            name: read_table(spark, f"{folder}/{name}.{fmt}", schema, fmt, multi_line)
            for name, schema in schemas.SALES_TABLES.items()
        }
    )


def sales_problems(spark: SparkSession, folder: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """``table, metric, value`` of :func:`read_problems` for the four sales tables."""
    folder = folder.rstrip("/")
    found = [
        read_problems(spark, f"{folder}/{name}.{fmt}", schema, fmt, multi_line).select(F.lit(name).alias("table"), "metric", "value")
        for name, schema in schemas.SALES_TABLES.items()
    ]
    return reduce(DataFrame.unionByName, found)


def read_employees(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    return read_table(spark, path, schemas.EMPLOYEES, fmt, multi_line)


def register(frames: dict[str, DataFrame]) -> None:
    """Make frames readable by name from ``spark.sql``, replacing older ones."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
