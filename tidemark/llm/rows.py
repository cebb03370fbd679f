"""Column plumbing shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def all_columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def with_arrow_column(
    df: DataFrame, name: str, kind: str, inputs: list[Column], made: Callable[[list[pa.Array]], pa.Array]
) -> DataFrame:
    """``df`` with a column that ``made`` computes from the input columns, a batch at a time.

    Other columns pass through whatever they are called; one of the same name is
    replaced.
    """
    kept = [c for c in df.columns if c != name]
    passed = [quoted(c).alias(f"c{i}") for i, c in enumerate(kept)]
    given = df.select(*passed, *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("x0", T._parse_datatype_string(kind))])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made(batch.columns[n:])], names=schema.names)

    return given.mapInArrow(run, schema).toDF(*kept, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context.

    A job submitted with the package in ``--py-files`` does not need it.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(prefix="tidemark-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(os.path.realpath(path))  # served by the driver while the context lives
    context._tidemark_shipped = True
