"""Upper-tail probabilities for the few result rows of a test.

Spark has no error function, so these run on the driver, on result rows only.
``erfc`` keeps tiny values that ``1 - cdf`` loses.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x) for chi-square with a whole number of degrees of freedom (finite sums)."""
    if dof <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        total, term = math.exp(-h), math.exp(-h)
        for k in range(1, dof // 2):
            term *= h / k
            total += term
        return min(total, 1.0)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return min(total, 1.0)


def two_sided(z: float) -> float:
    """P(|Z| > |z|) for a standard normal Z."""
    return min(math.erfc(abs(z) / math.sqrt(2.0)), 1.0)


def one_sided_twice(z: float) -> float:
    """Twice the upper tail, at most 1 (a continuity correction can make z negative)."""
    return min(math.erfc(z / math.sqrt(2.0)), 1.0)


def with_p(results: DataFrame, p_of: Callable[[Row], float]) -> DataFrame:
    """Add ``p_value`` to a result table that holds one row per test."""
    done = [(*row, None if any(v is None for v in row) else p_of(row)) for row in results.collect()]
    schema = T.StructType([*results.schema.fields, T.StructField("p_value", T.DoubleType(), True)])
    return results.sparkSession.createDataFrame(done, schema)
