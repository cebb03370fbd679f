"""Bringing one value per group back to the rows of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def group_join(rows: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """Null-safe left join of ``per_group`` (one row per group).

    The grouped side is written first, so its bytes are known when the join is
    planned: below Spark's own threshold it is broadcast and no row moves, above
    it both sides are shuffled for this join alone, where a hot group can be
    split at run time.
    """
    found = cut(per_group.withColumnRenamed(group, "_group"))
    return rows.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
