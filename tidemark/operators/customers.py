"""Customer reports: RFM scores, revenue concentration, cohorts."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import month_number, percent, round_away, rows
from tidemark.functions.selection import tile_ends
from tidemark.operators.fact import DELIVERED, delivered
from tidemark.session import cut

# Segment names in the order they are tried, with lowest/highest scores (r, f, m).
RFM_SEGMENTS = (
    ("Champions", {"r": (3, 4), "f": (3, 4), "m": (3, 4)}),
    ("Loyal / Potential", {"r": (3, 4), "f": (2, 4)}),
    ("New Customers", {"r": (4, 4)}),
    ("At Risk", {"r": (1, 2), "f": (3, 4)}),
    ("Lost", {"r": (1, 1), "f": (1, 2)}),
)
RFM_OTHERS = "Needs Attention"

# score -> (column, sign): tiles are numbered along sign * column, so the largest gets 4
_RFM_KEYS = {"r": ("recency_days", -1.0), "f": ("frequency", 1.0), "m": ("monetary", 1.0)}


def rfm_base(fact: DataFrame) -> DataFrame:
    """Recency, frequency and monetary value per customer with a delivered order.

    Recency counts from the day after the last order of any state. That day
    comes out of the same pass: customers keep the last day of any order until
    the table is computed, and the newest of those is one row.
    """
    is_delivered = F.col("status") == DELIVERED
    per_order = fact.groupBy("customer_id", "order_id", is_delivered.alias("done")).agg(
        F.max("order_date").alias("day"), F.sum("revenue").alias("revenue")
    )
    per_customer = cut(
        per_order.groupBy("customer_id").agg(
            F.max("day").alias("last_any"),
            F.max(F.when(F.col("done"), F.col("day"))).alias("last_day"),
            F.count(F.when(F.col("done"), F.col("order_id"))).alias("frequency"),
            F.count_if("done").alias("groups"),
            F.sum(F.when(F.col("done"), F.col("revenue"))).alias("revenue"),
        )
    )
    ref_day = F.date_add(per_customer.agg(F.max("last_any")).scalar(), 1)
    return per_customer.where(F.col("groups") > 0).select(
        "customer_id",
        F.datediff(ref_day, "last_day").alias("recency_days"),
        "frequency",
        round_away("revenue").alias("monetary"),
    )


def _segment() -> Column:
    out = F.lit(RFM_OTHERS)
    for name, bounds in reversed(RFM_SEGMENTS):
        inside = [F.col(f"{s}_score").between(lo, hi) for s, (lo, hi) in bounds.items()]
        out = F.when(reduce(lambda a, b: a & b, inside), F.lit(name)).otherwise(out)
    return out


def score_tiles(df: DataFrame, keys: dict[str, tuple[str, float]], entity: str, k: int = 4) -> DataFrame:
    """Add ``<name>_score``, the NTILE(k) of sign * column with ``entity`` as tie-break, for every key.

    The k-1 tile ends of all keys are selected by counting, and scoring a row is
    then a comparison with those few literals: no sort, no join and no window over
    the entities. ``df`` is read several times, so pass a table that is already
    computed.
    """
    value = [
        F.struct(F.lit(name).alias("key"), (F.col(c).cast("double") * sign).alias("value"))
        for name, (c, sign) in keys.items()
    ]
    long = df.select(entity, F.explode(F.array(*value)).alias("kv")).select("kv.key", "kv.value", entity)
    # at most (k - 1) * len(keys) rows
    ends = tile_ends(long, k, ["key"], "value", entity)
    kind = df.schema[entity].dataType
    scores = {}
    for name, (c, sign) in keys.items():
        v, e = F.col(c).cast("double") * sign, F.col(entity)
        beyond = F.lit(1)
        for last_value, last_entity in (end[2:] for end in ends if end[0] == name):
            edge, tie = F.lit(last_value).cast("double"), F.lit(last_entity).cast(kind)
            if last_value is None:  # NULLs sort first
                after = v.isNotNull() | (e > tie)
            else:
                after = F.coalesce((v > edge) | ((v == edge) & (e > tie)), F.lit(False))
            beyond = beyond + after.cast("int")
        scores[f"{name}_score"] = beyond
    return df.withColumns(scores)


def customer_rfm(fact: DataFrame) -> DataFrame:
    return (
        score_tiles(rfm_base(fact), _RFM_KEYS, "customer_id")
        .withColumn("segment", _segment())
        .select("customer_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score", "segment")
    )


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    sums = rfm.groupBy("segment").agg(rows().alias("customers"), F.sum("monetary").alias("revenue"))
    return (
        sums.withColumn("all_revenue", F.sum("revenue").over(Window.partitionBy()))
        .select(
            "segment",
            "customers",
            round_away("revenue").alias("revenue"),
            percent("revenue", "all_revenue").alias("revenue_share_pct"),
        )
        .orderBy(F.desc("revenue"), "segment")
    )


def rfm_segment_counts(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("segment").agg(rows().alias("customers")).orderBy("segment")


def _beyond(kind: T.DataType) -> Column:
    """The greatest value of a revenue's type."""
    if isinstance(kind, T.DecimalType):
        return F.lit(Decimal((0, (9,) * kind.precision, -kind.scale))).cast(kind)
    return F.lit(float("inf"))


def pareto_customers(fact: DataFrame, k: int = 10) -> DataFrame:
    """Customers in k equal groups from the highest revenue down, with the cumulative share.

    A customer's group follows from the k-1 ends of the groups, so nothing is
    sorted. The running total at its highest point inside a tile needs no running sum
    over customers: revenue falls along the order, so it is the total of the
    earlier tiles plus the non-negative revenues of this one (or, without any,
    its first revenue).
    """
    per_customer = cut(delivered(fact).groupBy("customer_id").agg(F.sum("revenue").alias("revenue")))
    r, me, kind = F.col("revenue"), F.col("customer_id"), per_customer.schema["customer_id"].dataType
    # a customer without any known revenue comes last
    down = F.coalesce(-r, _beyond(per_customer.schema["revenue"].dataType))
    decile = F.lit(1)
    for _, last_down, last_customer in tile_ends(per_customer.select(me, down.alias("down")), k, [], "down", "customer_id"):  # at most k - 1 rows
        tie = F.lit(last_customer).cast(kind)
        decile = decile + ((down > last_down) | ((down == last_down) & (me > tie))).cast("int")
    tiles = (
        per_customer.groupBy(decile.alias("decile"))
        .agg(
            rows().alias("customers"),
            F.sum(r).alias("revenue"),
            F.coalesce(F.sum(F.when(r >= 0, r)), F.max(r), F.lit(0)).alias("rise"),
        )
    )
    earlier = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, -1)
    peak = F.coalesce(F.sum("revenue").over(earlier), F.lit(0)) + F.col("rise")
    return (
        tiles.withColumn("peak", peak)
        .withColumn("all_revenue", F.sum("revenue").over(Window.partitionBy()))
        .select(
            (F.col("decile") * (100 // k) if 100 % k == 0 else F.col("decile") * 100 / k).alias("top_customer_pct"),
            "customers",
            round_away("revenue").alias("revenue"),
            percent("peak", "all_revenue").alias("cumulative_revenue_pct"),
        )
        .orderBy("top_customer_pct")
    )


def cohort_retention(fact: DataFrame, last: int = 6) -> DataFrame:
    """Share of each first-order month's customers that order again 0..last months later.

    Orders shrink to one row per (customer, month) before the per-customer
    window, so a customer's window holds at most one row per calendar month.
    """
    active = delivered(fact).groupBy("customer_id", "order_month").agg(rows().alias("lines"))
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    by_age = (
        active.withColumn("cohort_month", first)
        .withColumn("months_since", month_number("order_month") - month_number("cohort_month"))
        .where(F.col("months_since").between(0, last))
        .groupBy("cohort_month", "months_since")
        .agg(F.count("customer_id").alias("active_customers"))
    )
    # every customer is active in its own first month
    size = F.max(F.when(F.col("months_since") == 0, F.col("active_customers")))
    return (
        by_age.withColumn("cohort_size", size.over(Window.partitionBy("cohort_month")))
        .select(
            "cohort_month",
            "cohort_size",
            "months_since",
            "active_customers",
            percent("active_customers", "cohort_size").alias("retention_pct"),
        )
        .orderBy("cohort_month", "months_since")
    )


def cohort_matrix(retention: DataFrame, last: int = 6) -> DataFrame:
    """Cohorts down, months since the first order across; NULL where nobody came back."""
    wide = retention.groupBy("cohort_month").pivot("months_since", list(range(last + 1))).agg(F.first("retention_pct"))
    return wide.select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in range(last + 1)]).orderBy(
        "cohort_month"
    )
