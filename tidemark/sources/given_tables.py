"""The raw tables as seen in the given star-schema Parquet files.

Each function renames and derives columns of the given tables so that they
have the raw layout of ``schemas``, dirt included (blank ship modes, lower-case
status, stray blanks, repeated rows). Every rule is arithmetic on the keys, so
that the same tables can be written in SQL for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import RawSales


# Columns and types of the given files, stated so that no footer is read to infer them.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _with_nation(df: DataFrame, key: str, nation: DataFrame) -> DataFrame:
    return df.join(nation, F.col(key) == F.col("n_nationkey"))


def _with_region(df: DataFrame, region: DataFrame) -> DataFrame:
    return df.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def _twice(when: Column) -> Column:
    """One generated row, or two where the source repeats the record."""
    return F.explode(F.when(when, F.expr("array(1, 2)")).otherwise(F.expr("array(1)")))


def city_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, state, region): the place dictionary, one row per nation."""
    n = F.col("n_name")
    city = F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substr(n, F.lit(2))))
    places = _with_region(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"))
    return places.select(city.alias("city"), n.alias("state"), F.col("r_name").alias("region"))


def raw_sales(spark: SparkSession, sf_dir: str) -> RawSales:
    orders = load(spark, sf_dir, "orders")
    first_day = orders.agg(F.min("o_orderdate").cast("date")).scalar()
    c_key, o_key = F.col("c_custkey"), F.col("o_orderkey")

    at_home = _with_nation(load(spark, sf_dir, "customer"), "c_nationkey", load(spark, sf_dir, "nation"))
    customers = _with_region(at_home, load(spark, sf_dir, "region")).select(
        c_key.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(c_key % 19 == 0, F.concat(F.upper("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("city"),
        F.col("c_mktsegment").alias("segment"),
        F.date_add(first_day, (c_key % 900).cast("int")).cast("string").alias("signup_date"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
    )

    price = F.col("p_retailprice").cast("decimal(12,2)")
    share = (
        F.when(F.col("p_size") % 3 == 0, F.lit("0.70"))
        .when(F.col("p_size") % 3 == 1, F.lit("0.80"))
        .otherwise(F.lit("0.95"))
        .cast("decimal(4,2)")
    )
    products = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        (price * share).alias("unit_cost"),
        price.alias("unit_price"),
    )

    priority, state = F.col("o_orderpriority"), F.col("o_orderstatus")
    status = F.when(state == "F", "Delivered").when(state == "O", "Returned").otherwise("Cancelled")
    raw_orders = orders.select(
        o_key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        F.when(priority == "4-NOT SPECIFIED", F.lit(None))
        .when(priority == "5-LOW", " ")
        .otherwise(F.substr(priority, F.lit(3)))
        .alias("ship_mode"),
        F.element_at(F.expr("array(0, 5, 10, 15, 20, 30)"), (o_key % 6 + 1).cast("int")).alias("discount_pct"),
        F.when(o_key % 100 == 0, F.lower(status)).otherwise(status).alias("status"),
        _twice(o_key % 200 == 0).alias("copy"),
    ).drop("copy")

    order_items = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    return RawSales(customers, products, raw_orders, order_items)


def raw_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workforce read off the customers: tenure, pay and leaving follow from their orders."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("u")
    )
    last_day = orders.agg(F.max("day")).scalar()
    history = orders.groupBy("o_custkey").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("own_last"),
        F.max(F.when(F.col("u"), F.col("day"))).alias("last_urgent"),
        F.count_if("u").alias("urgent"),
        F.count(F.lit(1)).alias("orders"),
    )
    k = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    dept = F.concat(F.upper(F.substring(segment, 1, 1)), F.lower(F.substr(segment, F.lit(2))))
    since = F.floor(F.datediff(last_day, F.coalesce("last_urgent", "first_day")) / 180).cast("int")
    tenure = (k % 13).cast("int")
    over = F.when(F.col("urgent") * 4 >= F.col("orders"), "Yes").otherwise("No")
    return (
        _with_nation(load(spark, sf_dir, "customer"), "c_nationkey", load(spark, sf_dir, "nation"))
        .join(history, k == F.col("o_custkey"))
        .select(
            k.alias("employee_id"),
            (k % 41 + 20).cast("int").alias("age"),
            F.when(k % 12 < 7, "Male").otherwise("Female").alias("gender"),
            F.when(k % 25 == 0, F.upper(segment)).otherwise(dept).alias("department"),
            F.col("n_name").alias("job_role"),
            F.element_at(
                F.expr("array('Bachelors', 'Masters', 'Diploma', 'PhD')"), (k % 4 + 1).cast("int")
            ).alias("education"),
            F.when(k % 33 != 0, F.col("c_acctbal").cast("decimal(12,2)")).alias("monthly_income"),
            tenure.alias("years_at_company"),
            F.least(since, tenure).alias("years_since_last_promotion"),
            F.when(k % 40 == 0, F.substring(over, 1, 1)).otherwise(over).alias("overtime"),
            (k % 4 + 1).cast("int").alias("job_satisfaction"),
            (k % 7 % 4 + 1).cast("int").alias("work_life_balance"),
            (F.col("n_nationkey") * 2 + 1).cast("int").alias("distance_from_home_km"),
            F.when(k % 5 == 0, 4).otherwise(3).alias("performance_rating"),
            (k % 6).cast("int").alias("num_companies_worked"),
            F.when(F.datediff(last_day, "own_last") > 365, "Yes").otherwise("No").alias("attrition"),
            _twice(k % 60 == 0).alias("copy"),
        )
        .drop("copy")
    )
