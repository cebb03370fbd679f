"""What the physical plans must and must not do."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.medians import _bracketed_median, group_median
from tidemark.operators import cleaning, fact, sales
from tidemark.plans import registry
from tidemark.sources import readers

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    text = executed(df)
    return text[: text.rindex("== Initial Plan ==")] if "== Initial Plan ==" in text else text


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_query_pairs_all_rows(spark, name):
    if name in ("star_export", "run_catalogue"):
        pytest.skip("writes tables; its parts are checked on their own")
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEval" not in plan and "BatchEvalPython" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = executed(registry.queries()["category_profitability"](spark, SF))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    line = next(s for s in schemas if "l_orderkey" in s)
    assert sorted(c.split(":")[0] for c in line.split(",")) == ["l_orderkey", "l_partkey", "l_quantity"]
    assert not any("c_name" in s or "p_name" in s for s in schemas)


def test_status_filter_runs_before_the_shuffle(spark):
    plan = registry.queries()["kpi_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    dedup = plan[plan.index("Aggregate [order_id") if "Aggregate [order_id" in plan else 0 :]
    assert re.search(r"Filter .*Delivered", dedup[dedup.index("Generate") :]), plan


def test_drill_through_filters_orders_at_the_scan(spark):
    plan = registry.queries()["customer_order_detail"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(o_custkey", plan)
    assert re.search(r"PushedFilters: \[[^\]]*In\(c_custkey", plan)


def test_top_k_per_group_cuts_before_the_shuffle(spark):
    plan = executed(registry.queries()["top_products_per_category"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_k_needs_no_full_sort(spark):
    for name in ("top_customers", "rule_based_risk_flags", "high_risk_employees"):
        assert "TakeOrderedAndProject" in executed(registry.queries()[name](spark, SF))


def test_unused_medians_are_not_computed(spark):
    plan = executed(registry.queries()["attrition_by_overtime"](spark, SF))
    assert "role_median" not in plan
    assert "role_median" in executed(registry.queries()["workforce_kpis"](spark, SF))


def test_single_task_steps_see_only_grouped_rows(spark):
    """Every exchange to one partition sits above an aggregate."""
    for name in ("kpi_summary", "monthly_revenue_mom", "pareto_customers", "customer_rfm", "cohort_retention", "mann_whitney_u"):
        plan = final(registry.queries()[name](spark, SF))
        for part in plan.split("Exchange SinglePartition")[1:]:
            assert "Aggregate" in part.split("Scan")[0], plan


@pytest.fixture
def skewed_sales(spark):
    """Half of all lines belong to one order, half of all orders to one customer, a third of lines to one product."""
    n = 120_000
    k = F.col("id")
    items = spark.range(n, numPartitions=8).select(
        F.when(k % 2 == 0, F.lit(0)).otherwise(k % 20_000).alias("order_id"),
        F.when(k % 3 == 0, F.lit(1)).otherwise(k % 500).alias("product_id"),
        F.lit(1).alias("quantity"),
    )
    orders = spark.range(20_000, numPartitions=8).select(
        k.alias("order_id"), F.when(k % 2 == 0, F.lit(7)).otherwise(k % 3000).alias("customer_id"),
        F.lit("2024-01-01").cast("date").alias("order_date"), F.lit("Std").alias("ship_mode"),
        F.lit(10).alias("discount_pct"), F.lit("Delivered").alias("status"),
    )
    customers = spark.range(3000, numPartitions=4).select(
        k.alias("customer_id"), F.lit("n").alias("customer_name"), F.lit("c").alias("city"), F.lit("s").alias("state"),
        F.lit("r").alias("region"), F.lit("g").alias("segment"), F.lit(None).cast("date").alias("signup_date"),
    )
    products = spark.range(500, numPartitions=4).select(
        k.alias("product_id"), F.lit("cat").alias("category"), F.lit("sub").alias("sub_category"),
        F.concat(F.lit("p"), k.cast("string")).alias("product_name"),
        F.lit("1.00").cast("decimal(12,2)").alias("unit_cost"), F.lit("2.00").cast("decimal(12,2)").alias("unit_price"),
    )
    return items, orders, customers, products


def test_hot_keys_are_split_at_run_time(spark, conf, skewed_sales):
    conf(
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=2,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
    )
    report = sales.kpi_summary(fact.sales_fact(*skewed_sales))
    plan = executed(report)
    assert plan.count("SortMergeJoin(skew=true)") >= 2, plan
    # 120,000 lines of 1.80 at a cost of 1.00
    assert tuple(report.first())[:2] == (216_000.0, 96_000.0)


def test_hot_role_median_is_salted(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1)
    df = spark.range(30_000, numPartitions=8).select(F.concat(F.lit("g"), (F.col("id") % 1).cast("string")).alias("g"), (F.col("id") % 9973).cast("double").alias("v"))
    plan = executed(_bracketed_median(df, "g", "v", "m", None, 0.001))
    # the join is by group and salt, both null-safe
    assert re.search(r"hashpartitioning\(coalesce\(_g#.*_s#", plan)
    assert group_median(df, "g", "v", "m").first()["m"] == sorted(i % 9973 for i in range(30_000))[14_999] / 2 + sorted(
        i % 9973 for i in range(30_000)
    )[15_000] / 2


def test_employees_do_not_move_again_for_the_medians(spark, tmp_path):
    people = registry._QUERIES["clean_employees"](spark, SF).withColumn("monthly_income", F.col("monthly_income").cast("decimal(12,2)"))
    path = f"{tmp_path}/people"
    people.write.csv(path, header=True)
    raw = readers.read_employees(spark, path)
    plan = final(cleaning.clean_employees(raw))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan


def test_copies_collapse_before_the_shuffle(spark):
    raw = spark.range(1000).select(
        F.lit("O1").alias("order_id"), F.lit("C1").alias("customer_id"), F.lit("2024-01-01").alias("order_date"),
        F.lit(" ").alias("ship_mode"), F.lit(0).alias("discount_pct"), F.lit("delivered").alias("status"),
    )
    plan = executed(cleaning.clean_orders(raw))
    assert plan.count("HashAggregate") >= 2
    assert cleaning.clean_orders(raw).count() == 1


@pytest.mark.parametrize("name", ["kpi_summary", "regional_performance", "discount_impact"])
def test_lines_move_twice_and_are_never_doubled(spark, conf, name):
    conf(spark__sql__autoBroadcastJoinThreshold=-1, spark__sql__adaptive__autoBroadcastJoinThreshold=-1)
    conf(spark__sql__adaptive__forceOptimizeSkewedJoin="false")
    plan = registry._QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    by_order = re.findall(r"Exchange hashpartitioning\(order_id#\d+L, \d+\)", plan)
    by_product = re.findall(r"Exchange hashpartitioning\(product_id#\d+L, \d+\)", plan)
    # two sides of each join, and no further shuffle on the order
    assert "Expand" not in plan and len(by_order) == 2 and len(by_product) == 2, plan
