"""Sales, customer and calendar reports on small hand-made facts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, customers, fact, sales, totals
from tidemark.plans import catalogue
from tidemark.session import scratch_path
from tidemark.sources import schemas


def make_fact(spark, lines):
    """lines: (order, customer, day, status, discount, category, product, revenue, profit[, region])."""
    full = [(*line, "North") if len(line) == 9 else line for line in lines]
    df = spark.createDataFrame(
        full,
        "order_id string, customer_id string, day string, status string, discount_pct int, category string, "
        "product_name string, revenue double, profit double, region string",
    )
    return df.select(
        "order_id", F.col("day").cast("date").alias("order_date"), F.substring("day", 1, 7).alias("order_month"),
        "status", F.lit("Std").alias("ship_mode"), "discount_pct", "customer_id", F.lit("City").alias("city"),
        F.lit("State").alias("state"), "region", F.lit("Seg").alias("segment"), F.lit(date(2020, 1, 1)).alias("signup_date"),
        F.col("product_name").alias("product_id"), "product_name", "category", F.lit("Sub").alias("sub_category"),
        F.lit(1).alias("quantity"), F.col("revenue").cast("decimal(18,2)"),
        (F.col("revenue") - F.col("profit")).cast("decimal(18,2)").alias("cost"), F.col("profit").cast("decimal(18,2)"),
    )


@pytest.fixture(scope="module")
def small(spark):
    return make_fact(
        spark,
        [
            ("O1", "C1", "2023-01-10", "Delivered", 0, "Toys", "ball", 100.0, 20.0),
            ("O1", "C1", "2023-01-10", "Delivered", 0, "Food", "tea", 50.0, 10.0),
            ("O2", "C1", "2023-03-05", "Delivered", 20, "Toys", "ball", 40.0, -5.0),
            ("O3", "C2", "2023-03-06", "Returned", 0, "Toys", "kite", 60.0, 6.0),
            ("O4", "C2", "2023-03-07", "Delivered", 0, "Food", "tea", 30.0, 3.0, "South"),
            ("O5", "C3", "2023-04-01", "Cancelled", 0, "Food", "tea", 10.0, 1.0),
        ],
    ).cache()


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_fact_prices_lines_exactly(spark):
    items = spark.createDataFrame([("O1", "P1", 3), ("O1", "P2", 1), ("O9", "P1", 1)], schemas.ORDER_ITEMS)
    orders = spark.sql("SELECT 'O1' order_id, 'C1' customer_id, DATE'2024-01-31' order_date, 'x' ship_mode, 15 discount_pct, 'Delivered' status")
    people = spark.sql("SELECT 'C1' customer_id, 'n' customer_name, 'Pune' city, 'MH' state, 'West' region, 's' segment, DATE'2023-01-01' signup_date")
    goods = spark.sql("SELECT 'P1' product_id, 'c' category, 's' sub_category, 'p' product_name, 0.01BD unit_cost, 0.10BD unit_price UNION ALL SELECT 'P2', 'c', 's', 'q', 7.00BD, 0.10BD")
    out = fact.sales_fact(items, orders, people, goods)
    assert tuple(out.columns) == fact.COLUMNS
    got = {r["product_id"]: (str(r["revenue"]), str(r["cost"]), str(r["profit"]), r["order_month"]) for r in out.collect()}
    # 3 * 0.10 * 0.85 = 0.255 and 0.255 - 0.03 = 0.225, both rounded away from zero
    assert got == {"P1": ("0.26", "0.03", "0.23", "2024-01"), "P2": ("0.09", "7.00", "-6.92", "2024-01")}


def test_kpis(small):
    assert tuples(sales.kpi_summary(small)) == [(220.0, 28.0, 12.7, 3, 2, 73.0)]
    assert tuples(sales.kpi_summary(small.where("status = 'None'"))) == [(None, None, None, 0, 0, None)]


def test_monthly_growth_skips_empty_months_but_calendar_growth_does_not(small):
    assert tuples(sales.monthly_revenue_mom(small)) == [
        ("2023-01", 150.0, 30.0, None, None, 150.0),
        ("2023-03", 70.0, -2.0, 150.0, -53.3, 220.0),
    ]
    got = {r["order_month"]: (r["revenue"], r["prev_revenue"], r["mom_growth"]) for r in calendar.revenue_mom_calendar(small).collect()}
    assert len(got) == 12
    assert [float(v) if v is not None else None for v in got["2023-02"]] == [None, 150.0, -1.0]
    assert got["2023-03"][1:] == (None, None)


def test_growth_is_of_rounded_values(spark):
    """Months round before they accumulate, so the last running total is not the rounded grand total."""
    f = make_fact(spark, [(f"O{m}", "C", f"2023-{m:02d}-01", "Delivered", 0, "a", "p", 0.4, 0.0) for m in (1, 2, 3)])
    assert tuples(sales.monthly_revenue_mom(f))[-1][-1] == 0.0
    assert sales.kpi_summary(f).first()["total_revenue"] == 1.0


def test_categories(small):
    assert tuples(sales.category_profitability(small)) == [
        ("Toys", 140.0, 15.0, 10.7, 63.6),
        ("Food", 80.0, 13.0, 16.3, 36.4),
    ]
    # O1 counts in both of its categories
    assert tuples(sales.return_rate_by_category(small)) == [("Toys", 3, 1, 33.3), ("Food", 3, 0, 0.0)]
    assert tuples(sales.return_rate_overall(small)) == [(5, 1, 0.2)]


def test_zero_revenue_group_gives_null_margin(spark):
    f = make_fact(spark, [("O1", "C1", "2023-01-10", "Delivered", 0, "Free", "gift", 0.0, -1.0)])
    assert tuples(sales.category_profitability(f)) == [("Free", 0.0, -1.0, None, None)]
    assert tuples(sales.summary_blocks(sales.sales_cube_monthly(f)))[0][4:] == (0.0, 0.0)


def test_top_products_keep_ties(spark):
    profits = {"a": 5.0, "b": 5.0, "c": 4.0, "d": 3.0, "e": 3.0}
    f = make_fact(spark, [(f"O{p}", "C", "2023-01-01", "Delivered", 0, "x", p, 10.0, v) for p, v in profits.items()])
    got = tuples(sales.top_products_per_category(f))
    assert [(r[1], r[2]) for r in got] == [(1, "a"), (1, "b"), (3, "c")]


def test_regions_discounts_losses(small):
    assert tuples(sales.regional_performance(small)) == [("North", 1, 2, 190.0, 95.0, 13.2), ("South", 1, 1, 30.0, 30.0, 10.0)]
    assert tuples(sales.discount_impact(small)) == [(0, 2, 180.0, 33.0, 18.3), (20, 1, 40.0, -5.0, -12.5)]
    assert float(sales.loss_making_revenue(small).first()[0]) == 40.0
    assert sales.loss_making_revenue(small.where("profit > 0")).first()[0] is None


def test_slicers_combine(small):
    k = sales.sliced_kpis(small, years=[2023], regions=["North"], categories=["Toys"]).first()
    assert (float(k["revenue"]), float(k["profit"]), k["orders"]) == (140.0, 15.0, 2)
    assert sales.sliced_kpis(small).first()["orders"] == 3


def test_top_customers_and_their_lines(small):
    assert tuples(sales.top_customers(small, 1)) == [("C1", 190.0)]
    assert sorted(r["order_id"] for r in sales.customer_order_detail(small, 1).collect()) == ["O1", "O1", "O2"]
    assert sales.customer_order_detail(small.where("1 = 0"), 3).count() == 0


def test_cube_blocks_and_pivot_agree(small):
    cube = sales.sales_cube_monthly(small)
    assert tuples(cube)[0] == ("2023-01", 2023, "Food", "North", 1, 50.0, 10.0)
    blocks = tuples(sales.summary_blocks(cube))
    totals = [r for r in blocks if r[1] == "Total"]
    assert [r[0] for r in totals] == ["category", "region", "year"]
    assert {r[2] for r in totals} == {220.0} and {r[5] for r in totals} == {1.0}
    for block in ("category", "region", "year"):
        parts = [r for r in blocks if r[0] == block and r[1] != "Total"]
        assert sum(r[2] for r in parts) == 220.0
    pivot = tuples(sales.category_year_pivot(cube, regions=["North"]))
    assert pivot == [("Toys", 140.0, 15.0, 15.0 / 140.0, 140.0), ("Food", 50.0, 10.0, 0.2, 50.0)]
    assert sales.category_year_pivot(cube.where("1 = 0")).columns == ["category", "total_revenue"]


@pytest.fixture(scope="module")
def untidy(spark, small):
    """Nulls in every key, an order of two customers and states, repeated lines, one product in half of the lines."""
    more = make_fact(
        spark,
        [
            ("O1", "C9", "2023-01-10", "Delivered", 0, "Toys", "ball", 7.5, -1.25),
            ("O2", "C1", "2023-03-05", "Returned", 20, "Toys", "ball", 40.0, -5.0),
            (None, "C4", "2023-05-01", "Delivered", 5, "Toys", "kite", 12.0, 2.0),
            ("O7", None, "2024-01-01", "Delivered", None, None, "ball", 3.0, 1.0),
            ("O7", None, "2024-01-01", "Delivered", None, "Food", None, 3.0, 1.0),
            ("O8", "C5", "2024-02-01", None, 0, "Food", "tea", 9.0, 1.0, None),
            *[(f"P{i}", f"D{i % 9}", f"2024-03-{1 + i % 28:02d}", "Delivered", i % 3, "Toys", "ball", 1.0 * i, 0.5) for i in range(40)],
        ],
    )
    return small.union(more).union(more.limit(2))


def test_totals_answer_every_named_report(spark, untidy):
    orders, products = totals.save_totals(untidy, scratch_path(spark, "totals"))
    assert orders.count() == untidy.select(*totals.ORDER_KEYS).distinct().count()
    assert products.count() == untidy.select(*totals.PRODUCT_KEYS).distinct().count()
    for name, report in (catalogue.SALES_REPORTS | catalogue.SALES_TABLES).items():
        shared = report(products if name in catalogue.BY_PRODUCT else orders)
        whole = report(untidy)
        assert shared.columns == whole.columns
        assert sorted(map(str, shared.collect())) == sorted(map(str, whole.collect())), name


def test_totals_of_no_lines(spark, untidy):
    orders, products = totals.save_totals(untidy.where("1 = 0"), scratch_path(spark, "totals"))
    assert orders.count() == products.count() == 0
    assert sales.kpi_summary(orders).first()["orders"] == 0


def test_totals_read_the_lines_once(untidy):
    plan = totals.report_totals(untidy)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_every_year_of_the_data_counts(spark):
    rows = [(f"{y}-01", y, "Food", "North", 1, float(y - 1990), 1.0) for y in range(1995, 2004)]
    cube = spark.createDataFrame(rows, "month string, year long, category string, region string, orders long, revenue double, profit double")
    wide = sales.category_year_pivot(cube)
    assert wide.columns[-4:] == ["revenue_2003", "profit_2003", "margin_2003", "total_revenue"]
    assert wide.first()["total_revenue"] == sum(range(5, 14))
    assert sales.category_by_year(cube).count() == 9


def test_rfm(spark):
    lines = [(f"O{i}-{j}", f"C{i}", f"2023-{1 + i:02d}-{1 + j:02d}", "Delivered", 0, "a", "p", 10.0 * i, 1.0) for i in range(1, 9) for j in range(i)]
    # a later cancelled order sets the reference day but no score
    lines.append(("OX", "C0", "2023-12-30", "Cancelled", 0, "a", "p", 999.0, 1.0))
    rfm = {r["customer_id"]: r for r in customers.customer_rfm(make_fact(spark, lines)).collect()}
    assert sorted(rfm) == [f"C{i}" for i in range(1, 9)]
    best = rfm["C8"]
    assert (best["recency_days"], best["frequency"], best["monetary"]) == (114, 8, 640.0)
    assert [rfm[f"C{i}"]["r_score"] for i in range(1, 9)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert [rfm[f"C{i}"]["segment"] for i in (1, 3, 8)] == ["Lost", "Needs Attention", "Champions"]
    summary = tuples(customers.rfm_segment_summary(customers.customer_rfm(make_fact(spark, lines))))
    assert sum(r[1] for r in summary) == 8 and summary[0][0] == "Champions"


@pytest.mark.parametrize(
    ("scores", "name"),
    [
        ((4, 3, 3), "Champions"), ((3, 2, 1), "Loyal / Potential"), ((4, 1, 4), "New Customers"),
        ((2, 4, 4), "At Risk"), ((1, 2, 4), "Lost"), ((3, 1, 4), "Needs Attention"), ((2, 2, 2), "Needs Attention"),
    ],
)
def test_segments_are_tried_in_order(spark, scores, name):
    df = spark.createDataFrame([scores], "r_score int, f_score int, m_score int")
    assert df.select(customers._segment()).first()[0] == name


def test_pareto_with_remainder_and_negative_revenue(spark):
    revenue = [50.0, 20.0, 10.0, 8.0, 6.0, 4.0, 1.0, 0.0, -3.0, -6.0, -10.0]
    f = make_fact(spark, [(f"O{i}", f"C{i:02d}", "2023-01-01", "Delivered", 0, "a", "p", v, 0.0) for i, v in enumerate(revenue)])
    got = tuples(customers.pareto_customers(f, k=4))
    assert [(r[0], r[1]) for r in got] == [(25, 3), (50, 3), (75, 3), (100, 2)]
    running, peaks, at = 0.0, [], 0
    for size in (3, 3, 3, 2):
        steps = []
        for v in revenue[at : at + size]:
            running += v
            steps.append(running)
        at += size
        peaks.append(round(100 * max(steps) / sum(revenue), 1))
    assert [r[3] for r in got] == peaks


def test_fewer_customers_than_tiles(spark):
    f = make_fact(spark, [(f"O{i}", f"C{i}", "2023-01-01", "Delivered", 0, "a", "p", 10.0, 0.0) for i in range(3)])
    assert [(r[0], r[1]) for r in tuples(customers.pareto_customers(f))] == [(10, 1), (20, 1), (30, 1)]


def test_cohorts(spark):
    days = {"A": ["2022-12-01", "2022-12-20", "2023-01-03", "2023-07-01"], "B": ["2022-12-05", "2023-06-30"], "C": ["2023-01-09"]}
    f = make_fact(spark, [(f"O{c}{i}", c, d, "Delivered", 0, "a", "p", 1.0, 0.0) for c, ds in days.items() for i, d in enumerate(ds)])
    retention = customers.cohort_retention(f)
    assert tuples(retention) == [
        ("2022-12", 2, 0, 2, 100.0), ("2022-12", 2, 1, 1, 50.0), ("2022-12", 2, 6, 1, 50.0), ("2023-01", 1, 0, 1, 100.0),
    ]
    assert tuples(customers.cohort_matrix(retention)) == [
        ("2022-12", 100.0, 50.0, None, None, None, None, 50.0),
        ("2023-01", 100.0, *[None] * 6),
    ]


def test_date_dim(small):
    dim = calendar.date_dim_for(small)
    days = tuples(dim.orderBy("date"))
    assert len(days) == 365
    assert days[0] == (date(2023, 1, 1), 2023, 1, "Jan 23", "Q1") and days[-1] == (date(2023, 12, 31), 2023, 12, "Dec 23", "Q4")


def test_two_calendar_years(spark):
    days = ["2023-11-05", "2024-02-01", "2024-11-01"]
    f = make_fact(spark, [(f"O{i}", "C", d, "Delivered", 0, "a", "p", 10.0 * (i + 1), 0.0) for i, d in enumerate(days)])
    yoy = {r["order_month"]: r for r in calendar.revenue_yoy(f).collect()}
    assert len(yoy) == 24 and yoy["2024-11"]["yoy_growth"] == 2.0 and yoy["2024-02"]["yoy_growth"] is None
    ytd = {r["order_month"]: float(r["revenue_ytd"] or 0) for r in calendar.revenue_ytd(f).collect()}
    assert (ytd["2023-10"], ytd["2023-12"], ytd["2024-01"], ytd["2024-12"]) == (0.0, 10.0, 0.0, 50.0)
    growth = tuples(calendar.annual_growth(f))
    assert [(r[0], float(r[1]), r[3]) for r in growth] == [(2023, 10.0, None), (2024, 50.0, 4.0)]
