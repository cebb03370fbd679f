"""The check values of FIXTURES.md, section 5, at sf0.01."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.medians import group_median
from tidemark.operators import cleaning, fact, sales, workforce
from tidemark.sources import given_tables as given

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def raw(spark):
    return given.raw_sales(spark, SF)


@pytest.fixture(scope="module")
def table(raw):
    return fact.clean_and_join(raw).cache()


@pytest.fixture(scope="module")
def people(spark):
    return given.raw_employees(spark, SF)


@pytest.fixture(scope="module")
def staff(people):
    return cleaning.clean_employees(people).cache()


def counts(df, *keys):
    return {tuple(r)[:-1] if len(keys) > 1 else r[0]: r[-1] for r in df.groupBy(*keys).count().collect()}


def test_orders(raw):
    assert raw.orders.count() == 15_075 and raw.orders.select("order_id").distinct().count() == 15_000
    clean = cleaning.clean_orders(raw.orders)
    assert counts(clean, "status") == {"Cancelled": 5088, "Delivered": 4933, "Returned": 4979}
    assert len(counts(clean, "ship_mode")) == 4
    assert raw.customers.where("city <> trim(city)").count() == 79
    early = clean.join(cleaning.clean_customers(raw.customers), "customer_id").where("order_date < signup_date")
    assert early.count() == 2403


def test_fact(raw, table):
    sold = fact.delivered(table)
    total = sold.agg(F.count("*"), F.sum("revenue"), F.sum("cost")).first()
    assert total[0] == 19_856
    # the listed sums are over unrounded lines; each line is rounded by half a cent at most
    prices = cleaning.clean_products(raw.products).select("product_id", "unit_price", "unit_cost")
    exact = sold.join(prices, "product_id").select(
        (F.col("quantity") * F.col("unit_price") * (100 - F.col("discount_pct"))).alias("r"),
        (F.col("quantity") * F.col("unit_cost")).alias("c"),
    )
    revenue, cost = exact.agg(F.sum("r"), F.sum("c")).first()
    assert (str(revenue), str(cost)) == ("41436490527.50", "392212745.3950")
    assert float(total[1]) == pytest.approx(414364905.2750, abs=0.005 * 19_856)
    assert float(total[2]) == pytest.approx(392212745.3950, abs=0.005 * 19_856)
    assert sold.where("profit < 0").count() == 5622
    margins = {r["category"]: r["margin_pct"] for r in sales.category_profitability(table).collect()}
    assert margins == {"ECONOMY": 5.4, "LARGE": 4.9, "MEDIUM": 6.3, "PROMO": 5.9, "SMALL": 4.8, "STANDARD": 4.7}
    by_discount = {r["discount_pct"]: r["profit"] for r in sales.discount_impact(table).collect()}
    listed = {0: 14242252.14, 5: 10121924.505, 10: 6439769.8, 15: 2551307.815, 20: -1769997.035, 30: -9433097.345}
    assert by_discount == pytest.approx(listed, abs=0.005 * 19_856 + 0.5)


def test_raw_employees(people):
    assert people.count() == 1525 and people.select("employee_id").distinct().count() == 1500
    assert people.where("monthly_income IS NULL").count() == 49 and len(counts(people, "department")) == 10
    assert people.where("attrition = 'Yes'").count() == 327
    assert counts(people, "overtime") == {"N": 31, "No": 933, "Y": 20, "Yes": 541}


def test_employees(staff):
    assert workforce.attrition_overall(staff).first()["leavers"] == 322
    assert counts(staff, "overtime", "attrition") == {
        ("No", "Yes"): 197, ("No", "No"): 949 - 197, ("Yes", "Yes"): 125, ("Yes", "No"): 551 - 125,
    }
    bands = staff.groupBy(workforce.tenure_band().alias("b")).agg(F.count("*").alias("n"), F.count_if(workforce.left()).alias("l"))
    assert [tuple(r)[1:] for r in bands.orderBy("b").collect()] == [(348, 92), (347, 58), (575, 122), (230, 50)]
    gap = {r["promotion_gap"]: r["employees"] for r in workforce.attrition_by_promotion_gap(staff).collect()}
    assert gap == {workforce.LONG_GAP: 462, workforce.SHORT_GAP: 1038}


def test_department_medians(people):
    records = cleaning.employee_records(people)
    got = {r["department"]: float(r["median"]) for r in group_median(records, "department", "monthly_income").collect()}
    assert got == {"Automobile": 4794.51, "Building": 4349.09, "Furniture": 3901.715, "Household": 3956.34, "Machinery": 4388.07}
