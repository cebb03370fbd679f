from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning, quality
from tidemark.sources import schemas


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_customers(spark):
    raw = spark.createDataFrame(
        [("C1", "Ann", "MUMBAI ", "Consumer", "2023-02-30", "MH", "West"), ("C2", "Bo", "pune", "Corporate", "2023-02-28", "MH", "West")],
        schemas.CUSTOMERS,
    )
    assert rows(cleaning.clean_customers(raw)) == [
        ("C1", "Ann", "Mumbai", "MH", "West", "Consumer", None),
        ("C2", "Bo", "Pune", "MH", "West", "Corporate", date(2023, 2, 28)),
    ]


def test_orders_are_standardised_then_deduplicated(spark):
    raw = spark.createDataFrame(
        [
            ("O1", "C1", "2024-01-05", " ", 10, "delivered"),
            ("O1", "C1", "2024-01-05", None, 10, "Delivered "),
            ("O2", "C1", "2024-01-06", "Express", 0, "RETURNED"),
        ],
        schemas.ORDERS,
    )
    clean = cleaning.clean_orders(raw)
    assert rows(clean) == [
        ("O1", "C1", date(2024, 1, 5), "Unknown", 10, "Delivered"),
        ("O2", "C1", date(2024, 1, 6), "Express", 0, "Returned"),
    ]
    assert tuple(cleaning.dedup_report(cleaning.standard_orders(raw)).first()) == (3, 2, 1)
    assert tuple(cleaning.dedup_report(clean.where("1 = 0")).first()) == (0, 0, 0)


def test_lookup_keeps_unknown_keys(spark):
    places = spark.createDataFrame([("Pune", "MH")], "city string, state string")
    df = spark.createDataFrame([("Pune",), ("Atlantis",)], "city string")
    assert rows(cleaning.lookup_enrich(df, places, "city")) == [("Atlantis", None), ("Pune", "MH")]


def test_clamp_dates(spark):
    df = spark.sql(
        "SELECT id, CAST(d AS DATE) AS d, CAST(s AS DATE) AS s FROM VALUES (1, '2024-01-01', '2024-02-01'), "
        "(2, '2025-03-01', '2024-02-01'), (3, '2024-06-01', '2024-02-01'), (4, '2024-06-01', NULL), "
        "(5, '2024-06-01', '2025-02-01') AS t(id, d, s)"
    )
    got = {r["id"]: r["d"] for r in cleaning.clamp_dates(df, "d", "s", date(2024, 12, 31)).collect()}
    assert got == {1: date(2024, 2, 1), 2: date(2024, 12, 31), 3: date(2024, 6, 1), 4: None, 5: date(2024, 12, 31)}


def person(i, department="Sales", role="Clerk", income=100.0, overtime="No", **other):
    base = {
        "employee_id": f"E{i}", "age": 30, "gender": "Male", "department": department, "job_role": role,
        "education": "PhD", "monthly_income": income, "years_at_company": 3, "years_since_last_promotion": 1,
        "overtime": overtime, "job_satisfaction": 3, "work_life_balance": 3, "distance_from_home_km": 5,
        "performance_rating": 3, "num_companies_worked": 1, "attrition": "No",
    }
    return base | other


def frame(spark, people):
    df = spark.createDataFrame([[p[c] for c in schemas.EMPLOYEES.fieldNames()] for p in people], ", ".join(
        f"{f.name} {'double' if f.name == 'monthly_income' else f.dataType.simpleString()}" for f in schemas.EMPLOYEES.fields
    ))
    return df.withColumn("monthly_income", F.col("monthly_income").cast("decimal(12,2)"))


@pytest.fixture
def messy(spark):
    return frame(
        spark,
        [
            person(1, "HR", income=10.0),
            person(1, "HR", income=10.0),
            person(2, " hr\t", income=20.0, overtime="Y"),
            person(3, "SALES", income=None, overtime="N"),
            person(4, "Sales", income=31.0),
            person(4, "SALES", income=31.0),
            person(5, "Sales", role="Boss", income=99.0),
        ],
    )


def test_employees(messy):
    got = {r["employee_id"]: (r["department"], r["overtime"], float(r["monthly_income"])) for r in cleaning.clean_employees(messy).collect()}
    assert got == {
        "E1": ("HR", "No", 10.0),
        "E2": ("HR", "Yes", 20.0),
        "E3": ("Sales", "No", 20.0),
        "E4": ("Sales", "No", 31.0),
        "E5": ("Sales", "No", 99.0),
    }
    assert rows(cleaning.cleaning_log(messy)) == [("duplicates_removed", 2), ("missing_income", 1), ("rows_raw", 7)]
    assert dict(rows(cleaning.cleaning_log(messy, "before")))["duplicates_removed"] == 1


def test_dedup_stage(messy):
    assert cleaning.employee_records(messy, "before").count() == 6
    assert cleaning.employee_records(messy, "after").count() == 5
    with pytest.raises(ValueError):
        cleaning.employee_records(messy, "never")


def test_even_median_keeps_its_half_cent(spark):
    people = [person(1, income=0.01), person(2, income=0.02), person(3, income=None)]
    got = {r["employee_id"]: str(r["monthly_income"]) for r in cleaning.clean_employees(frame(spark, people)).collect()}
    assert got["E3"] == "0.015"


def test_quality_check(spark, messy):
    clean = cleaning.clean_employees(messy)
    assert quality.require_valid(clean, "employee_id")["rows"] == 5
    with pytest.raises(quality.DataQualityError, match="repeated_keys"):
        quality.require_valid(cleaning.employee_records(messy, "before"), "employee_id", optional=["monthly_income"])
    # nobody in this role has an income, so nothing can fill it
    lost = cleaning.clean_employees(frame(spark, [person(1), person(2, role="Ghost", income=None)]))
    with pytest.raises(quality.DataQualityError, match="null_monthly_income"):
        quality.require_valid(lost, "employee_id")


def test_integrity_counts(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (3,), (3,)], "k int")
    assert quality.duplicate_keys(parent, "k").first()[0] == 1
    assert quality.orphans(child, parent, "k").first()[0] == 2
    assert quality.duplicate_keys(parent.where("k > 9"), "k").first()[0] == 0
