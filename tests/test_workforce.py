import math

import pytest
from pyspark.sql import functions as F
from test_cleaning import frame, person

from tidemark.operators import workforce


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def staff(spark):
    return frame(
        spark,
        [
            person(1, "Sales", income=100.0, years_at_company=1, attrition="Yes", overtime="Yes", job_satisfaction=1),
            person(2, "Sales", income=200.0, years_at_company=2, job_satisfaction=2),
            person(3, "Sales", income=300.0, years_at_company=5, years_since_last_promotion=5),
            person(4, "Sales", income=400.0, years_at_company=10, years_since_last_promotion=9, overtime="Yes"),
            person(5, "HR", income=500.0, years_at_company=11, age=24),
            person(6, "HR", income=500.0, years_at_company=30, age=45),
        ],
    ).cache()


def test_rates(staff):
    assert tuples(workforce.attrition_overall(staff)) == [(6, 1, 16.7)]
    assert tuples(workforce.attrition_by_department(staff)) == [("Sales", 4, 1, 25.0), ("HR", 2, 0, 0.0)]
    assert tuples(workforce.attrition_by_overtime(staff)) == [("No", 4, 0.0), ("Yes", 2, 50.0)]
    assert tuples(workforce.attrition_by_satisfaction(staff)) == [(1, 1, 100.0), (2, 1, 0.0), (3, 4, 0.0)]
    assert tuples(workforce.attrition_by_promotion_gap(staff)) == [("0-4 yrs", 4, 25.0), ("5+ yrs since promotion", 2, 0.0)]
    assert tuples(workforce.attrition_by_age_group(staff)) == [("25-34", 4, 1, 25.0), ("45+", 1, 0, 0.0), ("<25", 1, 0, 0.0)]


def test_bands_and_their_edges(spark, staff):
    assert [(r[0], r[1]) for r in tuples(workforce.attrition_by_tenure_band(staff))] == [
        ("1. 0-2 yrs", 2), ("2. 3-5 yrs", 1), ("3. 6-10 yrs", 1), ("4. 10+ yrs", 2),
    ]
    odd = frame(spark, [person(i, years_at_company=y) for i, y in enumerate([None, -1, 0, 100, 101])])
    assert [r[0] for r in tuples(odd.select(workforce.tenure_band()))] == ["4. 10+ yrs"] + ["1. 0-2 yrs"] * 2 + ["4. 10+ yrs"] * 2
    assert [r["tenure_band"] for r in workforce.tenure_band_cut(odd).collect()] == [None, None, "0-2 yrs", "10+ yrs", None]


def test_income_quartiles_are_within_departments(staff):
    got = tuples(workforce.attrition_by_income_quartile(staff))
    # HR has two people, so it only fills the first two tiles
    assert got == [(1, 2, 300.0, 50.0), (2, 2, 350.0, 0.0), (3, 1, 300.0, 0.0), (4, 1, 400.0, 0.0)]


def test_cost_is_null_where_nobody_left(staff):
    assert tuples(workforce.attrition_cost_by_department(staff)) == [("Sales", 1, 600.0), ("HR", 0, None)]


def test_risk_points(staff):
    got = tuples(workforce.rule_based_risk_flags(staff))
    # E2: satisfaction, pay below 0.9 * 250, tenure; E4: overtime and gap; E3: gap
    assert [(r[0], r[4]) for r in got] == [("E2", 3), ("E4", 3), ("E3", 1), ("E5", 0), ("E6", 0)] or [
        (r[0], r[4]) for r in got
    ] == [("E4", 3), ("E2", 3), ("E3", 1), ("E5", 0), ("E6", 0)]
    assert [r[0] for r in got][:2] == ["E4", "E2"]  # better paid first among equals
    assert len(tuples(workforce.rule_based_risk_flags(staff, k=2))) == 2
    assert len(tuples(workforce.rule_based_risk_flags(staff, benchmark="median"))) == 5
    with pytest.raises(ValueError):
        workforce.risk_points(staff, benchmark="mode")


def test_kpis_and_slices(staff):
    k = workforce.workforce_kpis(staff).first()
    assert (k["headcount"], k["leavers"], k["avg_income"], k["overtime_rate"]) == (6, 1, 2000 / 6, 2 / 6)
    s = workforce.sliced_attrition(staff, departments=["Sales"], overtime=["Yes"], tenure_bands=["1. 0-2 yrs"], satisfaction=[1]).first()
    assert (s["headcount"], s["attrition_rate"], float(s["est_cost"])) == (1, 1.0, 600.0)
    assert workforce.sliced_attrition(staff).first()["headcount"] == 6


def test_blocks_show_empty_keys(staff):
    got = {(r["dim"], r["value"]): (r["employees"], r["leavers"], r["attrition_rate"]) for r in workforce.attrition_blocks(staff).collect()}
    assert got[("job_satisfaction", "4")] == (0, 0, 0.0)
    assert got[("department", "Sales")] == (4, 1, 0.25)
    for dim in ("department", "overtime", "job_satisfaction", "tenure_band"):
        assert sum(v[0] for k, v in got.items() if k[0] == dim) == 6


def test_comparisons(staff):
    got = {r["department"]: r for r in workforce.attrition_vs_average(staff).collect()}
    assert got["Sales"]["difference"] == 0.25 - 1 / 6 and got["HR"]["company_rate"] == 1 / 6
    assert tuples(workforce.department_attrition_pivot(staff)) == [("HR", 2, 0, 1.0, 0.0), ("Sales", 3, 1, 0.75, 0.25)]


def test_confounding_table(staff):
    got = {(r["promotion_gap"], r["tenure_band"]): (r["employees"], r["avg_tenure"]) for r in workforce.promotion_gap_confounding(staff).collect()}
    assert got[("0-4 yrs", "All")] == (4, 11.0) and got[("5+ yrs since promotion", "All")] == (2, 7.5)
    assert sum(v[0] for k, v in got.items() if k[1] != "All") == 6


def test_log_ratio(spark):
    df = frame(spark, [person(1, income=100.0), person(2, income=200.0), person(3, income=-5.0)])
    got = {r["employee_id"]: r["income_log_ratio"] for r in workforce.income_relative_log(df).collect()}
    assert got == {"E1": 0.0, "E2": math.log(2.0), "E3": None}


def test_empty_staff(spark, staff):
    none = staff.where(F.lit(False))
    assert tuples(workforce.attrition_overall(none)) == [(0, 0, None)]
    assert tuples(workforce.attrition_by_income_quartile(none)) == []
