"""Attrition reports over clean employees (one row per employee)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import percent, ratio, round_away, rows
from tidemark.functions.joins import group_join
from tidemark.functions.medians import group_median
from tidemark.functions.selection import tile_ends
from tidemark.session import cut

# The label's positive answer, and the names of bands and groups.
LEFT = "Yes"
STAYED = "No"
TENURE_BANDS = ((2, "1. 0-2 yrs"), (5, "2. 3-5 yrs"), (10, "3. 6-10 yrs"))
LONGEST_TENURE = "4. 10+ yrs"
TENURE_CUT = ((-1, 2, "0-2 yrs"), (2, 5, "3-5 yrs"), (5, 10, "6-10 yrs"), (10, 100, "10+ yrs"))
AGE_GROUPS = ((25, "<25"), (35, "25-34"), (45, "35-44"))
OLDEST = "45+"
PROMOTION_GAP_YEARS = 5
LONG_GAP, SHORT_GAP = "5+ yrs since promotion", "0-4 yrs"
REPLACEMENT_SHARE = Decimal("0.5")  # of a year's pay; an assumption, not a measured figure
BLOCK_KEYS = {
    "overtime": ("No", "Yes"),
    "job_satisfaction": ("1", "2", "3", "4"),
    "tenure_band": ("0-2 yrs", "3-5 yrs", "6-10 yrs", "10+ yrs"),
}


def left() -> Column:
    return F.col("attrition") == LEFT


def _steps(value: Column, steps: Sequence[tuple[int, str]], last: str, inclusive: bool) -> Column:
    out = F.lit(last)
    for bound, name in reversed(steps):
        out = F.when(value <= bound if inclusive else value < bound, name).otherwise(out)
    return out


def tenure_band() -> Column:
    """Unknown tenure lands in the last band; the quality check reports it."""
    return _steps(F.col("years_at_company"), TENURE_BANDS, LONGEST_TENURE, inclusive=True)


def age_group() -> Column:
    return _steps(F.col("age"), AGE_GROUPS, OLDEST, inclusive=False)


def promotion_gap() -> Column:
    return F.when(F.col("years_since_last_promotion") >= PROMOTION_GAP_YEARS, LONG_GAP).otherwise(SHORT_GAP)


def tenure_cut() -> Column:
    """Right-closed bins; NULL outside all of them."""
    y, out = F.col("years_at_company"), F.lit(None).cast("string")
    for low, high, name in TENURE_CUT:
        out = F.when((y > low) & (y <= high), name).otherwise(out)
    return out


def _rates(employees: DataFrame, *keys: Column) -> DataFrame:
    return (
        employees.groupBy(*keys)
        .agg(rows().alias("employees"), F.count_if(left()).alias("leavers"))
        .withColumn("attrition_rate_pct", percent("leavers", "employees"))
    )


def attrition_overall(employees: DataFrame) -> DataFrame:
    return _rates(employees)


def attrition_by_department(employees: DataFrame) -> DataFrame:
    return _rates(employees, F.col("department")).orderBy(F.desc("attrition_rate_pct"), "department")


def _rate_by(employees: DataFrame, name: str, key: Column) -> DataFrame:
    return _rates(employees, key.alias(name)).drop("leavers").orderBy(name)


def attrition_by_overtime(employees: DataFrame) -> DataFrame:
    return _rate_by(employees, "overtime", F.col("overtime"))


def attrition_by_tenure_band(employees: DataFrame) -> DataFrame:
    return _rate_by(employees, "tenure_band", tenure_band())


def attrition_by_satisfaction(employees: DataFrame) -> DataFrame:
    return _rate_by(employees, "job_satisfaction", F.col("job_satisfaction"))


def attrition_by_promotion_gap(employees: DataFrame) -> DataFrame:
    return _rate_by(employees, "promotion_gap", promotion_gap())


def attrition_by_age_group(employees: DataFrame) -> DataFrame:
    return _rates(employees, age_group().alias("age_group")).orderBy("age_group")


def attrition_by_income_quartile(employees: DataFrame, k: int = 4) -> DataFrame:
    """Pay tiles within each department, which is not sorted: rows are compared with the k-1 ends of its tiles."""
    slim = cut(employees.select("department", "monthly_income", "employee_id", "attrition"))
    ends: dict = {}
    for department, _, pay, last in tile_ends(slim, k, ["department"], "monthly_income", "employee_id"):
        ends.setdefault(department, []).append((pay, last))
    me = F.struct("monthly_income", "employee_id")
    kind = T.StructType([T.StructField("department", slim.schema["department"].dataType), T.StructField("ends", T.ArrayType(slim.select(me).schema[0].dataType))])
    known = slim.sparkSession.createDataFrame(list(ends.items()), kind)
    passed = F.filter(F.coalesce("ends", F.array()), lambda end: me > end)  # NULL before all, as in the order
    return (
        group_join(slim, known, "department")
        .groupBy((F.size(passed) + 1).alias("pay_quartile"))
        .agg(
            rows().alias("employees"),
            round_away(_mean("monthly_income")).alias("avg_income"),
            percent(F.count_if(left()), rows()).alias("attrition_rate_pct"),
        )
        .orderBy("pay_quartile")
    )


def attrition_cost_by_department(employees: DataFrame, share: Decimal = REPLACEMENT_SHARE) -> DataFrame:
    """Yearly pay of leavers times ``share``; NULL for a department nobody left."""
    cost = F.sum(F.when(left(), F.col("monthly_income") * 12 * F.lit(share)))
    return (
        employees.groupBy("department")
        .agg(F.count_if(left()).alias("leavers"), round_away(cost).alias("est_replacement_cost_inr"))
        .orderBy(F.desc("est_replacement_cost_inr"), "department")
    )


def _mean(name: str) -> Column:
    """Average of an exact column, divided as doubles."""
    return ratio(F.sum(name), F.count(name))


def risk_points(employees: DataFrame, benchmark: str = "avg", low_pay: float = 0.9) -> DataFrame:
    """Add ``risk_points`` 0-6; pay is compared with the department's ``avg`` or ``median`` income."""
    if benchmark == "avg":
        pay = employees.groupBy("department").agg(_mean("monthly_income").alias("usual_pay"))
    elif benchmark == "median":
        pay = group_median(employees, "department", "monthly_income", "usual_pay", spread_by="employee_id")
    else:
        raise ValueError(f"benchmark must be 'avg' or 'median', not {benchmark!r}")
    underpaid = F.col("monthly_income").cast("double") < F.lit(low_pay) * F.col("usual_pay").cast("double")
    # The signs and their points.
    signs = (
        (F.col("overtime") == "Yes", 2),
        (F.col("job_satisfaction") <= 2, 1),
        (F.col("years_since_last_promotion") >= PROMOTION_GAP_YEARS, 1),
        (underpaid, 1),
        (F.col("years_at_company") <= 2, 1),
    )
    points = sum((F.when(sign, p).otherwise(0) for sign, p in signs), F.lit(0))
    known = employees.where("department IS NOT NULL")
    return group_join(known, pay, "department").withColumn("risk_points", points).drop("usual_pay")


def rule_based_risk_flags(employees: DataFrame, k: int = 50, benchmark: str = "avg") -> DataFrame:
    """The k current employees with most points, better paid first among equals."""
    return (
        risk_points(employees, benchmark)
        .where(F.col("attrition") == STAYED)
        .select("employee_id", "department", "job_role", "monthly_income", "risk_points")
        .orderBy(F.desc("risk_points"), F.desc("monthly_income"), "employee_id")
        .limit(k)
    )


def tenure_band_cut(employees: DataFrame) -> DataFrame:
    return employees.select("employee_id", "years_at_company", tenure_cut().alias("tenure_band"))


def workforce_kpis(employees: DataFrame) -> DataFrame:
    return employees.agg(
        rows().alias("headcount"),
        F.count_if(left()).alias("leavers"),
        ratio(F.count_if(left()), rows()).alias("attrition_rate"),
        _mean("monthly_income").alias("avg_income"),
        _mean("job_satisfaction").alias("avg_satisfaction"),
        ratio(F.count_if(F.col("overtime") == "Yes"), rows()).alias("overtime_rate"),
    )


def attrition_blocks(employees: DataFrame) -> DataFrame:
    """(dim, value, employees, leavers, rate) for four dimensions in one pass.

    Rows shrink to one per combination of the four dimensions before they are
    laid out by dimension. The fixed keys of a block show up even when empty.
    """
    dims = ("department", "overtime", "job_satisfaction", "tenure_band")
    cells = (
        employees.withColumn("tenure_band", tenure_cut())
        .groupBy(*dims)
        .agg(rows().alias("employees"), F.count_if(left()).alias("leavers"))
    )
    pair = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]
    long = cells.select(F.explode(F.array(*pair)).alias("p"), "employees", "leavers").select(
        "p.dim", "p.value", "employees", "leavers"
    )
    fixed = [(d, v, 0, 0) for d, values in BLOCK_KEYS.items() for v in values]
    keys = employees.sparkSession.createDataFrame(fixed, "dim string, value string, employees long, leavers long")
    return (
        long.where("value IS NOT NULL")
        .unionByName(keys)
        .groupBy("dim", "value")
        .agg(F.sum("employees").alias("employees"), F.sum("leavers").alias("leavers"))
        .withColumn("attrition_rate", F.coalesce(ratio("leavers", "employees"), F.lit(0.0)))
        .orderBy("dim", "value")
    )


def attrition_vs_average(employees: DataFrame, key: str = "department") -> DataFrame:
    """Each group's rate beside the rate over all groups."""
    groups = employees.groupBy(key).agg(rows().alias("employees"), F.count_if(left()).alias("leavers"))
    everyone = Window.partitionBy()
    company = ratio(F.sum("leavers").over(everyone), F.sum("employees").over(everyone))
    own = ratio("leavers", "employees")
    return groups.select(
        key, own.alias("attrition_rate"), company.alias("company_rate"), (own - company).alias("difference")
    ).orderBy(key)


def department_attrition_pivot(employees: DataFrame) -> DataFrame:
    """Departments down, answers across, as counts and as shares of the row."""
    wide = employees.groupBy("department").pivot("attrition", [STAYED, LEFT]).agg(rows())
    stayed, gone = (F.coalesce(F.col(c), F.lit(0)) for c in (STAYED, LEFT))
    return wide.select(
        "department",
        stayed.alias("stayed"),
        gone.alias("left"),
        ratio(stayed, stayed + gone).alias("stayed_share"),
        ratio(gone, stayed + gone).alias("left_share"),
    ).orderBy("department")


def sliced_attrition(
    employees: DataFrame,
    departments: Sequence[str] | None = None,
    overtime: Sequence[str] | None = None,
    tenure_bands: Sequence[str] | None = None,
    satisfaction: Sequence[int] | None = None,
) -> DataFrame:
    """The dashboard cards under optional slicers."""
    slicers = (
        (F.col("department"), departments),
        (F.col("overtime"), overtime),
        (tenure_band(), tenure_bands),
        (F.col("job_satisfaction"), satisfaction),
    )
    kept = employees
    for column, wanted in slicers:
        if wanted is not None:
            kept = kept.where(column.isin(*wanted))
    cost = F.sum(F.when(left(), F.col("monthly_income") * 12 * F.lit(REPLACEMENT_SHARE)))
    return kept.agg(
        rows().alias("headcount"),
        F.count_if(left()).alias("leavers"),
        ratio(F.count_if(left()), rows()).alias("attrition_rate"),
        _mean("monthly_income").alias("avg_income"),
        cost.alias("est_cost"),
    )


def promotion_gap_confounding(employees: DataFrame) -> DataFrame:
    """Rate and average tenure by promotion gap, overall and within each tenure band."""
    cells = employees.groupBy(promotion_gap().alias("promotion_gap"), tenure_band().alias("tenure_band")).agg(
        rows().alias("employees"), F.count_if(left()).alias("leavers"), F.sum("years_at_company").alias("years")
    )
    sums = cells.groupingSets(
        [["promotion_gap", "tenure_band"], ["promotion_gap"]], "promotion_gap", "tenure_band"
    ).agg(
        F.sum("employees").alias("employees"),
        F.sum("leavers").alias("leavers"),
        F.sum("years").alias("years"),
    )
    return sums.select(
        "promotion_gap",
        F.coalesce("tenure_band", F.lit("All")).alias("tenure_band"),
        "employees",
        round_away(ratio("years", "employees"), 1).alias("avg_tenure"),
        percent("leavers", "employees").alias("attrition_rate_pct"),
    ).orderBy("promotion_gap", "tenure_band")


def income_relative_log(employees: DataFrame) -> DataFrame:
    """ln(income / median income of the department); NULL unless the ratio is positive."""
    usual = group_median(employees, "department", "monthly_income", "usual_pay", spread_by="employee_id")
    rel = ratio("monthly_income", "usual_pay")
    return group_join(employees, usual, "department").select(
        "employee_id", F.when(rel > 0, F.ln(rel)).alias("income_log_ratio")
    )
