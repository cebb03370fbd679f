import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cleaning import frame, person

from tidemark.operators import features, model, workforce


def planted(n, seed=3):
    """People whose leaving follows a known logistic rule."""
    rng = random.Random(seed)
    people = []
    for i in range(n):
        over, sat = rng.choice(["Yes", "No"]), rng.randrange(1, 5)
        income = round(rng.lognormvariate(8, 0.4), 2)
        logit = -0.6 + 1.2 * (over == "Yes") - 0.5 * (sat - 2.5) - 0.9 * (math.log(income) - 8)
        left = rng.random() < 1 / (1 + math.exp(-logit))
        people.append(
            person(
                i, rng.choice(["Sales", "HR", "Ops"]), rng.choice(["Clerk", "Boss"]), income, over,
                job_satisfaction=sat, age=rng.randrange(20, 60), years_at_company=rng.randrange(20),
                years_since_last_promotion=rng.randrange(8), work_life_balance=rng.randrange(1, 5),
                distance_from_home_km=rng.randrange(1, 40), performance_rating=rng.choice([3, 4]),
                num_companies_worked=rng.randrange(6), gender=rng.choice(["Male", "Female"]),
                education=rng.choice(["PhD", "Masters"]), attrition="Yes" if left else "No",
            )
        )
    return people


@pytest.fixture(scope="module")
def people():
    return planted(1200)


@pytest.fixture(scope="module")
def staff(spark, people):
    return frame(spark, people).repartition(5).cache()


def newton(x, y, weight, ridge):
    """Minimise sum(weight * log-loss) + ridge/2 |b|^2 with a free intercept."""
    z = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        hessian = z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty
        b -= np.linalg.solve(hessian, z.T @ (weight * (p - y)) + penalty @ b)
    return b, np.linalg.inv(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty)


NUM = ["age", "monthly_income", "years_at_company", "years_since_last_promotion", "job_satisfaction",
       "work_life_balance", "distance_from_home_km", "performance_rating", "num_companies_worked"]
CAT = ["gender", "department", "job_role", "education", "overtime"]


def test_column_kinds(staff):
    assert features.column_kinds(staff) == (NUM, CAT)
    got = {r["feature"]: (r["kind"], r["known"]) for r in features.feature_split(staff).collect()}
    assert got["age"] == ("numeric", 1200) and got["overtime"] == ("categorical", 1200) and len(got) == 14


def test_fit_matches_newton(staff, people):
    fitted = model.fit(staff)
    test_ids = {r[0] for r in staff.where(fitted.is_test).select("employee_id").collect()}
    train = [p for p in people if p["employee_id"] not in test_ids]
    x = np.array([[float(p[c]) for c in NUM] for p in train])
    x = (x - x.mean(0)) / x.std(0)
    names = list(NUM)
    for c in CAT:
        for level in sorted({p[c] for p in train})[1:]:
            names.append(f"{c}_{level}")
            x = np.hstack([x, np.array([[float(p[c] == level)] for p in train])])
    y = np.array([p["attrition"] == "Yes" for p in train], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, _ = newton(x, y, weight, 1.0)
    assert list(fitted.coefficients) == names
    assert np.allclose([fitted.intercept, *fitted.coefficients.values()], b, atol=1e-5)
    drivers = [tuple(r) for r in model.model_drivers(staff, 8).collect()]
    assert len(drivers) == 8 and drivers[0][0] in ("overtime_Yes", "monthly_income", "job_satisfaction")
    assert [abs(d[1]) for d in drivers] == sorted((abs(d[1]) for d in drivers), reverse=True)
    assert all(math.isclose(math.exp(c), o, abs_tol=0.004) for _, c, o in drivers)


def test_scores_and_unseen_level(spark, staff):
    fitted = model.fit(staff)
    known = frame(spark, [person(1, "HR", "Clerk")])
    unseen = frame(spark, [person(1, "Moon", "Clerk")])
    p_known, p_unseen = (fitted.score(df).first()["probability"] for df in (known, unseen))
    # HR is the dropped level, so a department never seen scores the same
    assert 0 < p_known < 1 and p_known == p_unseen
    held_out = model.attrition_probability(staff)
    assert held_out.count() == staff.where(fitted.is_test).count()


def test_split_is_stratified_and_repeatable(staff):
    split = features.stratified_split(staff)
    again = features.stratified_split(staff.repartition(3))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    sizes = split.groupBy("attrition").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert sum(r["t"] for r in sizes) == 300 and all(abs(r["t"] - 0.25 * r["n"]) < 1 for r in sizes)
    other = features.stratified_split(staff, seed=1)
    assert sorted(map(tuple, split.collect())) != sorted(map(tuple, other.collect()))


@pytest.mark.parametrize(
    ("classes", "want"),
    [
        ({"No": 1103, "Yes": 397}, {"No": 276, "Yes": 99}),
        ({"No": 5, "Yes": 2}, {"No": 1, "Yes": 1}),
        ({"No": 3, "Yes": 0}, {"No": 1, "Yes": 0}),
        ({"No": 10, "Yes": 10}, {"No": 2, "Yes": 3}),
        ({}, {}),
    ],
)
def test_held_out_sizes(classes, want):
    assert features.held_out(classes) == want


def test_scaling(staff, people):
    income = np.array([p["monthly_income"] for p in people])
    for sample in (False, True):
        got = features.standardize(staff, ["monthly_income"], sample).collect()
        want = {p["employee_id"]: v for p, v in zip(people, (income - income.mean()) / income.std(ddof=int(sample)))}
        assert all(math.isclose(r["monthly_income"], want[r["employee_id"]], abs_tol=1e-9) for r in got)


def test_constant_column_scales_to_zero(spark):
    df = frame(spark, [person(1), person(2)])
    assert [r["age"] for r in features.standardize(df, ["age"]).collect()] == [0.0, 0.0]


def test_dummies(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "employee_id long, kind string")
    got = features.one_hot_drop_first(df, ["kind"])
    assert got.columns == ["employee_id", "kind_b", "kind_c"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 0, 0)]
    assert list(features.dummies({"kind": ["a", "b", "c"]}, {"kind": "b"}, sep="")) == ["kinda", "kindc"]


def test_two_thousand_levels(spark):
    df = spark.range(4000).select(F.col("id").alias("employee_id"), (F.col("id") % 2000).cast("string").alias("kind"))
    assert len(features.category_levels(df, ["kind"])["kind"]) == 2000
    few = features.one_hot_drop_first(df, ["kind"])
    assert len(few.columns) == 2000 and few.where("kind_1999 = 1").count() == 2


def test_class_weights(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("No",), ("No",)], "attrition string")
    assert [tuple(r) for r in features.class_weights(df).collect()] == [("No", 3, 4 / 6), ("Yes", 1, 2.0)]
    assert features.balanced({"No": 3, "Yes": 1}) == {"No": 4 / 6, "Yes": 2.0}


def test_auc_counts_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["Yes", "No"]), rng.randrange(7) / 7) for _ in range(200)]
    pos, neg = ([s for a, s in rows if a == want] for want in ("Yes", "No"))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "attrition string, s double")
    assert math.isclose(model.roc_auc(df, "s", workforce.left()).first()["auc"], want, rel_tol=1e-12)
    only = df.where("attrition = 'Yes'")
    assert model.roc_auc(only, "s", workforce.left()).first()["auc"] is None


def test_classification_report(spark):
    cells = {(True, True): 6, (False, True): 4, (True, False): 2, (False, False): 8}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a boolean, p boolean")
    got = {r["class"]: tuple(r)[1:] for r in model.classification_report(df, F.col("a"), F.col("p")).collect()}
    assert got["Left"] == (0.6, 0.75, 12 / 18, 8)
    assert got["Stayed"] == (0.8, 8 / 12, 16 / 22, 12)
    assert got["accuracy"] == (None, None, 0.7, 20)
    assert math.isclose(got["macro avg"][0], 0.7) and math.isclose(got["weighted avg"][1], (0.75 * 8 + 8 / 12 * 12) / 20)
    never = model.classification_report(df, F.col("a"), F.lit(False)).collect()
    assert never[1]["precision"] == 0.0


def test_metrics_and_risk_list(staff):
    metrics = {r["metric"]: r["value"] for r in model.model_metrics(staff).collect()}
    assert list(metrics) == ["roc_auc", "recall_left", "precision_left"]
    assert 0.6 < metrics["roc_auc"] < 0.9 and 0.4 < metrics["recall_left"] < 0.9
    risk = model.high_risk_employees(staff).collect()
    assert len(risk) == 50 and tuple(risk[0].asDict()) == model.RISK_COLUMNS
    assert [(-r["attrition_risk"], r["employee_id"]) for r in risk] == sorted((-r["attrition_risk"], r["employee_id"]) for r in risk)


def test_wald_table_matches_newton(staff, people):
    got = {r["term"]: r for r in model.odds_ratios_wald(staff).collect()}
    income = np.array([p["monthly_income"] for p in people])
    columns = {
        "overtimeYes": [p["overtime"] == "Yes" for p in people],
        **{t: [p[t] for p in people] for t in model.WALD_TERMS if not t.startswith("scale(")},
        "scale(monthly_income)": (income - income.mean()) / income.std(ddof=1),
        **{f"department{d}": [p["department"] == d for p in people] for d in ("Ops", "Sales")},
    }
    x = np.array([np.asarray(v, float) for v in columns.values()]).T
    y = np.array([p["attrition"] == "Yes" for p in people], float)
    b, cov = newton(x, y, np.ones(len(y)), 0.0)
    assert set(got) == set(columns)
    for i, term in enumerate(columns, 1):
        se = math.sqrt(cov[i, i])
        row = got[term]
        assert math.isclose(row["odds_ratio"], math.exp(b[i]), rel_tol=1e-5)
        assert math.isclose(row["ci_low"], math.exp(b[i] - 1.959964 * se), rel_tol=1e-4)
        assert math.isclose(row["ci_high"], math.exp(b[i] + 1.959964 * se), rel_tol=1e-4)
        assert math.isclose(row["p_value"], math.erfc(abs(b[i] / se) / math.sqrt(2)), rel_tol=1e-2)


def test_the_optimum_is_exact(staff, people):
    """Newton steps on sums over non-zero places end where dense Newton does, to nine places."""
    fitted = model.fit(staff)
    rows = staff.where(~fitted.is_test).toPandas()
    x = rows[NUM].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    flags = [(rows[c] == v).to_numpy(float)[:, None] for c in CAT for v in sorted(set(rows[c]))[1:]]
    y = (rows["attrition"] == "Yes").to_numpy(float)
    b, _ = newton(np.hstack([x, *flags]), y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), 1.0)
    assert np.allclose([fitted.intercept, *fitted.coefficients.values()], b, rtol=0, atol=1e-9)


def test_curvature_sums_the_normal_equations(spark):
    rows = [("Yes", 1.5, "a"), ("No", 0.0, "b"), ("No", -2.0, None), ("Yes", 0.5, "c"), ("No", 1.0, "zz")]
    df = spark.createDataFrame(rows, "attrition string, v double, kind string")
    got = model.encode(df, {"v": F.col("v")}, {"kind": ["a", "b", "c"], "none": []}, weight=F.lit(2.0))
    assert got.names == ["v", "kind_b", "kind_c"]
    x = np.array([[1, v, k == "b", k == "c"] for _, v, k in rows], float)
    assert sorted(tuple(r["features"].toArray()) for r in got.rows.collect()) == sorted(map(tuple, x[:, 1:]))
    b, y = np.array([0.1, -0.4, 0.7, 0.2]), np.array([a == "Yes" for a, _, _ in rows], float)
    p = 1 / (1 + np.exp(-x @ b))
    hessian, gradient = model.curvature(got.rows, b)
    assert np.allclose(hessian, x.T @ (x * (2 * p * (1 - p))[:, None])) and np.allclose(gradient, x.T @ (2 * (p - y)))


def test_ten_thousand_levels_train_and_score(spark):
    """A level is a row of a table, not an expression: the plans stay short."""
    kind = F.format_string("k%05d", F.col("id") % 10_000)
    leaves = F.when((F.col("id") % 10_000 < 3_000) | (F.col("id") % 7 == 0), "Yes").otherwise("No")
    df = spark.range(40_000).select(
        F.col("id").alias("employee_id"), leaves.alias("attrition"), (F.col("id") % 41).alias("age"), kind.alias("kind")
    ).cache()
    fitted = model.fit(df)
    seen = df.where(~fitted.is_test).agg(F.count_distinct("kind")).first()[0]
    assert len(fitted.coefficients) == seen > 9_900 > model.DENSE  # age, and all seen levels but the first
    scored = fitted.score(df)
    assert scored.columns == [*df.columns, "probability"]
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    often, seldom = (scored.where(f"kind {op} 'k03000'").agg(F.avg("probability")).first()[0] for op in ("<", ">="))
    assert often > seldom + 0.2


def test_a_class_alone_gives_no_step(spark):
    df = spark.createDataFrame([("No", float(v)) for v in range(5)], "attrition string, v double")
    rows = model.encode(df, {"v": F.col("v")}, {}).rows
    start = np.array([-np.inf, 0.0])
    b, inverse = model.newton(rows, start, 1.0)
    assert b is start and inverse is None
