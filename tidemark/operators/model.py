"""Attrition model: a class-balanced ridge logistic regression, its scores and its reports."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio
from tidemark.functions.pvalues import two_sided
from tidemark.operators import features as feat
from tidemark.operators.stats import rank_sums
from tidemark.operators.workforce import STAYED, left
from tidemark.session import cut

# Names and sizes that the reports must carry.
CLASS_NAMES = {0: "Stayed", 1: "Left"}
RIDGE_C = 1.0
TOLERANCE = 1e-9
STEP = 1e-9
#: Coefficients up to which the matrix of the Newton steps is formed (8 MB on the driver).
DENSE = 1000
TOP_RISK = 50
RISK_COLUMNS = (
    "employee_id", "department", "job_role", "monthly_income", "overtime",
    "job_satisfaction", "years_since_last_promotion", "attrition_risk",
)
WALD_TERMS = (
    "job_satisfaction", "work_life_balance", "scale(monthly_income)",
    "years_at_company", "years_since_last_promotion", "distance_from_home_km",
)
NORMAL_975 = 1.959963984540054


@dataclass(frozen=True)
class Fitted:
    """What training leaves on the driver: scales, levels and coefficients."""

    scales: dict[str, feat.Moments]
    levels: dict[str, list[str]]
    intercept: float
    coefficients: dict[str, float]
    is_test: Column

    def score(self, employees: DataFrame) -> DataFrame:
        """``employees`` with the chance of leaving; a level unseen in training adds nothing.

        The coefficients of a column's levels come by a join with a table of them,
        which is broadcast: it is as long as the model, which the driver holds.
        """
        spark = employees.sparkSession
        logit = F.lit(self.intercept)
        for name, m in self.scales.items():
            logit = logit + F.lit(self.coefficients[name]) * m.scaled(name)
        out, added = employees, []
        for k, (name, levels) in enumerate(self.levels.items()):
            known = [(v, self.coefficients[f"{name}_{v}"]) for v in levels[1:]]
            if known:
                level, part = f"_level{k}", f"_part{k}"
                table = spark.createDataFrame(known, f"{level} string, {part} double")
                out = out.join(F.broadcast(table), F.col(name).cast("string") == F.col(level), "left")
                logit, added = logit + F.coalesce(F.col(part), F.lit(0.0)), [*added, level, part]
        return out.withColumn("probability", 1.0 / (1.0 + F.exp(-logit))).drop(*added)


@dataclass(frozen=True)
class Encoded:
    """Rows of ``features`` (sparse), ``label``, ``weight`` and ``cells``, and the names of the positions.

    ``cells`` are the non-zero places once more for sums of their products: (0, 1.0)
    for the intercept, then (place + 1, value).
    """

    rows: DataFrame
    names: list[str]


def encode(
    df: DataFrame,
    numbers: dict[str, Column],
    levels: dict[str, list[str]],
    base: dict[str, str] | None = None,
    sep: str = "_",
    weight: Column | None = None,
) -> Encoded:
    """Numbers first, then a place for each level but the base one (the first by default).

    A level is looked up in the indexer's table and becomes one place of a sparse
    vector, so neither the plan nor a row grows with the number of levels. The base
    level, nulls and unknown levels are zero throughout.
    """
    slots = {name: f"_x{i}" for i, name in enumerate(numbers)}
    others = {c: [v for v in vs if v != (base or {}).get(c, vs[0])] for c, vs in levels.items() if vs}
    others = {c: vs for c, vs in others.items() if vs}
    wide = df.select(
        *[c.cast("double").alias(slots[n]) for n, c in numbers.items()],
        *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(others)],
        left().cast("double").alias("label"),
        (F.lit(1.0) if weight is None else weight).alias("weight"),
    )
    parts = list(slots.values())
    cells = [F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(parts, 1)]
    if others:
        texts, places, flags = ([f"_{k}{i}" for i in range(len(others))] for k in "cif")
        indexed = wide
        for text, place, vs in zip(texts, places, others.values()):
            indexed = StringIndexerModel.from_labels(vs, text, place, handleInvalid="keep").transform(indexed)
        # the index of what is not listed comes last, and the last one is dropped
        wide = OneHotEncoder(inputCols=places, outputCols=flags, dropLast=True).fit(indexed).transform(indexed)
        parts += flags
        before = len(numbers) + 1
        for place, vs in zip(places, others.values()):
            listed = F.col(place) < len(vs)
            cells.append(F.struct((F.col(place) + before).cast("int").alias("i"), listed.cast("double").alias("x")))
            before += len(vs)
    first = F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("x"))
    used = F.filter(F.array(first, *cells), lambda c: c["x"] != 0.0)
    rows = VectorAssembler(inputCols=parts, outputCol="features").transform(wide)
    rows = rows.select("features", "label", "weight", used.alias("cells"))
    return Encoded(rows, [*numbers, *[f"{c}{sep}{v}" for c, vs in others.items() for v in vs]])


def curvature(rows: DataFrame, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient at ``b`` (intercept first) of the weighted log-loss, from one aggregate.

    A row gives one term for each pair of its non-zero places, so the work does not
    grow with the places that are zero. Two triangles of the matrix reach the driver.
    """
    at = F.lit([float(v) for v in b])
    logit = F.aggregate("cells", F.lit(0.0), lambda total, c: total + c["x"] * F.get(at, c["i"]))
    chance = rows.select("cells", "label", "weight", (1.0 / (1.0 + F.exp(-logit))).alias("p"))
    terms = chance.select(
        (F.col("weight") * F.col("p") * (1.0 - F.col("p"))).alias("bend"),
        (F.col("weight") * (F.col("p") - F.col("label"))).alias("miss"),
        F.col("cells"),
        F.explode("cells").alias("one"),
    ).select("bend", "miss", "one", F.explode(F.filter("cells", lambda c: c["i"] >= F.col("one")["i"])).alias("two"))
    x = F.col("one")["x"] * F.col("two")["x"]
    sums = terms.groupBy(F.col("one")["i"].alias("i"), F.col("two")["i"].alias("j")).agg(
        F.sum(F.col("bend") * x).alias("h"), F.sum(F.col("miss") * x).alias("g")
    )
    hessian, gradient = np.zeros((len(b), len(b))), np.zeros(len(b))
    for i, j, h, g in sums.collect():
        hessian[i, j] = hessian[j, i] = h
        if i == 0:
            gradient[j] = g
    return hessian, gradient


def newton(rows: DataFrame, b: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray | None]:
    """``b`` (intercept first) taken to the optimum, and the inverse Hessian there.

    Each step is one pass. Steps end when they are below ``STEP``; one that cannot be
    solved, or that is longer than the step before it, leaves ``b`` as it is.
    """
    penalty = np.diag([0.0] + [ridge] * (len(b) - 1))
    inverse, reach = None, math.inf
    while np.isfinite(b).all() and reach > STEP:
        hessian, gradient = curvature(rows, b)
        try:
            found = np.linalg.inv(hessian + penalty)
        except np.linalg.LinAlgError:
            break
        step = found @ (gradient + penalty @ b)
        size = float(np.abs(step).max())
        if not size < reach:
            break
        b, inverse, reach = b - step, found, size
    return b, inverse


def fit(employees: DataFrame, c: float = RIDGE_C, seed: int = feat.SPLIT_SEED) -> Fitted:
    """Train on 75 % of each class.

    Minimises 1/2 |b|^2 + C * sum(weight * loss); Spark divides the loss by the
    sum of weights, which balanced weights make the number of training rows:
    hence ``regParam = 1 / (C * rows)``. Inputs are already scaled, so Spark
    must not scale them again. Up to ``DENSE`` coefficients, Newton steps take
    Spark's solution, good to five places, to the optimum; beyond, it stays as it
    is. ``employees`` is read several times: pass a computed table.
    """
    split = feat.split_rule(employees, seed=seed)
    rows = employees.where(~split.is_test)
    numeric, categorical = feat.column_kinds(employees)
    scales = feat.moments(rows, numeric)
    levels = feat.category_levels(rows, categorical)
    total = sum(split.train_sizes.values())
    weight = F.lit(1.0)
    for label, w in feat.balanced(split.train_sizes).items():
        weight = F.when(F.col(feat.LABEL) == label, F.lit(w)).otherwise(weight)
    ready = encode(rows, {n: scales[n].scaled(n) for n in numeric}, levels, weight=weight)
    found = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=2000,
        tol=TOLERANCE,
    ).fit(ready.rows)
    b = np.array([found.intercept, *found.coefficients.toArray()])
    if len(b) <= DENSE:
        b, _ = newton(ready.rows, b, 1.0 / c)
    intercept, *weights = map(float, b)
    return Fitted(scales, levels, intercept, dict(zip(ready.names, weights)), split.is_test)


def train(employees: DataFrame) -> tuple[DataFrame, Fitted]:
    """Compute the clean employees once and fit; reports take both."""
    ready = cut(employees)
    return ready, fit(ready)


def attrition_model(employees: DataFrame) -> DataFrame:
    """The fitted coefficients with the intercept."""
    _, fitted = train(employees)
    rows = [("(Intercept)", fitted.intercept), *fitted.coefficients.items()]
    return employees.sparkSession.createDataFrame(rows, "feature string, coef double")


def drivers_of(ready: DataFrame, fitted: Fitted, k: int | None = None) -> DataFrame:
    """Coefficients and odds ratios, strongest first, 3 places; the k strongest if ``k`` is given."""
    table = ready.sparkSession.createDataFrame(
        [(n, b, math.exp(b)) for n, b in fitted.coefficients.items()], "feature string, coef double, odds_ratio double"
    )
    ranked = table.orderBy(F.abs("coef").desc(), "feature").select(
        "feature", F.bround("coef", 3).alias("coef"), F.bround("odds_ratio", 3).alias("odds_ratio")
    )
    return ranked if k is None else ranked.limit(k)


def model_drivers(employees: DataFrame, k: int | None = None) -> DataFrame:
    return drivers_of(*train(employees), k)


def held_out_scores(ready: DataFrame, fitted: Fitted) -> DataFrame:
    return fitted.score(ready.where(fitted.is_test)).select("employee_id", "attrition", "probability")


def attrition_probability(employees: DataFrame) -> DataFrame:
    """Chance of leaving for the held-out employees."""
    return held_out_scores(*train(employees))


def roc_auc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc): the chance that a positive row scores above a negative one, ties counting half."""
    one = rank_sums(scored, score, positive)
    return one.select(ratio("u", F.col("n1").cast("double") * F.col("n2").cast("double")).alias("auc"))


def classification_report(scored: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy and the two averages."""
    counts = scored.agg(
        F.count_if(actual & predicted).cast("double").alias("tp"),
        F.count_if(~actual & predicted).cast("double").alias("fp"),
        F.count_if(actual & ~predicted).cast("double").alias("fn"),
        F.count_if(~actual & ~predicted).cast("double").alias("tn"),
    )
    none = F.lit(None).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    def of_class(hit: str, wrong: str, missed: str) -> tuple[Column, Column, Column, Column]:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return share(h, h + w), share(h, h + m), share(h * 2, h * 2 + w + m), h + m

    zero, one = of_class("tn", "fn", "fp"), of_class("tp", "fp", "fn")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    accuracy = share(F.col("tp") + F.col("tn"), n)
    lines = [
        (CLASS_NAMES[0], *zero),
        (CLASS_NAMES[1], *one),
        ("accuracy", none, none, accuracy, n),
        ("macro avg", *[(a + b) / 2.0 for a, b in zip(zero[:3], one[:3])], n),
        ("weighted avg", *[share(a * zero[3] + b * one[3], n) for a, b in zip(zero[:3], one[:3])], n),
    ]
    names = ("class", "precision", "recall", "f1_score", "support")
    structs = [
        F.struct(F.lit(line[0]).alias(names[0]), *[c.alias(k) for c, k in zip(line[1:], names[1:])]) for line in lines
    ]
    return counts.select(F.inline(F.array(*structs))).withColumn("support", F.col("support").cast("long"))


def metrics_of(ready: DataFrame, fitted: Fitted) -> DataFrame:
    """(metric, value) on the held-out quarter, 3 places."""
    scored = cut(held_out_scores(ready, fitted))
    auc = roc_auc(scored, "probability", left()).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    report = classification_report(scored, left(), F.col("probability") > 0.5)
    of_left = (
        report.where(F.col("class") == CLASS_NAMES[1])
        .select(F.col("recall").alias("recall_left"), F.col("precision").alias("precision_left"))
        .unpivot([], ["recall_left", "precision_left"], "metric", "value")
    )
    return auc.unionByName(of_left).select("metric", F.bround("value", 3).alias("value"))


def report_of(ready: DataFrame, fitted: Fitted) -> DataFrame:
    """Classification report of the fitted model on the held-out quarter."""
    return classification_report(held_out_scores(ready, fitted), left(), F.col("probability") > 0.5)


def model_metrics(employees: DataFrame) -> DataFrame:
    return metrics_of(*train(employees))


def risk_list_of(ready: DataFrame, fitted: Fitted, k: int = TOP_RISK) -> DataFrame:
    """The k current employees with the highest modelled risk; equal risks by id."""
    return (
        fitted.score(ready.where(F.col("attrition") == STAYED))
        .withColumn("attrition_risk", F.bround("probability", 3))
        .select(*RISK_COLUMNS)
        .orderBy(F.desc("attrition_risk"), "employee_id")
        .limit(k)
    )


def high_risk_employees(employees: DataFrame, k: int = TOP_RISK) -> DataFrame:
    return risk_list_of(*train(employees), k)


def odds_ratios_wald(employees: DataFrame) -> DataFrame:
    """Unpenalised logistic regression on all rows: odds ratios with 95 % Wald intervals.

    Standard errors are null where the inputs leave the coefficients undetermined.
    """
    ready = cut(employees)
    income = feat.moments(ready, ["monthly_income"], sample=True)["monthly_income"].scaled("monthly_income")
    levels = feat.category_levels(ready, ["overtime", "department"])
    numbers = {t: income if t.startswith("scale(") else F.col(t) for t in WALD_TERMS}
    inputs = encode(ready, numbers, levels, {"overtime": "No"}, sep="")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", regParam=0.0, maxIter=50, tol=1e-10).fit(inputs.rows)
    b, inverse = newton(inputs.rows, np.array([glm.intercept, *glm.coefficients.toArray()]), 0.0)
    spread = np.full(len(b), np.nan) if inverse is None else np.sqrt(np.diag(inverse))
    found = []
    for term, value, se in zip(inputs.names, map(float, b[1:]), map(float, spread[1:])):
        sure = se > 0.0 and math.isfinite(se)
        ends = (math.exp(value - NORMAL_975 * se), math.exp(value + NORMAL_975 * se)) if sure else (None, None)
        found.append((term, math.exp(value), *ends, two_sided(value / se) if sure else None))
    return employees.sparkSession.createDataFrame(
        found, "term string, odds_ratio double, ci_low double, ci_high double, p_value double"
    ).orderBy(F.desc("odds_ratio"))
