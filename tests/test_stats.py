import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pvalues
from tidemark.operators import stats


def table(spark, feature, levels):
    return spark.createDataFrame([(feature, str(i), a, b) for i, (a, b) in enumerate(levels)], "feature string, level string, gone long, stayed long")


# counts (left, stayed) per level, with the known statistic and p-value text
KNOWN = [
    ("overtime", [(201, 838), (196, 265)], 86.9, 1, "1.14e-20"),
    ("department", [(54, 130), (118, 296), (80, 219), (30, 87), (115, 371)], 3.68, 4, "4.50e-01"),
    ("satisfaction", [(88, 142), (93, 219), (138, 374), (78, 368)], 36.76, 3, "5.17e-08"),
]


@pytest.mark.parametrize(("feature", "levels", "statistic", "dof", "p"), KNOWN)
def test_chi_square_known_tables(spark, feature, levels, statistic, dof, p):
    got = stats.chi_square(table(spark, feature, levels)).first()
    assert (round(got["statistic"], 2), got["dof"]) == (statistic, dof)
    assert f"{pvalues.chi_square_tail(got['statistic'], got['dof']):.2e}" == p


def test_empty_cells_count(spark):
    got = stats.chi_square(table(spark, "x", [(0, 10), (5, 0), (5, 10)])).first()
    n, a, b = 30, 10, 20
    want = sum((o - (x + y) * m / n) ** 2 / ((x + y) * m / n) for x, y in [(0, 10), (5, 0), (5, 10)] for o, m in ((x, a), (y, b)))
    assert math.isclose(got["statistic"], want) and got["dof"] == 2


def test_yates_never_overshoots(spark):
    got = stats.chi_square(table(spark, "x", [(5, 5), (5, 5)])).first()
    assert got["statistic"] == 0.0 and pvalues.chi_square_tail(0.0, 1) == 1.0


def test_one_answer_only(spark):
    got = stats.chi_square(table(spark, "x", [(0, 5), (0, 7)])).first()
    assert (got["statistic"], got["dof"]) == (0.0, 0) and pvalues.chi_square_tail(0.0, 0) == 1.0


@pytest.mark.parametrize("dof", range(1, 12))
def test_chi_square_tail_by_integration(dof):
    """Simpson over the density from x on; the tail beyond 400 is negligible."""
    x, top, n = 3.7, 400.0, 40_000

    def density(t):
        return math.exp((dof / 2 - 1) * math.log(t) - t / 2 - math.lgamma(dof / 2) - dof / 2 * math.log(2))

    h = (top - x) / n
    area = density(x) + density(top) + sum((4 if i % 2 else 2) * density(x + i * h) for i in range(1, n))
    assert math.isclose(pvalues.chi_square_tail(x, dof), area * h / 3, rel_tol=1e-6)


def by_hand(first, second):
    """U of the first sample by comparing all pairs, and the corrected z."""
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    n1, n2 = len(first), len(second)
    n, both = n1 + n2, first + second
    ties = sum(c**3 - c for c in (both.count(v) for v in set(both)))
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return u, (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd


@pytest.mark.parametrize("seed", range(3))
def test_mann_whitney_by_hand(spark, seed):
    rng = random.Random(seed)
    first = [float(rng.choice([1, 2, 2, 3, rng.randrange(40)])) for _ in range(80)]
    second = [float(rng.choice([1, 2, 2, 2, rng.randrange(60)])) for _ in range(170)]
    rows = [("Yes", v) for v in first] + [("No", v) for v in second] + [("No", None)]
    df = spark.createDataFrame(rows, "attrition string, monthly_income double").repartition(6)
    got = stats.mann_whitney_u(df).first()
    u, z = by_hand(first, second)
    assert (got["n1"], got["n2"], got["u"]) == (80, 170, u)
    assert math.isclose(got["z"], z, rel_tol=1e-12)
    w = stats.wilcox_w(df).first()
    assert w["w"] == 80 * 170 - u and math.isclose(w["p_value"], 2 * 0.5 * math.erfc(z / math.sqrt(2)))


def test_no_spread_gives_null(spark):
    df = spark.createDataFrame([("Yes", 1.0), ("No", 1.0)], "attrition string, monthly_income double")
    got = stats.mann_whitney_u(df).first()
    assert got["u"] == 0.5 and got["z"] is None
    assert stats.rank_test_p(df).first()["p_value"] is None


def test_report(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice(["Yes", "No"]), rng.choice("ABC"), rng.randrange(1, 5), float(rng.randrange(90)), rng.choice(["Yes", "No", "No"]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "overtime string, department string, job_satisfaction int, monthly_income double, attrition string")
    got = [tuple(r) for r in stats.statistical_tests(df).collect()]
    assert [r[0] for r in got] == [
        "Chi-square: attrition vs overtime",
        "Chi-square: attrition vs department",
        "Chi-square: attrition vs job_satisfaction",
        "Mann-Whitney U: income, leavers vs stayers",
    ]
    assert all(r[2][-4] == "e" and r[3] == (float(r[2]) < 0.05) for r in got)
    assert df.agg(F.count("*")).first()[0] == sum(r["gone"] + r["stayed"] for r in stats.contingency(df).where("feature = 'department'").collect())
