"""Model inputs: column kinds, scaling, dummies, the train/test split and class weights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import ratio, rows
from tidemark.functions.selection import rows_at

ID, LABEL = "employee_id", "attrition"
SPLIT_SEED = 42
TEST_SHARE = 0.25


def column_kinds(df: DataFrame, drop: Sequence[str] = (ID, LABEL)) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names in table order."""
    fields = [f for f in df.schema.fields if f.name not in drop]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if f.name not in numeric]


def feature_split(df: DataFrame, drop: Sequence[str] = (ID, LABEL)) -> DataFrame:
    """(feature, kind, known): how each feature is treated and how many values it has."""
    numeric, categorical = column_kinds(df, drop)
    names = numeric + categorical
    kind = F.when(F.col("feature").isin(*numeric), "numeric").otherwise("categorical")
    return (
        df.agg(*[F.count(c).alias(c) for c in names])
        .unpivot([], names, "feature", "known")
        .select("feature", kind.alias("kind"), "known")
    )


@dataclass(frozen=True)
class Moments:
    """Mean and spread of one numeric column."""

    mean: float
    sd: float

    def scaled(self, name: str) -> Column:
        centred = F.col(name).cast("double") - F.lit(self.mean)
        return centred / F.lit(self.sd) if self.sd else centred


def moments(df: DataFrame, columns: Sequence[str], sample: bool = False) -> dict[str, Moments]:
    """One pass, one row to the driver. ``sample`` divides by n - 1 instead of n."""
    spread = F.stddev_samp if sample else F.stddev_pop
    one = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
        *[spread(F.col(c).cast("double")).alias(f"sd_{c}") for c in columns],
    ).first()
    return {c: Moments(one[f"mean_{c}"] or 0.0, one[f"sd_{c}"] or 0.0) for c in columns}


def standardize(df: DataFrame, columns: Sequence[str], sample: bool = False, key: str = ID) -> DataFrame:
    """z-scores of ``columns`` beside the key."""
    fitted = moments(df, columns, sample)
    return df.select(key, *[fitted[c].scaled(c).alias(c) for c in columns])


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of each column.

    They come to the driver, one for each coefficient of a model over them, which
    is there as well.
    """
    if not columns:
        return {}
    pair = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns]
    found = df.select(F.explode(F.array(*pair)).alias("p")).select("p.*").where("level IS NOT NULL").distinct()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in found.collect():
        levels[row["name"]].append(row["level"])
    return {c: sorted(values) for c, values in levels.items()}


def dummies(
    levels: Mapping[str, Sequence[str]], reference: Mapping[str, str] | None = None, sep: str = "_"
) -> dict[str, Column]:
    """0/1 columns for all levels but the reference (the first by default).

    A level not in ``levels`` gives zeros throughout.
    """
    out = {}
    for name, values in levels.items():
        base = (reference or {}).get(name, values[0] if values else None)
        for level in values:
            if level != base:
                is_level = F.coalesce(F.col(name).cast("string") == level, F.lit(False))
                out[f"{name}{sep}{level}"] = is_level.cast("int")
    return out


def one_hot_drop_first(df: DataFrame, columns: Sequence[str], key: str = ID) -> DataFrame:
    return df.select(key, *[c.alias(n) for n, c in dummies(category_levels(df, columns)).items()])


def split_order(key: str = ID, seed: int = SPLIT_SEED) -> Column:
    """A reproducible shuffle: rows of a class are ordered by this text, then by key."""
    return F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string")))


def held_out(classes: Mapping[str, int], share: float = TEST_SHARE) -> dict[str, int]:
    """Test rows per class: ``share`` of all rows, rounded up, in the classes' proportions.

    Each class gives the whole part of its portion to training; the rows then
    still missing there come one each from the classes with the largest
    fractions (the earlier label among equals).
    """
    n = sum(classes.values())
    n_train = n - math.ceil(share * n)
    train = {c: size * n_train // n for c, size in classes.items()} if n else {}
    missing = n_train - sum(train.values())
    by_fraction = sorted(classes, key=lambda c: (-(classes[c] * n_train % n), str(c)))
    for c in by_fraction[:missing]:
        train[c] += 1
    return {c: classes[c] - train[c] for c in train}


@dataclass(frozen=True)
class Split:
    """``is_test`` tells the test rows; ``train_sizes`` counts the others per class."""

    is_test: Column
    train_sizes: dict[str, int]


def split_rule(
    df: DataFrame, label: str = LABEL, key: str = ID, share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> Split:
    """The first rows of each class in shuffled order are for testing.

    Only the last test row of each class is selected, by counting, so the split
    itself is a comparison, whatever the class sizes are. ``df`` is read here
    several times and again by the caller: pass a computed table.
    """
    classes = {r[label]: r["n"] for r in df.groupBy(label).agg(rows().alias("n")).collect()}
    held = held_out(classes, share)
    shuffled = df.select(label, split_order(key, seed).alias("draw"), key)
    wanted = F.lit(0)
    for value, size in held.items():
        wanted = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(size)).otherwise(wanted)
    ends = rows_at(shuffled, F.array(wanted.cast("long")), [label], "draw", key)
    draw, me, kind = split_order(key, seed), F.col(key), df.schema[key].dataType
    test = F.lit(False)
    for value, _, last_draw, last in ends:  # one row per class
        mine = F.col(label).eqNullSafe(F.lit(value))
        upto = (draw < last_draw) | ((draw == last_draw) & (me <= F.lit(last).cast(kind)))
        test = test | (mine & upto)
    return Split(test, {c: n - held[c] for c, n in classes.items()})


def stratified_split(
    df: DataFrame, label: str = LABEL, key: str = ID, share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> DataFrame:
    is_test = split_rule(df, label, key, share, seed).is_test
    return df.select(key, label, F.when(is_test, "test").otherwise("train").alias("split"))


def balanced(sizes: Mapping[str, int]) -> dict[str, float]:
    """Weight per class = rows / (classes * rows of the class); weights add up to the row count."""
    present = {c: n for c, n in sizes.items() if n}
    return {c: sum(present.values()) / (len(present) * n) for c, n in present.items()}


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    everyone = Window.partitionBy()
    return (
        df.groupBy(label)
        .agg(rows().alias("n"))
        .select(
            label,
            "n",
            ratio(F.sum("n").over(everyone), F.count(F.lit(1)).over(everyone) * F.col("n")).alias("weight"),
        )
        .orderBy(label)
    )

