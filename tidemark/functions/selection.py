"""Rows at given ranks of a group, exactly, without sorting the group.

To learn the ends of four tiles, a sort moves and writes every row. Here nothing
is sorted: rows are counted by number. A key is read as a list of numbers whose
order is the key's (the value, then the tie-break piece by piece). For the first
number a sketch gives a grid of quantiles for each group; the cell around a
wanted rank is counted value by value, what lies below as one number. That names
the value at the rank, and how many rows of this value come before the one that
is wanted. If more than ``SMALL`` rows share the value, the next number
narrows them down in the same way: a value that nine rows of ten have is
resolved by ids. The few rows left are then ordered by the whole key.

Each step reads the rows twice and moves partial counts only, so pass rows that
are computed already. What is wanted, one row for each group and rank, comes to
the driver and goes out again as a small local table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a grid, and the accuracy of its quantiles: their error is a twentieth of a cell.
GRID, ACCURACY = 512, 10_000
#: Rows of one wanted rank that may be ordered by one task.
SMALL = 10_000
#: Column of a group's size, for ranks that depend on it.
SIZE = "_n"
#: Bytes of text that fit a double exactly, and how many such pieces of a text are looked at.
PIECE, PIECES = 6, 8


def images(key: str, kind: T.DataType) -> list[Column]:
    """Numbers whose order, first to last, is the order of ``key``, NULL before all; texts by pieces of their bytes."""
    nothing = F.lit(float("-inf"))
    if not isinstance(kind, T.StringType):
        plain = F.unix_date(key) if isinstance(kind, T.DateType) else F.col(key)
        return [F.coalesce(plain.cast("double"), nothing)]
    code = F.encode(F.col(key), "UTF-8")
    pieces = [F.rpad(F.hex(F.substring(code, 1 + PIECE * k, PIECE)), 2 * PIECE, "0") for k in range(PIECES)]
    return [F.coalesce(F.conv(p, 16, 10).cast("double"), nothing) for p in pieces]


@dataclass(frozen=True)
class _Wanted:
    """A rank of a group, and how far it is found: a number for each level, and the rank among the rows that share them."""

    group: tuple
    rank: int
    path: tuple[float, ...]
    rest: int
    equals: int


def _same(keys: Sequence[str]) -> Column:
    """Equal keys on a side as they are and on a side as ``_k0``, ``_k1``, ..., NULL with NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def _beside(rows: DataFrame, keys: Sequence[str], wanted: list[tuple], names: dict[str, T.DataType]) -> DataFrame:
    """``rows`` once for each of the few ``wanted`` (keys, values of ``names``) with the same keys."""
    if not keys:
        every = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(w, names.items())]) for w in wanted]
        return rows.select("*", F.inline(F.array(*every)))
    kinds = [rows.schema[k].dataType for k in keys] + list(names.values())
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip([*[f"_k{i}" for i in range(len(keys))], *names], kinds)])
    columns = [[w[i] for w in wanted] for i in range(len(kinds))]
    arrays = [pa.array(c) if any(v is not None for v in c) else pa.nulls(len(c)) for c in columns]
    local = rows.sparkSession.createDataFrame(pa.table(arrays, names=schema.names), schema)
    return rows.join(local, _same(keys)).drop(*schema.names[: len(keys)])


def _step(rows: DataFrame, keys: Sequence[str], ranks: Column) -> list[tuple]:
    """(keys, rank, number at the rank, rank among equal rows, number of equal rows), by the column ``_image``."""
    rows = rows.select(*keys, "_image")
    points = ", ".join(f"{k / GRID!r}D" for k in range(GRID + 1))
    sketch = F.expr(f"percentile_approx(_image, array({points}), {ACCURACY})").alias("_grid")
    n, rank, image = F.col(SIZE), F.col("_rank"), F.col("_image")
    low, high = F.floor((rank - 1) * GRID / n) - 1, F.ceil(rank * GRID / n) + 1
    cells = rows.groupBy(*keys).agg(sketch, F.count(F.lit(1)).alias(SIZE)).withColumn("_rank", F.explode(F.array_distinct(ranks)))
    edges = [F.get("_grid", F.greatest(low, F.lit(0)).cast("int")), F.get("_grid", F.least(high, F.lit(GRID)).cast("int"))]
    asked = [tuple(r) for r in cells.where(rank.between(1, n)).select(*keys, "_rank", *edges).collect()]
    found = _counted(rows, keys, [(*a, w) for w, a in enumerate(asked)])
    missed = [(*a[:-2], float("-inf"), float("inf"), w) for w, a in enumerate(asked) if w not in found]
    found |= _counted(rows, keys, missed)  # the sketch's bound says that there are none
    return [(*asked[w][:-2], *found[w]) for w in sorted(found)]


def _counted(rows: DataFrame, keys: Sequence[str], asked: list[tuple]) -> dict[int, tuple]:
    if not asked:
        return {}
    image, end, rank, equals = F.col("_image"), F.col("_end"), F.col("_rank"), F.col("_equals")
    names = {"_rank": T.LongType(), "_low": T.DoubleType(), "_high": T.DoubleType(), "_a": T.LongType()}
    counts = (
        _beside(rows, keys, asked, names)
        .where(image <= F.col("_high"))
        .groupBy("_a", "_rank", F.when(image >= F.col("_low"), image).alias("_image"))
        .agg(F.count(F.lit(1)).alias("_equals"))
    )
    upto = Window.partitionBy("_a").orderBy(F.asc_nulls_first("_image")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = counts.withColumn("_end", F.sum("_equals").over(upto)).where((rank <= end) & (rank > end - equals) & image.isNotNull())
    return {r[0]: tuple(r)[1:] for r in here.select("_a", image, rank - (end - equals), "_equals").collect()}


def rows_at(df: DataFrame, ranks: Column, group: Sequence[str], value: str, tie: str, small: int = SMALL) -> list[tuple]:
    """``(*group, rank, value, tie)`` of the rows at the wanted ranks of each group.

    Rows are ordered by ``value`` and then ``tie``, both ascending, NULL first;
    ranks begin at 1 and those beyond a group are left out. ``ranks`` is an array
    of longs over the group's columns and ``SIZE``. A group may hold any share of
    the rows and a value any share of a group.
    """
    slim = df.select(*group, F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    levels = images("_value", slim.schema["_value"].dataType) + images("_tie", slim.schema["_tie"].dataType)
    g, last, out = len(group), len(levels) - 1, []
    first = _step(slim.withColumn("_image", levels[0]), group, ranks)
    open_ = [_Wanted(r[:g], r[g], (r[g + 1],), *r[g + 2 :]) for r in first]
    for depth in range(len(levels)):
        few = [w for w in open_ if w.equals <= small or depth == last]
        open_ = [w for w in open_ if w.equals > small and depth < last]
        if few:
            place = F.row_number().over(Window.partitionBy("_w").orderBy(F.asc_nulls_first("_value"), F.asc_nulls_first("_tie")))
            held = _within(slim, group, levels[: depth + 1], few).withColumn("_place", place).where("_place = _r")
            out += [(*few[r[0]].group, few[r[0]].rank, r[1], r[2]) for r in held.select("_w", "_value", "_tie").collect()]
        if not open_:
            return out
        level = _within(slim, group, levels[: depth + 1], open_).withColumn("_image", levels[depth + 1])
        found = {r[0]: r[3:] for r in _step(level, ["_w", "_r"], F.array("_r"))}
        open_ = [_Wanted(w.group, w.rank, (*w.path, found[k][0]), *found[k][1:]) for k, w in enumerate(open_)]
    return out


def _within(slim: DataFrame, group: Sequence[str], levels: list[Column], wanted: list[_Wanted]) -> DataFrame:
    """The rows whose numbers so far are those found, with ``_w``, the place in ``wanted``, and ``_r``, the rank there."""
    names = [f"_l{k}" for k in range(len(levels))]
    seen = slim.withColumns(dict(zip(names, levels)))
    asked = [(*w.group, *w.path, k, w.rest) for k, w in enumerate(wanted)]
    return _beside(seen, [*group, *names], asked, {"_w": T.LongType(), "_r": T.LongType()}).select(*group, "_value", "_tie", "_w", "_r")


def tile_ends(df: DataFrame, k: int, group: Sequence[str], value: str, tie: str, small: int = SMALL) -> list[tuple]:
    """``(*group, rank, value, tie)`` of the last row of each of NTILE(k)'s tiles but the k-th: at most k - 1 rows a group."""
    if k < 2:
        return []
    n = F.col(SIZE)
    last = F.array(*[(t * F.floor(n / k) + F.least(F.lit(t), n % k)).cast("long") for t in range(1, k)])
    return rows_at(df, F.filter(last, lambda r: r < n), group, value, tie, small)
