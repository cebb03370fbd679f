"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole passes over the source fill as
much of it as they can; the rest, less than one pass, is a subset-sum problem
over the source's document lengths. Its state is the count of documents by
exact length, a table far smaller than the documents. A bounded-knapsack dynamic
program over at most ``PROGRAM_WORDS`` words of budget (8 MB) picks the subset. A
smaller budget is its alone, and the subset is the best there is. Of a larger one
every length first gives its share, all but the table's, so the program
still chooses among documents of every length; it misses the best only where the
lengths left cannot make up a sum that others could, and by less than the longest
document. The result
says how many documents of each length get one more pass; which ones, a seeded
hash of the document decides.

Edge cases: a null source is a source of its own, after all others; null and
empty texts have size 0 and are never taken; a source of size 0 has target 0;
without documents there is no row. Repeated rows are documents of their own;
rows equal in ``doc_id`` and text are ranked arbitrarily among themselves, so
only their number matters. Other columns pass through :func:`mix`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.rows import all_columns
from tidemark.session import cut

WEIGHTS = (3.0, 1.0, 2.0)

#: Hash slices of the documents of one source and length; a hot length is ranked slice by slice.
SLICES = 256

#: Words of budget that the dynamic program's table spans: two bytes each.
PROGRAM_WORDS = 1 << 22


def word_count(text: Column) -> Column:
    """Number of words, the runs of anything but space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from the sizes by source.

    The budget is ``share`` of all sizes. Each source gets it by weight, at most
    ``most`` times its own size, and what is cut off goes to the others by
    weight. Sorted by size per weight, the capped sources are a prefix, so one
    running sum finds the level at which the budget is used up.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sizes.withColumn("weight", F.element_at(given, (F.row_number().over(place) - 1) % len(weights) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("here", (F.col("budget") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        # the level of the first source that is not capped; null when all are
        .withColumn("water", F.max(F.when(F.col("here") <= F.col("level"), F.col("here"))).over(Window.partitionBy()))
    )
    fitted = F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap")))
    return levels.select("source", "source_size", fitted.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, program_words: int = PROGRAM_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be.

    Beyond the table every length gives its share of all but ``program_words`` of
    the budget; shares are rounded along the lengths, so that what is left for
    the program differs from ``program_words`` by less than the longest document,
    and documents of all lengths are left to choose from.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.zeros_like(counts)
    first = budget - max(program_words, int(lengths.max()))
    if budget > program_words and first > 0:
        order = np.argsort(lengths, kind="stable")
        due = np.cumsum(counts[order].astype(object)) * first // total
        taken[order] = np.minimum(np.diff(due, prepend=0).astype(np.int64), counts[order])
        left = budget - int((lengths * taken).sum())
        for k in reversed(order):
            over = left - program_words
            if over <= 0:
                break
            more = min(int(counts[k] - taken[k]), -(-over // int(lengths[k])), left // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
        return taken + _knapsack(lengths, counts - taken, min(left, program_words))
    return _knapsack(lengths, counts, min(budget, program_words))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the reachable sums are the set bits of a whole number.

    Copies of a length come in batches of 1, 2, 4, ... Each sum remembers the
    batch by which it was first reached; without that batch it is a sum that was
    reached before, so one table leads back to a choice of batches.
    """
    batches: list[tuple[int, int]] = []
    for k in np.argsort(lengths, kind="stable"):
        count, batch = min(int(counts[k]), budget // int(lengths[k])), 1
        while count:
            batch = min(batch, count)
            batches.append((int(k), batch))
            count -= batch
            batch *= 2
    by = np.zeros(budget + 1, np.uint16 if len(batches) < 1 << 16 else np.uint32)
    reach, mask, n_bytes = 1, (1 << budget + 1) - 1, budget // 8 + 1
    for step, (k, batch) in enumerate(batches):
        new = reach << batch * int(lengths[k]) & mask & ~reach
        if not new:
            continue
        packed = np.frombuffer(new.to_bytes(n_bytes, "little"), np.uint8)
        filled = np.flatnonzero(packed)
        at, bit = np.nonzero(np.unpackbits(packed[filled, None], axis=1, bitorder="little"))
        by[filled[at] * 8 + bit] = step
        reach |= new
        if reach >> budget & 1:
            break
    out = np.zeros_like(counts)
    best = reach.bit_length() - 1
    while best:
        k, batch = batches[by[best]]
        out[k] += batch
        best -= batch * int(lengths[k])
    return out


def _plan(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, size, passes, extra``: whole passes, and documents of this length with one pass more."""

    def one(rows: pa.Table) -> pa.Table:
        size, target = rows["source_size"][0].as_py(), rows["target"][0].as_py()
        passes = int(target // size)
        lengths, counts = (rows[c].to_numpy().astype(np.int64) for c in ("size", "n"))
        extra = fit(lengths, counts, int(target - passes * size))
        return pa.table({"source": rows["source"], "size": rows["size"], "passes": pa.array(np.full(len(lengths), passes)), "extra": pa.array(extra)})

    known = histogram.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    joined = known.alias("h").join(goals.alias("g"), F.expr("h.source <=> g.source")).select("h.*", "source_size", "target")
    return joined.groupBy("source").applyInArrow(one, "source string, size long, passes long, extra long")


def _keyed(docs: DataFrame, seed: int, slices: int) -> DataFrame:
    """``docs`` with a struct column ``__mix`` of source, size, seeded order and hash slice."""
    order = F.xxhash64(F.lit(seed), "doc_id", F.length("text"))
    return docs.withColumn(
        "__mix",
        F.struct(
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            order.alias("order"),
            F.pmod(F.shiftrightunsigned(order, 32), F.lit(slices)).cast("int").alias("slice"),
        ),
    )


def _fitted(keyed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """The targets, and ``keyed`` with ``__passes``."""
    m = F.col("__mix")
    histogram = cut(
        keyed.groupBy(m["source"].alias("source"), m["size"].alias("size"), m["slice"].alias("slice")).agg(F.count("*").alias("n"))
    )
    by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = cut(targets(by_source, weights, share, most))
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        histogram.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .alias("h")
        .join(_plan(histogram, goals).alias("p"), F.expr("h.source <=> p.source and h.size = p.size"))
        .select("h.source", "h.size", "slice", "passes", (F.col("extra") - F.col("before")).alias("room"))
    )
    # a slice of the documents of one source and length is taken up to its room
    place = Window.partitionBy(m["source"], m["size"], m["slice"]).orderBy(m["order"], "doc_id")
    passes = F.coalesce(F.col("passes") + (F.col("__rank") <= F.col("room")).cast("long"), F.lit(0)).cast("long")
    ranked = keyed.withColumn("__rank", F.row_number().over(place)).alias("d")
    same = "d.__mix.source <=> q.source and d.__mix.size = q.size and d.__mix.slice = q.slice"
    return goals, ranked.join(plan.alias("q"), F.expr(same), "left").select(
        *[F.col(f"d.`{c.replace('`', '``')}`") for c in keyed.columns], passes.alias("__passes")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    slices: int = SLICES,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of ``docs``."""
    _, fitted = _fitted(_keyed(docs, seed, slices), weights, share, most)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__passes").cast("int")))
    return fitted.withColumn("__copy", copies).select(*all_columns(docs))


def allot(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    slices: int = SLICES,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, passes``: how often the mix takes each document."""
    keyed = cut(_keyed(docs.select("doc_id", "source", "text"), seed, slices).select("doc_id", "__mix"))
    goals, fitted = _fitted(keyed, weights, share, most)
    return (
        fitted.alias("f")
        .join(goals.alias("g"), F.expr("f.__mix.source <=> g.source"))
        .select("f.doc_id", "g.source", F.col("f.__mix.size").alias("size"), "g.source_size", "g.target", F.col("f.__passes").alias("passes"))
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    return allot(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken")
    )
