"""Byte-balanced shards by histogram sort.

Documents are ordered by (hash of the text, hash of ``doc_id``), so equal texts
stand together, and the order is cut into shards of near equal bytes. The cuts
are found without sorting: each round counts the exact bytes in a few bins of
the key around every cut, keeps the bin in which the wanted byte lies, and
divides that bin again, until the count below a cut is within tolerance. Only
then are rows exchanged, once, each to its final slice.

A cut is first sought in the text's hash. Where one value alone holds more than
the tolerance (a large group of equal texts), the search goes on in the hash of
``doc_id`` within it, so a group of any size is divided; smaller groups stay in
one shard. Shards are ranked in slices, cut by rows in the same way, so that no
task gets more than about one ``slices``-th of the rows.

The driver sees bin counts only: at most ``BINS`` for each cut and round.

Edge cases: a null text has no bytes, size 16 and checksum 0; rows equal in text
and ``doc_id`` stay in one shard; a document larger than a shard has one to
itself, and shards may be empty where there are few documents; without
documents there is no row. Other columns pass through :func:`shard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import quoted
from tidemark.session import cut

#: Bins into which a round divides the range around one cut, a power of two.
BINS = 64

#: Bits of the two parts of the key; a whole number of rounds.
BITS = 60

#: Leading bits of the key by which rows look up the cuts near them.
LOOKUP_BITS = 12


def _key(of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(of), 64 - BITS)


def size(text: Column) -> Column:
    """Bytes of the text plus 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__h": _key(F.col("text")), "__d": _key(F.col("doc_id")), "__size": size(F.col("text"))})


def _table(spark: SparkSession, names: str, rows: list[str]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _narrow(
    keyed: DataFrame, column: str, weight: Column, goals: dict[int, tuple[int, int, int]], tolerance: float
) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
    """Narrow every cut within one column of the key.

    ``goals`` has for each cut the value of ``__h`` it is in (0 while that is the
    column sought), the weight before it and the weight wanted. Returns the
    values found, and the goals of cuts that fall inside one heavy value.
    """
    found: dict[int, int] = {}
    inside: dict[int, tuple[int, int, int]] = {}
    shift = BITS
    sought = {c: (h, 0, before, goal) for c, (h, before, goal) in goals.items()}
    while sought:
        ranges = sorted({(h, low) for h, low, _, _ in sought.values()})
        rows = [f"({k}, {h}L, {low >> shift}L)" for k, (h, low) in enumerate(ranges)]
        where = _table(keyed.sparkSession, "r, h, block", rows)
        same = F.col("block") == F.shiftright(column, shift)
        if column != "__h":
            same &= F.col("h") == F.col("__h")
        shift -= BINS.bit_length() - 1
        counts = (
            keyed.join(F.broadcast(where), same)  # one row for each cut at most
            .groupBy("r", F.shiftright(column, shift).alias("bin"))
            .agg(F.sum(weight).alias("n"))
            .collect()
        )
        bins: list[list[tuple[int, int]]] = [[] for _ in ranges]
        for row in counts:
            bins[row["r"]].append((row["bin"], row["n"]))
        at = {r: sorted(bins[k]) for k, r in enumerate(ranges)}
        still = {}
        for c, (h, low, before, goal) in sought.items():
            for value, n in at[h, low]:
                if before + n > goal:
                    break
                before += n
            else:
                before -= n
            below, above = goal - before, before + n - goal
            if min(below, above) <= tolerance or (shift == 0 and column != "__h"):
                found[c] = (value if below <= above else value + 1) << shift
            elif shift == 0:
                inside[c] = (value, before, goal)
            else:
                still[c] = (h, value << shift, before, goal)
        sought = still
    return found, inside


def splitters(keyed: DataFrame, weight: Column, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """``parts - 1`` keys that cut the rows into parts of near equal weight, each within ``tolerance`` of a part."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return []
    allowed = tolerance * total / parts
    found, inside = _narrow(keyed, "__h", weight, {c: (0, 0, total * c // parts) for c in range(1, parts)}, allowed)
    within, _ = _narrow(keyed, "__d", weight, inside, allowed)
    return sorted([(h, 0) for h in found.values()] + [(inside[c][0], d) for c, d in within.items()])


def _lookup(spark: SparkSession, cuts: list[tuple[int, int]], name: str) -> DataFrame:
    """For each leading part of the key: cuts before it, and the cuts in it."""
    shift = BITS - LOOKUP_BITS
    inside: dict[int, list[tuple[int, int]]] = {}
    for h, d in cuts:
        inside.setdefault(h >> shift, []).append((h, d))
    rows, before = [], 0
    for block in range(1 << LOOKUP_BITS):
        here = inside.get(block, [])
        listed = ", ".join(f"struct({h}L, {d}L)" for h, d in here)
        typed = f"array({listed})" if here else "cast(array() as array<struct<col1:bigint,col2:bigint>>)"
        rows.append(f"({block}L, {before}, {typed})")
        before += len(here)
    return _table(spark, f"{name}_block, {name}_before, {name}_cuts", rows)


def _part(keyed: DataFrame, cuts: list[tuple[int, int]], name: str) -> DataFrame:
    """``keyed`` with the number of cuts at or below each row's key."""
    table = F.broadcast(_lookup(keyed.sparkSession, cuts, name))  # 2 ** LOOKUP_BITS rows
    key = F.struct(F.col("__h").alias("col1"), F.col("__d").alias("col2"))
    number = F.col(f"{name}_before") + F.size(F.filter(f"{name}_cuts", lambda c: c <= key))
    joined = keyed.join(table, F.col(f"{name}_block") == F.shiftright("__h", BITS - LOOKUP_BITS))
    return joined.withColumn(name, number).drop(f"{name}_block", f"{name}_before", f"{name}_cuts")


def _placed(keyed: DataFrame, searched: DataFrame, shards: int, slices: int, tolerance: float) -> DataFrame:
    """``keyed`` with ``__shard`` and ``__slot``; ``searched`` has the keys and sizes of the same rows."""
    by_bytes = splitters(searched, F.col("__size"), shards, tolerance)
    by_rows = splitters(searched, F.lit(1), slices, 0.25)

    def dealt(rows: DataFrame) -> DataFrame:
        return _part(_part(rows, by_bytes, "__shard"), by_rows, "__slice")

    counts = dealt(searched).groupBy("__shard", "__slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(  # at most shards + slices rows
        counts.select("__shard", "__slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    )
    order = Window.partitionBy("__shard", "__slice").orderBy("__h", "__d", "doc_id")
    ranked = dealt(keyed).withColumn("__place", F.row_number().over(order))
    placed = ranked.join(offsets, ["__shard", "__slice"])
    return placed.withColumn("__slot", (F.col("__offset") + F.col("__place") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 40, slices: int = 320, tolerance: float = 0.005) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, its place in the shard, counted from 0."""
    keyed = _keyed(docs)
    searched = cut(keyed.select("__h", "__d", "__size"))
    columns = [quoted(c) for c in docs.columns if c not in ("shard", "slot")]
    return _placed(keyed, searched, shards, slices, tolerance).select(
        *columns, F.col("__shard").alias("shard"), F.col("__slot").alias("slot")
    )


def report(docs: DataFrame, shards: int = 40, slices: int = 320, tolerance: float = 0.005) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    keyed = cut(_keyed(docs.select("doc_id", "text")).select("doc_id", "__h", "__d", "__size", crc.alias("text_crc32")))
    return _placed(keyed, keyed.select("__h", "__d", "__size"), shards, slices, tolerance).select(
        "doc_id",
        F.col("__size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
