"""Exact top-k by tiled matrix products.

Vectors are packed into tiles. Every tile of queries meets every tile of
candidates once, in one matrix product; only the best ``k`` of each query leave
it. The products form a grid, whose cells (one tile of queries, ``group`` tiles
of candidates) are dealt evenly over the tasks. The short lists are then merged
up a tree: first among a few tiles, then among the groups of tiles.

A task holds one tile of queries and one batch of candidate tiles. A tile of
candidates travels once for each tile of queries, a tile of queries once for
each cell.

Scores are inner products of whole numbers, so they must be exact: a product
whose sums stay below 2**53 is done in floating point, where each step is then
exact; a larger one in Python's whole numbers, with scores held to the range of
a long.

Edge cases: a vector that is null, or has a null or non-finite component, takes
no part; vectors are compared with those of the same length only, an empty
vector scores 0 with another; a row without an id takes no part; repeated rows
are candidates of their own, but none with the query's own id is; a query
without candidates has no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut

#: Vectors in a tile.
TILE = 4096

#: Tiles of candidates in a cell of the grid.
GROUP = 8

#: Tasks of the grid at most; beyond, a task does several cells one after the other.
TASKS = 20_000

#: Tiles of candidates whose lists are merged first.
FAN_IN = 64


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _tiles(rows: DataFrame, tile: int, side: str) -> DataFrame:
    """``dim, <side>_tile, ids, values``: vectors packed by hash of their id into tiles of about ``tile``."""
    counts = rows.groupBy(F.size("vector").alias("dim")).agg(F.greatest(F.ceil(F.count("*") / tile), F.lit(1)).alias("tiles"))
    dealt = (
        rows.withColumn("dim", F.size("vector"))
        .join(F.broadcast(counts), "dim")  # one row for each vector length
        .withColumn(f"{side}_tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")))
    )

    def pack(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = pa.concat_arrays(table.column("vector").chunks).flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "dim": pa.array([keys[0].as_py()], pa.int32()),
                f"{side}_tile": pa.array([keys[1].as_py()], pa.int64()),
                "tiles": pa.array([keys[2].as_py()], pa.int64()),
                "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "values": pa.array([np.floor(np.clip(values * 256.0, -1e300, 1e300)).tobytes()], pa.binary()),
            }
        )

    shape = f"dim int, {side}_tile long, tiles long, ids binary, values binary"
    return dealt.select("dim", f"{side}_tile", "tiles", "vec_id", "vector").groupBy("dim", f"{side}_tile", "tiles").applyInArrow(pack, shape)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    dim = queries.shape[1]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * dim
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in candidates]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array(
        [[min(max(sum(int(a) * b for a, b in zip(q, c)), low), high) for c in whole] for q in queries], np.int64
    ).reshape(len(queries), len(candidates))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row: highest score, then smallest id. ``ids`` ascend."""
    k = min(k, scores.shape[1])
    if k < scores.shape[1]:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        scores = np.where(scores < least[:, None], np.iinfo(np.int64).min, scores)
    # ids ascend, so a stable sort keeps the smaller id first
    return np.argsort(~scores, axis=1, kind="stable")[:, :k]


def _counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    return rows.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / size).alias(name))


def grid(asked: DataFrame, rows: DataFrame, tile: int, group: int, tasks: int = TASKS) -> DataFrame:
    """``dim, q_tile, c_group, c_tile, ids, values``: the cells of the grid, whole and in order in their partitions.

    The tile of queries comes first in its cell, with ``c_tile`` -1.
    """
    # one row for each vector length
    sizes = cut(_counts(asked, tile, "q_tiles").join(_counts(rows, tile * group, "c_groups"), "dim"))
    cells = sizes.agg(F.sum(F.col("q_tiles") * F.col("c_groups"))).first()[0] or 1
    tiles = ("dim", "q_tile", "c_group", "c_tile", "c_groups", "ids", "values")
    own = _tiles(asked, tile, "q").join(F.broadcast(sizes), "dim").withColumns(
        {"c_group": F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_groups") - 1)), "c_tile": F.lit(-1).cast("long")}
    )
    other = _tiles(rows, tile, "c").join(F.broadcast(sizes), "dim").withColumns(
        {"q_tile": F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_tiles") - 1)), "c_group": F.floor(F.col("c_tile") / group)}
    )
    place = F.hash("dim").cast("long") + F.col("q_tile") * F.col("c_groups") + F.col("c_group")
    parts = min(cells, tasks)
    return (
        own.select(*tiles)
        .union(other.select(*tiles))
        .repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int"))
        .drop("c_groups")
        .sortWithinPartitions("dim", "q_tile", "c_group", "c_tile")
    )


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, tile: int = TILE, fan_in: int = FAN_IN, group: int = GROUP
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query among all rows of ``vectors``."""
    rows = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("is_query"))
        .where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    )
    asked = cut(rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector")))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        q = q_ids = np.empty(0)
        for batch in batches:
            names = zip(*(batch.column(n).to_pylist() for n in ("dim", "q_tile", "c_group", "c_tile")))
            for at, (dim, q_tile, c_group, c_tile) in enumerate(names):
                tile_ids = np.frombuffer(batch.column("ids")[at].as_buffer(), np.int64)
                values = np.frombuffer(batch.column("values")[at].as_buffer(), np.float64).reshape(len(tile_ids), dim)
                if c_tile < 0:
                    cell, q_ids, q = (dim, q_tile, c_group), tile_ids.copy(), values.copy()
                    continue
                if cell != (dim, q_tile, c_group):  # no query was dealt to this tile
                    continue
                order = np.argsort(tile_ids, kind="stable")
                c_ids, c = tile_ids[order], values[order]
                for a in range(0, len(q_ids), 512):
                    ids = q_ids[a : a + 512]
                    scores = _scores(q[a : a + 512], c)
                    own = ids[:, None] == c_ids[None, :]
                    spare = int(own.sum(axis=1).max(initial=0))
                    best = _best(np.where(own, np.iinfo(np.int64).min, scores), c_ids, k + spare)
                    picked = np.take_along_axis(own, best, 1)
                    line = np.repeat(np.arange(len(ids)), best.shape[1])[~picked.ravel()]
                    column = best.ravel()[~picked.ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [ids[line], np.full(len(line), c_tile), c_ids[column], scores[line, column]],
                        names=["query_id", "c_tile", "vec_id", "score"],
                    )

    cells = grid(asked, rows.select("vec_id", "vector"), tile, group)
    lists = cells.mapInArrow(product, "query_id long, c_tile long, vec_id long, score long")
    entry = F.struct(F.bitwise_not("score").alias("worse"), "vec_id", "score")

    def first(entries: Column) -> Column:
        return F.slice(F.array_sort(entries), 1, k)

    some = lists.groupBy("query_id", F.floor(F.col("c_tile") / fan_in).alias("group")).agg(first(F.collect_list(entry)).alias("best"))
    merged = some.groupBy("query_id").agg(first(F.flatten(F.collect_list("best"))).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def report(embeddings: DataFrame) -> DataFrame:
    """The 5 best for every vector whose id is divisible by 50."""
    return search(embeddings, F.col("vec_id") % 50 == 0)
