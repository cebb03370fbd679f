"""Exact Jaccard self-join of word n-gram sets by universe partition.

Sets that differ in at most ``d`` of their grams agree on one of any ``d + 1``
parts of the universe of grams. Sets are put into bands by size; in a band the
universe is cut into segments by hash, and a set is indexed by the hash of the
grams it has in a segment. Two sets that may be similar share such a signature:

* Small sets (a band that allows few differences) get half as many segments,
  each indexed with its one-deletion neighbourhood: the segment's hash, and the
  hash of the segment without each one gram. Every segment of two grams or more
  then takes up two differences instead of one, a segment of one gram takes up
  one, an empty one none.
* Larger sets get one segment for each difference and a few more; a set goes on
  until it has one signature more than it may have differences.

Nothing empty is a signature, neither a segment nor what a deletion leaves of it,
as it would join everything. A set whose segments do not take up its differences
is cut again by another hash, up to ``ROUNDS`` times, and compared with the sets
of its band that never got enough either: two similar sets meet in the first
round in which one of them has enough. Sets so small that only an equal one is
similar have their own hash as their only signature.

Which of the two a band gets is decided by cost: the signatures a set needs, and
the grams that are left in each to tell sets apart. A set of 200 grams that may
differ by a quarter needs about 70 signatures in segments of three or four grams,
and would need seven times as many with deletions.

A set is indexed in its own band and, if a larger similar set could be in the
next, there too. Equal sets are folded into one before anything is compared, so
a group of copies costs what one document costs. Sets that share a signature are
first compared with the least of them, similar ones are joined into components,
and only pairs between different components are compared after that: a group of
near copies costs about its size, not its square.

What moves: signatures once, in 12 bytes each; sketches of the sets that share
one; and the texts of those whose sketch is close to another's in a group. The
other texts stay where they are.

Edge cases: null texts and texts without words have an empty set and are linked
with nothing; a text of fewer words than ``n`` has its whole sequence as its only
gram; rows without ``doc_id`` are linked like others but never name a component
unless all its rows lack an id, which then is null; repeated rows are copies of
each other; without documents there is no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import arrays
from tidemark.llm.components import components
from tidemark.llm.rows import all_columns
from tidemark.session import cut

#: From this similarity on, sets need few signatures, and these can be told apart better.
CLOSE = 90

#: Ratio of the largest to the smallest size in a band, below ``CLOSE`` and from there on.
BAND = (1.5, 1.2)

#: What a thin segment costs, in signatures that travel, likewise.
THIN = (5, 10)

#: Ways to cut the universe that are tried on a set whose segments are too thin.
ROUNDS = 16

_SEED = np.uint64(0xD6E8FEB86659FD93)


class Scheme:
    """Bands, and how the sets of each are indexed, for similarity of ``percent`` in the hundred."""

    def __init__(self, percent: int = 90, largest: int = 1 << 40):
        self.percent = percent
        ratio, thin = BAND[percent >= CLOSE], THIN[percent >= CLOSE]
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1], floor(low[-1] * ratio)) + 1)
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        most = self.differences(high)
        small = -(-(most + 1) // 2)
        large = most + 1 + np.maximum(4, (most + 1) // 20)
        # cost: signatures a set needs, and how little a segment may have to tell sets apart
        cost_small = high + small + thin * high * np.exp(-high / small / 2)
        cost_large = most + 1 + thin * high * np.exp(-high / large / 2)
        self.deletions = cost_small <= cost_large
        # more segments where too few are expected to hold two grams
        for _ in range(50):
            missing = small * np.exp(-self.low[:-1] / small) * (2 + self.low[:-1] / small)
            few = (missing > (2 * small - most) / 4) & (small < high)
            small = np.where(few, np.minimum(small + 1 + small // 100, high), small)
        self.segments = np.where(self.deletions, small, large)

    def differences(self, size: np.ndarray) -> np.ndarray:
        """Most grams in which a set of this size can differ from a similar one."""
        return (size + size * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def reach(self, size: np.ndarray) -> np.ndarray:
        """The last band in which a set of this size may have a similar one."""
        return self.band(size * 100 // self.percent)

    def signatures(self, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of sets given as flat arrays, and the set of each."""
        sizes = np.diff(first)
        most = self.differences(sizes)
        alone = np.flatnonzero((sizes > 0) & (most == 0))
        keys, sets = [arrays.mix(set_ids(grams, first)[alone] ^ _SEED)], [alone]
        own, last = self.band(sizes), self.reach(sizes)
        for step in range(int((last - own).max(initial=-1)) + 1):
            chosen = np.flatnonzero((most > 0) & (own + step <= last))
            band = own[chosen] + step
            for deletions in (False, True):
                these = self.deletions[band] == deletions
                made = self._signatures(grams, first, chosen[these], band[these], deletions)
                keys.append(made[0])
                sets.append(made[1])
        return np.concatenate(keys), np.concatenate(sets)

    def _signatures(self, grams: np.ndarray, first: np.ndarray, sets: np.ndarray, band: np.ndarray, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
        keys, of = [], []
        for turn in range(ROUNDS):
            if not len(sets):
                break
            made, owner, thin = self._cut(grams, first, sets, band, deletions, turn)
            keys.append(made)
            of.append(sets[owner])
            sets, band = sets[thin], band[thin]
        return np.concatenate([*keys, arrays.mix(~band.astype(np.uint64))]), np.concatenate([*of, sets])

    def _cut(
        self, grams: np.ndarray, first: np.ndarray, sets: np.ndarray, band: np.ndarray, deletions: bool, turn: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures by one way to cut the universe, the place of each one's set in ``sets``, and the sets that need another."""
        sizes = first[sets + 1] - first[sets]
        seed = _SEED if turn == 0 else arrays.mix(np.array([turn], np.uint64))
        tokens = arrays.mix(grams[arrays.ranges(first[sets], sizes)] ^ seed)
        m = self.segments[band]
        offset = np.cumsum(m) - m
        of = np.repeat(np.arange(len(sets)), sizes)
        segment = ((tokens >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = offset[of] + segment
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, cell, tokens)
        count = np.bincount(cell, minlength=len(sums))
        owner = np.repeat(np.arange(len(sets)), m)
        place = arrays.mix((band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(owner)) - offset[owner]).astype(np.uint64))
        full = count > 0
        most = self.differences(sizes)
        if deletions:
            left = count[cell] > 1
            thin = np.add.reduceat(np.minimum(count, 2), offset) <= most
            keys = np.concatenate([arrays.mix(sums[full] ^ place[full]), arrays.mix((sums[cell] - tokens)[left] ^ place[cell[left]])])
            return keys, np.concatenate([owner[full], of[left]]), thin
        rank = np.cumsum(full)
        before = np.concatenate([[0], rank])[offset]
        chosen = full & (rank - before[owner] <= most[owner] + 1)
        return arrays.mix(sums[chosen] ^ place[chosen]), owner[chosen], np.add.reduceat(full, offset, dtype=np.int64) <= most


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each text, flat, and where each set begins."""
    hashes, first = arrays.word_hashes(arrays.LOWER[data], offsets, arrays.NOT_SPACE)
    found, at = arrays.grams(hashes, first, n)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < n))
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    extra = np.zeros(len(short), np.uint64)
    for k in range(1, n):  # a short text is one gram of all its words
        rows = np.flatnonzero(words[short] == k)
        starts = first[:-1][short[rows]]
        value = np.full(len(rows), np.uint64(k))
        for j in range(k):
            value = arrays.mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + j])
        extra[rows] = value
    found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(words) + 1))


def set_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, the same for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(grams + _SEED))])
    sizes = np.diff(first)
    return arrays.mix((sums[first[1:]] - sums[first[:-1]]) ^ arrays.mix(sizes.astype(np.uint64)))


# --- the join --------------------------------------------------------------

#: Classes of a sketch: how many grams of a set fall into each.
SKETCH = 256

def _sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Grams in each class, held to a byte: two sketches differ by at most what the sets do."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(owner * SKETCH + (grams % np.uint64(SKETCH)).astype(np.int64), minlength=(len(first) - 1) * SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, SKETCH)


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """Each document with its set's id, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in arrays.pieces(batch.column(2)):
                grams, first = gram_sets(data, offsets, n)
                sketches = [x.tobytes() for x in _sketches(grams, first)]
                made = [pa.array(np.diff(first)), pa.array(set_ids(grams, first).view(np.int64)), pa.array(sketches, pa.binary())]
                given = [batch.column(k).slice(row, stop - row) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*given, *made], names=["doc_id", "h", "n", "id", "sketch"])

    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text.cast("binary")).mapInArrow(
        run, "doc_id long, h long, n long, id long, sketch binary"
    )


def _signatures(docs: DataFrame, scheme: Scheme, n: int, buckets: int) -> DataFrame:
    """``bucket, keys, ids``: signatures dealt by their low half, four bytes of each and the eight of its set.

    Signatures of a bucket that only differ in the low half count as one: their sets meet for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in arrays.pieces(batch.column(0)):
                grams, first = gram_sets(data, offsets, n)
                ids, at = np.unique(set_ids(grams, first), return_index=True)
                sizes = np.diff(first)[at]
                keys, sets = scheme.signatures(grams[arrays.ranges(first[at], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
                bucket = (keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, sets = bucket[order].astype(np.int64), (keys[order] >> np.uint64(32)).astype(np.uint32), ids[sets[order]]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (keys, sets)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int64()), *packed], names=["bucket", "keys", "ids"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, keys binary, ids binary")


def _shared(table: pa.Table) -> pa.Table:
    """The groups of sets that share a signature of this bucket, each with a hash of its members."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("ids").to_pylist()])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    edges = np.append(np.flatnonzero(np.diff(keys, prepend=~keys[:1])), len(keys))
    several = np.flatnonzero(np.diff(edges) > 1)
    names = set_ids(ids, edges).view(np.int64)[several]
    members = [ids[edges[g] : edges[g + 1]].view(np.int64) for g in several]
    return pa.table({"name": pa.array(names, pa.int64()), "members": pa.array(members, pa.list_(pa.int64()))})


#: Sketches of a group that are compared at a time.
BLOCK = 1024


class _Group:
    """Sets that share a signature, by sketch."""

    def __init__(self, table: pa.Table, percent: int):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        self.ids = ids[order]
        self.n = table.column("n").to_numpy()[order]
        self.sketch = np.empty((len(order), SKETCH), np.uint8)
        sketches = table.column("sketch")
        for a in range(0, len(order), BLOCK):
            packed = b"".join(sketches.take(pa.array(order[a : a + BLOCK])).to_pylist())
            self.sketch[a : a + BLOCK] = np.frombuffer(packed, np.uint8).reshape(-1, SKETCH)
        self.percent = percent

    def middle(self) -> np.ndarray:
        """Median of each place of the sketches; of more than a block from counts of its values."""
        if len(self.sketch) <= BLOCK:
            return np.median(self.sketch, axis=0)
        below, above = (len(self.sketch) - 1) // 2, len(self.sketch) // 2
        out = np.empty(SKETCH)
        for k in range(SKETCH):
            upto = np.cumsum(np.bincount(self.sketch[:, k], minlength=256))
            out[k] = np.searchsorted(upto, [below, above], "right").mean()
        return out

    def distances(self, others: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Distance of each of the others to a point, a block at a time."""
        out = np.zeros(len(others), point.dtype)
        for a in range(0, len(others), BLOCK):
            out[a : a + BLOCK] = np.abs(self.sketch[others[a : a + BLOCK]] - point).sum(axis=1)
        return out

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may be similar to one; never leaves out one that is."""
        most = (self.n[one] + self.n[others]) * (100 - self.percent) // (100 + self.percent)
        return self.distances(others, self.sketch[one].astype(np.int32)) <= most


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=_PAIR)


def _tree(table: pa.Table, percent: int) -> pa.Table:
    """Pairs that would join the group as far as its sketches allow: every set with the first found near it.

    A set that has any other near it is in a pair: whichever of two is taken
    first finds the other, unless that was found before.
    """
    group = _Group(table, percent)
    by_middle = np.argsort(group.distances(np.arange(len(group.ids)), group.middle()), kind="stable")
    left, right = [], []
    rest = by_middle
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        one = queue.pop(0)
        near = group.near(one, rest)
        reached = rest[near]
        left.append(np.full(len(reached), group.ids[one]))
        right.append(group.ids[reached])
        queue.extend(reached.tolist())
        rest = rest[~near]
    return _pairs(left, right)


def _across(table: pa.Table, percent: int) -> pa.Table:
    """All pairs of the group that may be similar and are in different components."""
    group = _Group(table, percent)
    component = table.column("component").to_numpy()[np.argsort(table.column("id").to_numpy())]
    everyone = np.arange(len(group.ids))
    left, right = [], []
    for one in everyone:
        others = everyone[one + 1 :][component[one + 1 :] != component[one]]
        reached = others[group.near(one, others)]
        left.append(np.full(len(reached), group.ids[one]))
        right.append(group.ids[reached])
    return _pairs(left, right)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar, by counting common grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                kept.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    of_a = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    of_b = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


#: Classes of text hashes; those of the wanted texts are sent to every task, eight bytes each.
CLASSES = 1 << 20


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``id, grams`` of the sets in ``wanted`` (``id, doc_id, h`` of one document of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in arrays.pieces(batch.column(0)):
                grams, first = gram_sets(data, offsets, n)
                ids, at = np.unique(set_ids(grams, first), return_index=True)
                packed = [grams[first[k] : first[k + 1]].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(packed, pa.binary())], names=["id", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    same = "t.doc_id <=> w.doc_id and t.h = w.h"
    # texts of no wanted class of hashes need not move
    texts = texts.withColumn("c", F.expr(f"h & {CLASSES - 1}"))
    texts = texts.join(F.broadcast(wanted.select(F.expr(f"h & {CLASSES - 1}").alias("c")).distinct()), "c", "left_semi")
    # both sides grow with the documents, so they meet by a shuffle at every size
    found = texts.alias("t").join(wanted.hint("merge").alias("w"), F.expr(same), "left_semi").select("text")
    return found.mapInArrow(run, "id long, grams binary").dropDuplicates(["id"])


def classes(docs: DataFrame, n: int = 3, percent: int = 90, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, h, n_shingles, component``: every document with its set's size and its component of linked sets.

    ``h`` is a hash of the text. Documents link when their sets of word n-grams
    have ``percent`` in the hundred of their union in common.
    """
    scheme = Scheme(percent)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, ceil(total / bucket_bytes))
    rows = cut(_rows(docs, n))
    # from the texts again: signatures are only shuffled, not written beside
    groups = cut(
        _signatures(docs, scheme, n, buckets).groupBy("bucket").applyInArrow(_shared, "name long, members array<long>").dropDuplicates(["name"])
    )
    members = groups.select("name", F.explode("members").alias("id"))
    known = cut(
        rows.join(members.select("id").distinct(), "id", "left_semi")
        .groupBy("id")
        .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("of"))
    )
    sketched = members.join(known.select("id", "n", "sketch"), "id")
    tried = cut(sketched.groupBy("name").applyInArrow(lambda t: _tree(t, percent), "a long, b long").distinct())

    # sets outside the tree have no other near them in any group: they need no text and no further comparison
    near = cut(known.join(tried.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    sets = cut(_sets(docs, near.select("id", "of.doc_id", "of.h"), n))
    links = cut(_verify(tried, sets, percent))
    names = components(links)

    sketched = members.join(near.select("id", "n", "sketch"), "id")
    named = sketched.join(names.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_groups = named.groupBy("name").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("name")
    more = (
        named.join(open_groups, "name", "left_semi")
        .groupBy("name")
        .applyInArrow(lambda t: _across(t, percent), "a long, b long")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    links = cut(links.unionByName(_verify(cut(more), sets, percent)))
    names = components(links)
    return rows.join(names.withColumnRenamed("node", "id"), "id", "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).alias("component")
    )


def report(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    found = cut(classes(docs, n, percent))
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, in the same columns: the one with the least ``doc_id``.

    Rows with an empty set all stay. Among rows of one ``doc_id`` the least hash
    of the text stays, and of equal rows one.
    """
    found = cut(classes(docs, n, percent))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    kept = found.where("component is not null").groupBy("component").agg(F.min(order).alias("of")).select("of.doc_id", "of.h")
    # no key is null, so that one shuffle of the texts serves the join and the repeated rows
    key = {"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull()}
    marked = docs.withColumns(key | {"__h": F.xxhash64("text"), "__words": F.col("text").rlike(r"[^\x20\x09-\x0D]")})
    columns = all_columns(docs)
    names = [*key, "__h"]
    chosen = marked.where("__words").join(kept.withColumns(key).select(*key, F.col("h").alias("__h")).hint("merge"), names, "left_semi")
    single = chosen.dropDuplicates(names).select(*columns)
    return single.unionByName(marked.where("not coalesce(__words, false)").select(*columns))
