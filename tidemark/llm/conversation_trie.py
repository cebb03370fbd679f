"""The prefix trie of conversations, built as a burst trie over shards.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation
by the names of its turns in order. Equal conversations are folded into one
sequence, so copies weigh nothing. The sequences then lie in containers below
trie heads: the root is a head; a container of more than ``container_turns``
turns (and more than one sequence) bursts by its sequences' next turn into one
container for each such turn, and what it hung on becomes a head. One round of
bursts looks several turns ahead, twice as many each round, so a long prefix
that many conversations share takes the logarithm of its length in rounds.

Containers left over are dealt to tasks, sorted, and swept once: neighbours'
common prefixes say where nodes begin. Heads are sums over the containers and
the heads below them.

Bounds: a task holds containers of about ``SWEEP_TURNS`` turns (or one
conversation if that is longer) at about 150 bytes a turn; one conversation is
one row of 20 bytes a turn; the ids of conversations that end at a node travel
in blocks and pass through a running SHA-256, so that no task holds them all.
Nothing reaches the driver but a count of rows for each round.

Rows of no ``conv_id`` belong to no conversation and are left out; a null role
or text is empty; turns are ordered by ``turn``, null first, and rows of the
same turn by the hash of role and text; repeated rows are turns of their own.
No conversations give no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.joins import group_join
from tidemark.llm.arrays import flat, ranges
from tidemark.session import cut

#: Turns that a container may hold before it bursts, and turns of containers that are swept together.
CONTAINER_TURNS, SWEEP_TURNS = 1024, 1 << 16
#: Turns that one round of bursts looks ahead: at first, and at most.
AHEAD, MOST_AHEAD = 2, 64
#: Ids of conversations share a row of members by blocks of two to this many.
BLOCK_BITS = 12
ID = 16

_NONE = hashlib.sha256(b"").hexdigest()

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, turn_id binary, path binary, path_sizes array<int>"
)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id as hex, size): every turn by name, with the UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(named, 1, 2 * ID).alias("turn_id"), F.octet_length(text).alias("size")
    )


def _as_sequence(ordered: Column) -> list[Column]:
    return [
        F.unhex(F.array_join(F.transform(ordered, lambda t: t["turn_id"]), "")).alias("ids"),
        F.transform(ordered, lambda t: t["size"]).alias("sizes"),
    ]


def _in_order() -> Column:
    return F.sort_array(F.collect_list(F.struct("turn", "turn_id", "size"))).alias("own")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): every conversation's turns in order."""
    ordered = turns(conversations).groupBy("conv_id").agg(_in_order())
    return ordered.select("conv_id", *_as_sequence(F.col("own")))


def branched(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Sequences as in :func:`sequences`, each begun by the turns of another conversation.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % every`` and its own
    after its first ``h``, with ``h = crc32(c) % most``. Conversations with the
    same beginning are dealt by it, so the turns move once.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns(conversations).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(_in_order())
    # at most 2 * every - 1 conversations share a base
    lead = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rest = F.expr("slice(own, h + 1, greatest(size(own) - h, 0))")
    spliced = F.when(F.col("lead").isNull(), rest).otherwise(F.concat(F.expr("slice(lead, 1, h)"), rest))
    placed = own.withColumns({"lead": lead, "h": h}).select("conv_id", spliced.alias("own"))
    return placed.select("conv_id", *_as_sequence(F.col("own")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, members, first, n, ids, sizes) by key and block to one row a key: a running hash over its blocks."""
    key = row = None
    for batch in batches:
        done = []
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for found, _, members, first, n, ids, sizes in zip(*columns):
            if found != key:
                if row:
                    done.append((row[0], row[1], row[2], row[3], row[4].hexdigest()))
                key, row = found, [first, n, ids, sizes, hashlib.sha256(members.encode())]
            else:
                row[1] += n
                row[4].update(b"," + members.encode())
        if done:
            yield _distinct_batch(done)
    if row:
        yield _distinct_batch([(row[0], row[1], row[2], row[3], row[4].hexdigest())])


def _distinct_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "n", "ids", "sizes", "digest"])


def folded(sequences: DataFrame) -> DataFrame:
    """One row for each distinct sequence: its least conversation, their number, and the hash of their ids in order."""
    blocks = (
        sequences.withColumn("key", F.substring(F.sha2(F.col("ids"), 256), 1, 2 * ID))
        .groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("found"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    )
    members = F.array_join(F.transform("found", lambda c: c.cast("string")), ",")
    sent = blocks.select("key", "block", members.alias("members"), F.get("found", F.lit(0)).alias("first"), F.size("found").cast("long").alias("n"), "ids", "sizes")
    return sent.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "conv_id long, n long, ids binary, sizes array<int>, digest string")


def _prefix(ids: str, depth: Column) -> Column:
    return F.col(ids).substr(F.lit(1), depth * ID)


def _head(ids: str, depth: Column) -> Column:
    return F.unhex(F.substring(F.sha2(_prefix(ids, depth), 256), 1, 2 * ID))


def burst(distinct: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """``distinct`` with ``turns`` and ``at``: the depth of the deepest head on each sequence's way."""
    waiting = distinct.withColumns({"turns": F.expr(f"octet_length(ids) div {ID}").cast("int"), "at": F.lit(0)})
    settled, ahead = [], AHEAD
    while True:
        # a prefix is a head when too many turns hang on it; prefixes of heads are heads
        steps = F.sequence(F.col("at") + 1, F.least(F.col("turns"), F.col("at") + ahead))
        ways = waiting.where("turns > at").select("conv_id", "turns", "ids", F.explode(steps).alias("k"))
        ways = ways.select("conv_id", "turns", "k", _head("ids", F.col("k")).alias("head"))
        loads = ways.groupBy("head").agg(F.sum(F.col("turns") - F.col("k") + 1).alias("load"), F.count(F.lit(1)).alias("paths"))
        heads = cut(loads.where((F.col("load") > container_turns) & (F.col("paths") > 1)).select("head"))
        passed = ways.join(heads, "head", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("passed"))
        moved = group_join(waiting, passed, "conv_id").withColumn("passed", F.coalesce("passed", F.lit(0)))
        open_ = (F.col("passed") == ahead) & (F.col("turns") > F.col("at") + ahead)
        moved = cut(moved.withColumns({"open": open_, "at": F.col("at") + F.col("passed")}).drop("passed"))
        settled.append(moved.where("not open").drop("open"))
        waiting = moved.where("open").drop("open")
        if waiting.isEmpty():
            break
        ahead = min(2 * ahead, MOST_AHEAD)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def sweep(containers: pa.Table) -> pa.RecordBatch:
    """All nodes of whole containers, whose rows are sorted by container and ids.

    A row's turns below its head are elements. An element begins a node where it
    lies beyond the common prefix with the row before; in the order of container,
    depth and row the elements of a node stand together, so every figure of a
    node is a sum over a run. Turns that a conversation does not own (another,
    smaller one passes through the same node) are the ones saved.
    """
    n_rows = containers.num_rows
    conv, weight, at = (containers[c].to_numpy().astype(np.int64) for c in ("conv_id", "n", "at"))
    data, offsets = flat(containers["ids"])
    ids = np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2)
    first = offsets[:-1] // ID
    sizes = containers["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets) // ID - at
    starts = first + at
    container = np.cumsum(np.concatenate([[False], _differ(containers["container"])]))

    common = np.zeros(n_rows, np.int64)
    shared = np.where(container[1:] == container[:-1], np.minimum(lengths[1:], lengths[:-1]), 0)
    left, right = ranges(starts[:-1], shared), ranges(starts[1:], shared)
    unequal = (ids[left] != ids[right]).any(axis=1)
    before = np.concatenate([[0], np.cumsum(shared)])
    breaks = np.flatnonzero(unequal)
    next_break = np.searchsorted(breaks, before[:-1])
    at_break = np.append(breaks, np.iinfo(np.int64).max)[next_break]
    common[1:] = np.minimum(at_break - before[:-1], shared)

    element = ranges(starts, lengths)
    row = np.repeat(np.arange(n_rows), lengths)
    ends = np.cumsum(lengths)
    depth = np.arange(len(element)) - np.repeat(ends - lengths, lengths)
    begins = depth >= common[row]
    order = np.lexsort((row, depth, container[row]))
    run_starts = np.flatnonzero(begins[order])
    node = np.empty(len(element), np.int64)
    node[order] = np.cumsum(begins[order]) - 1

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[order], run_starts)

    def onwards(values: np.ndarray) -> np.ndarray:
        """Sums from each element to the end of its row."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[np.repeat(ends, lengths)] - total[:-1]

    least = np.minimum.reduceat(conv[row][order], run_starts)
    size = sizes[element]
    foreign = np.where(conv[row] == least[node], 0, size)
    saved = summed((weight[row] - 1) * onwards(size) + onwards(foreign))
    last = ends - 1
    childless = np.ones(n_rows, bool)
    childless[:-1] = (container[1:] != container[:-1]) | (common[1:] < lengths[:-1])
    head = order[run_starts]  # the element that begins each node
    inner = depth[head] > 0
    parent = node[head - inner]
    picked = np.full(len(head), n_rows)
    picked[node[last]] = np.arange(n_rows)
    digest = pa.concat_arrays([containers["digest"].combine_chunks(), pa.array([_NONE])]).take(pa.array(picked))
    turn_ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ID), len(head), [None, pa.py_buffer(np.ascontiguousarray(ids[element[head]]))])
    tops = pa.array(row[head], mask=inner)
    way = pa.array(_cut_lists(data, offsets[:-1], at * ID), pa.binary())
    way_sizes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]), pa.int32()), pa.array(sizes[ranges(first, at)], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(least),
            pa.array(at[row[head]] + depth[head] + 1, pa.int64()),
            pa.array(least[parent], mask=~inner),
            pa.array(summed(weight[row])),
            pa.array(np.bincount(parent[inner], minlength=len(head))),
            pa.array(summed(childless[row].astype(np.int64))),
            pa.array(saved),
            digest,
            turn_ids.cast(pa.binary()),
            way.take(tops),
            way_sizes.take(tops),
        ],
        names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id", "path", "path_sizes"],
    )


def _differ(column: pa.ChunkedArray) -> np.ndarray:
    """Where a column of fixed-length keys differs from the row before, without the first row."""
    data, offsets = flat(column)
    keys = data.reshape(len(offsets) - 1, -1)
    return (keys[1:] != keys[:-1]).any(axis=1)


def _cut_lists(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]


def _swept(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Sweep runs of whole containers of about ``at_once`` turns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        done = 0
        edges = np.flatnonzero(_differ(pa.chunked_array([batch.column("container")]))) + 1
        if held and held[-1].column("container")[-1] != batch.column("container")[0]:
            edges = np.concatenate([[0], edges])
        turns_before = np.concatenate([[0], np.cumsum(batch.column("turns").to_numpy())])
        waiting = sum(int(np.sum(b.column("turns").to_numpy())) for b in held)
        for edge in edges.tolist():
            if waiting + turns_before[edge] - turns_before[done] >= at_once:
                held.append(batch.slice(done, edge - done))
                yield sweep(pa.Table.from_batches(held))
                held, done, waiting = [], edge, 0
        held.append(batch.slice(done))
    if held:
        yield sweep(pa.Table.from_batches(held))


def nodes(sequences: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """Every node of the trie of ``sequences``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id."""
    placed = burst(cut(folded(sequences)), container_turns)
    dealt = placed.where("turns > at").withColumn("container", _head("ids", F.col("at") + 1))
    dealt = dealt.repartition("container").sortWithinPartitions("container", "ids")
    below = cut(dealt.mapInArrow(lambda batches: _swept(batches, SWEEP_TURNS), _NODE))

    # every container and every sequence that ends at a head counts towards all heads on its way
    tops = below.where("path is not null")
    ends = placed.where("turns = at")
    figures = ["conv_id", "n_convs", "n_leaves", "saved_tokens", "path", "path_sizes"]
    given = tops.select(*figures, F.lit(1).alias("top")).unionByName(
        ends.select("conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("ids").alias("path"), F.col("sizes").alias("path_sizes"), F.lit(0).alias("top"))
    )
    up = given.withColumn("d", F.explode(F.sequence(F.lit(0), F.size("path_sizes"))))
    up = up.withColumns({"top": F.when(F.col("d") == F.size("path_sizes"), F.col("top")).otherwise(0), "path": _prefix("path", F.col("d")), "path_sizes": F.slice("path_sizes", F.lit(1), F.col("d"))})
    heads = cut(
        up.groupBy("path", "path_sizes").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.sum("top").alias("tops")
        )
    )
    depth = F.size("path_sizes")
    own = (F.col("n_convs") - 1) * F.coalesce(F.get("path_sizes", depth - 1), F.lit(0))
    chain = heads.select("path", depth.alias("depth"), own.alias("own"), F.explode(F.sequence(F.lit(0), depth)).alias("d"))
    chain = chain.groupBy(_prefix("path", F.col("d")).alias("up")).agg(F.sum("own").alias("own"), F.sum((F.col("d") == F.col("depth") - 1).cast("long")).alias("head_children"))
    over = heads.select(F.col("path").alias("over"), F.col("conv_id").alias("parent_conv_id"))
    ended = ends.select(F.col("ids").alias("ended"), "digest")
    children = F.col("tops") + F.col("head_children")
    named = (
        heads.join(chain, F.col("path") == F.col("up"))
        .join(ended, F.col("path") == F.col("ended"), "left")
        .join(over, (F.octet_length("path") > 0) & (_prefix("path", depth - 1) == F.col("over")), "left")
        .select(
            "conv_id",
            depth.cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            children.alias("n_children"),
            F.when(children == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            (F.col("below") + F.col("own")).alias("saved_tokens"),
            F.coalesce("digest", F.lit(_NONE)).alias("ends_sha256"),
            F.when(depth > 0, F.col("path").substr((depth - 1) * ID + 1, F.lit(ID))).alias("turn_id"),
        )
    )
    hung = group_join(tops.drop("parent_conv_id"), heads.select("path", F.col("conv_id").alias("parent_conv_id")), "path")
    inner = below.where("path is null")
    return inner.select(*named.columns).unionByName(hung.select(*named.columns)).unionByName(named)


def with_texts(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null at the root): the trie as rows to pack prompts from."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.unhex(F.substring(named, 1, 2 * ID)).alias("turn_id"), role.alias("role"), text.alias("text"))
    return trie.join(known.dropDuplicates(["turn_id"]), "turn_id", "left")


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the branched conversations, one row a node."""
    return nodes(branched(conversations)).drop("turn_id")
