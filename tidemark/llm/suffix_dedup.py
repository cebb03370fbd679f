"""Removal of repeated byte strings with suffix arrays.

A byte goes when it is covered by a string of ``length`` bytes that also starts
earlier in the collection. The work is dealt by content, so that no task needs
more than its share and nothing but what may repeat is sorted:

1. Documents are gathered into blocks by hash. In every text, each window of
   ``length`` bytes names an anchor, the k-gram in it with the least hash. Equal
   windows name equal anchors, so an anchor that occurs once in the collection
   rules all its windows out. Anchors are counted by hash.
2. The windows of each anchor that occurs more than once form a segment. Equal
   segments of a block are folded into the first. Segments go to the bucket of
   their anchor; copies of whole segments are folded there too.
3. In a bucket, a suffix array of the segments that are left is built in two
   stages. Suffixes smaller than their successors are sorted directly. The
   others are induced by scanning the buckets of first bytes in order: behind a
   sorted suffix, the byte before it tells where the next larger one goes.
   Common prefixes of neighbours then show which windows are equal; all but the
   earliest are reported.
4. Each block gets back the windows found in its texts and removes the bytes.

An anchor that occurs more often than ``hot`` times would pile up in one bucket.
Its windows are dealt one by one instead, by a 128-bit hash of their bytes.

Edge cases: null and empty texts, and those shorter than ``length``, lose
nothing; "earlier" is by ``doc_id`` (null last), among rows of one ``doc_id`` by
a hash of the text, and among equal rows by any fixed order; without documents
there is no row. Other columns pass through :func:`dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import arrays
from tidemark.llm.rows import all_columns

#: Bytes of text in a block, and of segments in a bucket, as far as single texts allow.
BLOCK_BYTES = 8 << 20

#: Bytes of a k-gram that can be an anchor.
ANCHOR = 32

#: Occurrences of an anchor from which its windows are dealt one by one.
HOT = 2000

_NO_ID = (1 << 63) - 1


# --- anchors ---------------------------------------------------------------


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For every run of windows with one anchor: anchor hash, first window, number of windows, row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    sums = arrays.prefix_sums(data)
    at = np.arange(n - k + 1)
    hashes = arrays.span_hash(sums, at, at + k)
    # the position in the low bits makes the least value name its place, the leftmost among equals
    low = np.uint64((1 << 32) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    # sliding minimum over the k-grams of a window, by doubling
    wide, done = length - k + 1, 1
    while done < wide:
        step = min(done, wide - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    windows = np.diff(offsets) - (length - 1)
    rows = np.flatnonzero(windows > 0)
    inside = np.zeros(len(least) + 1, np.int8)
    inside[offsets[:-1][rows]] += 1
    inside[offsets[:-1][rows] + windows[rows]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    place = (least & low).astype(np.int64)
    begins = inside.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    begins[offsets[:-1][rows]] = True
    first = np.flatnonzero(begins)
    row = np.searchsorted(offsets, first, "right") - 1
    # a run ends where the next begins or the row has no more windows
    following = np.append(first[1:], np.iinfo(np.int64).max)
    number = np.minimum(following, offsets[row] + windows[row]) - first
    return hashes[place[first]], first, number, row


# --- two-stage suffix sorting ----------------------------------------------


def _words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one whole number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for b in range(8):
        out = out << np.uint64(8) | text[at + b]
    return out


def _sort_to_depth(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes; ``text`` is padded by that many."""
    order = at[np.argsort(_words_at(text, at), kind="stable")]
    group = np.zeros(len(order), np.int64)
    active = np.arange(len(order))
    for d in range(0, depth, 8):
        words = _words_at(text, order[active] + d)
        key = np.lexsort((words, group[active]))
        order[active] = order[active][key]
        words, owner = words[key], group[active]
        new = np.ones(len(active), bool)
        new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
        group[active] = np.maximum.accumulate(np.where(new, active, -1))
        tied = ~new
        tied[:-1] |= ~new[1:]
        active = active[tied]
        if not len(active):
            break
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of the first ``depth`` bytes from each, by two-stage sorting.

    ``text`` must end in ``depth`` zero bytes, which take no part; a suffix that
    runs into them sorts as if they were its bytes.
    """
    n = len(text) - depth
    if n <= 0:
        return np.zeros(0, np.int64)
    body = text[:n]
    # smaller than its successor: the next different byte is larger
    change = np.flatnonzero(text[:-1] != text[1:])
    next_change = np.searchsorted(change, np.arange(n))
    rises = np.zeros(n, bool)
    known = next_change < len(change)
    spots = change[next_change[known]]
    rises[known] = text[spots] < text[spots + 1]
    direct = _sort_to_depth(text, np.flatnonzero(rises), depth)

    out = np.empty(n, np.int64)
    sizes = np.bincount(body, minlength=256)
    head = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    stop = head + sizes
    bounds = np.searchsorted(text[direct], np.arange(257))
    for c in range(256):
        part = direct[bounds[c] : bounds[c + 1]]
        out[stop[c] - len(part) : stop[c]] = part
    fill = head.copy()

    def induce(sources: np.ndarray) -> None:
        """Place what precedes the sorted ``sources`` and is larger, in their order."""
        before = sources[sources > 0] - 1
        before = before[~rises[before]]
        first = text[before]
        by_bucket = np.argsort(first, kind="stable")
        counts = np.bincount(first, minlength=256)
        starts = np.repeat(fill - (np.cumsum(counts) - counts), counts)
        out[starts + np.arange(len(before))] = before[by_bucket]
        fill[:] += counts

    # the suffix behind the last byte is the smallest of all
    if not rises[n - 1]:
        c = text[n - 1]
        out[fill[c]] = n - 1
        fill[c] += 1
    for c in range(256):
        if not sizes[c]:
            continue
        done = head[c]
        while done < fill[c]:  # those that precede others of this bucket go on within it
            upto = fill[c]
            induce(out[done:upto])
            done = upto
        induce(out[done : stop[c]])
    return out


def common_prefix(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, at most ``most``; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for d in range(0, most, 8):
        a, b = order[active - 1] + d, order[active] + d
        differ = _words_at(text, a) ^ _words_at(text, b)
        equal = differ == 0
        shared[active[equal]] += 8
        rest = differ[~equal]
        lead = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
        shared[active[~equal]] += np.clip(lead, 0, 63) // 8
        active = active[equal]
    return np.minimum(shared, most)


# --- what the stages exchange ----------------------------------------------


def _rows(kind: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in kind]
    return pa.table({name: pa.array(values, t) for (name, t), values in zip(kind.items(), columns)})


_COUNTS = {"bucket": pa.int64(), "block": pa.int64(), "anchors": pa.binary(), "counts": pa.binary()}
_MARKED = {"block": pa.int64(), "anchors": pa.binary(), "hot": pa.binary()}
_PIECES = {"bucket": pa.int64(), "block": pa.int64(), "segments": pa.binary(), "data": pa.binary(), "windows": pa.binary(), "copies": pa.binary()}
_FOUND = {"block": pa.int64(), "runs": pa.binary()}

_SEGMENT = np.dtype([("anchor", "u8"), ("id", "i8"), ("row", "i4"), ("pos", "i4"), ("n", "i4")])
_WINDOW = np.dtype([("key", "u8"), ("check", "u8"), ("id", "i8"), ("row", "i4"), ("pos", "i4")])
_RUN = np.dtype([("row", "i4"), ("pos", "i4"), ("n", "i4")])


def _schema(kind: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'long' if t == pa.int64() else 'binary'}" for name, t in kind.items())


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a block by id (null last) and hash of the text, and the ids."""
    ids = np.array(table.column("id").fill_null(_NO_ID).to_numpy(), np.int64)
    order = np.lexsort((table.column("h").to_numpy(), ids))
    return table.take(order), ids[order]


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the keys in each bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each entry is the first with its keys."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        out[order[new]] = True  # the sort is stable
    return out


def _count_anchors(table: pa.Table, length: int, k: int, buckets: int) -> pa.Table:
    table, _ = _ordered(table)
    block = table.column("block")[0].as_py()
    found = [_anchors(data, offsets, length, k)[0] for _, _, data, offsets in arrays.pieces(table.column("data"))]
    anchors, counts = np.unique(np.concatenate(found), return_counts=True)
    counts = np.minimum(counts, 65535).astype(np.uint16)
    rows = [(b, block, anchors[at].tobytes(), counts[at].tobytes()) for b, at in _dealt(anchors, buckets)]
    return _rows(_COUNTS, rows)


def _mark_repeated(table: pa.Table, hot: int) -> pa.Table:
    blocks = table.column("block").to_pylist()
    lists = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
    anchors = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(anchors, return_inverse=True)
    total = np.bincount(at, counts)[at]
    ends = np.cumsum([len(x) for x in lists])
    rows = []
    for block, a, b in zip(blocks, [0, *ends[:-1]], ends):
        kept = np.flatnonzero(total[a:b] >= 2) + a
        if len(kept):
            rows.append((block, anchors[kept].tobytes(), (total[kept] > hot).tobytes()))
    return _rows(_MARKED, rows)


def _cut_segments(table: pa.Table, marked: pa.Table, length: int, k: int, buckets: int) -> pa.Table:
    if not table.num_rows or not marked.num_rows:
        return _rows(_PIECES, [])
    table, ids = _ordered(table)
    block = table.column("block")[0].as_py()
    known = np.concatenate([np.frombuffer(x, np.uint64) for x in marked.column("anchors").to_pylist()])
    hot = np.concatenate([np.frombuffer(x, bool) for x in marked.column("hot").to_pylist()])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    segments, hashes, bodies, is_hot, windows = [], [], [], [], []
    for row, _, data, offsets in arrays.pieces(table.column("data")):
        anchors, first, n, owner = _anchors(data, offsets, length, k)
        at = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
        repeated = known[at] == anchors
        anchors, first, n, owner, at = anchors[repeated], first[repeated], n[repeated], owner[repeated], at[repeated]
        if not len(anchors):
            continue
        sums = arrays.prefix_sums(data)
        part = np.zeros(len(anchors), _SEGMENT)
        part["anchor"], part["id"], part["row"], part["pos"], part["n"] = anchors, ids[row + owner], row + owner, first - offsets[owner], n
        segments.append(part)
        hashes.append(arrays.span_hash(sums, first, first + n + length - 1))
        is_hot.append(hot[at])
        sizes = np.where(hot[at], 0, n + length - 1)
        bodies.append(data[arrays.ranges(first, sizes)])
        # windows of hot anchors, one by one
        f, m = first[hot[at]], n[hot[at]]
        each = arrays.ranges(f, m)
        whole = np.zeros(len(each), _WINDOW)
        whole["key"] = arrays.span_hash(sums, each, each + length)
        halves = arrays.span_hash(sums, each, each + length // 2), arrays.span_hash(sums, each + length // 2, each + length)
        whole["check"] = arrays.mix(halves[0] + arrays.mix(halves[1]))
        doc = np.repeat(owner[hot[at]], m)
        whole["id"], whole["row"], whole["pos"] = ids[row + doc], row + doc, each - offsets[doc]
        windows.append(whole)
    if not segments:
        return _rows(_PIECES, [])
    part, hash_, warm = np.concatenate(segments), np.concatenate(hashes), ~np.concatenate(is_hot)
    body = np.concatenate(bodies)
    part, hash_ = part[warm], hash_[warm]
    sizes = part["n"].astype(np.int64) + length - 1
    begins = np.cumsum(sizes) - sizes
    new = _firsts(hash_, part["n"], part["anchor"])
    copies = np.zeros(len(part), _RUN)
    copies["row"], copies["pos"], copies["n"] = part["row"], part["pos"], part["n"]
    whole = np.concatenate(windows)
    fresh = _firsts(whole["check"], whole["key"])
    out: dict[int, list[bytes]] = {}
    for b, at in _dealt(part["anchor"], buckets):
        mine = at[new[at]]
        text = body[arrays.ranges(begins[mine], sizes[mine])]
        out.setdefault(b, [b""] * 4)[0:2] = [part[mine].tobytes(), text.tobytes()]
        out[b][3] += copies[at[~new[at]]].tobytes()
    for b, at in _dealt(whole["key"], buckets):
        entry = out.setdefault(b, [b""] * 4)
        entry[2] = whole[at[fresh[at]]].tobytes()
        entry[3] += _as_runs(whole["row"], whole["pos"], at[~fresh[at]]).tobytes()
    return _rows(_PIECES, [(b, block, *entry) for b, entry in out.items()])


def _as_runs(row: np.ndarray, pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Single windows as runs of one."""
    out = np.zeros(len(at), _RUN)
    out["row"], out["pos"], out["n"] = row[at], pos[at], 1
    return out


def _find_repeats(table: pa.Table, length: int) -> pa.Table:
    blocks = table.column("block").to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []  # blocks, runs

    def joined(name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        return np.concatenate(parts), np.repeat(blocks, [len(p) for p in parts])

    copies, where = joined("copies", _RUN)
    found.append((where, copies))
    windows, where = joined("windows", _WINDOW)
    if len(windows):
        order = np.lexsort((windows["pos"], windows["row"], where, windows["id"]))
        windows, where = windows[order], where[order]
        again = np.flatnonzero(~_firsts(windows["check"], windows["key"]))
        found.append((where[again], _as_runs(windows["row"], windows["pos"], again)))
    segments, where = joined("segments", _SEGMENT)
    if len(segments):
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        found += _segment_repeats(segments, where, data, length)
    at, runs = np.concatenate([b for b, _ in found]), np.concatenate([r for _, r in found])
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.diff(at[order], prepend=-1))
    return _rows(
        _FOUND, [(int(at[order[a]]), runs[order[a:b]].tobytes()) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)])]
    )


def _segment_repeats(segments: np.ndarray, where: np.ndarray, data: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = segments["n"].astype(np.int64) + length - 1
    begins = np.cumsum(sizes) - sizes
    hashes = np.concatenate(
        [
            arrays.span_hash(arrays.prefix_sums(data[begins[a] : begins[b - 1] + sizes[b - 1]]), begins[a:b] - begins[a], begins[a:b] - begins[a] + sizes[a:b])
            for a, b in _batches(sizes, arrays.CHUNK)
        ]
    )
    # in order of document and position, the first of equal segments is the earliest
    order = np.lexsort((segments["pos"], segments["row"], where, segments["id"], segments["anchor"]))
    segments, where, begins, sizes, hashes = segments[order], where[order], begins[order], sizes[order], hashes[order]
    new = _firsts(hashes, segments["n"], segments["anchor"])
    copies = np.zeros(np.count_nonzero(~new), _RUN)
    for name in ("row", "pos", "n"):
        copies[name] = segments[name][~new]
    found = [(where[~new], copies)]
    segments, where, begins, sizes = segments[new], where[new], begins[new], sizes[new]
    # an anchor with one segment left has no further repeats
    _, of, times = np.unique(segments["anchor"], return_inverse=True, return_counts=True)
    several = times[of] > 1
    segments, where, begins, sizes = segments[several], where[several], begins[several], sizes[several]
    edges = np.flatnonzero(np.diff(segments["anchor"], prepend=np.uint64(0), append=np.uint64(0))) if len(segments) else np.zeros(0, np.int64)
    edges = np.unique(np.concatenate([[0], edges, [len(segments)]]))
    total = np.add.reduceat(sizes, edges[:-1]) if len(segments) else np.zeros(0, np.int64)
    for a, b in _batches(total, arrays.CHUNK):
        part = slice(edges[a], edges[b])
        found.append(_window_repeats(segments[part], where[part], data[arrays.ranges(begins[part], sizes[part])], sizes[part], length))
    return found


def _batches(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to about ``limit``."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _window_repeats(segments: np.ndarray, where: np.ndarray, text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the segments that equal an earlier one, by suffix array and common prefixes."""
    depth = -(-length // 8) * 8
    text = np.concatenate([text, np.zeros(depth, np.uint8)])
    begins = np.cumsum(sizes) - sizes
    owner = np.full(len(text), -1, np.int64)
    starts = arrays.ranges(begins, segments["n"].astype(np.int64))
    owner[starts] = np.repeat(np.arange(len(segments)), segments["n"])
    order = suffix_array(text, depth)
    order = order[owner[order] >= 0]
    same = common_prefix(text, order, depth) >= length
    tied = same.copy()
    tied[:-1] |= same[1:]
    group = np.cumsum(~same)[tied]
    at = order[tied]
    of = owner[at]
    pos = segments["pos"][of] + (at - begins[of])
    rank = np.lexsort((pos, segments["row"][of], where[of], segments["id"][of], group))
    later = rank[1:][group[rank[1:]] == group[rank[:-1]]]
    return where[of[later]], _as_runs(segments["row"][of], pos, later)


# --- removal ---------------------------------------------------------------


def _removed(data: np.ndarray, offsets: np.ndarray, runs: np.ndarray, length: int) -> np.ndarray:
    """Which bytes are covered by the windows of the runs."""
    change = np.zeros(len(data) + 1, np.int32)
    starts = offsets[runs["row"]] + runs["pos"]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + runs["n"] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _apply(table: pa.Table, found: pa.Table, length: int, names: list[str]) -> pa.Table:
    if not table.num_rows:
        return pa.table({n: pa.array([], t) for n, t in [*zip(names, [table.schema.field(n).type for n in names]), *_RESULT.items()]})
    table, _ = _ordered(table)
    data, offsets = arrays.flat(table.column("data"))
    runs = np.concatenate([np.zeros(0, _RUN), *[np.frombuffer(x, _RUN) for x in found.column("runs").to_pylist()]])
    gone = _removed(data, offsets, runs, length)
    rising = gone.copy()
    rising[1:] &= ~gone[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    rising[firsts] = gone[firsts]
    count = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(rising)])
    kept = data[~gone].tobytes()
    at = (offsets - count[offsets]).tolist()
    texts = [kept[a:b] for a, b in zip(at, at[1:])]
    made = {
        "n_bytes": np.diff(offsets),
        "n_removed": np.diff(count[offsets]),
        "n_spans": np.diff(spans[offsets]),
        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
        "kept": texts,
    }
    return pa.table({**{n: table.column(n) for n in names}, **{n: pa.array(made[n], t) for n, t in _RESULT.items()}})


_RESULT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _spans_by_block(blocks: DataFrame, length: int, k: int, hot: int, n_blocks: int) -> DataFrame:
    counts = blocks.groupBy("block").applyInArrow(lambda t: _count_anchors(t, length, k, n_blocks), _schema(_COUNTS))
    marked = counts.groupBy("bucket").applyInArrow(lambda t: _mark_repeated(t, hot), _schema(_MARKED))
    pieces = (
        blocks.groupBy("block")
        .cogroup(marked.groupBy("block"))
        .applyInArrow(lambda t, m: _cut_segments(t, m, length, k, n_blocks), _schema(_PIECES))
    )
    return pieces.groupBy("bucket").applyInArrow(lambda t: _find_repeats(t, length), _schema(_FOUND))


def _blocks(docs: DataFrame, block_bytes: int, carried: dict[str, Column]) -> tuple[DataFrame, int]:
    """``block, id, h, data`` and the carried columns, and the number of blocks."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("h"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
        *[c.alias(n) for n, c in carried.items()],
    ), n_blocks


def _finish(blocks: DataFrame, found: DataFrame, length: int, names: list[str]) -> DataFrame:
    fields = [blocks.schema[n] for n in names]
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    result = T._parse_datatype_string(", ".join(f"{n} {kinds[t]}" for n, t in _RESULT.items()))
    return (
        blocks.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(lambda t, f: _apply(t, f, length, names), T.StructType([*fields, *result.fields]))
    )


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and the remaining bytes ``kept``.

    Columns of ``docs`` that have one of these names are replaced.
    """
    names = [c for c in docs.columns if c not in _RESULT]
    columns = dict(zip(docs.columns, all_columns(docs)))
    plain = [f"c{i}" for i in range(len(names))]
    blocks, n_blocks = _blocks(docs, block_bytes, {p: columns[c] for p, c in zip(plain, names)})
    found = _spans_by_block(blocks.select("block", "id", "h", "data"), length, min(ANCHOR, length), hot, n_blocks)
    return _finish(blocks, found, length, plain).toDF(*names, *_RESULT)


def report(docs: DataFrame, length: int = 100, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    blocks, n_blocks = _blocks(docs, block_bytes, {})
    found = _spans_by_block(blocks, length, min(ANCHOR, length), hot, n_blocks)
    done = _finish(blocks, found, length, ["id"])
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
