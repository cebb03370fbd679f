"""Stupid-backoff scores of every document under the n-gram counts of the collection.

The score of a word after its history is the relative frequency of the longest
n-gram that the collection has seen elsewhere, times ``alpha`` for each order
given up:

    S(w | h) = c(h w) / c(h)  if c(h w) > 0, else alpha * S(w | shorter h),
    S(w)     = c(w) / N, and alpha * 1 / N for a word seen nowhere else.

A document's own n-grams do not count for it: every count is that of the
collection less that of the document.

The counts are relations. Documents are gathered into blocks by hash; a block's
distinct n-grams, with their counts, go to the count table's part for their hash,
where the counts of all blocks are summed; every block gets the totals of its own
n-grams back, in the order in which it sent them, and sums the logarithms of its
documents. Only n-grams of the block travel, once each way, and each part is
bounded by the n-grams that hash there: a frequent n-gram arrives once a block.
Parts are ranges of hashes, so sorted hashes travel as the gaps between them,
which takes about six bytes instead of eight, and counts as a byte each; texts
travel compressed, those of a task and a block together.

Words are runs of letters and digits (ASCII lower-cased, all characters beyond
ASCII count as letters). N-grams are told apart by 64-bit hashes.

Edge cases: null and empty texts and texts without words have no tokens and a
null score; in a collection of one document every word is unseen and ``N`` is
held to 1; repeated rows are documents of their own, so they know each other;
rows without ``doc_id`` are scored like others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import arrays
from tidemark.session import cut

#: Longest n-grams counted.
ORDER = 3

ALPHA = 0.4

#: Bytes of text in a block, as far as single texts allow.
BLOCK_BYTES = 12 << 20


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents of a block, and the first word of each."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in arrays.pieces(table.column("text")):
        found, first = arrays.word_hashes(arrays.LOWER[data], offsets, arrays.ALPHANUMERIC)
        hashes.append(found)
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a batch by block, compressed."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1))
        packed = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            part = batch.select([1, 2, 3]).take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[order[edges]]), pa.array(packed, pa.binary())], names=["block", "docs"])


def _texts(table: pa.Table) -> pa.Table:
    """The documents of a block in an order that repeats."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("docs")]
    return pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("h", "ascending")])


def _part_starts(parts: int) -> np.ndarray:
    """The least hash of each part of the count table; parts are ranges of hashes."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)


def _slices(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, last + 1) of the sorted hashes in each part that has any."""
    edges = [*np.searchsorted(hashes, _part_starts(parts)).tolist(), len(hashes)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def pack_gaps(hashes: np.ndarray, start: int) -> tuple[bytes, bytes, int]:
    """Sorted hashes as their gaps, in as few bytes each as nearly all need; wider gaps are listed apart."""
    gaps = np.diff(hashes, prepend=np.uint64(start))
    need = int(np.quantile(gaps, 0.999)).bit_length() if len(gaps) else 1
    width = min(8, max(1, -(-need // 8)))
    wide = np.flatnonzero(gaps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    low = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :width]
    return low.tobytes(), np.stack([wide.astype(np.uint64), gaps[wide]], 1).tobytes(), width


def unpack_gaps(low: bytes, wide: bytes, width: int, start: int) -> np.ndarray:
    gaps = np.zeros((len(low) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    gaps = gaps.reshape(-1).view(np.uint64)
    listed = np.frombuffer(wide, np.uint64).reshape(-1, 2)
    gaps[listed[:, 0].astype(np.int64)] = listed[:, 1]
    if len(gaps):
        gaps[0] += np.uint64(start)
    return np.cumsum(gaps)


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each; those from 255 on are listed apart."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([large, counts[large]], 1).astype(np.int64).tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    listed = np.frombuffer(large, np.int64).reshape(-1, 2)
    counts[listed[:, 0]] = listed[:, 1]
    return counts


_SENT = "part long, block long, n long, width long, gaps binary, wide binary, counts binary, large binary"
_TOTALS = "block long, part long, n long, counts binary, large binary"


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in kind.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _count(table: pa.Table, order: int, parts: int) -> pa.Table:
    """The distinct n-grams of a block and how often it has each, for every order and part."""
    words, first = _words(_texts(table))
    block, starts = table.column("block")[0].as_py(), _part_starts(parts)
    rows = []
    for n in range(1, order + 1):
        hashes, counts = np.unique(arrays.grams(words, first, n)[0], return_counts=True)
        for part, a, b in _slices(hashes, parts):
            gaps, wide, width = pack_gaps(hashes[a:b], int(starts[part]))
            rows.append((part, block, n, width, gaps, wide, *pack_counts(counts[a:b])))
    return _table(_SENT, rows)


def _total(table: pa.Table, parts: int) -> pa.Table:
    """Totals over all blocks, for each block in the order it sent its n-grams."""
    rows = table.to_pylist()
    start = int(_part_starts(parts)[rows[0]["part"]])
    lists = [unpack_gaps(r["gaps"], r["wide"], r["width"], start) for r in rows]
    counts = np.concatenate([unpack_counts(r["counts"], r["large"]) for r in rows])
    _, at = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(at, counts)[at].astype(np.int64)
    ends = np.cumsum([len(x) for x in lists])
    return _table(_TOTALS, [(r["block"], r["part"], r["n"], *pack_counts(totals[a:b])) for r, a, b in zip(rows, [0, *ends[:-1]], ends)])


def _elsewhere(grams: np.ndarray, row: np.ndarray, totals: dict[int, np.ndarray]) -> np.ndarray:
    """How often each n-gram stands in other documents, from the totals of the block's parts."""
    if not len(grams):
        return np.zeros(0, np.int64)
    known = np.concatenate([totals[p] for p in sorted(totals)])
    order = np.argsort(grams, kind="stable")  # equal n-grams stay in the order of their documents
    new = np.ones(len(order), bool)
    grams = grams[order]
    new[1:] = grams[1:] != grams[:-1]
    del grams
    total = known[np.cumsum(new, dtype=np.int32) - 1]
    row = row[order]
    new[1:] |= row[1:] != row[:-1]
    own = np.diff(np.flatnonzero(new), append=len(order))
    total -= np.repeat(own, own)
    out = np.empty(len(order), np.int64)
    out[order] = total
    return out


def _score(table: pa.Table, totals: pa.Table, order: int, alpha: float) -> pa.Table:
    if not table.num_rows:
        return _SCORED.empty_table()
    table = _texts(table)
    words, first = _words(table)
    n_tokens = np.diff(first)
    row = np.repeat(np.arange(len(n_tokens), dtype=np.int32), n_tokens)
    place = (np.arange(len(row)) - first[row]).astype(np.int32)
    sent: dict[int, dict[int, np.ndarray]] = {}
    for r in totals.to_pylist():
        sent.setdefault(r["n"], {})[r["part"]] = unpack_counts(r["counts"], r["large"])
    score, steps, alone = np.zeros(len(row)), np.zeros(len(row), np.int16), np.zeros(len(row), bool)
    shorter, shorter_first = None, None
    for n in range(1, order + 1):
        grams, at = arrays.grams(words, first, n)
        gram_row = np.repeat(np.arange(len(n_tokens), dtype=np.int32), np.diff(at))
        seen = _elsewhere(grams, gram_row, sent.pop(n, {}))
        del grams, gram_row
        if n == 1:
            score = np.log(np.maximum(seen, 1)) + np.where(seen > 0, 0.0, np.log(alpha))
            steps = (seen == 0).astype(np.int16)
            alone = np.ones(len(row), bool)  # scored as one word, still to be divided by all words
        else:
            # the n-gram that ends at a word, and the shorter one that is its history
            has = np.flatnonzero(place >= n - 1)
            found = seen[at[row[has]] + place[has] - (n - 1)]
            history = shorter[shorter_first[row[has]] + place[has] - (n - 1)]
            score[has] = np.where(found > 0, np.log(np.maximum(found, 1) / np.maximum(history, 1)), np.log(alpha) + score[has])
            steps[has] = np.where(found > 0, 0, steps[has] + 1)
            alone[has] &= found == 0
        shorter, shorter_first = seen, at
    documents = len(n_tokens)
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "log_sum": pa.array(np.bincount(row, score, documents), pa.float64()),
            "n_alone": pa.array(np.bincount(row, alone, documents).astype(np.int64)),
            "n_backoffs": pa.array(np.bincount(row, steps, documents).astype(np.int64)),
        },
        schema=_SCORED,
    )


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_sum", pa.float64()), ("n_alone", pa.int64()), ("n_backoffs", pa.int64())])


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, log_score, n_backoffs``: each document's sum of log scores, and the orders given up in all.

    Divide ``log_score`` by ``n_tokens`` for a score per word.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    parts = 2 * n_blocks
    blocks = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("h"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(_pack_texts, "block long, docs binary")
    counts = blocks.groupBy("block").applyInArrow(lambda t: _count(t, order, parts), _SENT)
    totals = counts.groupBy("part").applyInArrow(lambda t: _total(t, parts), _TOTALS)
    scored = cut(
        blocks.groupBy("block")
        .cogroup(totals.groupBy("block"))
        .applyInArrow(
            lambda t, c: _score(t, c, order, alpha), "doc_id long, n_tokens long, log_sum double, n_alone long, n_backoffs long"
        )
    )
    # words scored alone are relative to all words of the other documents
    tokens = scored.agg(F.sum("n_tokens")).first()[0] or 0
    others = F.greatest(F.lit(tokens) - F.col("n_tokens"), F.lit(1))
    return scored.select(
        "doc_id",
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.col("log_sum") - F.col("n_alone") * F.ln(others)).alias("log_score"),
        "n_backoffs",
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, log_score, n_backoffs, mean_log_score``; scores to 4 places."""
    return score(docs).select(
        "doc_id",
        "n_tokens",
        F.round("log_score", 4).alias("log_score"),
        "n_backoffs",
        F.round(F.col("log_score") / F.nullif("n_tokens", F.lit(0)), 4).alias("mean_log_score"),
    )
