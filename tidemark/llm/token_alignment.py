"""Tokens of one vocabulary beside those of another over the same bytes.

Every text is encoded by two public tokenizers, A (byte-level pairs) over a
space and the text and B (pieces) over the text, to which B itself adds the
space. Both token lists cover the same bytes. For each list a dictionary leads
from the byte where a token ends to the token's index; the ends that are keys of
both, in order, cut the two lists into groups; all A and B tokens of a group are
linked. Over the collection each pair of ids counts the documents that hold it
linked, and each document is told how its links stand in those counts.

A text falls apart before every space that has no space before it and no white
space after it: there A's pattern starts a new pre-token, and no piece of B
reaches across (checked when a vocabulary is opened; another kind of vocabulary
takes the whole text as one unit). So only the different units of a block of
texts are encoded and aligned, each once, and a document is a list of units.

Two passes. The first reads the texts and writes for each block of about
``BLOCK_BYTES`` its different pairs with the number of its documents that hold
them, and, packed, which document holds which how often. Counts of pairs are
summed over blocks; each block gets back the counts of its own pairs; the second
pass sums them for each document. Texts do not move; what does grows with the
different pairs of the blocks, and no pair has more rows than there are blocks.

Bounds: a task holds one block (or one text, if longer) and its pairs. Vocabulary
files are read by the driver and sent with the tasks. A group of very many
different tokens (a long run without a common end) has a link for each of its
pairs of ids, once, with its multiplicity.

Texts that are null, empty, or whose bytes a tokenizer doesn't give back have no
tokens, hence no groups and no links. Repeated rows count as documents of their
own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions.joins import group_join
from tidemark.llm.arrays import flat, pieces, ranges
from tidemark.session import cut

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

#: Text of a block; bytes that one call of a tokenizer gets.
BLOCK_BYTES, CALL_BYTES = 8 << 20, 8 << 10
#: Groups of more links than this are linked by their different ids.
WIDE = 4096

SPACE = 32
#: First bytes of a unit: visible ASCII, and characters beyond that no white space begins like.
_BEGINS = np.zeros(256, bool)
_BEGINS[33:127] = True
_BEGINS[128:] = True
_BEGINS[[0xC2, 0xE1, 0xE2, 0xE3]] = False

#: A's pattern of pre-tokens, and the bytes of texts in which any engine finds the same letters: ASCII and Latin letters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = bytes([*range(0xC0), *range(0xC3, 0xCA)])


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, and the bytes of every token."""

    def __init__(self, a_file: bytes, b_file: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(a_file), SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True
        bytes_of = _byte_level()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(bytes_of[c] for c in names[i]) if set(names.get(i, "\n")) <= set(bytes_of) else b"" for i in range(max(names) + 1)]
        parts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(parts)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        kind = json.loads(a_file)
        first = kind.get("pre_tokenizer") or {}
        by_words = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not kind.get("normalizer")
        self.splits = bool(by_words) and not any(re.search("[^▁]▁", p) for p in parts)
        self.quick = self._quick(kind["model"]) if by_words else None

    def _quick(self, model: dict):
        """The same pairs for tiktoken, three times as fast, if every pair's rank is its token's id."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        if not merges or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {t: i for i, t in enumerate(self.a_bytes[: 256 + len(merges)])}
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def encode_a(self, text: str) -> list[int]:
        if self.quick and not text.encode().translate(None, _LATIN):
            return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A of space and text and by B of the text; None where bytes differ."""
        plain = text.decode()
        a = self.encode_a(" " + plain)
        b = self.b.encode(plain)
        whole = b" " + text
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(1)
def _opened(files: tuple[bytes, bytes]) -> Tokenizers:
    return Tokenizers(*files)


@dataclass
class Units:
    """Aligned units: ids of both lists, the end of each group in either list, and where each unit begins in all three."""

    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    group_at: np.ndarray
    sound: np.ndarray

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        def ends(name: str, by: str) -> np.ndarray:
            before = np.cumsum([0, *(len(getattr(p, by)) for p in parts)])
            return np.concatenate([np.zeros(0, np.int64), *(getattr(p, name) + n for p, n in zip(parts, before))])

        def starts(name: str, by: str) -> np.ndarray:
            before = np.cumsum([0, *(len(getattr(p, by)) for p in parts)])
            return np.concatenate([*(getattr(p, name)[:-1] + n for p, n in zip(parts, before)), before[-1:]]).astype(np.int64)

        def all_of(name: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(getattr(p, name) for p in parts)])

        return Units(
            all_of("a"), all_of("b"), ends("a_cut", "a"), ends("b_cut", "b"), starts("a_at", "a"), starts("b_at", "b"), starts("group_at", "a_cut"), all_of("sound").astype(bool)
        )


def _aligned(tokenizers: Tokenizers, units: list[bytes]) -> list[Units]:
    """The units as one text; each by itself if that fails, without tokens if it fails alone."""
    found = tokenizers.encode(b" ".join(units))
    unit_ends = np.cumsum([len(u) + 1 for u in units])
    if found is not None:
        a, b = found
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
        # dictionaries from end to index: the keys are places in the text, so an array holds them
        a_index, b_index = np.zeros(unit_ends[-1] + 1, np.int64), np.zeros(unit_ends[-1] + 1, np.int64)
        a_index[a_ends], b_index[b_ends] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        common = np.flatnonzero((a_index > 0) & (b_index > 0))
        group_at = np.searchsorted(common, unit_ends)
        if (common[np.minimum(group_at, len(common) - 1)] == unit_ends).all():
            a_cut, b_cut = a_index[common], b_index[common]
            at = np.concatenate([[0], group_at + 1])
            return [Units(a, b, a_cut, b_cut, np.append(0, a_cut)[at], np.append(0, b_cut)[at], at, np.ones(len(units), bool))]
    if len(units) > 1:
        return [part for u in units for part in _aligned(tokenizers, [u])]
    none, zero = np.zeros(0, np.int64), np.zeros(2, np.int64)
    return [Units(none, none, none, none, zero, zero, zero, np.zeros(1, bool))]


def align(tokenizers: Tokenizers, units: list[bytes]) -> Units:
    """All units, many in one call of the tokenizers where they can stand beside each other."""
    parts, call, size = [], [], 0
    for unit in units:
        alone = not _BEGINS[unit[0]] or unit[-1] == SPACE or not tokenizers.splits
        if call and (alone or size + len(unit) > CALL_BYTES):
            parts += _aligned(tokenizers, call)
            call, size = [], 0
        call.append(unit)
        size += len(unit) + 1
        if alone:
            parts += _aligned(tokenizers, call)
            call, size = [], 0
    if call:
        parts += _aligned(tokenizers, call)
    return Units.joined(parts)


def _spans(data: np.ndarray, offsets: np.ndarray, splits: bool) -> tuple[np.ndarray, ...]:
    """Starts and ends of the units, the first unit of each row, and the spaces between units."""
    inner = np.zeros(0, np.int64)
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full]
    if splits and len(data) > 2:
        inner = np.flatnonzero((data[1:-1] == SPACE) & (data[:-2] != SPACE) & _BEGINS[data[2:]]) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[begin] = True
        inner = inner[~edge[inner] & ~edge[inner + 1]]
        begin, end = np.sort(np.concatenate([begin, inner + 1])), np.sort(np.concatenate([inner, end]))
    return begin, end, np.searchsorted(begin, offsets), inner


@dataclass
class Block:
    """Texts as lists of aligned units: ``unit[first[i]:first[i + 1]]`` are those of text ``i``."""

    units: Units
    unit: np.ndarray
    first: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[self.unit])])
        return total[self.first[1:]] - total[self.first[:-1]]


def read_block(tokenizers: Tokenizers, texts: pa.Array) -> Block:
    """Split the texts into units and align the different ones.

    A text of which a unit does not come back byte by byte is taken whole; if it
    does not come back either it has no tokens.
    """
    data, offsets = flat(texts)
    begin, end, first, between = _spans(data, offsets, tokenizers.splits)
    at = np.concatenate([[0], np.cumsum(end - begin)])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.delete(data, between))])
    coded = spans.dictionary_encode()
    names = coded.dictionary.to_pylist()
    unit = coded.indices.to_numpy().astype(np.int64)
    units = align(tokenizers, names)
    bad = np.flatnonzero(np.add.reduceat(np.append(~units.sound[unit], False).astype(np.int64), np.minimum(first[:-1], len(unit))) * (np.diff(first) > 0)) if len(unit) else []
    if not len(bad):
        return Block(units, unit, first)
    whole = Units.joined([part for row in bad for part in _aligned(tokenizers, [data[offsets[row] : offsets[row + 1]].tobytes()])])
    taken = np.split(unit, first[1:-1])
    for k, row in enumerate(bad):
        taken[row] = np.array([len(names) + k] if whole.sound[k] else [], np.int64)
    return Block(Units.joined([units, whole]), np.concatenate(taken), np.concatenate([[0], np.cumsum(list(map(len, taken)))]))


def unit_texts(units: Units) -> pa.Array:
    """``a1,a2|b1;`` for each unit: the decimal ids of its groups, each group closed by a semicolon."""
    n_groups = len(units.a_cut)
    groups = np.arange(n_groups)
    a_group, b_group = np.repeat(groups, np.diff(units.a_cut, prepend=0)), np.repeat(groups, np.diff(units.b_cut, prepend=0))
    codes = np.empty(len(units.a) + len(units.b), np.int64)
    a_before, b_before = np.append(0, units.a_cut[:-1]), np.append(0, units.b_cut[:-1])
    a_last, b_last = np.zeros(len(units.a), np.int64), np.zeros(len(units.b), np.int64)
    a_last[units.a_cut - 1], b_last[units.b_cut - 1] = 1, 2
    if n_groups:
        codes[np.arange(len(units.a)) + b_before[a_group]] = 3 * units.a + a_last
        codes[np.arange(len(units.b)) + units.a_cut[b_group]] = 3 * units.b + b_last
    most = int(max(units.a.max(initial=0), units.b.max(initial=0))) + 1
    signs = pa.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], pa.large_string())
    # the taken signs lie one after the other: a unit's text is a stretch of their bytes
    _, offsets, data = signs.take(pa.array(codes)).buffers()
    at = np.frombuffer(offsets, np.int64)[units.a_at + units.b_at] if len(codes) else np.zeros(len(units.a_at), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), data])


def unit_links(units: Units, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, multiplicity, first link of each unit): the different pairs ``a * n_b + b`` of each unit, sorted."""
    n_units = len(units.sound)
    a_sizes, b_sizes = np.diff(units.a_cut, prepend=0), np.diff(units.b_cut, prepend=0)
    unit_of = np.repeat(np.arange(n_units), np.diff(units.group_at))
    a_from, b_from = units.a_cut - a_sizes, units.b_cut - b_sizes
    wide = np.flatnonzero(a_sizes * b_sizes > WIDE)
    plain = a_sizes * b_sizes <= WIDE
    times = (a_sizes * b_sizes)[plain]
    within = ranges(np.zeros(len(times), np.int64), times)
    width = np.repeat(b_sizes[plain], times)
    pairs = [units.a[np.repeat(a_from[plain], times) + within // np.maximum(width, 1)] * n_b + units.b[np.repeat(b_from[plain], times) + within % np.maximum(width, 1)]]
    of, often = [np.repeat(unit_of[plain], times)], [np.ones(len(within), np.int64)]
    for g in wide:
        a, a_often = np.unique(units.a[a_from[g] : units.a_cut[g]], return_counts=True)
        b, b_often = np.unique(units.b[b_from[g] : units.b_cut[g]], return_counts=True)
        pairs.append((a[:, None] * n_b + b).ravel())
        often.append((a_often[:, None] * b_often).ravel())
        of.append(np.full(len(pairs[-1]), unit_of[g]))
    pair, of, often = map(np.concatenate, (pairs, of, often))
    order = np.lexsort((pair, of))
    pair, of, often = pair[order], of[order], often[order]
    begins = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))[: len(pair)])
    often = np.add.reduceat(often, begins) if len(begins) else often
    return pair[begins], often, np.searchsorted(of[begins], np.arange(n_units + 1))


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[begins], (np.add.reduceat(values[order], begins) if len(begins) else values)


def _few(first: np.ndarray, at_once: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``at_once`` units."""
    row = 0
    while row < len(first) - 1:
        stop = max(row + 1, int(np.searchsorted(first, first[row] + at_once, "right")) - 1)
        yield row, stop
        row = stop


def _text_links(block: Block, link: np.ndarray, often: np.ndarray, link_at: np.ndarray, n_links: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each text, link number, multiplicity) in order of text and link, a few texts at a time."""
    n_units, counts, links, times = len(link_at) - 1, np.zeros(len(block.first) - 1, np.int64), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for row, stop in _few(block.first):
        unit = block.unit[block.first[row] : block.first[stop]]
        of = np.repeat(np.arange(stop - row), np.diff(block.first[row : stop + 1]))
        key, n = _summed(of * n_units + unit, np.ones(len(unit), np.int64))
        unit, of = key % n_units, key // n_units
        sizes = link_at[unit + 1] - link_at[unit]
        at = ranges(link_at[unit], sizes)
        key, n = _summed(np.repeat(of, sizes) * n_links + link[at], np.repeat(n, sizes) * often[at])
        counts[row:stop] = np.bincount(key // n_links, minlength=stop - row)
        links.append((key % n_links).astype(np.int32))
        times.append(n.astype(np.int32) if n.max(initial=0) < 1 << 31 else n)
    return counts, np.concatenate(links), np.concatenate(times[1:] or times)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte planes apart, compressed."""
    width = 8 if numbers.max(initial=0) >> 32 else 4
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(numbers) else b""


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    width = packed[0]
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[1:], n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _digests(block: Block) -> list[str]:
    """The hash of each text's groups, ``''`` for texts without tokens; a few texts at a time."""
    texts, sizes, out = unit_texts(block.units), np.diff(block.first), []
    for row, stop in _few(block.first):
        at = block.first[row : stop + 1]
        _, offsets, data = texts.take(pa.array(block.unit[at[0] : at[-1]])).buffers()
        offsets = np.frombuffer(offsets, np.int64)[at - at[0]].tolist() if at[-1] > at[0] else [0] * len(at)
        plain = memoryview(data) if data is not None else memoryview(b"")
        out += [hashlib.sha256(plain[a : b - 1]).hexdigest() if n else "" for a, b, n in zip(offsets, offsets[1:], sizes[row:stop].tolist())]
    return out


def _block_row(number: int, ids: pa.Array, texts: pa.Array, tokenizers: Tokenizers) -> pa.RecordBatch:
    block = read_block(tokenizers, texts)
    units = block.units
    pair, often, link_at = unit_links(units, len(tokenizers.b_bytes))
    different, link = np.unique(pair, return_inverse=True)
    n_pairs, link, times = _text_links(block, link, often, link_at, max(len(different), 1))
    held = np.bincount(link, minlength=len(different))
    # frequent pairs first, so that the gaps between a text's pairs are small
    order = np.argsort(-held, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    at, text_at = place[link], np.concatenate([[0], np.cumsum(n_pairs)])
    for row, stop in _few(text_at):
        part = slice(text_at[row], text_at[stop])
        sorted_ = np.argsort(np.repeat(np.arange(stop - row), n_pairs[row:stop]) * len(place) + at[part], kind="stable")
        at[part], times[part] = at[part][sorted_], times[part][sorted_]
    gaps = np.diff(at, prepend=np.int32(0))
    starts = text_at[:-1][n_pairs > 0]
    gaps[starts] = at[starts]
    a_sizes, b_sizes = np.diff(units.a_cut, prepend=0), np.diff(units.b_cut, prepend=0)
    per_unit = np.concatenate([[0], np.cumsum(a_sizes * b_sizes)])[units.group_at]
    sums = [block.per_text(np.diff(x)) for x in (units.a_at, units.b_at, units.group_at, per_unit)]
    listed = [ids, *map(pa.array, sums), pa.array(_digests(block), pa.string()), pa.array(n_pairs), pa.array(different[order]), pa.array(held[order])]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in listed]
    columns += [pa.array([x], pa.binary()) for x in (_pack(gaps), _pack(times))]
    return pa.RecordBatch.from_arrays([pa.array([number]), *columns], names=["block", "doc_id", *_FIGURES, "digest", "n_pairs", "pairs", "held", "gaps", "times"])


def _blocked(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for row, stop, data, _ in pieces(batch.column(1), limit):
            if held and size + len(data) > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch.slice(row, stop - row))
            size += len(data)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _files(a_file: str, b_file: str) -> tuple[bytes, bytes]:
    def read(path: str) -> bytes:
        with open(path, "rb") as file:
            return file.read()

    return read(a_file), read(b_file)


def _blocks(docs: DataFrame, files: tuple[bytes, bytes], block_bytes: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files of a few megabytes
    kind = docs.schema["doc_id"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("doc_id", T.ArrayType(kind)),
            *[T.StructField(name, longs) for name in _FIGURES],
            T.StructField("digest", T.ArrayType(T.StringType())),
            T.StructField("n_pairs", longs),
            T.StructField("pairs", longs),
            T.StructField("held", longs),
            T.StructField("gaps", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _opened(sent.value)
        task = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(_blocked(batches, block_bytes)):
            yield _block_row(task + k, rows.column(0), rows.column(1), tokenizers)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, best) over the collection; a vocabulary bounds how many pairs share an A id."""
    tall = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = tall.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.expr(f"pair div {n_b}")))
    return counts.withColumn("best", F.col("n_docs") == most)


def _weighed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to one row a document."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            n_pairs = one["n_pairs"].values.to_numpy()
            total = int(n_pairs.sum())
            gaps, times = (_unpack(one[c].as_py(), total) for c in ("gaps", "times"))
            ends = np.cumsum(n_pairs)
            run = np.cumsum(gaps)
            at = run - np.repeat(np.append(0, run)[ends - n_pairs], n_pairs)
            counts, best = (one[c].values.to_numpy(zero_copy_only=False) if one[c].is_valid else np.zeros(0, np.int64) for c in ("counts", "best"))

            def summed(values: np.ndarray) -> np.ndarray:
                whole = np.concatenate([[0], np.cumsum(values)])
                return whole[ends] - whole[ends - n_pairs]

            columns = [one["doc_id"].values, *(one[c].values for c in _FIGURES)]
            columns += [pa.array(summed(times * best[at])), pa.array(summed(times * counts[at])), one["digest"].values]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def report(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: tokens of both, groups, links, links that are best for their A id, sum of the links' counts, hash of the groups."""
    files = _files(a_file, b_file)
    n_b = len(_opened(files).b_bytes)
    blocks = cut(_blocks(docs, files, block_bytes))
    counts = cut(_pair_counts(blocks, n_b))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n_docs", "best"))).alias("x"))
    told = answers.select("block", F.col("x.n_docs").alias("counts"), F.transform("x.best", lambda b: b.cast("int")).alias("best"))
    names = ["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"]
    kinds = [docs.schema["doc_id"].dataType, *[T.LongType()] * 6, T.StringType()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds)])
    return group_join(blocks.drop("pairs", "held"), told, "block").mapInArrow(lambda batches: _weighed(batches, names), schema)


def links(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The translation table of the vocabularies: a_id, b_id, n_docs that hold the two linked, and whether no other b_id has more."""
    files = _files(a_file, b_file)
    n_b = len(_opened(files).b_bytes)
    found = _pair_counts(cut(_blocks(docs, files, block_bytes).select("pairs", "held")), n_b)
    return found.select(F.expr(f"pair div {n_b}").alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "n_docs", "best")


def groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): both encodings, and how many tokens of each lie before the end of every group."""
    sent = docs.sparkSession.sparkContext.broadcast(_files(a_file, b_file))
    names = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.ArrayType(T.LongType())) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _opened(sent.value)
        for batch in batches:
            for row, stop, _, _ in pieces(batch.column(1)):
                block = read_block(tokenizers, batch.column(1).slice(row, stop - row))
                u, unit = block.units, block.unit
                out = [batch.column(0).slice(row, stop - row)]
                for at, values in ((u.a_at, u.a), (u.b_at, u.b), (u.group_at, np.diff(u.a_cut, prepend=0)), (u.group_at, np.diff(u.b_cut, prepend=0))):
                    sizes = at[unit + 1] - at[unit]
                    picked = values[ranges(at[unit], sizes)]
                    before = np.concatenate([[0], np.cumsum(sizes)])[block.first]
                    if at is u.group_at:
                        total = np.concatenate([[0], np.cumsum(picked)])
                        picked = total[1:] - np.repeat(total[before[:-1]], np.diff(before))
                    out.append(pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(picked)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
