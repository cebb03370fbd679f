"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items build one automaton over word numbers. The
words of the training texts are streamed through it; the matching length at a
word says how many words up to it stand somewhere in an item. A length of
``window`` words, or the whole of an item that is shorter, is a hit.

Only words of the benchmark can match, and only neighbours that are neighbours
in an item, so whole-array lookups first cut a text down to the runs in which a
match can lie; the automaton then reads those runs word by word.

Edge cases: null and empty texts have no words and are never hit; an item
without words is ignored; repeated items count once by ``item_id``, and an item
without an id is listed as ``null``; an empty benchmark hits nothing. Every
input row gives one row, repeated rows included, and other columns of any name
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import arrays
from tidemark.llm.rows import all_columns, quoted, with_arrow_column
from tidemark.session import cut

#: Benchmark words held by one automaton; a larger benchmark is read in several.
BLOCK_WORDS = 2_000_000


class Automaton:
    """Suffix automaton of the word hashes of items, keyed by item id."""

    def __init__(self, window: int, sequences: dict[str, list[list[int]]]):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set[str]] = [set()]
        self.whole: list[int] = [0]
        self.short_items: dict[int, set[str]] = {}
        self.numbers: dict[int, int] = {}
        self.pairs: set[int] = set()
        self.shortest = window
        self._add(sequences)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, sequences: dict[str, list[list[int]]]) -> None:
        numbered = []
        for item, texts in sequences.items():
            for hashes in texts:
                row = [self.numbers.setdefault(h, len(self.numbers)) for h in hashes]
                if row:
                    numbered.append((item, row))
                    self.shortest = min(self.shortest, len(row))
        for _, row in numbered:
            last = 0
            for c in row:
                last = self._extend(last, c)
            self.pairs.update(a << 32 | b for a, b in zip(row, row[1:]))
        for item, row in numbered:
            state = 0
            for c in row:
                state = self.next[state][c]
                p = state
                while p > 0 and item not in self.items[p]:
                    self.items[p].add(item)
                    p = self.link[p]
            if len(row) < self.window:
                self.whole[state] = len(row)
                self.short_items.setdefault(state, set()).add(item)
        self.known = np.array(sorted(self.numbers), np.uint64)
        self.number_of = np.array([self.numbers[int(h)] for h in self.known], np.int64)
        self.pair_table = np.array(sorted(self.pairs), np.int64)

    def read(self, run: list[int], first: int, hit: np.ndarray) -> set[str]:
        """Stream one run of word numbers, mark hit words from ``first`` on, return the items met."""
        state = matched = 0
        found: set[str] = set()
        for i, c in enumerate(run):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c not in self.next[state]:
                matched = 0
                continue
            state = self.next[state][c]
            matched += 1
            p = state
            if matched >= self.window:
                while self.length[self.link[p]] >= self.window:
                    p = self.link[p]
                hit[first + i + 1 - self.window : first + i + 1] = True
                found |= self.items[p]
            while p > 0:
                if self.whole[p] and self.whole[p] <= matched:
                    hit[first + i + 1 - self.whole[p] : first + i + 1] = True
                    found |= self.short_items[p]
                p = self.link[p]
        return found


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in the sorted table, and whether the value is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list[Automaton]:
    """Automata over the items, read from the benchmark a block at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")
    ).where("text is not null")
    made, held, size = [], {}, 0
    for row in items.orderBy("item", "text").toLocalIterator():
        hashes, _ = arrays.word_hashes(*_lowered([bytes(row["text"])]), arrays.ALPHANUMERIC)
        if size and size + len(hashes) > block_words:
            made.append(Automaton(window, held))
            held, size = {}, 0
        held.setdefault(row["item"], []).append(hashes.tolist())
        size += len(hashes)
    made.append(Automaton(window, held))
    return made


def _lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.flat(pa.array(texts, pa.large_binary()))
    return arrays.LOWER[data], offsets


def _runs(hashes: np.ndarray, first: np.ndarray, automaton: Automaton) -> Iterator[tuple[int, list[int]]]:
    """(first word, word numbers) of the runs of words that can hold a match."""
    at, known = _member(hashes, automaton.known)
    if not known.any():
        return
    numbers = np.where(known, automaton.number_of[at], -1)
    joined = np.zeros(len(hashes), bool)  # this word goes on from the one before
    both = np.flatnonzero(known[1:] & known[:-1])
    _, fits = _member(numbers[both] << 32 | numbers[both + 1], automaton.pair_table)
    joined[both[fits] + 1] = True
    joined[first[:-1][first[:-1] < len(hashes)]] = False
    begins = np.flatnonzero(known & ~joined)
    goes_on = np.append(joined[1:], False)
    ends = np.flatnonzero(known & ~goes_on) + 1
    long = ends - begins >= automaton.shortest
    for a, b in zip(begins[long].tolist(), ends[long].tolist()):
        yield a, numbers[a:b].tolist()


_REPORT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_list", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _reports(column: pa.Array, automaton: Automaton, before: list[dict] | None) -> Iterator[dict]:
    """One report a row: the automaton's hits, united with those of ``before``."""
    for row, stop, data, offsets in arrays.pieces(column):
        data = arrays.LOWER[data]
        starts, ends, first = arrays.words(data, offsets, arrays.ALPHANUMERIC)
        hashes = arrays.span_hash(arrays.prefix_sums(data), starts, ends)
        hit = np.zeros(len(hashes), bool)
        items: list[set[str]] = [set() for _ in range(stop - row)]
        for begin, run in _runs(hashes, first, automaton):
            found = automaton.read(run, begin, hit)
            if found:
                items[int(np.searchsorted(first, begin, "right")) - 1] |= found
        for k, found in enumerate(items):
            a, b = first[k], first[k + 1]
            if before:
                found |= set(before[row + k]["item_list"])
                for span in before[row + k]["spans"]:
                    inside = np.searchsorted(starts[a:b] - offsets[k], [span["start"], span["end"]])
                    hit[a + inside[0] : a + inside[1]] = True
            spans = []
            if hit[a:b].any():
                edges = np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))
                spans = [
                    {"start": int(starts[a + x] - offsets[k]), "end": int(ends[a + y - 1] - offsets[k])}
                    for x, y in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))
                ]
            yield {"n_words": int(b - a), "n_hit": int(hit[a:b].sum()), "item_list": sorted(found), "spans": spans}


def _with_report(docs: DataFrame, automaton: Automaton, name: str, again: bool) -> DataFrame:
    """``docs`` with the struct column ``name`` added, or, ``again``, brought up to date."""
    held = docs.sparkSession.sparkContext.broadcast(automaton)
    inputs = [F.col("text").cast("binary"), *([quoted(name)] if again else [])]

    def scan(columns: list[pa.Array]) -> pa.Array:
        before = columns[1].to_pylist() if again else None
        return pa.array(list(_reports(columns[0], held.value, before)), _REPORT)

    kind = "struct<n_words:long,n_hit:long,item_list:array<string>,spans:array<struct<start:long,end:long>>>"
    return with_arrow_column(docs, name, kind, inputs, scan)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, name: str = "contamination", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with a struct column ``name``: words, hit words, ids of the items hit, byte spans of the hit words.

    Every task gets the automaton, which holds at most ``block_words`` words. A
    larger benchmark is read in several passes, each adding its hits.
    """
    blocks = _blocks(benchmark, window, block_words)
    for k, automaton in enumerate(blocks):
        docs = _with_report(docs, automaton, name, again=k > 0)
        if k + 1 < len(blocks):
            docs = cut(docs)
    return docs


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5
) -> DataFrame:
    """``docs`` without benchmark passages, in the same columns.

    Every hit span is cut out of its text; a document goes as a whole when more
    than ``max_coverage`` of its words are hit. ``n_chars``, if there, follows
    the new text. Documents without a hit are returned as they are.
    """
    found = find_contamination(docs, benchmark, window, name="__contamination")
    c = F.col("__contamination")
    whole = F.col("text").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), c["spans"]["end"])
    starts = F.concat(c["spans"]["start"], F.array(F.octet_length("text").cast("long")))
    kept = F.transform(
        F.arrays_zip(ends.alias("a"), starts.alias("b")),
        lambda x: F.substring(whole, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"),
    )
    cleaned = found.where(c["n_hit"] <= max_coverage * c["n_words"]).withColumn(
        "text", F.when(c["n_hit"] > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(c["n_hit"] > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*all_columns(docs))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    c = F.col("contamination")
    return find_contamination(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_list"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["item_list"]).cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )
