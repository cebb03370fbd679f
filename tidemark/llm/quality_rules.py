"""Quality rules by isolation forests over statistics of documents.

Every document gets a row of rule statistics, counted over its whole text. An
isolation forest learns which rows are unusual: its trees split random
statistics at random values, and a row that few splits set apart is an anomaly.
There is one forest over all statistics and one over each alone, since what is
unusual in one (a repeated notice) may be harmless and in another (words full
of symbols) junk. Labelled documents say which of them decide and from which
score on: step by step the forest and the cut that catch the most bad rows join
the verdict, a good row counting against them as ``LOSS`` bad ones.

The texts are read once and never move; what is written between the passes is
one row of numbers a document. Trees are grown on the driver from about
``SAMPLE_ROWS`` rows, those of least hash, never more: the sample repeats and does not
grow with the input. Scoring and calibration cover all rows: labelled rows are
counted by score in ``BINS`` classes on the cluster.

A word is a run of characters other than space and the controls 9 to 13. Null
and empty texts have no words and fail the base rules. Repeated rows count as
often as they are there. A document with several labels is bad if one of them
says so; labels that are neither 0 nor 1 and labels of no document are left out.
Without labelled rows of both classes the forest over all statistics decides, at
``DEFAULT_CUT``. Without rows that pass the base rules there is no forest and
nothing is kept. Other columns pass through :func:`keep` whatever their names
are; :func:`report` does not read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import NOT_SPACE, pieces, ranges, words
from tidemark.llm.rows import all_columns, with_arrow_column
from tidemark.session import cut

#: Words of a window that must not come again.
WINDOW = 8
#: Base rules: least words, and the percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rows the forests may learn from, trees of a forest, and rows of a tree.
SAMPLE_ROWS, TREES, TREE_ROWS, SEED = 16_384, 64, 256, 12
#: Classes of scores in calibration, and the cut where no labels say another.
BINS, DEFAULT_CUT = 2_048, 0.65
#: Bad rows that must be caught for each good row lost, and at least.
LOSS, LEAST_CAUGHT = 10, 3

_NOT_NEWLINE = np.arange(256) != 10
_LEADING = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True

#: What :func:`counts` counts, in this order.
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_shouts", "n_echoes",
]


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes only."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    packed = np.ascontiguousarray(data[ranges(starts, ends - starts)])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the words inside windows that the row holds twice or more.

    Windows are named by doubling: names of two halves make the name of both,
    so equal names are equal words, without a hash.
    """
    n_rows = len(first) - 1
    windows = np.maximum(np.diff(first) - (WINDOW - 1), 0)
    at = ranges(first[:-1], windows)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    name, span = names, 1
    while span < WINDOW:
        name, _ = pd.factorize(name[:-span] * len(names) + name[span:])
        span *= 2
    row = np.repeat(np.arange(n_rows), windows)
    found, _ = pd.factorize(row * len(names) + name[at])
    again = at[np.bincount(found)[found] > 1]
    edges = np.bincount(again, minlength=len(names) + 1) - np.bincount(again + WINDOW, minlength=len(names) + 1)[: len(names) + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of ``COUNTS`` for each row, one line a row."""
    n_rows = len(offsets) - 1
    starts, ends, first = words(data, offsets, NOT_SPACE)

    def within(mask: np.ndarray, edges: np.ndarray = offsets) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])[edges]
        return total[1:] - total[:-1]

    names = _names(data, starts, ends)
    of = np.repeat(np.arange(n_rows), np.diff(first))
    echo = np.concatenate([[False], (names[1:] == names[:-1]) & (of[1:] == of[:-1])])[: len(names)]
    solid = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    from_, to, line = words(data, offsets, _NOT_NEWLINE)
    with_word = solid[to] > solid[from_]
    line_of = np.repeat(np.arange(n_rows), np.diff(line))[with_word]
    lines = np.bincount(line_of, minlength=n_rows)
    line_names = _names(data, from_[with_word], to[with_word])
    different = pd.unique(line_of * (len(line_names) + 1) + line_names) // (len(line_names) + 1)
    return np.stack(
        [
            np.diff(first),
            within(NOT_SPACE[data] & _LEADING[data]),
            within(SYMBOLS[data]),
            lines - np.bincount(different, minlength=n_rows),
            _repeated(names, first),
            lines,
            within(_UPPER[data]),
            within(_LETTER[data] & _LEADING[data]),
            within(_SHOUT[data]),
            within(echo, first),
        ],
        axis=1,
    )


#: Statistics the forest sees: each a rate, so that length alone is not unusual.
RATES = ["word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "shouts", "echoes"]


def rates(count: np.ndarray) -> np.ndarray:
    """The statistics of ``RATES``, one line a row; parts of nothing are 0."""
    c = {name: count[:, k].astype(float) for k, name in enumerate(COUNTS)}

    def share(part: str, whole: str) -> np.ndarray:
        return c[part] / np.maximum(c[whole], 1)

    return np.stack(
        [
            share("word_chars", "n_words"),
            share("n_symbols", "n_words"),
            share("n_dup_lines", "n_lines"),
            share("n_repeat_words", "n_words"),
            share("n_upper", "n_letters"),
            share("n_shouts", "n_words"),
            share("n_echoes", "n_words"),
        ],
        axis=1,
    )


def _usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of ``n`` rows: what a leaf of ``n`` rows still stands for."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as complete binary trees in arrays: children of ``k`` are ``2k + 1`` and ``2k + 2``; a leaf hands its path down."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    usual: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits set apart, under 0.5 for the usual ones."""
        total = np.zeros(len(rows))
        levels = int(np.log2(self.feature.shape[1] + 1)) - 1
        every = np.arange(len(rows))
        for feature, value, path in zip(self.feature, self.value, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(levels):
                node = 2 * node + 1 + (rows[every, feature[node]] > value[node])
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.usual)


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """An isolation forest over ``rows``: each tree splits a random part of them by random features at random values."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    levels = max(1, int(np.ceil(np.log2(max(size, 2)))))
    n_nodes = 2 ** (levels + 1) - 1
    feature = np.zeros((trees, n_nodes), np.int64)
    value = np.full((trees, n_nodes), np.inf)
    path = np.zeros((trees, n_nodes))
    for t in range(trees):
        held = {0: rows[rng.choice(len(rows), size, replace=False)]}
        for node in range(n_nodes):
            depth = int(np.log2(node + 1))
            part = held.pop(node, None)
            if part is None:  # below a leaf
                path[t, node] = path[t, (node - 1) // 2]
                continue
            path[t, node] = depth + _usual_path(len(part))
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if depth == levels or not len(open_):
                continue
            k = rng.choice(open_)
            split = rng.uniform(low[k], high[k])
            feature[t, node], value[t, node] = k, split
            right = part[:, k] > split
            held[2 * node + 1], held[2 * node + 2] = part[~right], part[right]
    return Forest(feature, value, path, float(max(_usual_path(size), 1.0)))


@dataclass(frozen=True)
class Rules:
    """A forest over all statistics, one over each, and the class of scores from which each rejects (``BINS`` + 1: never)."""

    forests: tuple[Forest, ...] = ()
    cuts: tuple[int, ...] = ()

    def classes(self, count: np.ndarray) -> np.ndarray:
        """The class of each row's score in every forest, one line a row."""
        found = rates(count)
        views = [found, *(found[:, [k]] for k in range(found.shape[1]))]
        scores = [forest.score(view) for forest, view in zip(self.forests, views)]
        return np.minimum(np.stack(scores, axis=1) * BINS, BINS - 1).astype(np.int64) if scores else np.zeros((len(count), 0), np.int64)

    def verdict(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: whether the base rules fail, the class of its score over all, and which forest rejects it (-1: none)."""
        failed = fails_base(count)
        classes = self.classes(count)
        rejected = classes >= np.array(self.cuts, np.int64)
        which = np.where(rejected.any(axis=1), rejected.argmax(axis=1), -1) if len(self.cuts) else np.full(len(count), -1)
        return failed, classes[:, 0] if len(self.cuts) else np.zeros(len(count), np.int64), which


def fails_base(count: np.ndarray) -> np.ndarray:
    return (count[:, 0] < LEAST_WORDS) | (100 * count[:, 4] > MOST_REPEATED * count[:, 0])


def _counted(texts: pa.Array) -> pa.Array:
    found = [counts(data, offsets) for _, _, data, offsets in pieces(texts)]
    return _lists(np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64))


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _matrix(column: pa.Array, width: int = len(COUNTS)) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, count): the counts of ``COUNTS`` for every document."""
    return with_arrow_column(docs.select("doc_id", "text"), "text", "array<long>", [F.col("text")], lambda x: _counted(x[0])).withColumnRenamed("text", "count")


def _sample(measured: DataFrame, rows: int) -> np.ndarray:
    """About ``rows`` rows of least hash, never more: first by a bound on the hash, so that few rows meet."""
    passing = measured.where((F.col("count")[0] >= LEAST_WORDS) & (100 * F.col("count")[4] <= MOST_REPEATED * F.col("count")[0]))
    there = passing.count()
    key = F.xxhash64("doc_id", "count")
    bound = -(2**63) + int(2**64 * min(1.0, 1.1 * rows / max(there, 1))) - 1
    keyed = passing.select(key.alias("key"), "count")
    found = keyed.where(F.col("key") <= bound).orderBy("key").limit(rows).collect()
    if there and not found:  # nearly all rows are the same one
        found = keyed.dropDuplicates(["key"]).orderBy("key").limit(rows).collect()
    return np.array([r["count"] for r in found], np.int64).reshape(-1, len(COUNTS))


def _best_cut(bad: np.ndarray, good: np.ndarray) -> tuple[int, int]:
    """(worth, class): where bad rows caught less ``LOSS`` times good rows lost is most; the middle of equal places."""
    def above(n: np.ndarray) -> np.ndarray:
        return np.append(np.cumsum(n[::-1])[::-1], 0)

    worth = above(bad) - LOSS * above(good)
    best = int(np.argmax(worth))
    last = best
    while last + 1 < len(worth) - 1 and worth[last + 1] == worth[best]:
        last += 1
    return int(worth[best]), (best + last + 1) // 2


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Grow the forests on a sample of the measured rows that pass the base rules; calibrate them on all labelled rows."""
    sample = _sample(measured, sample_rows)
    if not len(sample):
        return Rules()
    seen = rates(sample)
    views = [seen, *(seen[:, [k]] for k in range(seen.shape[1]))]
    rules = Rules(tuple(grow(view, seed=SEED + k) for k, view in enumerate(views)), (BINS + 1,) * len(views))

    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = measured.join(known, "doc_id").select("quality", "count")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = _matrix(batch.column(1))
            passing = ~fails_base(count)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(passing)), _lists(rules.classes(count[passing]))], names=["quality", "classes"])

    scored = cut(rows.mapInArrow(classed, "quality int, classes array<long>"))
    cuts = list(rules.cuts)
    n = {r["quality"]: r["count"] for r in scored.groupBy("quality").count().collect()}
    if len(n) < 2:
        cuts[0] = int(DEFAULT_CUT * BINS)
        return replace(rules, cuts=tuple(cuts))
    while True:
        rejected = [F.col("classes")[k] >= c for k, c in enumerate(cuts) if c < BINS]
        left = scored.where(~F.greatest(*rejected, F.lit(False), F.lit(False)))
        tall = left.select("quality", F.posexplode("classes").alias("view", "class"))
        table = np.zeros((2, len(cuts), BINS), np.int64)
        for r in tall.groupBy("quality", "view", "class").count().collect():
            table[r["quality"], r["view"], r["class"]] = r["count"]
        found = [(*_best_cut(table[0, k], table[1, k]), -k) for k in range(len(cuts)) if cuts[k] > BINS]
        worth, at, k = max(found, default=(0, 0, 0))
        if worth < LEAST_CAUGHT:
            return replace(rules, cuts=tuple(cuts))
        cuts[-k] = at


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: its base counts, whether the base rules fail, whether it is kept, its score over all statistics, and the statistic that rejects it."""
    measured = cut(measure(docs))
    rules = fit(measured, labels)
    names = ["all", *RATES]

    def judged(columns: list[pa.Array]) -> pa.Array:
        count = _matrix(columns[0])
        failed, score, which = rules.verdict(count)
        rule = pa.array(["base" if f else None if k < 0 else names[k] for f, k in zip(failed.tolist(), which.tolist())], pa.string())
        return pa.StructArray.from_arrays([pa.array(failed), pa.array(~failed & (which < 0)), pa.array(score / BINS), rule], names=["base_failed", "kept", "score", "rule"])

    found = with_arrow_column(measured, "verdict", "struct<base_failed: boolean, kept: boolean, score: double, rule: string>", [F.col("count")], judged)
    return found.select("doc_id", *[F.col("count")[k].alias(name) for k, name in enumerate(COUNTS[:5])], "verdict.*")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and that no forest rejects, in the columns they came in."""
    rules = fit(cut(measure(docs)), labels)

    def judged(columns: list[pa.Array]) -> pa.Array:
        failed, _, which = rules.verdict(_matrix(_counted(columns[0])))
        return pa.array(~failed & (which < 0))

    kept = "kept"
    while kept in docs.columns:
        kept += "_"
    return with_arrow_column(docs, kept, "boolean", [F.col("text")], judged).where(F.col(kept)).select(*all_columns(docs))
