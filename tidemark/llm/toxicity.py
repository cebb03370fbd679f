"""Toxicity by maximum-scoring segments.

A word's score is the log-odds of toxic against clean documents with a Dirichlet
prior in proportion to the word's frequency, less a small drift; words without a
significant score of their own fall back on how they begin. A text is read once:
the maximal scoring segments (runs of words whose sum cannot be raised by
shortening or lengthening them) are the passages in which toxic words crowd.

How high a sum chance alone reaches is learnt from clean labelled documents: the
tail of their segment sums is exponential, so a sum ``s`` in a text of ``n``
words has the expected number ``K n exp(-rate s)`` of equals. A document's
evidence is the sum of what its segments stand above that number, in logs, and a
logistic curve over the evidence, fitted on the labelled sample, is the score.

Training reads at most ``SAMPLE`` labelled documents of each class, chosen by a
hash of the id, and each distinct text once; the sample bounds the word table
that is sent to the tasks. All documents are scored, each on its whole text.

Edge cases: a null text counts as empty, and a text without words gets the score
of no evidence; a document labelled more than once counts as toxic if any label
says so; labels other than 0 and 1 are ignored; without labels of both classes
every score is 0; a null ``doc_id`` is never trained on and is not held out.
Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import arrays
from tidemark.llm.rows import all_columns, with_arrow_column
from tidemark.session import cut

#: Labelled documents of each class that training reads.
SAMPLE = 12_000

#: Every FOLDS-th document, by checksum of its id, is held out.
FOLDS = 5

#: Bounds tried for how many standard errors a word's log-odds must be from 0.
LEAST_Z = (2.0, 3.0, 4.0, 5.0, 6.0)

#: Bytes of a word's beginning that stand in for an unknown word, longest first.
BEGINNINGS = (5, 4)

_SALTS = {k: np.uint64(0x5851F42D4C957F2D ^ k << 32) for k in BEGINNINGS}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings (0 where it is shorter), word starts and ends, first word of each row."""
    data = arrays.LOWER[data]
    starts, ends, first = arrays.words(data, offsets, arrays.ALPHANUMERIC)
    sums = arrays.prefix_sums(data)
    found = [arrays.span_hash(sums, starts, ends)]
    for k in BEGINNINGS:
        stop = np.minimum(starts + k, ends)
        found.append(np.where(ends - starts > k, arrays.mix(arrays.span_hash(sums, starts, stop) ^ _SALTS[k]), np.uint64(0)))
    return found, starts, ends, first


@dataclass
class Model:
    """Sorted feature hashes with their scores, and the calibration."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.25
    rate: float = 1.0
    k: float = 1.0
    intercept: float = -50.0
    slope: float = 0.0

    def word_scores(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(found[0]), -self.drift)
        if not len(self.hashes):
            return out
        open_words = np.arange(len(out))
        for hashes in found:
            wanted = hashes[open_words]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            known = self.hashes[at] == wanted
            out[open_words[known]] = self.scores[at[known]] - self.drift
            open_words = open_words[~known]
        return out

    def evidence(self, sums: list[float], n: int) -> float:
        return float(sum(max(0.0, self.rate * s - np.log(self.k * n)) for s in sums))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -500, 500))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last + 1, sum), by one scan from left to right."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    left, right = total[places].tolist(), total[places + 1].tolist()
    # each candidate: sum before it, sum after it, first, last, nearest earlier candidate with a lower sum before it
    stack: list[tuple[float, float, int, int, int]] = []
    for place, low, high in zip(places.tolist(), left, right):
        first, j = place, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, first, place, j))
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
    return [(a, b + 1, high - low) for low, high, a, b, _ in stack]


def _segments(column: pa.Array, models: list[Model]) -> Iterator[tuple[int, list[list[tuple[int, int, float]]]]]:
    """For each text: its words, and for each model its segments as (first byte, last byte + 1, sum)."""
    for _, _, data, offsets in arrays.pieces(column):
        found, starts, ends, first = _features(data, offsets)
        scores = [m.word_scores(found) for m in models]
        positive = [np.concatenate([[0], np.cumsum(s > 0)]) for s in scores]
        for k in range(len(offsets) - 1):
            a, b = first[k], first[k + 1]
            yield int(b - a), [
                [(int(starts[a + x] - offsets[k]), int(ends[a + y - 1] - offsets[k]), t) for x, y, t in maximal_segments(s[a:b])]
                if p[b] > p[a]
                else []
                for s, p in zip(scores, positive)
            ]


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic, half`` of the labelled documents to train on, each text once."""
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    both = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    return text.join(both, "doc_id").dropDuplicates(["text", "toxic"]).select("text", "toxic", half.alias("half"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class and half that have a feature, by batch."""
    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, stop, data, offsets in arrays.pieces(batch.column(0)):
            found, _, _, first = _features(data, offsets)
            owner = np.tile(np.repeat(np.arange(stop - row), np.diff(first)), len(found))
            every = np.concatenate(found)
            real = every != 0
            seen = np.unique(np.stack([every[real], owner[real].astype(np.uint64)], 1), axis=0)
            hashes, at = np.unique(seen[:, 0], return_inverse=True)
            kinds = kind[row + seen[:, 1].astype(np.int64)]
            counts = [pa.array(np.bincount(at[kinds == c], minlength=len(hashes)).astype(np.int64)) for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *counts], names=["hash", "n0", "n1", "n2", "n3"])


def _fit(hashes: np.ndarray, clean: np.ndarray, toxic: np.ndarray, sizes: tuple[float, float], prior: float, least_z: float, drift: float) -> Model:
    """Significant log-odds of documents with a feature, under a Dirichlet prior of ``prior`` times the documents."""
    documents = sizes[0] + sizes[1]
    pseudo = prior * (clean + toxic)
    a0, a1 = clean + pseudo, toxic + pseudo
    total = prior * documents
    odds = np.log((a1 + 1e-9) / (sizes[1] + total - a1 + 0.5)) - np.log((a0 + 1e-9) / (sizes[0] + total - a0 + 0.5))
    with np.errstate(divide="ignore"):
        significant = (clean + toxic > 0) & (np.abs(odds) >= least_z * np.sqrt(1 / a1 + 1 / a0))
    order = np.argsort(hashes[significant])
    return Model(hashes[significant][order], odds[significant][order], drift)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float = 0.1, least_z: tuple[float, ...] = LEAST_Z, drift: float = 0.25
) -> Model:
    """Fit word scores and calibration; only rows that are not held out are read.

    The calibration reads each half of the sample with the word scores of the
    other half, so that words which stand in toxic texts by chance count as they
    will on new texts. Of several bounds for the significance of a word, the one
    under which the halves predict each other best is taken.
    """
    rows = cut(_sample(docs, labels, sample))
    kind = (2 * F.col("half") + F.col("toxic")).cast("int").alias("kind")
    sizes = np.zeros(4)
    for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect():
        sizes[r["kind"]] = r["n"]
    if not (sizes[0] + sizes[2] and sizes[1] + sizes[3]):
        return Model(drift=drift)
    names = ["n0", "n1", "n2", "n3"]
    counts = rows.select(F.col("text").cast("binary"), kind).mapInArrow(_count, "hash long, n0 long, n1 long, n2 long, n3 long")
    # features of the sample; one of a single document is never significant
    table = counts.groupBy("hash").agg(*[F.sum(n).alias(n) for n in names]).where("n0 + n1 + n2 + n3 >= 2").toPandas()
    hashes, n = table["hash"].to_numpy(np.int64).view(np.uint64), [table[x].to_numpy(float) for x in names]
    tries = []
    for z in sorted(least_z, reverse=True):
        settings = (prior, z, drift)
        halves = [_fit(hashes, n[2 * h], n[2 * h + 1], (sizes[2 * h], sizes[2 * h + 1]), *settings) for h in (0, 1)]
        whole = _fit(hashes, n[0] + n[2], n[1] + n[3], (sizes[0] + sizes[2], sizes[1] + sizes[3]), *settings)
        tries.append((whole, halves))
    return _calibrated(rows, tries)


def _calibrated(rows: DataFrame, tries: list[tuple[Model, list[Model]]]) -> Model:
    """The model whose halves predict each other best, with its calibration."""
    held = rows.sparkSession.sparkContext.broadcast([halves for _, halves in tries])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for h in (0, 1):
                mine = batch.filter(pa.array(half == h))
                found = list(_segments(mine.column(0), [halves[1 - h] for halves in held.value]))
                sums = [[[s for _, _, s in x] for x in each] for _, each in found]
                yield pa.RecordBatch.from_arrays(
                    [mine.column(1), pa.array([w for w, _ in found], pa.int64()), pa.array(sums, pa.list_(pa.list_(pa.float64())))],
                    names=["toxic", "n", "sums"],
                )

    # one row for each document of the sample
    shape = "toxic int, n long, sums array<array<double>>"
    seen = rows.select(F.col("text").cast("binary"), "toxic", "half").mapInArrow(read, shape).collect()
    y, words = np.array([r["toxic"] for r in seen], float), sum(r["n"] for r in seen if r["toxic"] == 0) + 1
    best = None
    for k, (model, _) in enumerate(tries):
        tail = np.array([s for r in seen if r["toxic"] == 0 for s in r["sums"][k]])
        floor = float(np.median(tail)) if len(tail) else 1.0
        above = tail[tail >= floor]
        # one unit of prior weight keeps both finite when clean texts have no segment
        model.rate = float((len(above) + 1) / ((above - floor).sum() + 1))
        model.k = float((len(above) + 0.5) / words * np.exp(model.rate * floor))
        x = np.log1p([model.evidence(r["sums"][k], max(r["n"], 1)) for r in seen])
        model.intercept, model.slope = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -30, 30)))
        loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``name``: ``score``, and ``passages`` (byte span, sum, log of the expected number by chance)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double,passages:array<struct<start:long,end:long,sum:double,log_expected:double>>>"
    arrow = pa.struct(
        [("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("log_expected", pa.float64())])))]
    )

    def read(columns: list[pa.Array]) -> pa.Array:
        m, made = held.value, []
        for n, (segments,) in _segments(columns[0], [m]):
            n = max(n, 1)
            expected = [(a, b, s, float(np.log(m.k * n) - m.rate * s)) for a, b, s in segments]
            made.append(
                {
                    "score": m.score(float(np.log1p(m.evidence([s for _, _, s in segments], n)))),
                    "passages": [{"start": a, "end": b, "sum": s, "log_expected": e} for a, b, s, e in expected if e < 0],
                }
            )
        return pa.array(made, arrow)

    return with_arrow_column(docs, name, kind, [F.col("text").cast("binary")], read)


def remove_toxic(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``at_least`` so much, in the same columns."""
    scored = score(docs, train(docs, labels), "__toxicity")
    return scored.where(F.col("__toxicity")["score"] < at_least).select(*all_columns(docs))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_passages``."""
    s = F.col("toxicity")
    return score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        s["score"].alias("score"),
        (s["score"] >= 0.5).cast("int").alias("predicted"),
        F.size(s["passages"]).alias("n_passages"),
    )
