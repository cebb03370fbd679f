"""Token counts of a unigram tokenizer by dynamic programming over a trie.

Texts are split into pre-tokens (letters, digits, other signs, each with the
space before it, or white space), and every distinct pre-token is segmented
once. Sorted, the pre-tokens are a trie laid out flat: a pre-token shares the
nodes of the prefix it has in common with the one before it. The forward score
of a node is that of the best segmentation of its prefix,

    best(p) = max over vocabulary pieces s that p ends in: best(p without s) + log P(s),

so a prefix shared by many pre-tokens is scored once. All nodes of one depth are
scored together. The number of pieces at the node where a pre-token ends is its
token count; a document's count is the sum over its pre-tokens.

The vocabulary is a file of public pieces in order of rank, read on the driver
and sent to the tasks. It holds no probabilities; they follow its ranks by
Zipf's rule, ``P(rank) ~ 1 / (rank + 1)``. Equal scores are decided for the
longer last piece. A byte that is no piece counts as one token of low score.

Edge cases: null and empty texts have no tokens and score 0; white space is
tokens like any other text; repeated rows are counted each; without documents
there is no row. Other columns pass through :func:`with_counts`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import arrays
from tidemark.llm.rows import with_arrow_column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pieces a vocabulary may have to be sent to the tasks.
MOST_PIECES = 1_000_000

#: Pre-tokens up to this many bytes go through the trie; longer ones are segmented alone.
WIDE = 64

#: Distinct pre-tokens segmented at once, and remembered by a worker.
TOGETHER, REMEMBERED = 100_000, 1_000_000

_PRETOKEN = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")


@dataclass
class Vocabulary:
    """Pieces with their log probabilities, also as sorted hashes."""

    pieces: dict[bytes, float]

    def __post_init__(self):
        longest = [p for p in self.pieces if 0 < len(p) <= WIDE]
        data, offsets = arrays.flat(pa.array(longest, pa.binary()))
        hashes = arrays.span_hash(arrays.prefix_sums(data), offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.scores = np.array([self.pieces[longest[k]] for k in order])
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min(self.pieces.values(), default=0.0) - 10
        # one bit for each low end of a hash: most substrings are no piece
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Log probability of each hashed piece, minus infinity where it is none."""
        out = np.full(len(hashes), -np.inf)
        at = np.flatnonzero(self.likely[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            found = self.hashes[place] == hashes[at]
            out[at[found]] = self.scores[place[found]]
        return out


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if len(ranks) > MOST_PIECES:
        raise ValueError(f"{path} has {len(ranks)} pieces; the tasks are sent {MOST_PIECES} at most")
    total = np.log(sum(1 / (r + 1) for r in ranks.values()))
    return Vocabulary({piece: float(-np.log(rank + 1) - total) for piece, rank in ranks.items()})


def segment_one(word: bytes, vocabulary: Vocabulary) -> tuple[int, float]:
    """Token count and score of one pre-token, alone."""
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, pieces = -np.inf, 0
        for start in range(max(0, end - vocabulary.longest), end):
            score = vocabulary.pieces.get(word[start:end])
            if score is None:
                if end - start > 1:
                    continue
                score = vocabulary.unknown
            if best[start] + score > top:
                top, pieces = best[start] + score, count[start] + 1
        best.append(top)
        count.append(pieces)
    return count[-1], best[-1]


def segment(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and scores of distinct, sorted pre-tokens of at most ``WIDE`` bytes."""
    n = len(words)
    data, offsets = arrays.flat(pa.array(words, pa.binary()))
    length = np.diff(offsets)
    wide = int(length.max(initial=0))
    letters = np.zeros((n, wide), np.int16)
    row = np.repeat(np.arange(n), length)
    letters[row, np.arange(len(data)) - offsets[row]] = data.astype(np.int16) + 1
    # nodes: a pre-token adds those below the prefix it shares with the one before
    differ = np.ones((n, wide), bool)
    differ[1:] = np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1)
    sums = arrays.prefix_sums(data)
    node = [np.zeros(n, np.int64)]  # which node of a depth each pre-token passes
    best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    out_count, out_score = np.zeros(n, np.int64), np.zeros(n)
    for depth in range(1, wide + 1):
        through = length >= depth
        new = differ[:, depth - 1] & through
        node.append(np.cumsum(new) - 1)
        named = np.flatnonzero(new)  # the first pre-token through each node
        top, pieces = np.full(len(named), -np.inf), np.zeros(len(named), np.int64)
        end = offsets[named] + depth
        for size in range(min(depth, vocabulary.longest), 0, -1):
            score = vocabulary.look_up(arrays.span_hash(sums, end - size, end))
            if size == 1:
                score[np.isneginf(score)] = vocabulary.unknown
            parent = node[depth - size][named]
            total = best[depth - size][parent] + score
            better = total > top
            top[better] = total[better]
            pieces[better] = count[depth - size][parent[better]] + 1
        best.append(top)
        count.append(pieces)
        ends = np.flatnonzero(length == depth)
        out_count[ends], out_score[ends] = pieces[node[depth][ends]], top[node[depth][ends]]
    return out_count, out_score


class _Counter:
    """Segments the distinct pre-tokens of a task and remembers them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.counts) + len(words) > REMEMBERED:
            self.counts.clear()
            self.scores.clear()
        coded = sorted((w.encode(), w) for w in words if w not in self.counts)
        short = [x for x in coded if len(x[0]) <= WIDE]
        for a in range(0, len(short), TOGETHER):
            part = short[a : a + TOGETHER]
            counts, scores = segment([b for b, _ in part], self.vocabulary)
            self.counts.update(zip((w for _, w in part), counts.tolist()))
            self.scores.update(zip((w for _, w in part), scores.tolist()))
        for b, w in coded:
            if len(b) > WIDE:
                self.counts[w], self.scores[w] = segment_one(b, self.vocabulary)

    def texts(self, texts: list[str]) -> Iterator[dict]:
        split = [_PRETOKEN.findall(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        for words in split:
            yield {
                "n_pretokens": len(words),
                "n_tokens": sum(map(self.counts.__getitem__, words)),
                "log_prob": sum(map(self.scores.__getitem__, words)) + 0.0,
            }


_MADE = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])


def with_counts(docs: DataFrame, vocabulary: Vocabulary, name: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``name``: pre-tokens, tokens, log probability of the best segmentation."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept: dict[str, _Counter] = {}

    def count(columns: list[pa.Array]) -> pa.Array:
        counter = kept.setdefault("", _Counter(held.value))
        made, texts, size = [], [], 0
        for text in columns[0]:
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > arrays.CHUNK:
                made += counter.texts(texts)
                texts, size = [], 0
        return pa.array([*made, *counter.texts(texts)], _MADE)

    return with_arrow_column(docs, name, "struct<n_pretokens:long,n_tokens:long,log_prob:double>", [F.col("text")], count)


def report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: ``doc_id, n_pretokens, n_tokens, log_prob`` (to 4 places)."""
    t = F.col("tokens")
    return with_counts(docs.select("doc_id", "text"), read_vocabulary(path)).select(
        "doc_id", t["n_pretokens"].alias("n_pretokens"), t["n_tokens"].alias("n_tokens"), F.round(t["log_prob"], 4).alias("log_prob")
    )
