import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import quality_rules
from tidemark.llm.arrays import pieces

SPACE = "[^\x20\x09-\x0d]+"


def brute(text):
    """The base counts, word by word."""
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(8)}
    lines = [line for line in text.split("\n") if re.search(SPACE, line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def counted(texts):
    return [row for _, _, data, offsets in pieces(pa.array(texts, pa.string()), 100) for row in quality_rules.counts(data, offsets).tolist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n#\r|é\x0b\0　", max_size=80), st.lists(st.sampled_from(["a", "b", "é!"]), max_size=60).map(" ".join)), max_size=6))
def test_counts_are_those_of_brute_force(texts):
    found = counted(texts)
    assert [row[:5] for row in found] == [brute(t) for t in texts]
    for row, text in zip(found, texts):
        words = re.findall(SPACE, text or "")
        assert row[-1] == sum(a == b for a, b in zip(words, words[1:]))


def test_words_that_share_a_hash_are_two_words():
    one = "ab"
    for _ in range(9):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    text = f"{one} 1 2 3 4 5 6 7 8 {other} 1 2 3 4 5 6 7 9"
    assert counted([text])[0][:5] == brute(text)


def brute_path(forest, tree, row):
    """Follow one row down one tree until it is in a leaf."""
    node = 0
    while 2 * node + 1 < forest.feature.shape[1] and np.isfinite(forest.value[tree, node]):
        node = 2 * node + 1 + (row[forest.feature[tree, node]] > forest.value[tree, node])
    return forest.path[tree, node]


def test_forest_scores_by_mean_path():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 3))
    rows[0] = 9
    forest = quality_rules.grow(rows, trees=20)
    scores = forest.score(rows)
    for k in (0, 1, 77):
        mean = np.mean([brute_path(forest, t, rows[k]) for t in range(20)])
        assert scores[k] == pytest.approx(2 ** (-mean / forest.usual))
    assert scores.argmax() == 0 and np.median(scores) < 0.5
    assert (quality_rules.grow(rows, trees=20).score(rows) == scores).all()


def test_a_forest_of_equal_rows_finds_nothing_unusual():
    same = quality_rules.grow(np.ones((40, 2)))
    assert same.score(np.ones((3, 2))) == pytest.approx([0.5] * 3)
    assert quality_rules.grow(np.ones((1, 2))).score(np.zeros((1, 2)))[0] <= 1


@pytest.mark.parametrize("seed", range(20))
def test_best_cut(seed):
    rng = np.random.default_rng(seed)
    bad, good = rng.integers(0, 20, 12), rng.integers(0, 3, 12)
    worth, at = quality_rules._best_cut(bad, good)
    every = [int(bad[t:].sum() - quality_rules.LOSS * good[t:].sum()) for t in range(13)]
    assert worth == max(every) and every[at] == worth


def test_held_out_labels(spark, tmp_path):
    """Thresholds learned from half of the labels hold for the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    found = quality_rules.report(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    bad = [r for r in found if r.quality == 0]
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    assert len(bad) > 20 and sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert {r.rule for r in bad} & {"symbols", "all", "word_length"}


def test_base_counts_of_the_given_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = {r.doc_id: r for r in quality_rules.report(documents, labels).collect()}
    for r in documents.collect():
        f, want = found[r.doc_id], brute(r.text)
        assert [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words] == want
        assert f.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (f.base_failed and f.kept) and f.kept == (f.rule is None)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 1, "x"), (6, 0, "x"), (None, 0, "x"), (7, None, "x"), (12, 5, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    found = quality_rules.report(awkward, labels)
    assert found.count() == awkward.count()
    assert all(r.base_failed and not r.kept and r.rule == "base" for r in found.collect() if r.doc_id in (2, 3, 9, 10))
    kept = quality_rules.keep(awkward.withColumnRenamed("size", "kept"), labels)
    assert kept.columns == awkward.withColumnRenamed("size", "kept").columns
    assert kept.count() == found.where("kept").count() > 0
    for none in (labels.where("false"), labels):
        assert quality_rules.report(nothing, none).count() == 0 == quality_rules.keep(nothing, none).count()
    assert quality_rules.report(awkward, labels.where("false")).count() == awkward.count()


def test_the_sample_is_bounded(spark):
    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.array(*[F.lit(100 - k).cast("long") if k < 4 else F.lit(0).cast("long") for k in range(len(quality_rules.COUNTS))]).alias("count"))
    assert 1 <= len(quality_rules._sample(rows, 40)) <= 40  # equal rows have one hash
    assert len(quality_rules._sample(rows, 4000)) == 500
    other = rows.withColumn("doc_id", F.monotonically_increasing_id())
    assert 25 <= len(quality_rules._sample(other, 40)) <= 40
