import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, cut at the cap, share the excess again until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, budget, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "é": 5, None: 300}, {"a": 7}, {"a": 0, "b": 5}, {"a": 0}, {None: 12, "": 12}, {"Z": 90, "a": 3, "b": 2, "c": 1, "d": 500}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_the_fit_is_the_best_there_is():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 30, 4))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 3))
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := int(np.dot(c, lengths))) <= budget)
        assert int((taken * lengths).sum()) == best
        bound = mixing.fit(lengths, counts, budget, program_words=20)
        assert best - lengths.max() < int((bound * lengths).sum()) <= best and (bound <= counts).all()


def test_long_documents_are_fitted_exactly():
    lengths, counts = np.array([15_000, 20_001]), np.array([2, 1])
    assert mixing.fit(lengths, counts, 30_000).tolist() == [2, 0]
    lengths, counts = np.array([70_000, 90_000, 1_000_001]), np.array([9, 9, 1])
    assert int((mixing.fit(lengths, counts, 1_000_000) * lengths).sum()) == 1_000_000


def test_long_lengths_beyond_the_table_are_fitted_exactly():
    lengths = np.array([1, 2, 3, 4, 1_000_000, 1_000_002, 1_000_004, 1_000_006])
    counts = np.array([3, 3, 3, 3, 900, 900, 900, 900])
    taken = mixing.fit(lengths, counts, 1_692_005_090)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert int((taken * lengths).sum()) == 1_692_005_090


@pytest.mark.parametrize("seed", range(30))
def test_shares_leave_the_program_its_table(seed):
    """Whatever the lengths, the miss is under the longest document, and none is taken twice."""
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 10 ** int(rng.integers(1, 6)), 40))
    counts = rng.integers(1, 300, len(lengths))
    total = int((lengths * counts).sum())
    budget = int(rng.integers(0, total))
    taken = mixing.fit(lengths, counts, budget, program_words=int(rng.integers(1, 5000)))
    assert (taken >= 0).all() and (taken <= counts).all()
    assert budget - int(lengths.max()) < int((taken * lengths).sum()) <= budget


def test_the_table_is_all_the_program_holds():
    """Even lengths never make an odd budget, so the program runs to its end."""
    lengths, counts = np.arange(2, 1200, 2), np.full(599, 5000)
    tracemalloc.start()
    taken = mixing.fit(lengths, counts, 900_000_001)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert int((taken * lengths).sum()) == 900_000_000
    assert peak < 16 << 20


def test_mix_of_the_given_documents(spark, documents):
    found = mixing.report(documents).cache()
    assert found.count() == documents.count()
    assert found.where("taken > 2 * size or taken % size <> 0 and size > 0 or size = 0 and taken > 0").count() == 0
    sources: dict = {}
    for r in mixing.allot(documents).collect():
        sources.setdefault((r.source, r.source_size, r.target), []).append(r)
    for (_, size, target), rows in sources.items():
        budget = int(target - target // size * size)
        reach = 1
        for r in rows:
            reach |= reach << r.size
        best = (reach & (1 << budget + 1) - 1).bit_length() - 1
        assert sum(r.size * r.passes for r in rows) == target // size * size + best
    assert sorted(mixing.report(documents.repartition(7)).collect()) == sorted(found.collect())


def test_slices_do_not_change_how_many_are_taken(spark):
    rows = [(k, "word " * (k % 3 + 1), "hot") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for slices in (1, 7, 256):
        found = mixing.allot(docs, slices=slices).agg(F.sum(F.col("size") * F.col("passes"))).first()[0]
        assert found == 900


def test_awkward_rows(awkward, nothing):
    found = mixing.report(awkward).collect()
    assert len(found) == awkward.count()
    assert all(r.taken == 0 and r.size == 0 for r in found if r.doc_id in (2, 3, 9))
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in found)
    assert mixing.report(nothing).count() == 0 and mixing.mix(nothing).count() == 0
