import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import arrays, jaccard_join

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))} if words else set()


def brute(texts, percent=90, n=3):
    """(set size, least linked position) of each text, all pairs compared."""
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def variants(seed, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [None, "", "  \n ", "a", "A", "a b", "a b c", "A  B C", "b a"]
    for size in sizes:
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(8):
                words = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 3])):
                    p, kind = rng.randrange(len(words)), rng.random()
                    if kind < 0.4:
                        words[p] = rng.choice(vocabulary)
                    elif kind < 0.7:
                        words.insert(p, rng.choice(vocabulary))
                    elif len(words) > 3:
                        del words[p]
                texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("sizes", [(6, 9, 10, 11, 12, 15), (20, 30, 45, 60), (120, 400)])
def test_against_brute_force(spark, sizes):
    texts = variants(len(sizes), sizes)
    found = jaccard_join.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == brute(texts)


def test_the_pipeline_stage_against_brute_force(spark):
    """Five words and 0.8: one document of each class stays, as all pairs compared say."""
    texts = variants(7, (7, 12, 24, 40, 90, 250))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = brute(texts, 80, 5)
    found = jaccard_join.report(docs, n=5, percent=80)
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == wanted
    kept = {r.doc_id for r in jaccard_join.keep_one(docs, n=5, percent=80).collect()}
    assert kept == {k for k, (size, least) in enumerate(wanted) if not size or least == k}


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(0)
    scheme = jaccard_join.Scheme()
    for size in (1, 5, 9, 10, 19, 38, 46, 47, 60, 100, 500, 3000):
        for _ in range(20):
            one = rng.integers(1, 1 << 62, size).astype(np.uint64)
            most = int(scheme.differences(np.array([size]))[0])
            drop = int(rng.integers(0, most + 1))
            other = np.concatenate([one[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, most - drop + 1))).astype(np.uint64)])
            common = len(np.intersect1d(one, other))
            if 100 * common < 90 * (len(one) + len(other) - common):
                continue
            first = np.array([0, len(one), len(one) + len(other)])
            keys, sets = scheme.signatures(np.concatenate([one, other]), first)
            assert set(keys[sets == 0]) & set(keys[sets == 1]), (size, drop)


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_similar_sets_share_a_signature_at_every_size_and_cut(percent, monkeypatch):
    rng = np.random.default_rng(percent)
    for rounds in (16, 1):  # with one round the thin sets have to meet in their band
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        scheme = jaccard_join.Scheme(percent)
        for size in [*range(1, 60), 130, 700]:
            for _ in range(15):
                one = rng.integers(1, 1 << 62, size).astype(np.uint64)
                most = int(scheme.differences(np.array([size]))[0])
                drop = int(rng.integers(0, most + 1))
                other = np.concatenate([one[drop:], rng.integers(1, 1 << 62, int(rng.integers(0, most - drop + 1))).astype(np.uint64)])
                common = len(np.intersect1d(one, other))
                if not common or 100 * common < percent * (len(one) + len(other) - common):
                    continue
                keys, sets = scheme.signatures(np.concatenate([one, other]), np.array([0, len(one), len(one) + len(other)]))
                assert set(keys[sets == 0]) & set(keys[sets == 1]), (size, drop, rounds)


@pytest.mark.parametrize("percent", [90, 80])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 9, 18, 32, 46, 60, 300])
def test_sets_without_a_common_gram_share_no_signature(percent, size):
    rng = np.random.default_rng(size)
    number = 6000 // size + 400
    grams = rng.integers(1, 1 << 62, number * size).astype(np.uint64)
    keys, sets = jaccard_join.Scheme(percent).signatures(grams, np.arange(number + 1) * size)
    assert len(np.unique(np.stack([keys, sets.astype(np.uint64)], 1), axis=0)) == len(np.unique(keys))
    assert set(sets) == set(range(number))


def test_sets_that_only_equal_ones_resemble_have_one_signature():
    grams = np.arange(1, 9, dtype=np.uint64)
    for size in range(1, 9):
        assert len(jaccard_join.Scheme(90).signatures(grams[:size], np.array([0, size]))[0]) == 1


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    other = np.concatenate([one[50:], rng.integers(0, 1 << 62, 20).astype(np.uint64)])
    sketch = jaccard_join._sketches(np.concatenate([one, other]), np.array([0, len(one), len(one) + len(other)])).astype(int)
    assert np.abs(sketch[0] - sketch[1]).sum() <= 70


def test_awkward_rows(awkward):
    found = {r.doc_id: r for r in jaccard_join.report(awkward).collect()}
    assert (found[2].n_shingles, found[2].component_id) == (0, 2)
    assert found[9].n_shingles == 0 and found[10].n_shingles == 1
    assert found[7].component_id == 6 and found[8].component_id == 6 and found[None].component_id == 6


def test_keep_one(awkward, nothing):
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13]
    assert jaccard_join.keep_one(nothing).count() == 0 and jaccard_join.report(nothing).count() == 0


def test_short_texts_are_one_gram():
    data, offsets = arrays.flat(__import__("pyarrow").array(["a b", "b a", "A B", "", None, "a b c d"]))
    grams, first = jaccard_join.gram_sets(data, offsets, 3)
    assert np.diff(first).tolist() == [1, 1, 1, 0, 0, 2]
    ids = jaccard_join.set_ids(grams, first)
    assert ids[0] == ids[2] != ids[1]


def test_a_group_takes_little_more_than_its_sketches():
    """A signature shared by many sets: the peak of its task is under 600 bytes a set."""
    rng, n = np.random.default_rng(5), 30_000
    rows = rng.integers(0, 256, (n, jaccard_join.SKETCH), dtype=np.uint8)
    rows[n // 2 :] = rows[: n // 2]
    table = pa.table({"id": rng.permutation(n), "n": np.full(n, 50), "sketch": pa.array([r.tobytes() for r in rows], pa.binary())})
    group = jaccard_join._Group(table, 90)
    assert (group.sketch == rows[np.argsort(table.column("id").to_numpy())]).all()
    assert (group.middle() == np.median(group.sketch, axis=0)).all()
    everyone, point = np.arange(n), group.sketch[3].astype(np.int32)
    assert (group.distances(everyone, point) == np.abs(group.sketch.astype(np.int32) - point).sum(axis=1)).all()
    some, before = table.slice(0, 2_000), pa.total_allocated_bytes()
    assert len(jaccard_join._tree(some, 90)) == 0  # no set is near another in these
    del group
    tracemalloc.start()
    group = jaccard_join._Group(table, 90)
    np.argsort(group.distances(everyone, group.middle()), kind="stable")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak + pa.total_allocated_bytes() - before < 600 * n


@pytest.mark.parametrize("percent", [90, 80])
def test_large_sets_need_fewer_signatures_than_grams(percent):
    """Signatures are what moves: at 0.8 a set of 200 grams once had 500 of them."""
    rng = np.random.default_rng(percent)
    scheme = jaccard_join.Scheme(percent)
    for size in (100, 200, 1000, 5000):
        grams = rng.integers(1, 1 << 62, 20 * size).astype(np.uint64)
        assert len(scheme.signatures(grams, np.arange(21) * size)[0]) < 0.75 * len(grams)


def test_a_signature_travels_in_twelve_bytes(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(50)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:10])], "doc_id long, text string").coalesce(1)
    scheme = jaccard_join.Scheme(80)
    data, offsets = arrays.flat(pa.array(texts))
    number = len(scheme.signatures(*jaccard_join.gram_sets(data, offsets, 5))[0])
    rows = jaccard_join._signatures(docs, scheme, 5, 4).collect()
    assert {r.bucket for r in rows} == {0, 1, 2, 3}
    assert sum(len(r.keys) for r in rows) == 4 * number and sum(len(r.ids) for r in rows) == 8 * number


def test_a_tree_has_every_set_that_is_near_another():
    rng = np.random.default_rng(11)
    middles = rng.integers(0, 12, (25, jaccard_join.SKETCH))
    rows = np.clip(middles[rng.integers(0, 25, 90)] + rng.integers(-1, 2, (90, jaccard_join.SKETCH)) * (rng.random((90, 1)) < 0.6), 0, 255).astype(np.uint8)
    table = pa.table({"id": rng.permutation(90), "n": rows.sum(axis=1).astype(np.int64), "sketch": pa.array([r.tobytes() for r in rows], pa.binary())})
    group, everyone = jaccard_join._Group(table, 80), np.arange(90)
    wanted = {int(group.ids[k]) for k in everyone if group.near(k, everyone[everyone != k]).any()}
    pairs = jaccard_join._tree(table, 80)
    assert 0 < len(wanted) < 90 and set(pairs.column("a").to_pylist()) | set(pairs.column("b").to_pylist()) == wanted


def test_only_texts_near_another_are_read_again(spark, monkeypatch):
    """Documents that share a passage meet in a group; their sketches tell that they are not similar."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    texts = [f"{passage} {x}" for x in own] + [f"{passage} {own[0]} end"]
    asked, read = [], jaccard_join._sets
    monkeypatch.setattr(jaccard_join, "_sets", lambda docs, wanted, n: asked.append(sorted(r.doc_id for r in wanted.collect())) or read(docs, wanted, n))
    found = jaccard_join.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=5, percent=80)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == [*range(40), 0]
    assert asked == [[0, 40]]


def test_one_of_each_moves_the_texts_once(spark):
    rows = [(0, "a b c d e f"), (None, "x y z u v w"), (None, "x y z u v w"), (0, "a b c d e f"), (7, "a b c d e f"), (0, None)]
    single = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80)
    plan = single._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "__h" in x]
    assert len(moved) == 2, plan  # the texts, and what is kept of them
    assert sorted(map(str, single.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in (rows[0], rows[1], rows[5]))
