import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string, container string, at int, path string"


def brute_rebuilt(rows):
    """Remainders as in SQL: of the id's sign."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def brute_nodes(sequences):
    members = defaultdict(list)
    for c, ts in sequences.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for way in members:
        if way:
            children[way[:-1]].append(way)

    found = []
    leaves, saved = {}, {}
    for way in sorted(members, key=len, reverse=True):
        own = (len(members[way]) - 1) * len(way[-1][1].encode()) if way else 0
        leaves[way] = sum(leaves[w] for w in children[way]) or 1
        saved[way] = own + sum(saved[w] for w in children[way])
        ends = sorted(c for c in members[way] if len(sequences[c]) == len(way))
        found.append(
            (
                min(members[way]),
                len(way),
                min(members[way[:-1]]) if way else None,
                len(members[way]),
                len(children[way]),
                leaves[way],
                saved[way],
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return found


def rows_of(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "p") for r in rows], KIND).repartition(5)


def random_rows(seed, conversations=120, deep=6):
    """Shared openings, exact copies, conversations that are prefixes of others, and one long common beginning."""
    rng = random.Random(seed)
    rows = []
    long = [("user", f"long {k} é") for k in range(70)]
    for c in range(conversations):
        if c % 6 == 0:
            turns = [("user" if k % 2 else None, rng.choice(["hi", "ho", "", None])) for k in range(rng.randint(1, deep))]
        elif c % 6 == 1:
            turns = long[: rng.choice([3, 40, 69, 70])] + [("user", rng.choice("ab"))] * rng.randint(0, 2)
        else:
            turns = [("user", "same"), ("assistant", "answer")] * rng.randint(1, 3)
        rows += [(c - 7, k, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("container_turns", [1, 7, 60, 100_000])
def test_nodes_are_those_of_brute_force(spark, container_turns):
    rows = random_rows(container_turns)
    sequences = brute_rebuilt([r for r in rows])
    assert rows_of(conversation_trie.nodes(conversation_trie.branched(table(spark, rows)), container_turns)) == sorted(brute_nodes(sequences), key=str)


def test_plain_sequences_and_texts(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "x", "bb"), (2, 0, "u", "a"), (2, 1, "x", "cc"), (3, 0, "u", "a")]
    frame = table(spark, rows)
    trie = conversation_trie.nodes(conversation_trie.sequences(frame))
    found = conversation_trie.with_texts(trie, frame)
    assert sorted(((r.conv_id, r.depth, r.n_convs, r.role, r.text) for r in found.collect()), key=str) == sorted(
        [(1, 0, 3, None, None), (1, 1, 3, "u", "a"), (1, 2, 1, "x", "bb"), (2, 2, 1, "x", "cc")], key=str
    )


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"),
        (0, None, "user", "null turn first"),
        (0, 1, None, None),
        (0, 1, "", None),
        (0, 2, "user", "z" * 200_000),
        (0, 2, "user", "z" * 200_000),
        (-3, 5, "user", "null turn first"),
        (9, 0, "user", "all of it cut away"),
        (2**40, 0, "user", "ä\0b"),
    ]
    assert rows_of(conversation_trie.report(table(spark, rows))) == sorted(brute_nodes(brute_rebuilt(rows)), key=str)


def test_empty_tables(spark):
    assert conversation_trie.report(table(spark, [(0, 0, "a", "b")]).where("false")).count() == 0
    assert conversation_trie.report(table(spark, [(None, 0, "a", "b")])).count() == 0


def test_only_conversations_without_turns(spark):
    cut_away = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    found = conversation_trie.report(table(spark, [(cut_away, 0, "user", "x")])).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in found] == [(cut_away, 0, 1, 0, 1)]


def test_copies_are_folded(spark):
    """A third of all conversations are one text: their ids pass in blocks, and no task holds a row for each."""
    copies = spark.range(60_000).select(F.col("id").alias("conv_id"), F.lit("00" * 16).alias("turn_id"))
    same = copies.select("conv_id", F.unhex("turn_id").alias("ids"), F.array(F.lit(3)).alias("sizes"))
    found = conversation_trie.folded(same).collect()
    wanted = hashlib.sha256(",".join(map(str, range(60_000))).encode()).hexdigest()
    assert [(r.conv_id, r.n, r.digest) for r in found] == [(0, 60_000, wanted)]
