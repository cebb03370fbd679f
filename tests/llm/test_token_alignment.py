import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import token_alignment

TOKENIZERS = token_alignment._opened(token_alignment._files(token_alignment.A_FILE, token_alignment.B_FILE))


def brute_groups(text):
    """Both lists cut where both have an end; None without tokens."""
    if not text:
        return None
    a = TOKENIZERS.a.encode(" " + text, add_special_tokens=False).ids
    b = TOKENIZERS.b.encode(text)
    whole = (" " + text).encode()
    sides = []
    for ids, named in ((a, TOKENIZERS.a_bytes), (b, TOKENIZERS.b_bytes)):
        if b"".join(named[i] for i in ids) != whole:
            return None
        ends, at = {}, 0
        for k, i in enumerate(ids):
            at += len(named[i])
            ends[at] = k + 1
        sides.append(ends)
    groups, before = [], (0, 0)
    for end in sorted(sides[0].keys() & sides[1].keys()):
        cut = (sides[0][end], sides[1][end])
        groups.append((a[before[0] : cut[0]], b[before[1] : cut[1]]))
        before = cut
    return groups


def digest(groups):
    if not groups:
        return ""
    text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return hashlib.sha256(text.encode()).hexdigest()


def brute_report(texts):
    found = [brute_groups(t) or [] for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    count = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (
            sum(len(a) for a, _ in g),
            sum(len(b) for _, b in g),
            len(g),
            sum(c.values()),
            sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()),
            digest(g),
        )
        for g, c in zip(found, links)
    ]


def block_groups(texts):
    block = token_alignment.read_block(TOKENIZERS, pa.array(texts, pa.string()))
    u = block.units
    out = []
    for k in range(len(texts)):
        groups = []
        for unit in block.unit[block.first[k] : block.first[k + 1]]:
            for g in range(u.group_at[unit], u.group_at[unit + 1]):
                a0, b0 = (int(c[g - 1]) if g else 0 for c in (u.a_cut, u.b_cut))
                groups.append((u.a[a0 : u.a_cut[g]].tolist(), u.b[b0 : u.b_cut[g]].tolist()))
        out.append(groups)
    return out, token_alignment._digests(block)


WORDS = ["the", "Straße", "don't", "l'été", "naïve,", "x=1;", "日本 語", " ", "　a", "  ", " ", "\n", "\n\n", "\t", "▁", "<s>", "<|endoftext|>", "😀", "é", "\0", "\x85", "aaaaaaaaaaaaaaaa", "12345", "----------", "ﬁ", " ", "İ", "ǅ"]
TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), st.lists(st.sampled_from(WORDS), max_size=12).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_blocks_of_units_are_whole_texts(texts):
    """Splitting into units, joining them in calls and the quick form of A change nothing."""
    wanted = [brute_groups(t) or [] for t in texts]
    found, digests = block_groups(texts)
    assert found == wanted
    assert digests == [digest(g) for g in wanted]


def test_vocabularies_are_read_as_they_are():
    assert TOKENIZERS.splits and TOKENIZERS.quick is not None
    assert TOKENIZERS.a_bytes[TOKENIZERS.a.token_to_id("Ġthe")] == b" the"
    assert TOKENIZERS.b_bytes[TOKENIZERS.b.piece_to_id("<0x0A>")] == b"\n"
    slow = token_alignment.Tokenizers(*token_alignment._files(token_alignment.A_FILE, token_alignment.B_FILE))
    slow.splits, slow.quick = False, None
    text = "Où est l'été ?  Là-bas, 12345 fois.\n\n Punkt"
    block = token_alignment.read_block(slow, pa.array([text]))
    assert len(block.unit) == 1
    assert token_alignment._digests(block) == [digest(brute_groups(text))]


@pytest.mark.parametrize("wide", [1, 4, 4096])
def test_links_of_units(monkeypatch, wide):
    """Wide groups are linked by their different ids, to the same counts."""
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    texts = ["日本語 𝔘𝔫𝔦𝔠𝔬𝔡𝔢 😀😀😀 naïve", "zzzzzzzz " * 5, "the the"]
    block = token_alignment.read_block(TOKENIZERS, pa.array(texts))
    n_b = len(TOKENIZERS.b_bytes)
    pair, often, at = token_alignment.unit_links(block.units, n_b)
    for k, text in enumerate(texts):
        found = Counter()
        for unit in block.unit[block.first[k] : block.first[k + 1]]:
            for p, n in zip(pair[at[unit] : at[unit + 1]].tolist(), often[at[unit] : at[unit + 1]].tolist()):
                found[divmod(p, n_b)] += n
        assert found == Counter((x, y) for a, b in brute_groups(text) for x in a for y in b)


@pytest.mark.parametrize("numbers", [[], [0], [5, 0, 2**31, 7], [2**40, 1]])
def test_packing_is_a_round_trip(numbers):
    given = np.array(numbers, np.int64)
    assert token_alignment._unpack(token_alignment._pack(given), len(given)).tolist() == numbers


@pytest.mark.parametrize("block_bytes", [2000, 8 << 20])
def test_given_documents(spark, documents, block_bytes):
    rows = documents.select("doc_id", "text").limit(120).collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: tuple(r)[1:] for r in token_alignment.report(docs, block_bytes=block_bytes).collect()}
    assert found == dict(zip([r.doc_id for r in rows], brute_report([r.text for r in rows])))


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.collect()
    extra = [(20, "a▁b", "en", "s", 1, 5, "h", "b"), (21, "<s> <|endoftext|>", "en", "s", 1, 5, "h", "b")]
    docs = awkward.union(spark.createDataFrame(extra, awkward.schema))
    found = sorted((tuple(r) for r in token_alignment.report(docs).collect()), key=str)
    texts = [r.text for r in rows] + [e[1] for e in extra]
    ids = [r.doc_id for r in rows] + [e[0] for e in extra]
    assert found == sorted(((i, *r) for i, r in zip(ids, brute_report(texts))), key=str)
    assert dict((f[0], f[1:]) for f in found)[20] == (0, 0, 0, 0, 0, 0, "")
    for of in (token_alignment.report, token_alignment.links, token_alignment.groups):
        assert of(nothing).count() == 0


def test_links_and_groups(spark):
    texts = ["the cat", "the dog", "", None, "naïve the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = Counter(p for t in texts for p in {(x, y) for a, b in brute_groups(t) or [] for x in a for y in b})
    found = token_alignment.links(docs).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in found} == count
    assert all(r.best == (r.n_docs == max(n for (a, _), n in count.items() if a == r.a_id)) for r in found)
    for r in token_alignment.groups(docs).collect():
        cuts = list(zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends))
        assert [(r.a_ids[a:b], r.b_ids[c:d]) for a, b, c, d in cuts] == (brute_groups(texts[r.doc_id]) or [])
    assert docs.where(F.col("text").isNull()).count() == 1
