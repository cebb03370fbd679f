import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup


def brute(rows, length=100):
    """(bytes, removed, spans, digest) of each text, strings compared one by one."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for x in range(len(data)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 26, 256])
def test_suffix_array_sorts_and_finds_common_prefixes(letters):
    rng, depth = np.random.default_rng(letters), 16
    for n in (1, 2, 5, 60, 700):
        body = rng.integers(0, letters, n).astype(np.uint8)
        body[n // 2 : n // 2 + 20] = body[: len(body[n // 2 : n // 2 + 20])]
        text = np.concatenate([body, np.zeros(depth, np.uint8)])
        order = suffix_dedup.suffix_array(text, depth)
        assert sorted(order) == list(range(n))
        keys = [text[i : i + depth].tobytes() for i in order]
        assert keys == sorted(keys)
        shared = suffix_dedup.common_prefix(text, order, depth)
        for a, b, common in zip(keys, keys[1:], shared[1:]):
            assert common == next((k for k in range(depth) if a[k] != b[k]), depth)


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "hot": 2}])
def test_against_brute_force(spark, settings):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = ["a" * 500, None, "", "ab" * 300, "x" * 99, "a" * 300, "é" * 200, "\0" * 250, "\0" * 250 + "z"]
    texts += [base[i * 13 : i * 13 + 200] + "".join(rng.choice("abc ") for _ in range(80)) + base[300 - i * 5 : 500] for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.report(docs, **settings).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == brute(texts)


def test_null_ids_come_last_and_repeated_rows_count(spark, awkward):
    rows = awkward.collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    wanted = sorted(zip([str(r.doc_id) for r in order], brute([r.text for r in order])))
    found = suffix_dedup.report(awkward, block_bytes=50_000).collect()
    assert sorted((str(r.doc_id), tuple(r)[1:]) for r in found) == wanted


def test_other_columns_pass_through(awkward):
    found = suffix_dedup.dedup(awkward)
    assert found.columns[: len(awkward.columns)] == awkward.columns
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[5]["text.h"] == "h" and by_id[5].size == 5 and by_id[2].text is None
    assert bytes(by_id[10].kept) == b"one"


def test_no_rows(nothing):
    assert suffix_dedup.report(nothing).count() == 0
