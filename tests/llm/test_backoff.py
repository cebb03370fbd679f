import collections
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import backoff

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, order, alpha):
    """(words, score, orders given up) of each text, counts kept as dictionaries."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_LOWER)) for t in texts]

    def grams(words, n):
        return collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))

    total = [sum((grams(w, n) for w in split), collections.Counter()) for n in range(order + 1)]
    every = sum(map(len, split))
    out = []
    for words in split:
        own = [grams(words, n) for n in range(order + 1)]
        rest = max(every - len(words), 1)
        score, given_up = 0.0, 0
        for k in range(len(words)):
            steps = 0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(words[k - n + 1 : k + 1])
                seen = total[n][g] - own[n][g]
                if seen:
                    score += math.log(seen / (rest if n == 1 else total[n - 1][g[:-1]] - own[n - 1][g[:-1]]))
                    break
                steps += 1
            else:
                score += math.log(1 / rest)
            score += steps * math.log(alpha)
            given_up += steps
        out.append((len(words), round(score, 6) if words else None, given_up))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_against_brute_force(spark, order, block_bytes):
    rng = random.Random(order)
    texts = [None, "", "!!", "alone", "The the THE"]
    texts += [" ".join(rng.choice(["the", "of", "Café", "x1", "rare%d" % k]) for _ in range(rng.randrange(30))) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = backoff.score(docs, order=order, block_bytes=block_bytes).orderBy("doc_id").collect()
    got = [(r.n_tokens, None if r.log_score is None else round(r.log_score, 6), r.n_backoffs) for r in found]
    for a, b in zip(got, brute(texts, order, backoff.ALPHA)):
        assert a[0] == b[0] and a[2] == b[2] and (a[1] is b[1] or a[1] == pytest.approx(b[1], abs=1e-5))


def test_awkward_rows(spark, awkward, nothing):
    found = backoff.report(awkward).collect()
    assert len(found) == awkward.count()
    assert all((r.log_score is None) == (r.n_tokens == 0) for r in found)
    seven = [r for r in found if r.doc_id == 7]
    assert seven[0] == seven[1]  # each knows the other
    assert backoff.report(nothing).count() == 0
    one = spark.createDataFrame([(1, "only this")], "doc_id long, text string")
    assert backoff.score(one).first().log_score == pytest.approx(3 * math.log(0.4))


@pytest.mark.parametrize("parts", [1, 2, 7, 108])
def test_hashes_and_counts_survive_packing(parts):
    rng = np.random.default_rng(parts)
    for n in (0, 1, 5, 3000):
        hashes = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        hashes = np.unique(np.concatenate([hashes, hashes[:3] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)[:n]]))
        starts, back = backoff._part_starts(parts), []
        for part, a, b in backoff._slices(hashes, parts):
            assert ((hashes[a:b] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == part).all()
            gaps, wide, width = backoff.pack_gaps(hashes[a:b], int(starts[part]))
            back += backoff.unpack_gaps(gaps, wide, width, int(starts[part])).tolist()
        assert back == hashes.tolist()
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], n)
        assert backoff.unpack_counts(*backoff.pack_counts(counts)).tolist() == counts.tolist()
