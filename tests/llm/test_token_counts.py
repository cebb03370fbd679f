import random

import pytest

from tidemark.llm import token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary()


def test_the_trie_agrees_with_one_word_at_a_time(vocabulary):
    rng = random.Random(1)
    letters = [b"a", b"b", b"c", b"the", b" ", b"on", b"\xc3\xa9", b"\0", b"ing"]
    words = sorted({b"".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))) for _ in range(3000)} | {b"a\0", b"\0"})
    counts, scores = token_counts.segment(words, vocabulary)
    for word, count, score in zip(words, counts, scores):
        alone = token_counts.segment_one(word, vocabulary)
        assert alone[0] == count and alone[1] == pytest.approx(score, abs=1e-9)


def test_best_of_all_segmentations():
    pieces = {b"a": -1.0, b"b": -1.5, b"ab": -2.0, b"ba": -2.2, b"aba": -4.0}
    vocabulary = token_counts.Vocabulary(pieces)

    def every(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                yield from ([word[:k], *rest] for rest in every(word[k:]))

    for word in (b"a", b"ab", b"aba", b"ababab", b"bbabaab"):
        best = max(sum(pieces[p] for p in s) for s in every(word))
        counts, scores = token_counts.segment([word], vocabulary)
        assert scores[0] == pytest.approx(best) and counts[0] in {len(s) for s in every(word) if sum(pieces[p] for p in s) == pytest.approx(best)}


def test_unknown_bytes_are_tokens_of_their_own():
    vocabulary = token_counts.Vocabulary({b"a": -1.0})
    assert token_counts.segment([b"axa"], vocabulary)[0].tolist() == [3]
    assert token_counts.segment_one(b"axa", vocabulary)[0] == 3


def test_texts(spark, awkward, nothing, vocabulary):
    found = token_counts.with_counts(awkward, vocabulary, "tokens")
    assert found.columns == [*awkward.columns, "tokens"] and found.count() == awkward.count()
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[2].tokens.n_tokens == 0 and by_id[3].tokens.n_tokens == 0
    assert by_id[13].tokens.n_pretokens == 1 and by_id[13].tokens.n_tokens >= 1
    text = by_id[8].text
    alone = [token_counts.segment_one(w.encode(), vocabulary)[0] for w in token_counts._PRETOKEN.findall(text)]
    assert by_id[8].tokens.n_tokens == sum(alone)
    assert token_counts.report(nothing).count() == 0


def test_pretokens_cover_the_text():
    text = "It's 3 o'clock —  café\n\n\tend. "
    assert "".join(token_counts._PRETOKEN.findall(text)) == text


def test_a_vocabulary_has_a_bound(tmp_path, monkeypatch):
    path = tmp_path / "v"
    path.write_text("YQ== 0\nYg== 1\n")
    assert set(token_counts.read_vocabulary(str(path)).pieces) == {b"a", b"b"}
    monkeypatch.setattr(token_counts, "MOST_PIECES", 1)
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(str(path))
