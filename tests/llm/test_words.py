import random

import pytest

from ledgerloom.llm import substrings, words


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_words_are_those_of_split(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab .,\n\t\r\x0b\x0cÉ\x1cZ") for _ in range(rng.randrange(90))).encode() for _ in range(200)] + [b"", b"", b"x" * 500 + b" y\n"]
    w = words.words(texts)
    seen = {}
    for k, t in enumerate(texts):
        tokens = t.lower().split()
        hashes = w.hashes[w.docs[k] : w.docs[k + 1]].tolist()
        assert len(tokens) == len(hashes)
        for token, h in zip(tokens, hashes):
            assert seen.setdefault(token, h) == h
        of = [i for i, p in enumerate(substrings.sentences(t)) for _ in p.split()]
        assert [a != b for a, b in zip(of, [*of[1:], -1])] == w.ends[w.docs[k] : w.docs[k + 1]].tolist()
    assert len(set(seen.values())) == len(seen)


def test_no_texts():
    w = words.words([])
    assert len(w.hashes) == 0 and w.docs.tolist() == [0]
