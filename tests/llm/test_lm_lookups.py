"""What a lookup of the trie reads, and words hashed from running sums."""

import random

import numpy as np

from quillgraph.llm import lm_trie, shingles


def sequence(v):
    return lm_trie.EliasFano(lm_trie.unpack(lm_trie.pack(lm_trie.ef_encode(v, "x"))), "x")


def test_lookups_equal_a_search_and_read_few_values(monkeypatch):
    rng = np.random.default_rng(2)
    read, lows = [], lm_trie.EliasFano.lows
    for n, top in ((1, 5), (300, 400), (3000, 10 ** 7), (20_000, 10 ** 9)):
        v = np.unique(np.concatenate([rng.integers(0, top, n), np.arange(min(n, 200))])).astype(np.uint64)  # with a run of neighbours
        e, n = sequence(v), len(v)
        asked = np.sort(np.concatenate([v, rng.integers(0, top + 9, n).astype(np.uint64)]))
        first = rng.integers(0, n + 1, len(asked))
        last = np.minimum(first + rng.integers(0, n + 1, len(asked)), n)
        for a, b in ((first, last), (np.zeros(len(asked), np.int64), np.full(len(asked), n))):
            at = np.searchsorted(v, asked)
            want = np.where((at >= a) & (at < b) & (v[np.minimum(at, n - 1)] == asked), at, -1)
            assert (e.successor(asked, a, b) == want).all()
        some = np.arange(n - 1)
        assert all((x == y).all() for x, y in zip(e.with_next(some), (v[:-1], v[1:])))
    monkeypatch.setattr(lm_trie.EliasFano, "lows", lambda self, i: read.append(len(i)) or lows(self, i))
    e.successor(v, np.zeros(n, np.int64), np.full(n, n))
    assert sum(read) < 2 * n


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(5)
    words = ["w" * k for k in (1, 2, 63, 64, 65, 300)] + ["é", "naïve", "\ud800", "\x00", "\x00\x00", "A", "Z9"] + [f"x{i}" for i in range(3000)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "x" * 200_000 + " y"] + [" ".join(rng.choice(words) + rng.choice(["", " ", "\n\t"]) for _ in range(k)) for k in (1, 50, 40_000)]
    seen = {}
    for text in texts:
        split, found = shingles.split_words(text), lm_trie.tokens(text)
        assert len(found) == len(split) + 1 and found[-1] == lm_trie.END
        for w, h in zip(split, found.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 3000
