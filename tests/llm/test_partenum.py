"""PartEnum signatures and the join beside brute force."""

import random

import numpy as np
import pytest

from quillgraph.llm import partenum

SCHEMA = "doc_id bigint, text string, component string, `sig` int, `a.b` int"


def brute(rows, percent):
    """(n_shingles, component) by comparing all pairs."""
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.mark.parametrize("fine", [False, True])
def test_similar_sets_share_signatures(fine):
    """Sets at 0.8 and just above share at least one signature of a band, or as many fine ones as promised."""
    rng, tried = np.random.default_rng(1), 0
    ks = partenum.differences(partenum.bands(80), 80)
    for n in (*range(4, 60), 77, 150, 333, 1000):
        for _ in range(6):
            union = np.unique(rng.integers(0, 1 << 62, n))
            shared = -(-len(union) * 8 // 10)
            mine = rng.integers(0, len(union) - shared + 1)
            x = np.sort(np.delete(union, rng.permutation(len(union))[:0]))
            rest = rng.permutation(len(union))[:len(union) - shared]
            a, b = np.delete(x, rest[:mine]), np.delete(x, rest[mine:])
            if len(a) == len(b) == len(x):
                continue
            of, band, sig = partenum.sign(np.concatenate([a, b]), np.array([len(a), len(b)]), 80, fine)
            one = set(zip(band[of == 0].tolist(), sig[of == 0].tolist()))
            two = set(zip(band[of == 1].tolist(), sig[of == 1].tolist()))
            top = int(np.searchsorted(partenum.bands(80), max(len(a), len(b))))
            met = sum(p[0] == top for p in one & two)
            k = int(ks[top])
            assert met >= partenum.agreeing(k, fine) >= 1
            tried += 1
    assert tried > 300


def test_bitmaps_differ_no_more_than_their_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, n)) for n in (1, 5, 300, 4000)]
    sets += [np.union1d(x[:-1], rng.integers(0, 1 << 62, 3)) for x in sets] + [sets[2].copy()]
    bits = partenum.bitmaps(np.concatenate(sets), np.array([len(x) for x in sets]))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            far = int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum())
            assert far <= len(np.setxor1d(x, y)) and (far == 0) == (i == j or {i, j} == {2, 8})


def edited(rng, words, rate):
    return [f"e{rng.randrange(10 ** 6)}" if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 5, 8, 9, 12, 20, 60, 200, 900)))]
        rows += [" ".join(edited(rng, base, rng.choice((0, 0.005, 0.02, 0.04)))) for _ in range(6)]
    for _ in range(80):  # a passage that many share, with little or much of their own
        rows.append(" ".join(common + [f"o{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 60))]))
    rows += ["one two", "one two", "one", "", None, " \t "]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.similar_documents(df).collect()}
    want = brute(sorted(rows), 80)
    assert got == want and len(set(c for _, c in want.values())) < len(rows) - 60


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (None, base), (3, base + " tail"), (3, "other text of its own and of none"), (4, None), (5, " \n "), (6, "x " * 300), (7, " ".join(f"l{i}" for i in range(30_000))), (7, " ".join(f"l{i}" for i in range(29_000)))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in partenum.similar_documents(df).collect())
    # both texts of document 3 count, so its class reaches document 1
    assert got == sorted([("1", 56, "1"), ("None", 56, "None"), ("3", 57, "1"), ("3", 4, "1"), ("4", 0, "4"), ("5", 0, "5"), ("6", 1, "6"), ("7", 29996, "7"), ("7", 28996, "7")])
    assert partenum.similar_documents(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        partenum.similar_documents(df, 40)
