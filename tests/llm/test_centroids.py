"""Centroid clustering beside plain whole-number rounds, and on odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, v string, `a.b` int"


def by_hand(rows, k, rounds):
    """(cluster, distance) of each row and the last centroids, with Python's whole numbers."""
    x = [[int(v) for v in r] for _, r in rows]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, x) if i is not None)
    c = [v for _, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for v, (_, o) in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(o, d) for d, o in assign()], c


@pytest.mark.parametrize("spread", [3, 40, 30_000_000])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i % 280 if i % 50 else None, [float(v) for v in rng.integers(-spread, spread, 4)]) for i in range(300)]
    rows += rows[:20]  # repeated rows
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, v array<double>"), 12, 5, 4).collect()
    want, c = by_hand(rows, 12, 5)
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    per = [sum(d for o, d in want if o == j) for j in range(12)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got], key=key) == sorted(
        [(i, o, d, per[o], sum(per), digest[o]) for (i, _), (o, d) in zip(rows, want)], key=key)


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-9, 9, (200, 6)) + 100 * j for j in range(5)]).astype(float)
    c = np.array([x[200 * j] for j in range(5)])
    own, up, low = centroids.nearest(x, c)
    for _ in range(4):
        new = np.array([np.floor(x[own == j].mean(0)) for j in range(5)])
        own, up, low, scanned = centroids.step(x, own, up, low, c, new)
        assert scanned < 20 and (own == centroids.squares(x, new).argmin(1)).all()
        assert (up ** 2 * (1 + 1e-8) >= centroids.squares(x, new)[np.arange(len(x)), own]).all()
        c = new


def test_odd_vectors(spark):
    good = [(i, [float(i % 7), 1.0]) for i in range(6)]
    rows = [*good, (90, None), (91, [None, 1.0]), (92, [float("nan"), 0.0]), (93, [1.0]), (94, []), (95, [float("inf"), 0.0]), (96, [1.0, 2.0, 3.0]), (None, [2.0, 2.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA)
    got = centroids.cluster(centroids.to_whole(df, 2), 40, 2, 2).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["0", "1", "2", "3", "4", "5", "None"]
    assert len({r["cluster"] for r in got}) == 6
    empty = centroids.to_whole(df.where("false"), 2)
    assert centroids.cluster(empty, 40, 2, 2).count() == 0
    assert centroids.cluster(centroids.to_whole(df.where("vec_id is null"), 2), 40, 2, 2).count() == 0
    assert [r["v"] for r in centroids.to_whole(df.where(F.col("vec_id") == 3), 2).collect()] == [[768.0, 256.0]]


def test_distances_beyond_64_bits_raise(spark):
    far = spark.createDataFrame([(1, [0.0]), (2, [3e18]), (3, [1e19])], "vec_id bigint, v array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(far, 1, 1, 1).count()
