"""Even samples of few large groups, beside plain lists; no task sorts a whole group."""

from pyspark.sql import functions as F

from quillgraph.operators import folds


def test_places_of_groups(spark):
    rows = [(g, k) for g, n in (("a", 1000), ("b", 100), ("c", 101), ("d", 7), (None, 333)) for k in range(n)] + [("e", 5)] * 250 + [("f", None)]
    got = folds.systematic(spark.createDataFrame(rows, "g string, k int").repartition(5), "g", "k", 100).collect()
    groups = {}
    for g, k in rows:
        groups.setdefault(g, []).append(k)
    want = [(g, v) for g, ks in groups.items() for v in [sorted(ks, key=lambda k: -1 if k is None else k)[p] for p in sorted({i * len(ks) // 100 for i in range(100)})]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_group_is_sorted_in_ranges(spark):
    """Rows taken come out of several tasks, though all are of one group."""
    seen = folds.systematic(spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").alias("k")), "g", "k", 100)
    spots = seen.select("k", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["k"] for r in spots) == [i * 1000 for i in range(100)]
    assert len({r["p"] for r in spots}) > 1
