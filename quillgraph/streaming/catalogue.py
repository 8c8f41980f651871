"""The file catalogue: which files are new, changed, cached or gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(path, action): probe new and changed files, skip cached ones whose filter failed, hit the others, drop lost ones.

    Listing and state have path, size, mtime_ns; state also content_indexed and matches.
    """
    s = state.select(F.col("path").alias("s_path"), F.col("size").alias("s_size"), F.col("mtime_ns").alias("s_mtime"), "content_indexed", "matches")
    j = listing.join(s, F.col("path") == F.col("s_path"), "full_outer")
    same = F.col("size").eqNullSafe(F.col("s_size")) & F.col("mtime_ns").eqNullSafe(F.col("s_mtime"))
    action = (F.when(F.col("path").isNull(), "drop").when(F.col("s_path").isNull(), "probe").when(~same, "probe")
              .when(F.col("content_indexed"), "hit").when(F.coalesce("matches", F.lit(False)), "read").otherwise("skip"))
    return j.select(F.coalesce("path", "s_path").alias("path"), action.alias("action"))


def diagnostics(decided: DataFrame) -> DataFrame:
    """One row of counters."""
    return decided.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("probe", "changed_files"), ("hit", "cache_hits"), ("read", "full_scans"), ("skip", "skipped"), ("drop", "removed"))])


def upsert(state: DataFrame, fresh: DataFrame, decided: DataFrame) -> DataFrame:
    """State rows after a pass: lost and re-read files out, fresh rows in."""
    gone = decided.where("action = 'drop'").select("path").unionByName(fresh.select("path")).distinct()
    return state.join(gone, "path", "left_anti").unionByName(fresh)
