"""The change journal: pages, retention and replay, last operation wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETAINED, NODE_CAP, EDGE_CAP = 1000, 5000, 20000


def page(journal: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """Entries after a sequence, in order."""
    return journal.where(F.col("sequence") > after).orderBy("sequence").limit(max(1, min(1000, limit)))


def retain(journal: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The last ``keep`` sequences."""
    top = journal.agg(F.max("sequence").alias("top"))
    return journal.join(F.broadcast(top)).where(F.col("sequence") > F.col("top") - keep).drop("top")


def bounds(journal: DataFrame) -> DataFrame:
    return journal.agg(F.coalesce(F.min("sequence"), F.lit(0)).alias("first"), F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))


def replay(changes: DataFrame, after: int = 0) -> DataFrame:
    """(entity, id, op, sequence): the last operation of each id.

    ``changes`` has sequence, entity, op, id; within one sequence removals come
    after creations and updates.
    """
    rank = F.when(F.col("op") == "removed", 1).otherwise(0)
    last = F.max(F.struct("sequence", rank.alias("rank"), "op")).alias("l")
    return changes.where(F.col("sequence") > after).groupBy("entity", "id").agg(last).select("entity", "id", F.when(F.col("l.op") == "removed", "removed").otherwise("upsert").alias("op"), F.col("l.sequence").alias("sequence"))


def replay_state(changes: DataFrame, after: int, node_cap: int = NODE_CAP, edge_cap: int = EDGE_CAP) -> DataFrame:
    """One row: first, last, changed nodes and edges, and whether a reader must start anew.

    It must if its place has fallen out of the journal, lies ahead of it, or more
    changed than the caps allow.
    """
    ends = changes.agg(F.coalesce(F.min("sequence"), F.lit(0)).alias("first"), F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    counts = replay(changes, after).agg(F.count_if(F.col("entity") == "node").alias("nodes"), F.count_if(F.col("entity") == "edge").alias("edges"))
    a = F.lit(after)
    return ends.join(F.broadcast(counts)).select("*", ((a > F.col("last")) | (a + 1 < F.col("first")) | (F.col("nodes") > node_cap) | (F.col("edges") > edge_cap)).alias("reset_required"))


def hydrate(replayed: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    """Current rows of the upserted ids."""
    ids = replayed.where((F.col("entity") == entity) & (F.col("op") == "upsert")).select("id")
    return rows.join(ids, "id", "left_semi")


def apply_changes(state: DataFrame, replayed: DataFrame, current: DataFrame, entity: str) -> DataFrame:
    """A reader's copy brought up to date."""
    mine = replayed.where(F.col("entity") == entity)
    return state.join(mine.select("id"), "id", "left_anti").unionByName(hydrate(replayed, current, entity))
