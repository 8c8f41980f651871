"""Retrieval evaluation and deterministic graph fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .graph import EDGE_KINDS

# The kinds of generated nodes in turn, and the steps of generated edges.
KIND_CYCLE = ("memory", "memory", "memory", "session", "skill", "source_document", "evidence")
OFFSETS = (1, 7, 31, 127, 509, 1021, 4093)


def evaluate(holdouts: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """One row: holdouts, recall, durable recall, duplicate rate.

    Holdouts have id, query, target; results holdout_id, unit_id, session_id,
    rank, text.  A hit is durable if the first hit shares two query tokens.
    """
    top = results.where(F.col("rank") <= k)
    pairs = holdouts.join(top, F.col("id") == F.col("holdout_id"), "left")
    hit = F.when(F.col("session_id") == F.col("target"), F.col("rank"))
    one = pairs.groupBy("id", "query", "target").agg(F.min(hit).alias("place"), F.min_by("text", hit).alias("hit_text"), F.count("unit_id").alias("n"), F.count_distinct("unit_id").alias("kinds"))
    shared = F.size(F.array_intersect(text.tokens(F.col("query"), 3, text.SEARCH_STOP_WORDS), text.tokens(F.col("hit_text"), 3, text.SEARCH_STOP_WORDS)))
    one = one.select("*", F.col("place").isNotNull().alias("found"), (F.col("place").isNotNull() & (shared >= 2)).alias("durable"))
    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)
    n = F.count(F.lit(1))
    return one.agg(n.alias("holdouts"), share(F.count_if("found"), n).alias("recall"), share(F.count_if("durable"), n).alias("durable_recall"),
                   share(F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("duplicate_rate"))


def fixture_nodes(spark: SparkSession, n: int) -> DataFrame:
    """Generated staging nodes, by arithmetic on their number."""
    i = F.col("id")
    suffix = F.lpad(i.cast("string"), 8, "0")
    kind = F.element_at(F.array(*map(F.lit, KIND_CYCLE)), (i % 7 + 1).cast("int"))
    whole = i % 50 == 0
    return spark.range(n).select(i.alias("n"), F.concat(F.lit("fixture:"), suffix).alias("source_key"), kind.alias("kind"), F.when(whole, "global").otherwise("project").alias("scope"),
                                 F.when(~whole, "/fixture/project").alias("project"), F.concat(F.lit("topic-"), (i % 251).cast("string"), F.lit(" group-"), (i % 97).cast("string")).alias("content"),
                                 F.concat(F.lit("2026-07-"), F.lpad((i % 10 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z")).alias("modified"))


def fixture_edges(spark: SparkSession, nodes: int, edges: int) -> DataFrame:
    """Generated edges: lanes of fixed steps around the ring of nodes."""
    j = F.col("id")
    src, lane = j % nodes, F.floor(j / nodes)
    step = F.element_at(F.array(*map(F.lit, OFFSETS)), (lane % 7 + 1).cast("int")) + 2 * F.floor(lane / 7)
    dst = (src + step) % nodes
    return spark.range(edges).select(j.alias("e"), src.alias("src"), F.when(dst == src, (dst + 1) % nodes).otherwise(dst).alias("dst"),
                                     F.element_at(F.array(*map(F.lit, EDGE_KINDS)), (j % 9 + 1).cast("int")).alias("kind"), (F.lit(0.5) + (j % 51) / 100).alias("confidence"))
