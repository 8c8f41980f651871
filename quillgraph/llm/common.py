"""Helpers shared by the operators: scratch tables, row keys, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What separates words and is stripped from lines: blank and TAB to CR.
BLANKS = r"\x20\x09-\x0D"
#: Whether Spark removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written to the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir``; a session without one gets a local
    temporary folder if it is local itself (tests), else an error.  A table cuts the lineage: a lost executor
    costs the tasks that ran on it, not the steps before the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="scratch-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame, observation: Observation | None = None) -> DataFrame:
        """Write ``df`` and read it again."""
        return self.spark.read.schema(df.schema).parquet(self.path(df, observation))

    def path(self, df: DataFrame, observation: Observation | None = None) -> str:
        """Write ``df`` and return where it lies; the shuffle files behind it are then of no more use and go."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (df.observe(observation, *observation_columns(df)) if observation else df).write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return path

    def drop(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def observation_columns(df: DataFrame) -> list[Column]:
    """Row count and an order-free checksum of a table of edges."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, split at runs of blanks; null gives no words."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{BLANKS}]+")
    return F.filter(split, lambda w: w != "")


def own(df: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    """The frame's columns, safe for names with dots."""
    return [df[f"`{c}`"] for c in df.columns if c not in skip]


def with_decision(docs: DataFrame, decision: DataFrame, how: str = "left", key: str = "doc_id") -> DataFrame:
    """Join columns of ``decision`` to ``docs`` on a nullable key.

    ``decision`` has the key as ``_llm_key`` and its columns named ``_llm_*``,
    so that no column of ``docs`` clashes.
    """
    return docs.join(decision, docs[key].eqNullSafe(decision["_llm_key"]), how)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """Deal an aggregated side out anew, so that a join on ``keys`` has a shuffle of
    its own on both sides and the adaptive planner can split a hot key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two integer columns; the result has ``node`` and ``component``
    (the smallest node reachable) for every node that an edge touches.  Each
    round is a few joins on the node, written as a table; hot nodes are split by
    the adaptive planner, and nothing but a count and a checksum reaches the
    driver.  Raises if ``rounds`` don't suffice.
    """
    a, b = edges.columns
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    seen = Observation()
    path = scratch.path(first, seen)
    state, start = seen.get, path
    read = scratch.spark.read.schema("u bigint, v bigint").parquet
    if not state["n"]:
        return read(path).select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        now = read(path)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        middle = scratch.path(large)
        large = read(middle)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        seen = Observation()
        new = scratch.path(small, seen)
        scratch.drop(middle)
        if path != start:
            scratch.drop(path)
        path = new
        if seen.get == state:
            break
        state = seen.get
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = read(path)
    tops = ends.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
