"""Bounded walks over the graph, a level at a time.

A walk is told as a queue: nodes in order of discovery, each one's edges in order of their ids,
until a limit is reached.  Here a level's events are one DataFrame, ordered by the
parent's place in the queue and the edge id.  Firsts of each edge and node are aggregates, budgets
are limits on an order, so what is accepted is at most as many rows as the budgets allow,
and only those rows reach the driver.  A parent's page of edges depends on what its
predecessors used up; the level is solved again with the pages so found until they agree, which settles
at least one more parent each time and nearly always at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import both_ways, eligible, filter_edges, in_scope

BUCKETS = 256


class Adjacency:
    """Edges in both directions (src, dst, id, kind, confidence), from a DataFrame or laid out in buckets of the source node."""

    def __init__(self, steps: DataFrame, buckets: int = 0):
        self.steps, self.buckets = steps, buckets

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        return cls(both_ways(edges))

    @classmethod
    def write(cls, edges: DataFrame, path: str, buckets: int = BUCKETS) -> Adjacency:
        """Lay edges out by bucket; within a bucket files are sorted by source, so that a few nodes read little of it."""
        rows = both_ways(edges).withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "src", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return cls.read(edges.sparkSession, path, buckets)

    @classmethod
    def read(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> Adjacency:
        return cls(spark.read.schema("src string, dst string, id string, kind string, confidence double, bucket int").parquet(path), buckets)

    def where(self, condition: Column) -> Adjacency:
        return Adjacency(self.steps.where(condition), self.buckets)

    def around(self, front: list[str]) -> DataFrame:
        """Edges of the nodes, with the node's place in the list; of a bucketed layout only their buckets are read."""
        spark = self.steps.sparkSession
        steps = self.steps
        if self.buckets:
            mine = spark.createDataFrame([(n,) for n in front], "n string").select(F.pmod(F.xxhash64("n"), F.lit(self.buckets)).cast("int").alias("b"))
            steps = steps.where(F.col("bucket").isin([r["b"] for r in mine.distinct().collect()])).drop("bucket")
        return steps.join(F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(front)], "src string, pos int")), "src")


def _pages(events: DataFrame, most: int) -> DataFrame:
    """The first ``most`` edges of each parent, numbered; Spark cuts a hub's edges down where they are read."""
    return events.select("*", F.row_number().over(Window.partitionBy("pos").orderBy("id")).alias("page")).where(F.col("page") <= most)


def _within(pages: DataFrame, limits: list[int]) -> DataFrame:
    """Rows within each parent's own page."""
    if len(set(limits)) == 1:
        return pages.where(F.col("page") <= limits[0])
    table = pages.sparkSession.createDataFrame(list(enumerate(limits)), "pos int, most int")
    return pages.join(F.broadcast(table), "pos").where(F.col("page") <= F.col("most")).drop("most")


def _ids(spark: SparkSession, ids, name: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(x,) for x in ids], f"{name} string"))


@dataclass
class Hydrated:
    nodes: dict[str, int | None]  # known nodes; the depth of those that were queued
    edges: list[str] = field(default_factory=list)


def hydrate(nodes: DataFrame, adjacency: Adjacency, known: list[str], seeds: list[str], hops: int, max_nodes: int, max_edges: int) -> Hydrated:
    """Nodes and edges that a plan from ``seeds`` may need: all kinds, any confidence, any scope.

    ``known`` nodes count towards ``max_nodes`` and are walked through once an edge leads to them.
    A node's page holds as many edges as are still free when its turn comes; edges to nodes that are
    missing or no longer fit are kept, their nodes are not walked.
    """
    spark = nodes.sparkSession
    out = Hydrated(dict.fromkeys([*known, *seeds]))
    out.nodes |= dict.fromkeys(seeds, 0)
    used: dict[str, None] = {}
    front = list(dict.fromkeys(seeds))
    for level in range(1, hops + 1):
        free = max_edges - len(used)
        if not front or free <= 0:
            break
        pages = _pages(adjacency.around(front), free).select("pos", "id", "dst", "page").persist()
        try:
            limits = [free] * len(front)
            while True:
                mine = _within(pages, limits)
                first = mine.join(_ids(spark, used, "u"), F.col("id") == F.col("u"), "left_anti").groupBy("id").agg(F.min("pos").alias("pos"))
                new = {r["pos"]: r["n"] for r in first.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a parent
                left, then = free, []
                for p in range(len(front)):
                    then.append(max(left, 0))
                    left -= new.get(p, 0)
                if then == limits:
                    break
                longest = {r["pos"]: r["n"] for r in pages.groupBy("pos").agg(F.max("page").alias("n")).collect()}
                same = all(min(longest.get(p, 0), a) == min(longest.get(p, 0), b) for p, (a, b) in enumerate(zip(limits, then)))
                limits = then
                if same:
                    break
            mine = _within(pages, limits)
            edges = mine.groupBy("id").agg(F.min(F.struct("pos", "id")).alias("at")).orderBy("at").limit(max_edges).collect()
            used |= dict.fromkeys(r["id"] for r in edges)
            first = mine.groupBy("dst").agg(F.min(F.struct("pos", "id")).alias("at"))
            room = max_nodes - len(out.nodes)
            fresh = first.join(_ids(spark, out.nodes, "k"), F.col("dst") == F.col("k"), "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
            more = fresh.orderBy("at").limit(max(room, 0)).collect()
            waiting = [n for n, d in out.nodes.items() if d is None]
            met = first.join(_ids(spark, waiting, "k"), F.col("dst") == F.col("k"), "left_semi").collect() if waiting else []
        finally:
            pages.unpersist()
        front = [r["dst"] for r in sorted([*more, *met], key=lambda r: r["at"])]
        out.nodes |= dict.fromkeys(front, level)
    out.edges = list(used)
    return out


@dataclass
class Neighbourhood:
    nodes: DataFrame             # id, depth
    edges: DataFrame             # id
    truncated: dict[str, bool]   # nodes, edges, depth


def neighbourhood(nodes: DataFrame, edges: DataFrame | Adjacency, root: str, depth: int = 1, max_nodes: int = 100, max_edges: int = 300, scope: str = "global", project: str | None = None,
                  kinds: list[str] | None = None, least: float = 0.0) -> Neighbourhood:
    """The bounded walk from a node: depth at most 6, 1000 nodes and 3000 edges at most.

    ``nodes`` has id, scope and project.  A root that is missing (LookupError) or not visible to
    the request (PermissionError) is refused; other invisible nodes are passed over.  An edge counts first and
    is taken back if its node no longer fits.  Each node's page holds one edge more than is still free; ``truncated`` tells
    whether nodes or edges were left out, or the walk ended for its depth.
    """
    in_scope(nodes, root, scope, project)
    spark = nodes.sparkSession
    depth, max_nodes, max_edges = max(0, min(6, depth)), max(1, min(1000, max_nodes)), max(0, min(3000, max_edges))
    adjacency = (edges if isinstance(edges, Adjacency) else Adjacency.of(edges))
    adjacency = Adjacency(filter_edges(adjacency.steps, kinds, least), adjacency.buckets)
    visible = nodes.where(eligible(scope, project)).select(F.col("id").alias("dst"))
    found, used, front = {root: 0}, {}, [root]
    cut = dict.fromkeys(("nodes", "edges", "depth"), False)
    for level in range(1, depth + 2):
        if not front:
            break
        start = len(used)
        # one row beyond the largest page, to see that there are more
        pages = _pages(adjacency.around(front), max(1, max_edges - start + 1) + 1).select("pos", "id", "dst", "page")
        pages = pages.join(visible.withColumn("seen", F.lit(True)), "dst", "left").persist()
        try:
            limits = [max(1, max_edges - start + 1)] * len(front)
            rows: list = []
            chosen: list[str] = []
            while level <= depth:
                events = _within(pages, limits).where("seen")
                first = events.join(_ids(spark, used, "u"), F.col("id") == F.col("u"), "left_anti").groupBy("id", "dst").agg(F.min("pos").alias("pos"))
                # an edge between two nodes of the level comes up at both ends, each time with the other as target
                first = first.groupBy("id").agg(F.min(F.struct("pos", "dst")).alias("e")).select("e.pos", "id", "e.dst")
                fresh = first.join(_ids(spark, found, "k"), F.col("dst") == F.col("k"), "left_anti").groupBy("dst").agg(F.min(F.struct("pos", "id")).alias("at"))
                chosen = [r["dst"] for r in fresh.orderBy("at").limit(max_nodes - len(found)).collect()]
                rows = first.join(_ids(spark, [*found, *chosen], "k"), F.col("dst") == F.col("k"), "left_semi").orderBy("pos", "id").limit(max_edges - start).collect()
                then, size, at = [], start, 0
                for p in range(len(front)):
                    then.append(max(1, max_edges - size + 1))
                    while at < len(rows) and rows[at]["pos"] == p:
                        size, at = size + 1, at + 1
                if then == limits:
                    break
                longest = {r["pos"]: r["n"] for r in pages.groupBy("pos").agg(F.max("page").alias("n")).collect()}  # a row a parent
                same = all(min(longest.get(p, 0), a) == min(longest.get(p, 0), b) for p, (a, b) in enumerate(zip(limits, then)))
                limits = then
                if same:
                    break
            mine = _within(pages, limits)
            cut["edges"] |= pages.count() > mine.count()
            if level > depth:
                cut["depth"] |= not mine.where("seen").isEmpty()
                break
            used |= dict.fromkeys(r["id"] for r in rows)
            left = mine.where("seen").join(_ids(spark, used, "u"), F.col("id") == F.col("u"), "left_anti")
            if len(used) >= max_edges:
                # what comes after the last edge that fits finds no room; what came before had no room for its node
                last = F.struct(F.lit(rows[-1]["pos"]).alias("pos"), F.lit(rows[-1]["id"]).alias("id")) if rows else F.struct(F.lit(-1).alias("pos"), F.lit("").alias("id"))
                late = F.struct("pos", "id") > last
                cut["edges"] |= not left.where(late).isEmpty()
                left = left.where(~late)
            cut["nodes"] |= not left.isEmpty()
        finally:
            pages.unpersist()
        have = {r["dst"] for r in rows}
        front = [n for n in chosen if n in have]
        found |= dict.fromkeys(front, level)
    return Neighbourhood(spark.createDataFrame(list(found.items()), "id string, depth int"), spark.createDataFrame([(e,) for e in used], "id string"), cut)
