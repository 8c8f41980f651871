"""Reading the graph: lookup, adjacency, snapshot pages, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of edges, in the order that generated graphs take them.
EDGE_KINDS = ("DERIVED_FROM", "OBSERVED_IN_SESSION", "APPLIES_TO_PROJECT", "SUPPORTS", "CONTRADICTS", "SUPERSEDES", "DUPLICATES", "SAME_TOPIC_AS", "REQUIRES_SKILL")


def eligible(scope: str, project: str | None) -> Column:
    """Global requests see global nodes; others also their project's."""
    if scope == "global":
        return F.col("scope") == "global"
    return (F.col("scope") == "global") | F.col("project").eqNullSafe(F.lit(project))


def fresh(ts: Column, now: str, days: int | None) -> Column:
    """Not older than ``days``; no limit and unreadable times pass."""
    if days is None:
        return F.lit(True)
    return F.coalesce(F.try_to_timestamp(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)), F.lit(True))


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes by id or, failing that, by source key: two equi joins, no OR."""
    by_id = wanted.join(nodes, wanted["ref"] == nodes["id"]).withColumn("rank", F.lit(0))
    by_key = wanted.join(nodes, wanted["ref"] == nodes["source_key"]).withColumn("rank", F.lit(1))
    w = Window.partitionBy("ref").orderBy("rank", "id")
    return by_id.unionByName(by_key).select("*", F.row_number().over(w).alias("n")).where("n = 1").drop("n", "rank")


def filter_edges(edges: DataFrame, kinds: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Edges of the kinds, all if None, with at least that confidence."""
    kept = edges.where(F.col("confidence") >= least)
    return kept.where(F.col("kind").isin(*kinds)) if kinds is not None else kept


def adjacency(edges: DataFrame, node, direction: str = "both", kinds: list[str] | None = None, least: float = 0.0, limit: int = 500) -> DataFrame:
    """A page of a node's edges by id; ``truncated`` tells whether there are more."""
    kept = filter_edges(edges, kinds, least)
    out, into = kept.where(F.col("source_node_id") == node), kept.where(F.col("target_node_id") == node)
    both = {"outgoing": out, "incoming": into, "both": out.union(into).distinct()}[direction]
    first = both.orderBy("id").limit(limit + 1)
    w = Window.orderBy("id")
    return first.select("*", F.row_number().over(w).alias("n"), (F.count(F.lit(1)).over(Window.partitionBy()) > limit).alias("truncated")).where(F.col("n") <= limit).drop("n")


def inspect(nodes: DataFrame, revisions: DataFrame, edges: DataFrame, node: str, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A node, by id or source key, with its current revision; its incoming and its outgoing edges, a page of each."""
    wanted = nodes.sparkSession.createDataFrame([(node,)], "ref string")
    found = lookup(nodes, wanted).drop("ref")
    r = revisions.select(F.col("id").alias("current_revision_id"), *[F.col(c).alias(f"revision_{c}") for c in revisions.columns if c not in ("id", "node_id")])
    first = found.select("id").first()
    at = first["id"] if first else None
    return found.join(r, "current_revision_id", "left"), adjacency(edges, at, "incoming", limit=limit), adjacency(edges, at, "outgoing", limit=limit)


def in_scope(nodes: DataFrame, node: str, scope: str, project: str | None) -> None:
    """Raise unless the node is there and visible to the request."""
    rows = nodes.where(F.col("id") == node).select(eligible(scope, project).alias("ok")).limit(1).collect()
    if not rows:
        raise LookupError(f"no node {node}")
    if not rows[0]["ok"]:
        raise PermissionError(f"node {node} is outside the request's scope")


def snapshot_page(nodes: DataFrame, edges: DataFrame, node_limit: int, edge_limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and the first edges with both ends among them."""
    page = nodes.orderBy("id").limit(max(1, min(50_000, node_limit)))
    ids = page.select("id")
    inner = edges.join(ids.toDF("source_node_id"), "source_node_id", "left_semi").join(ids.toDF("target_node_id"), "target_node_id", "left_semi")
    return page, inner.orderBy("id").limit(max(0, min(200_000, edge_limit)))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, id, kind, confidence) in both directions, self-loops once."""
    one = edges.select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), "id", "kind", "confidence")
    return one.unionByName(one.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id", "kind", "confidence"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of ``start`` (id), by level joins."""
    steps = both_ways(edges).select("src", "dst")
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        new = steps.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen
