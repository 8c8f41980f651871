"""Incremental graph sync: staging rows to nodes, revisions, edges, and what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text

ENTITIES = ("node", "revision", "edge")
INDEXER = "1"


@dataclass
class Graph:
    nodes: DataFrame
    revisions: DataFrame
    edges: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "revisions": self.revisions, "edges": self.edges}


def require_empty(df: DataFrame, what: str, shown: int = 5) -> None:
    """Raise if ``df`` has rows; names a few."""
    bad = df.limit(shown).collect()
    if bad:
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def duplicate_keys(items: DataFrame) -> DataFrame:
    return items.groupBy("source_adapter", "source_key").count().where("count > 1")


def stage(items: DataFrame, previous: Graph | None = None, now: str | None = None, indexer: str = INDEXER) -> tuple[DataFrame, DataFrame]:
    """Nodes and revisions of staging items; unchanged revisions keep the time they were indexed."""
    node = identity.node_id(F.col("source_adapter"), F.col("source_key"))
    rows = items.select(node.alias("id"), "*", identity.content_hash(F.col("content")).alias("content_hash"), text.normalise_newlines(F.col("content")).alias("body"))
    rows = rows.select("*", identity.revision_id(F.col("id"), F.col("content_hash"), F.lit(indexer)).alias("rev"))
    nodes = rows.select("id", "source_adapter", "source_key", "kind", "scope", "project", "label", "uri", F.col("rev").alias("current_revision_id"), "metadata")
    revisions = rows.select(F.col("rev").alias("id"), F.col("id").alias("node_id"), "content_hash", F.lit(indexer).alias("indexer_version"), F.col("body").alias("content"),
                            text.utf16_length(F.col("body")).alias("char_count"), F.lit(now).cast("string").alias("indexed_at"), "source_modified_at")
    if previous is not None:
        old = previous.revisions.select(F.col("id").alias("old_id"), F.col("indexed_at").alias("old_at"))
        revisions = revisions.join(old, F.col("id") == F.col("old_id"), "left").withColumn("indexed_at", F.coalesce("old_at", "indexed_at")).drop("old_id", "old_at")
    return nodes, revisions


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of staging edges that no node has."""
    ends = edges.select(F.col("source_adapter").alias("a"), F.col("source_key").alias("k")).union(edges.select("target_adapter", "target_key")).distinct()
    return ends.join(nodes, (ends.a == nodes.source_adapter) & (ends.k == nodes.source_key), "left_anti")


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staging edges with ids; of edges that share an id the last in input order stays."""
    s = nodes.select(F.col("source_adapter"), F.col("source_key"), F.col("id").alias("source_node_id"), F.col("current_revision_id").alias("source_revision_id"))
    t = nodes.select(F.col("source_adapter").alias("target_adapter"), F.col("source_key").alias("target_key"), F.col("id").alias("target_node_id"))
    rows = edges.join(s, ["source_adapter", "source_key"]).join(t, ["target_adapter", "target_key"])
    eid = identity.edge_id(F.col("source_node_id"), F.col("target_node_id"), F.col("kind"), F.col("source_revision_id"), F.col("derivation"))
    rows = rows.select(eid.alias("id"), "source_node_id", "target_node_id", "kind", "source_revision_id", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"),
                       F.to_json(F.struct("derivation", "evidence_refs", "metadata")).alias("provenance"), "input_pos")
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("id", "input_pos")]), "input_pos").alias("r")
    return rows.groupBy("id").agg(last).select("id", "r.*")


def diff(entity: str, before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(entity, op, id) of a full outer comparison; rows count as changed if any column differs."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"k_{name}"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(after.columns)], *[F.col(c).isNull() for c in sorted(after.columns)]).alias(name))
    both = packed(before, "b").join(packed(after, "a"), F.col("k_b") == F.col("k_a"), "full_outer")
    op = F.when(F.col("k_b").isNull(), "created").when(F.col("k_a").isNull(), "removed").when(F.col("a") != F.col("b"), "updated")
    return both.select(F.lit(entity).alias("entity"), op.alias("op"), F.coalesce("k_a", "k_b").alias("id")).where("op is not null")


def sync(items: DataFrame, edges: DataFrame, previous: Graph | None, now: str, check: bool = True) -> tuple[Graph, DataFrame]:
    """The next graph and its delta as (entity, op, id) rows."""
    if check:
        require_empty(duplicate_keys(items), "duplicate source keys")
    nodes, revisions = stage(items, previous, now)
    if check:
        require_empty(unresolved(edges, nodes), "edges without nodes")
    graph = Graph(nodes, revisions, resolve(edges, nodes))
    empty = Graph(*[t.where(F.lit(False)) for t in graph.tables().values()])
    parts = [diff(e, b, a) for e, b, a in zip(ENTITIES, (previous or empty).tables().values(), graph.tables().values())]
    # revisions are never changed in place
    return graph, parts[0].unionByName(parts[1].where("op <> 'updated'")).unionByName(parts[2])


def summary(delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counters."""
    def n(entity: str, op: str):
        return F.count_if((F.col("entity") == entity) & (F.col("op") == op)).alias(f"{entity}s_{op}")
    row = delta.agg(*[n(e, o) for e in ENTITIES for o in ("created", "updated", "removed")])
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    return row.join(F.broadcast(total)).select(*row.columns, (F.col("n") - F.col("nodes_created") - F.col("nodes_updated")).alias("nodes_unchanged"))


def dangling(graph: Graph) -> DataFrame:
    """Foreign keys that point nowhere, as (what, id)."""
    n, r, e = graph.nodes, graph.revisions, graph.edges
    def missing(what: str, left: DataFrame, col: str, right: DataFrame) -> DataFrame:
        return left.select(F.col(col).alias("id")).join(right.select(F.col("id")), "id", "left_anti").select(F.lit(what).alias("what"), "id")
    return (missing("current revision", n, "current_revision_id", r).unionByName(missing("revision's node", r, "node_id", n))
            .unionByName(missing("edge source", e, "source_node_id", n)).unionByName(missing("edge target", e, "target_node_id", n)))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.select("*", F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")
