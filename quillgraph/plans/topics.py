"""Topics of a plan's units, and who is woken for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The specialist that a unit's kind wakes, and which specialists talk in each topology.
WAKES = {"memory": "memory-cartographer", "skill": "proposal-editor", "source-cluster": "claim-scout", "session": "claim-scout", "resource": "claim-scout"}
SCOUT, CARTOGRAPHER, AUDITOR, EDITOR, SYNTHESIZER = "claim-scout", "memory-cartographer", "evidence-auditor", "proposal-editor", "decision-synthesizer"
GROUPS = {
    "pipeline": [(SCOUT, CARTOGRAPHER), (CARTOGRAPHER, AUDITOR), (AUDITOR, EDITOR), (EDITOR, SYNTHESIZER)],
    "debate-critique": [(SCOUT, CARTOGRAPHER), (CARTOGRAPHER, EDITOR), (SCOUT, AUDITOR), (AUDITOR, SYNTHESIZER), (EDITOR, SYNTHESIZER)],
    "sparse-blackboard": [(SCOUT, CARTOGRAPHER), (SCOUT, AUDITOR), (SCOUT, EDITOR), (CARTOGRAPHER, EDITOR), (AUDITOR, EDITOR), (EDITOR, SYNTHESIZER)],
}


def wake_target(kind: Column) -> Column:
    """The specialist for a unit's kind; null for unknown kinds."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in WAKES.items() for x in pair]), kind)


def communication(units: DataFrame, topology: str) -> DataFrame:
    """(unit_id, state, wake_target, attached): the blackboard wakes the scout alone; only awake units are attached."""
    target = F.lit(SCOUT) if topology == "sparse-blackboard" else wake_target(F.col("kind"))
    return units.select("unit_id", "state", target.alias("wake_target"), F.when(F.col("state") == "awake", target).alias("attached"))


def topic_chunks(units: DataFrame, contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(unit_id, chunk_id): chunks that a unit's nodes name, or that come from a source unit of its contexts.

    Units have unit_id and nodes; contexts unit_id and source_unit; chunks chunk_id
    and source_unit.  Two equi joins, no OR.
    """
    by_node = units.select("unit_id", F.explode("nodes").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id")
    by_unit = contexts.where("source_unit is not null").select("unit_id", "source_unit").distinct().join(chunks.select("chunk_id", "source_unit"), "source_unit")
    return by_node.select("unit_id", "chunk_id").unionByName(by_unit.select("unit_id", "chunk_id")).where("chunk_id is not null").distinct()


def topics(units: DataFrame, contexts: DataFrame, chunks: DataFrame, project: str) -> DataFrame:
    """(topic_id, unit_id, chunks, nodes, state) of every unit; without units one root topic of all chunks."""
    met = topic_chunks(units, contexts, chunks).groupBy("unit_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    rows = units.join(met, "unit_id", "left").select("unit_id", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), "nodes", "state")
    root = chunks.agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks")).join(units.agg(F.count(F.lit(1)).alias("n")).where("n = 0")).select(
        F.lit(None).cast("string").alias("unit_id"), "chunks", F.array().cast("array<string>").alias("nodes"), F.lit("awake").alias("state"))
    name = F.concat(F.lit("topic:"), F.substring(F.sha2(F.concat(F.lit(project), F.lit("\0"), F.coalesce("unit_id", F.lit("root"))), 256), 1, 12))
    return rows.unionByName(root).select(name.alias("topic_id"), "unit_id", "chunks", "nodes", "state")
