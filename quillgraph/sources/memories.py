"""Markdown notes as records: one per bullet, with heading, project and origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from .files import read_texts

FRONT = ("thread_id", "updated_at", "rollout_path", "cwd")


def origin_kind(rel):
    """What kind of note a relative path is."""
    return (F.when(rel == "MEMORY.md", "memory-index").when(rel == "memory_summary.md", "memory-summary").when(rel == "raw_memories.md", "raw-memory")
            .when(rel.startswith("rollout_summaries/"), "rollout-summary").when(rel.startswith("extensions/ad_hoc/"), "ad-hoc-note")
            .when(rel.startswith("skills/"), "skill-note").otherwise("unknown"))


def read_notes(spark: SparkSession, home: str) -> DataFrame:
    """rel, text, origin and front matter of every note below ``home``."""
    rows = read_texts(spark, home, "*.md")
    rel = F.regexp_replace("path", "^.*?/memories/", "")
    front = [F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{f}:\s*(.+)$", 1)), F.lit("")).alias(f) for f in FRONT]
    return rows.select(rel.alias("rel"), text.normalise_newlines(F.col("text")).alias("text"), *front).select("*", origin_kind(F.col("rel")).alias("origin"))


def inline_fields(line):
    """``(k=v, k=v)`` lists as a map; null without a thread id."""
    inner = F.regexp_extract(line, r"\(([^()]*thread_id=[^()]*)\)", 1)
    pairs = F.filter(F.split(inner, r"\s*,\s*"), lambda p: F.contains(p, F.lit("=")))
    return F.when(inner != "", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^\s*([^=]+)=", 1), F.regexp_extract(p, r"=(.*)$", 1)))))


def to_records(notes: DataFrame) -> DataFrame:
    """One row per bullet: id, rel, line, heading, project, type, scope, body.

    The heading is the nearest one above; the project is the first path of the
    section's first ``applies_to:`` (else ``scope:``) line above the bullet.  An
    ad-hoc note without bullets is one record of its whole text.
    """
    lines = notes.select("rel", "origin", "thread_id", "updated_at", "cwd", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("rel").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.trim(F.regexp_extract("line", r"^#+\s+(.+)$", 1)), F.lit(""))
    rows = lines.select("*", F.last(heading, ignorenulls=True).over(w).alias("heading"), F.sum(F.col("line").rlike(r"^#\s+").cast("int")).over(w).alias("section"))
    s = Window.partitionBy("rel", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    def first_path(prefix: str):
        value = F.nullif(F.regexp_extract("line", rf"^{prefix}:\s*(.*)$", 1), F.lit(""))
        found = F.first(value, ignorenulls=True).over(s)
        return F.nullif(F.trim(F.element_at(F.split(F.regexp_extract(found, r"(?:cwd=)?(/[^,;]+)", 1), r"\s+(?:and|with|plus)\s+"), 1)), F.lit(""))
    rows = rows.select("*", F.coalesce(first_path("applies_to"), first_path("scope"), F.col("cwd")).alias("project"))
    bullet = F.regexp_extract("line", r"^\s*-\s+(.+)$", 1)
    bullets = rows.where(bullet != "").select("rel", "origin", (F.col("pos") + 1).alias("line"), "heading", "project", text.squeeze(bullet).alias("body"),
                                              F.coalesce(inline_fields(F.col("line"))["thread_id"], F.col("thread_id")).alias("thread_id"), "updated_at")
    plain = notes.where("origin = 'ad-hoc-note'").join(bullets.select("rel").distinct(), "rel", "left_anti").select(
        "rel", "origin", F.lit(1).alias("line"), F.lit(None).cast("string").alias("heading"), F.col("cwd").alias("project"), text.compact(F.col("text"), 1600).alias("body"), "thread_id", "updated_at")
    every = bullets.unionByName(plain).where("body <> ''")
    key = F.concat(F.lit("memory:"), F.col("rel"), F.lit(":"), F.col("line").cast("string"))
    return every.select(key.alias("id"), "*", text.memory_type(F.col("heading"), F.col("body")).alias("type"),
                        F.when(F.col("project").isNull(), "global").otherwise("project").alias("scope"), F.lit("active").alias("status"))


def memory_items(records: DataFrame, adapter: str = "notes") -> DataFrame:
    """Records as staging rows of the graph."""
    return records.select(F.lit(adapter).alias("source_adapter"), F.col("id").alias("source_key"), F.lit("memory").alias("kind"), "scope", "project",
                          text.compact(F.col("body"), 80).alias("label"), F.col("body").alias("content"), F.col("rel").alias("uri"),
                          F.to_json(F.struct("heading", "type", "thread_id", "line")).alias("metadata"), F.col("updated_at").alias("source_modified_at"),
                          identity.node_id(F.lit(adapter), F.col("id")).alias("node_id"))
