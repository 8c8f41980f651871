"""Row validators, public projections, counts and small set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("created_nodes", "updated_nodes", "removed_nodes", "created_edges", "updated_edges", "removed_edges", "created_revisions", "removed_revisions")


# --- filters --------------------------------------------------------------------------------------

def scope_filter(path: Column, root: str | None = None, everywhere: bool = False, project: str | None = None) -> Column:
    """The filter that a source asks for: a root first, then everything, then exactly one project; else all pass."""
    if root:
        return F.coalesce((path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/"), F.lit(False))
    if everywhere or project is None:
        return F.lit(True)
    return F.coalesce(path == project, F.lit(False))


def same_fingerprint(one: str, other: str) -> Column:
    """Whether two structs of identity, size and mtime are the same; nulls equal nulls."""
    parts = [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in ("identity", "size", "mtime")]
    return parts[0] & parts[1] & parts[2]


def is_control_reference(ref: Column) -> Column:
    """References to how a run was made (control files, plans, packets) are no evidence."""
    return F.coalesce(ref.rlike(r"(?i)(^|[/:_-])(objective|packet|plan|constraints|topology|control)([/:_.-]|$)"), F.lit(False))


# --- public projections ---------------------------------------------------------------------------

def visual_node(nodes: DataFrame) -> DataFrame:
    """A node as others may see it: whether it has a uri, not which."""
    return nodes.select("id", "kind", "scope", "label", F.col("uri").isNotNull().alias("has_uri"))


def visual_edge(edges: DataFrame) -> DataFrame:
    """An edge without its provenance."""
    return edges.select("id", "source_node_id", "target_node_id", "kind", "confidence")


def compact_plan(nodes: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plan without its texts, and its exclusions as counts by reason."""
    return nodes.drop("text", "content"), exclusion_counts(exclusions)


# --- counts ---------------------------------------------------------------------------------------

def exclusion_counts(exclusions: DataFrame) -> DataFrame:
    return exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def corpus_size(rows: DataFrame, group: str) -> DataFrame:
    """One row: rows and distinct groups."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"))


def corpus_identity(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: a digest that any change, of order by ``key`` too, alters.

    Each row's digest holds its key; their bitwise sums need no order and no row leaves its task.
    """
    d = F.sha2(F.concat_ws("\0", key, *[F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in columns]), 256)
    parts = [F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.lpad(F.conv((F.coalesce(F.sum(p), F.lit(0)) % (1 << 60)).cast("string"), 10, 16), 15, "0") for p in parts]
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat(*sums), 256).alias("identity"))


def change_counts(events: DataFrame) -> DataFrame:
    """Sizes of each event's arrays, absent ones 0, and their sum."""
    sizes = [F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ARRAYS if c in events.columns]
    sized = events.select("sequence", *[F.when(F.col(c).isNull(), F.array().cast(events.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in ARRAYS if c in events.columns])
    out = sized.select("sequence", *sizes)
    total = sum((F.col(c) for c in out.columns[1:]), F.lit(0))
    return out.select("*", total.alias("total"))


def normalised_delta(events: DataFrame) -> DataFrame:
    """Every array there, sorted and without repeats."""
    have = {c for c in events.columns}
    return events.select("sequence", *[F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias(c) if c in have
                                       else F.array().cast("array<string>").alias(c) for c in ARRAYS])


# --- sets -----------------------------------------------------------------------------------------

def missing(required: Column, present: Column) -> Column:
    """What is required and not there, sorted."""
    return F.array_sort(F.array_except(required, F.coalesce(present, F.array().cast("array<string>"))))


def merged(*sets: Column) -> Column:
    """One sorted set of several, nulls as empty ones."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sets]))))


def same_set(one: Column, other: Column) -> Column:
    return F.array_sort(F.array_distinct(one)) == F.array_sort(F.array_distinct(other))


# --- validators -----------------------------------------------------------------------------------

def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that do not hold, in order; a null is a failure."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def share(c: Column) -> Column:
    """Whether a number lies in 0..1."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & c.between(0, 1)


def candidate_errors() -> Column:
    """What is wrong with a candidate: claim, source_refs, why_future_useful."""
    return errors({"claim": F.length(F.trim("claim")) > 0, "source_refs": F.col("source_refs").isNotNull(), "why_future_useful": F.length(F.trim("why_future_useful")) > 0})


def finding_errors(relations: list[str]) -> Column:
    """What is wrong with a finding: body, relation, confidence, rationale, source_refs; relations other than novel need a target."""
    target = F.col("target_memory_id").isNotNull() | F.col("relation").isin("novel", "too_weak")
    return errors({"body": F.length(F.trim("body")) > 0, "relation": F.col("relation").isin(*relations), "confidence": share(F.col("confidence")),
                   "rationale": F.length(F.trim("rationale")) > 0, "source_refs": F.col("source_refs").isNotNull(), "target_memory_id": target})


def corpus_errors(sets: DataFrame, documents: DataFrame, memories: DataFrame, most: dict[str, int]) -> DataFrame:
    """One row: numbers of sets, documents and memories, the longest document, and the bounds they break."""
    one = sets.agg(F.count(F.lit(1)).alias("sets")).join(documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest"))).join(memories.agg(F.count(F.lit(1)).alias("memories")))
    return one.select("*", errors({name: F.col(name) <= limit for name, limit in most.items()}).alias("errors"))


def indexed_file_errors(requested: DataFrame, indexed: DataFrame, units: DataFrame, longest: int = 32_000) -> DataFrame:
    """(error, path): files asked for and not indexed, indexed and not asked for, indexed twice, and units that are too long."""
    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("error"), "path")
    twice = indexed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (named(requested.join(indexed, "path", "left_anti").distinct(), "missing").unionByName(named(indexed.join(requested, "path", "left_anti").distinct(), "unexpected"))
            .unionByName(named(twice, "duplicate")).unionByName(named(units.where(F.length("text") > longest).select("path").distinct(), "too-long")))
