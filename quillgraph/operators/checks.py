"""Contracts and audits of runs: citations, derivation, usage, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def unsupported_refs(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, ref) of cited references that the input did not offer; proposals without any cite null."""
    refs = proposals.select("id", F.explode_outer("refs").alias("ref"))
    return refs.join(allowed.select("ref").distinct(), "ref", "left_anti").select("id", "ref")


def underived(proposals: DataFrame, typed: DataFrame) -> DataFrame:
    """Proposals that no typed candidate of the same action covers with all its refs."""
    p = proposals.select("id", "action", F.explode(F.array_distinct("refs")).alias("ref"), F.size(F.array_distinct("refs")).alias("need"))
    t = typed.select(F.col("id").alias("typed"), "action", F.explode(F.array_distinct("refs")).alias("ref"))
    full = p.join(t, ["action", "ref"]).groupBy("id", "typed", "need").agg(F.count(F.lit(1)).alias("met")).where("met = need")
    return proposals.select("id").join(full.select("id").distinct(), "id", "left_anti")


def covered_groups(rows: DataFrame, group: str, member: str, allowed: DataFrame) -> DataFrame:
    """Groups of which every member is allowed."""
    marked = rows.select(group, member).distinct().join(allowed.select(member, F.lit(True).alias("ok")).distinct(), member, "left")
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.every(F.coalesce("ok", F.lit(False))).alias("covered")).where("covered").select(group, "members")


def run_audit(conclusions: DataFrame) -> DataFrame:
    """run, conclusions, unsupported, citation_validity, duplicate_rate; columns run, action, body, cited, valid."""
    key = text.conclusion(F.col("action"), F.col("body"))
    rows = conclusions.groupBy("run").agg(F.count(F.lit(1)).alias("conclusions"), F.sum("cited").alias("cited"), F.sum("valid").alias("valid"),
                                          F.count_if(F.col("valid") < F.col("cited")).alias("unsupported"), F.count_distinct(key).alias("kinds"))
    return rows.select("run", "conclusions", "unsupported", F.when(F.col("cited") > 0, F.col("valid") / F.col("cited")).otherwise(1.0).alias("citation_validity"),
                       ((F.col("conclusions") - F.col("kinds")) / F.col("conclusions")).alias("duplicate_rate"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Reductions in calls and tokens, and whether the other run passes; one row each with calls, tokens, citation_validity, duplicate_rate."""
    b, o = base.select(*[F.col(c).alias(f"b_{c}") for c in ("calls", "tokens")]), other.select("calls", "tokens", "citation_validity", "duplicate_rate")
    j = b.join(F.broadcast(o))
    calls, tokens = text.reduction(F.col("b_calls"), F.col("calls")), text.reduction(F.col("b_tokens"), F.col("tokens"))
    cheap = (F.coalesce(calls, F.lit(0.0)) >= 0.5) | (F.coalesce(tokens, F.lit(0.0)) >= 0.5)
    return j.select(calls.alias("call_reduction"), tokens.alias("token_reduction"), (cheap & (F.col("citation_validity") == 1) & (F.col("duplicate_rate") <= 0.05)).alias("passed"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts of the non-blank values."""
    return rows.where(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(kinds: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """A count for every kind, 0 for those without rows."""
    n = rows.groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("kind").join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
