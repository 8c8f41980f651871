"""Fuzzy linkage of rows to claims, inside a run, by shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.written import folder, written
from .containment import held


def _folded(df: DataFrame, key: str, root: str) -> DataFrame:
    """Bodies folded and cut into tokens, written below ``root``, as many joins read them."""
    body = F.lower(text.squeeze(F.col("body")))
    return written(df.select("run", F.col("id").alias(key), body.alias(f"{key}_body"), text.claim_tokens(F.col("body")).alias(f"{key}_tokens")).select("*", F.size(f"{key}_tokens").alias(f"{key}_size")), root)


def match(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(run, row, claim, score) of pairs that score: both sides have run, id, body.

    Pairs come from equi joins on the run and a shared token, scored by counts alone, and on fingerprints
    where one text lies within the other; only the texts of the latter meet.  Those score higher than any tokens.
    """
    root = folder(claims.sparkSession, "linkage")
    c, r = _folded(claims, "claim", root), _folded(rows, "row", root)
    met = c.select("run", "claim", "claim_size", F.explode("claim_tokens").alias("t")).join(r.select("run", "row", "row_size", F.explode("row_tokens").alias("t")), ["run", "t"])
    met = met.groupBy("run", "claim", "row").agg(F.count(F.lit(1)).alias("both"), F.first("claim_size").alias("claim_size"), F.first("row_size").alias("row_size"))
    by_tokens = met.select("run", "row", "claim", text.token_match(F.col("both"), (F.col("claim_size"), F.col("row_size"))).alias("score")).where("score > 0")
    inner = held(c.select("run", F.col("claim").alias("outer"), F.col("claim_body").alias("text")), r.select("run", F.col("row").alias("inner"), F.col("row_body").alias("part")))
    heads = c.select("run", F.col("claim").alias("inner"), F.substring("claim_body", 1, 80).alias("part"))
    head = held(r.select("run", F.col("row").alias("outer"), F.col("row_body").alias("text")), heads)
    same = inner.select("run", F.col("outer").alias("claim"), F.col("inner").alias("row")).unionByName(head.select("run", F.col("inner").alias("claim"), F.col("outer").alias("row"))).distinct()
    same = same.join(c.select("run", "claim", "claim_body", "claim_size"), ["run", "claim"]).join(r.select("run", "row", "row_body", "row_size"), ["run", "row"])
    by_text = same.select("run", "row", "claim", text.body_match(F.col("claim_body"), F.col("row_body"), F.lit(0), (F.col("claim_size"), F.col("row_size"))).alias("score")).where("score > 0")
    return by_tokens.unionByName(by_text).groupBy("run", "row", "claim").agg(F.max("score").cast("int").alias("score"))


def best(scored: DataFrame, claims: DataFrame) -> DataFrame:
    """The best claim of each row, of several the one with the smallest place; none if two share the best score and it is under 60.

    ``claims`` has run, id and place, the number of a claim in its run.
    """
    w = Window.partitionBy("run", "row")
    placed = scored.join(claims.select("run", F.col("id").alias("claim"), "place"), ["run", "claim"])
    top = placed.select("*", F.row_number().over(w.orderBy(F.desc("score"), "place", "claim")).alias("n"), F.max("score").over(w).alias("top"))
    ties = top.select("*", F.count_if(F.col("score") == F.col("top")).over(w).alias("ties"))
    return ties.where("n = 1 and (ties = 1 or score >= 60)").select("run", "row", "claim", "score")


def assign_once(scored: DataFrame, order: str = "row") -> DataFrame:
    """Rows in order take the best claim that no earlier row has taken; sequential inside a run."""
    def run(pdf):
        taken, out = set(), []
        for row, g in pdf.groupby(order, sort=True):
            for claim, score in sorted(zip(g["claim"], g["score"]), key=lambda x: (-x[1], x[0])):
                if claim not in taken:
                    taken.add(claim)
                    out.append((g["run"].iloc[0], row, claim, score))
                    break
        import pandas as pd

        return pd.DataFrame(out, columns=["run", "row", "claim", "score"])

    return scored.select("run", "row", "claim", "score").groupBy("run").applyInPandas(run, scored.select("run", "row", "claim", "score").schema)


def material_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(run, l, r, both): pairs of a run whose token sets overlap materially; sides have run, id, body."""
    def side(df: DataFrame, key: str) -> DataFrame:
        t = text.tokens(F.col("body"), 3, text.SEARCH_STOP_WORDS)
        return df.select("run", F.col("id").alias(key), t.alias("ts")).select("run", key, F.size("ts").alias(f"n{key}"), F.explode("ts").alias("t"))
    both = side(left, "l").join(side(right, "r"), ["run", "t"]).groupBy("run", "l", "r", "nl", "nr").agg(F.count(F.lit(1)).alias("both"))
    return both.where(text.overlaps_materially(F.col("both"), F.col("nl"), F.col("nr"))).select("run", "l", "r", "both")


def challenges(findings: DataFrame, linked: DataFrame) -> DataFrame:
    """Findings linked to claims, as challenges; ``findings`` has run, id, relation."""
    rows = findings.join(linked.withColumnRenamed("row", "id"), ["run", "id"])
    return rows.select("run", "id", "claim", text.challenge_kind(F.col("relation")).alias("kind"), text.claim_status(F.col("relation")).alias("status"))


def route(candidates: DataFrame, memories: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per run: overlap, contradiction, weakness, high impact, disagreement, survivors.

    Candidates have run, id, body, refs, future; memories run, id, body; findings
    run, id, body, relation.
    """
    met = material_overlap(candidates, memories)
    polar = met.join(candidates.select("run", F.col("id").alias("l"), text.is_negative(F.col("body")).alias("pl")), ["run", "l"]).join(
        memories.select("run", F.col("id").alias("r"), text.is_negative(F.col("body")).alias("pr")), ["run", "r"])
    risk = polar.groupBy("run").agg(F.lit(True).alias("overlap_detected"), F.bool_or(F.col("pl") != F.col("pr")).alias("contradiction_risk"))
    same = candidates.select("run", F.col("id").alias("l"), "body").join(findings.select("run", F.col("id").alias("r"), "body"), ["run", "body"]).select("run", "l", "r")
    near = material_overlap(candidates, findings).select("run", "l", "r").unionByName(same).distinct()
    bad = near.join(findings.where("relation in ('duplicate', 'too_weak')").select("run", F.col("id").alias("r")), ["run", "r"]).select("run", "l").distinct()
    own = candidates.groupBy("run").agg(F.bool_or(text.is_weak(F.col("refs"), F.col("body"), F.col("future"))).alias("weakness_detected"), F.bool_or(text.is_high_impact(F.col("body"))).alias("high_impact"))
    alive = candidates.join(bad.withColumnRenamed("l", "id"), ["run", "id"], "left_anti").groupBy("run").agg(F.count(F.lit(1)).alias("survivors"))
    disagree = findings.groupBy("run").agg((F.count_distinct("relation") > 1).alias("disagreement"))
    out = own.join(risk, "run", "left").join(alive, "run", "left").join(disagree, "run", "left")
    return out.select("run", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("overlap_detected", "contradiction_risk", "weakness_detected", "high_impact", "disagreement")], F.coalesce("survivors", F.lit(0)).alias("survivors"))
