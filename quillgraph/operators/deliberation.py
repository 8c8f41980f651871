"""Claims, findings and proposals of a run: targets, best claims with bonuses, first messages, summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text
from ..sources.written import folder, written
from . import linkage

TARGET, REFERENCE, PLACE = 45, 15, 8
#: Runs with at most so many pairs of rows and claims are told row by row inside a task, larger ones in rounds of all.
GROUP = 200_000
#: A run's lists, by rank: the step and phase of the message, the list.
LISTS = (("proposal-editor", "typed-proposal", "typed"), ("memory-cartographer", "memory-cartography", "findings"), ("evidence-auditor", "preflight-critique", "findings"),
         ("decision-synthesizer", "proposal-synthesis", "proposals"), ("decision-synthesizer", "proposal-synthesis", "rejected"))


def body_of(body: Column, claim: Column, proposal: Column) -> Column:
    """The first of the names a row's text may have that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (body, claim, proposal)])


def target_ids(ids: Column, one: Column, refs: Column) -> Column:
    """A row's target memories: its list; else its single target; else the memories it refers to."""
    return F.when(ids.isNotNull(), F.array_compact(ids)).when(one.isNotNull(), F.array(one)).otherwise(F.array_compact(F.coalesce(refs, F.array().cast("array<string>"))))


def claim_cards(candidates: DataFrame) -> DataFrame:
    """Candidates as numbered claims: columns run, pos, body, refs; an empty body is named by its number."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("pos"))
    rows = candidates.select("*", n.alias("place"))
    return rows.select("run", F.concat(F.lit("claim:"), "run", F.lit(":"), F.col("place").cast("string")).alias("id"), "place",
                       F.coalesce(F.nullif("body", F.lit("")), F.concat(F.lit("Unnamed claim "), F.col("place").cast("string"))).alias("body"), "refs", F.lit("proposed").alias("status"))


def by_bodies(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(run, row, claim, score) of the bodies alone, which no turn changes: both sides have run, id, body."""
    return linkage.match(claims.select("run", "id", "body"), rows.where("body <> ''").select("run", "id", "body"))


def scored(claims: DataFrame, rows: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(run, row, claim, score, ref): what body, targets and place tell of a row and a claim, and whether they share a reference.

    Claims have run, id, place, body, refs, targets; rows run, id, place, body, refs, targets.
    To the body's score come 45 for a common target and 8 for the same place.  Each bonus is an equi join.
    ``bodies`` are the scores of ``by_bodies`` for these claims and for these or more rows, if known.
    """
    by_body = by_bodies(claims, rows) if bodies is None else bodies.join(rows.select("run", F.col("id").alias("row")), ["run", "row"], "left_semi")
    by_body = by_body.select("run", "row", "claim", F.col("score").alias("s"))

    def sides(column: str) -> DataFrame:
        c = claims.select("run", F.col("id").alias("claim"), F.explode(column).alias("x"))
        r = rows.select("run", F.col("id").alias("row"), F.explode(column).alias("x"))
        return c.join(r, ["run", "x"]).select("run", "row", "claim").distinct()

    by_target = sides("targets").select("run", "row", "claim", F.lit(TARGET).alias("s"))
    by_ref = sides("refs").select("run", "row", "claim", F.lit(0).alias("s"), F.lit(True).alias("ref"))
    by_place = claims.select("run", F.col("id").alias("claim"), "place").join(rows.select("run", F.col("id").alias("row"), "place"), ["run", "place"]).select("run", "row", "claim", F.lit(PLACE).alias("s"))
    every = by_body.unionByName(by_target).unionByName(by_place).withColumn("ref", F.lit(False)).unionByName(by_ref)
    return every.groupBy("run", "row", "claim").agg(F.sum("s").cast("int").alias("score"), F.bool_or("ref").alias("ref"))


def with_reference(pairs: DataFrame) -> DataFrame:
    """Scores with 15 more for the only claim of a row's that shares a reference; those that are positive."""
    alone = F.count_if("ref").over(Window.partitionBy("run", "row")) == 1
    return pairs.select("*", (F.col("score") + F.when(F.col("ref") & alone, REFERENCE).otherwise(0)).alias("total")).where("total > 0").drop("score", "ref").withColumnRenamed("total", "score")


def find_claims(claims: DataFrame, rows: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(run, row, claim, score): the best claim of each row (columns as in ``scored``).

    A claim that is the only one that shares a reference has 15 more.  Rows without a
    positive score, and ties under 60, have none; of others the first claim in order
    of place wins.
    """
    return linkage.best(with_reference(scored(claims, rows, bodies)), claims)


def _best(pairs: dict) -> str | None:
    """``find_claims`` for the pairs of one row: claim to (score, ref, place)."""
    alone = sum(ref for _, ref, _ in pairs.values()) == 1
    totals = {claim: score + REFERENCE * (ref and alone) for claim, (score, ref, _) in pairs.items()}
    top = max(totals.values(), default=0)
    held = [claim for claim, total in totals.items() if total == top]
    return min(held, key=lambda c: (pairs[c][2], c)) if top >= 60 or top > 0 and len(held) == 1 else None


def _told(decide: Callable) -> Callable:
    """applyInArrow function: a run's rows, in order of ``turn``, with their pairs to (run, row, claim).

    ``decide`` gets an empty dict, the run's number of claims, and each row's targets and pairs, and tells the row's claim.
    """
    def run(table: pa.Table) -> pa.Table:
        out, state = [], {}
        for r in sorted(table.to_pylist(), key=lambda r: r["nth"]):
            claim = decide(state, r["claims"], {t for t in r["targets"] or () if t is not None}, {p["claim"]: (p["score"], p["ref"], p["place"]) for p in r["pairs"]})
            if claim is not None:
                out.append((r["run"], r["row"], claim))
        kinds = table.schema.field("run").type, table.schema.field("row").type, pa.string()
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 3, kinds)], names=["run", "row", "claim"])

    return run


def _tell(decide: Callable, claims: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run, row, claim): each run's rows decided in turn inside a task, from ``pairs`` as in ``scored``."""
    nth = F.dense_rank().over(Window.partitionBy("run").orderBy("turn"))
    held = pairs.join(claims.select("run", F.col("id").alias("claim"), "place"), ["run", "claim"]).groupBy("run", "row").agg(F.collect_list(F.struct("claim", "score", "ref", "place")).alias("pairs"))
    sizes = claims.groupBy("run").agg(F.count(F.lit(1)).alias("claims"))
    told = rows.select("run", F.col("id").alias("row"), "turn", "targets").join(held, ["run", "row"], "left").join(sizes, "run")
    told = told.select("run", "row", nth.alias("nth"), "targets", "claims", F.coalesce("pairs", F.array().cast(held.schema["pairs"].dataType)).alias("pairs"))
    return told.groupBy("run").applyInArrow(_told(decide), StructType([*told.select("run", "row").schema, StructField("claim", StringType())]))


def _split(pairs: DataFrame, rows: DataFrame, group: int, root: str) -> tuple[DataFrame | None, Callable]:
    """The runs of more than ``group`` pairs or rows, None without any, and a function that leaves their rows out."""
    many = pairs.select("run").groupBy("run").count().unionByName(rows.groupBy("run").count()).where(F.col("count") > group).select("run").distinct()
    many = written(many, root)
    return (None, lambda df: df) if many.isEmpty() else (many, lambda df: df.join(many, "run", "left_anti"))


def _take(taken: dict, n: int, _: set, pairs: dict) -> str | None:
    claim = _best(pairs if len(taken) == n else {c: p for c, p in pairs.items() if c not in taken})
    if claim is not None:
        taken[claim] = True
    return claim


def take_turns(claims: DataFrame, rows: DataFrame, root: str, bodies: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """(run, row, claim): rows in order of ``turn`` take their best claim among those that no earlier row has taken.

    Rows have columns as in ``scored`` and ``turn``.  When all claims of a run are taken, later rows choose
    among all, by the targets that the claims came with.  Runs of up to ``group`` pairs are each told
    inside a task, so they cost one pass, however many rows compete; larger ones go in rounds.  Written below ``root``.
    """
    pairs = written(scored(claims, rows, bodies), root)
    many, rest = _split(pairs, rows, group, root)
    told = _tell(_take, claims, rest(rows), rest(pairs))
    if many is None:
        return told
    return told.unionByName(_take_in_rounds(claims, *(df.join(many, "run", "left_semi") for df in (rows, pairs)), root, bodies))


def _take_in_rounds(claims: DataFrame, rows: DataFrame, pairs: DataFrame, root: str, bodies: DataFrame | None) -> DataFrame:
    """``take_turns`` for runs of any size.

    A row is decided as soon as no earlier undecided row could take any of its claims; all such rows of
    all runs are decided at once, so the number of rounds is the longest chain of rows that compete,
    not the number of rows.
    """
    turns = rows.select("run", F.col("id").alias("row"), "turn")
    pairs = written(pairs.join(turns, ["run", "row"]), root)
    done = None
    while True:
        head = F.min("turn").over(Window.partitionBy("run", "claim"))
        ready = pairs.select("*", (F.col("turn") == head).alias("mine")).select("*", F.bool_and("mine").over(Window.partitionBy("run", "row")).alias("ready"))
        ready = written(ready.where("ready").drop("mine", "ready"), root)
        if ready.isEmpty():
            break
        chosen = written(linkage.best(with_reference(ready.drop("turn")), claims).select("run", "row", "claim").join(turns, ["run", "row"]), root)
        done = chosen if done is None else written(done.unionByName(chosen), root)
        pairs = written(pairs.join(ready.select("run", "row").distinct(), ["run", "row"], "left_anti").join(chosen.select("run", "claim"), ["run", "claim"], "left_anti"), root)
    if done is None:
        return pairs.select("run", "row", "claim")
    left = claims.groupBy("run").agg(F.count(F.lit(1)).alias("n")).join(done.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.max("turn").alias("last")), "run").where("n = m")
    late = written(rows.join(left.select("run", "last"), "run").where("turn > last").drop("last"), root)
    again = find_claims(claims, late, bodies).select("run", "row", "claim")
    return done.select("run", "row", "claim").unionByName(again)


def _type(held: dict, _: int, targets: set, pairs: dict) -> str | None:
    for claim, (theirs, place) in held.items():
        if targets & theirs:
            score, ref, _ = pairs.get(claim, (0, False, place))
            pairs[claim] = score + TARGET, ref, place
    claim = _best(pairs)
    if claim is not None:
        held[claim] = targets, pairs[claim][2]
    return claim


def type_in_turn(claims: DataFrame, rows: DataFrame, root: str, bodies: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """(run, row, claim): rows in order of ``turn`` find their claim and hand it their targets, which later rows then meet.

    Claims come without targets.  Runs of up to ``group`` pairs are each told inside a task, larger ones go in rounds.
    Written below ``root``.
    """
    base = written(scored(claims.withColumn("targets", F.array().cast("array<string>")), rows, bodies), root)
    many, rest = _split(base, rows, group, root)
    told = _tell(_type, claims, rest(rows), rest(base))
    if many is None:
        return told
    return told.unionByName(_type_in_rounds(claims, *(df.join(many, "run", "left_semi") for df in (rows, base)), root))


def _type_in_rounds(claims: DataFrame, rows: DataFrame, base: DataFrame, root: str) -> DataFrame:
    """``type_in_turn`` for runs of any size.

    Rows none of whose targets an earlier row of the run has are decided at once; the others one in
    each run at a time, by what their predecessors left.
    """
    rows = written(rows.select("run", F.col("id").alias("row"), "turn", "place", "body", "refs", "targets"), root)
    named = rows.select("run", "row", "turn", F.explode("targets").alias("x"))
    later = named.withColumn("first", F.min("turn").over(Window.partitionBy("run", "x"))).where("turn > first").select("run", "row").distinct()
    todo = written(rows.join(later, ["run", "row"]).select("run", "row", "turn", "targets"), root)
    ready = rows.join(later, ["run", "row"], "left_anti").select("run", "row", "turn", "targets")
    done = None
    while True:
        pairs = base.join(ready.select("run", "row"), ["run", "row"])
        if done is not None:
            # the targets that each claim has when the row's turn comes
            before = ready.select("run", "row", F.col("turn").alias("now"), F.col("targets").alias("mine")).join(done, "run").where("turn < now")
            held = before.groupBy("run", F.col("row").alias("row"), "claim", "mine").agg(F.max_by("targets", "turn").alias("theirs"))
            met = held.where(F.arrays_overlap("mine", "theirs")).select("run", "row", "claim", F.lit(TARGET).alias("score"), F.lit(False).alias("ref"))
            pairs = pairs.unionByName(met).groupBy("run", "row", "claim").agg(F.sum("score").cast("int").alias("score"), F.bool_or("ref").alias("ref"))
        chosen = linkage.best(with_reference(pairs), claims).select("run", "row", "claim").join(rows.select("run", F.col("row"), "turn", "targets"), ["run", "row"])
        chosen = chosen.select("run", F.col("row").alias("by"), "claim", "turn", "targets")
        done = written(chosen if done is None else done.unionByName(chosen), root)
        if todo.isEmpty():
            return done.select("run", F.col("by").alias("row"), "claim")
        head = todo.groupBy("run").agg(F.min("turn").alias("turn"))
        ready = written(todo.join(head, ["run", "turn"]).select("run", "row", "turn", "targets"), root)
        todo = written(todo.join(ready.select("run", "row"), ["run", "row"], "left_anti"), root)


def first_messages(messages: DataFrame, step: str, phase: str) -> DataFrame:
    """One message a run: the first of the step that succeeded in the phase, else the first in any; columns run, pos, step, phase, status."""
    w = Window.partitionBy("run").orderBy((F.coalesce(F.col("phase"), F.lit("")) != phase).cast("int"), "pos")
    return messages.where((F.col("step") == step) & (F.col("status") == "succeeded")).select("*", F.row_number().over(w).alias("n")).where("n = 1").drop("n")


def phases_complete(messages: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """(run, complete): whether every wanted (step, phase) has a message that succeeded."""
    have = [F.bool_or((F.col("step") == s) & F.col("phase").eqNullSafe(F.lit(p)) & (F.col("status") == "succeeded")) for s, p in wanted]
    done = have[0]
    for h in have[1:]:
        done = done & h
    return messages.groupBy("run").agg(F.coalesce(done, F.lit(False)).alias("complete"))


def transcript(messages: DataFrame, threads: list[str], limit: int = 1200) -> DataFrame:
    """Messages of the threads, bodies cut, in order."""
    return messages.where(F.col("thread").isin(*threads)).select("run", "pos", "thread", "sender", text.compact(F.col("body"), limit).alias("body")).orderBy("run", "pos")


def all_messages(threads: DataFrame) -> DataFrame:
    """Threads with a list of messages as one row a message; empty threads have none."""
    return threads.select("thread", F.explode("messages").alias("m")).select("thread", "m.*")


def numbered(trace: DataFrame) -> DataFrame:
    """A run's moves with their names, in order of pos."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("pos"))
    return trace.select("*", F.concat(F.lit("move:"), n.cast("string")).alias("move"))


def settle(claims: DataFrame) -> DataFrame:
    """Claims that nothing has decided are unresolved."""
    return claims.withColumn("status", F.when(F.col("status") == "proposed", "unresolved").otherwise(F.col("status")))


def summary(claims: DataFrame, challenges: DataFrame, trace: DataFrame) -> DataFrame:
    """Seven counts a run."""
    c = claims.groupBy("run").agg(F.count(F.lit(1)).alias("claims"), *[F.count_if(F.col("status") == s).alias(f"{s}_claims") for s in ("accepted", "rejected", "challenged")])
    h = challenges.groupBy("run").agg(F.count(F.lit(1)).alias("challenges"), F.count_if(F.col("status") == "open").alias("unresolved_challenges"))
    t = trace.groupBy("run").agg(F.count(F.lit(1)).alias("moves"))
    out = c.join(h, "run", "full_outer").join(t, "run", "full_outer")
    return out.select("run", *[F.coalesce(x, F.lit(0)).alias(x) for x in out.columns if x != "run"])


def resolutions(claims: DataFrame, rejected: DataFrame, proposals: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(run, claim, resolution): why the final message rejects or takes a claim; the first rejection that matches, else the first proposal.

    Rows have run, id, pos, body, rationale; rejections without one get a fixed text, as do proposals.
    ``bodies`` as in ``scored``.
    """
    def first(rows: DataFrame, words: str, rank: int) -> DataFrame:
        met = (by_bodies(claims, rows) if bodies is None else bodies).join(rows.select("run", F.col("id").alias("row"), "pos", "rationale"), ["run", "row"])
        return met.groupBy("run", "claim").agg(F.min_by(F.coalesce("rationale", F.lit(words)), "pos").alias("resolution")).withColumn("rank", F.lit(rank))
    both = first(rejected, "Rejected during proposal synthesis.", 0).unionByName(first(proposals, "Accepted into final proposal synthesis.", 1))
    return both.groupBy("run", "claim").agg(F.min_by("resolution", "rank").alias("resolution"))


@dataclass
class Artifacts:
    claims: DataFrame       # run, claim, place, body, refs, action, targets, confidence, status, reason
    challenges: DataFrame   # run, challenge, claim, kind, raised_by, status, rationale, refs, resolution, message
    trace: DataFrame        # run, move, n, kind, claim, challenge, agent, message, summary, refs
    summary: DataFrame      # seven counts a run


def artifacts(messages: DataFrame, rows: DataFrame, group: int = GROUP) -> Artifacts:
    """What the messages of many runs come to: claims with their final status, challenges, moves and counts.

    Messages have run, pos, message, step, phase, status, agent; rows have run, message, list (candidates, typed, findings,
    proposals, rejected), index from 0, body, refs, targets, action, confidence, relation, rationale, reason.
    Claims come from all claim scouts; then the first editor's types, the first cartographer's and
    auditor's findings and the first synthesis count.  A claim's status after the findings doesn't depend on their order but for
    challenged, which stays; so it is an aggregate, as are the last type and the last decision.
    Two things are decided in turn: which claim a type goes to, as types hand on their targets (``type_in_turn``), and
    who takes which claim in the synthesis (``take_turns``).  Bodies of claims and rows are compared once, for all lists.
    """
    spark = messages.sparkSession
    root = folder(spark, "deliberation")
    done = messages.where("status = 'succeeded'")
    claim_no = F.row_number().over(Window.partitionBy("run").orderBy("pos", "index"))
    found = done.where("step = 'claim-scout'").join(rows.where("list = 'candidates'"), ["run", "message"])
    claims = found.select("run", "agent", "message", "refs", "body", claim_no.alias("place"))
    claims = written(claims.select("run", F.concat(F.lit("claim:"), "run", F.lit(":"), F.col("place").cast("string")).alias("id"), "place", "agent", "message",
                                   F.coalesce(F.nullif("body", F.lit("")), F.concat(F.lit("Unnamed claim "), F.col("place").cast("string"))).alias("body"), _list("refs").alias("refs")), root)

    # the rows of each list of a run's first such message, in order
    firsts = None
    for rank, (step, phase, name) in enumerate(LISTS):
        first = first_messages(messages, step, phase).select("run", "message", "agent", F.col("phase").alias("at"), F.lit(rank).alias("rank"), F.lit(name).alias("list"))
        firsts = first if firsts is None else firsts.unionByName(first)
    heard = written(firsts.join(rows, ["run", "message", "list"]).select(
        "run", F.concat(F.col("rank").cast("string"), F.lit(":"), F.col("index").cast("string")).alias("id"), (F.col("index") + 1).alias("place"), F.struct("rank", "index").alias("turn"), "message", "agent", "at",
        "body", _list("refs").alias("refs"), _list("targets").alias("targets"), "action", "confidence", "relation", "rationale", "reason"), root)
    typed, findings, final = (heard.where(F.col("turn.rank").isin(*ranks)) for ranks in ((0,), (1, 2), (3, 4)))
    bodies = written(by_bodies(claims, heard), root)

    bare = claims.select("run", "id", "place", "body", "refs", F.array().cast("array<string>").alias("targets"))
    types = type_in_turn(bare, typed, root, bodies, group).select("run", F.col("row").alias("id"), "claim").join(typed, ["run", "id"])
    types = types.groupBy("run", "claim").agg(F.max_by(F.struct("action", "targets", "confidence"), "turn").alias("t"))
    known = written(claims.join(types.withColumnRenamed("claim", "id"), ["run", "id"], "left").select(*claims.columns, F.col("t.action").alias("action"), _list("t.targets").alias("targets"), F.col("t.confidence").alias("confidence")), root)
    bare = known.select("run", "id", "place", "body", "refs", "targets")

    met = written(find_claims(bare, findings, bodies).select("run", F.col("row").alias("id"), "claim").join(findings, ["run", "id"]).withColumn("kind", text.challenge_kind(F.col("relation"))), root)
    why = written(resolutions(claims.select("run", "id", "body"), *[final.where(F.col("turn.rank") == k).where("body <> ''").select("run", "id", F.col("turn.index").alias("pos"), "body", (F.coalesce("reason", "rationale") if k == 4 else F.col("rationale")).alias("rationale")) for k in (4, 3)], bodies), root)
    raised = met.where("kind is not null").join(why, ["run", "claim"], "left")
    n = F.row_number().over(Window.partitionBy("run").orderBy("turn")).cast("string")
    challenges = written(raised.select("run", F.concat(F.lit("challenge:"), "run", F.lit(":"), n).alias("challenge"), "claim", "kind", F.col("agent").alias("raised_by"), F.when(F.col("resolution").isNotNull(), "resolved").otherwise("open").alias("status"),
                                       F.coalesce("rationale", F.concat("relation", F.lit(" relationship raised for claim."))).alias("rationale"), "refs", "resolution", "message", "turn"), root)

    own = F.col("at").eqNullSafe(F.lit("proposal-synthesis"))
    turns = take_turns(bare, final.where(own), root, bodies, group).unionByName(find_claims(bare, final.where(~own), bodies).select("run", "row", "claim"))
    taken = written(turns.select("run", F.col("row").alias("id"), "claim").join(final, ["run", "id"]), root)
    decided = taken.where(own).withColumn("accepted", F.col("turn.rank") == 3)
    last = decided.groupBy("run", "claim").agg(F.max_by(F.struct("accepted", F.when(F.col("accepted"), F.col("rationale")).otherwise(F.coalesce("reason", "rationale")).alias("reason")), "turn").alias("d"),
                                               F.max_by(F.struct("action", "targets", "confidence"), F.when(F.col("accepted"), F.col("turn"))).alias("p"))
    state = met.groupBy("run", "claim").agg(F.bool_or(F.col("kind").isNotNull()).alias("challenged"), F.bool_or(F.col("relation").eqNullSafe(F.lit("novel"))).alias("novel"))
    state = state.join(why, ["run", "claim"], "left").join(last, ["run", "claim"], "full_outer").withColumnRenamed("claim", "id")
    status = (F.when(F.col("d.accepted"), "accepted").when(F.col("d").isNotNull(), "rejected").when(F.col("challenged"), "challenged").when(F.col("novel"), "endorsed").otherwise("unresolved"))
    out = known.join(state, ["run", "id"], "left").select(
        "run", F.col("id").alias("claim"), "place", "body", "refs", F.coalesce("p.action", "action").alias("action"), F.when(F.col("p").isNotNull(), F.col("p.targets")).otherwise(F.col("targets")).alias("targets"),
        F.coalesce("p.confidence", "confidence").alias("confidence"), status.alias("status"), F.when(F.col("d").isNotNull(), F.col("d.reason")).when(F.col("challenged"), F.col("resolution")).alias("reason"))

    null = F.lit(None).cast("string")
    moves = [claims.select("run", F.struct(F.lit(0).alias("rank"), F.col("place").alias("index")).alias("turn"), F.lit("claim").alias("kind"), F.col("id").alias("claim"), null.alias("challenge"), "agent", "message", F.col("body").alias("summary"), "refs"),
             met.where("relation = 'novel'").select("run", "turn", F.lit("endorsement").alias("kind"), "claim", null.alias("challenge"), "agent", "message", F.coalesce("rationale", F.lit("Claim was endorsed as novel.")).alias("summary"), "refs"),
             challenges.select("run", "turn", F.lit("challenge").alias("kind"), "claim", "challenge", F.col("raised_by").alias("agent"), "message", F.col("rationale").alias("summary"), "refs"),
             taken.select("run", "turn", F.when(F.col("turn.rank") == 3, "handoff").otherwise("challenge").alias("kind"), "claim", null.alias("challenge"), "agent", "message",
                          F.when(F.col("turn.rank") == 3, F.coalesce("rationale", F.lit("Claim was handed off as a proposal candidate."))).otherwise(F.coalesce("reason", "rationale", F.lit("Claim was rejected."))).alias("summary"), "refs")]
    every = moves[0]
    for part in moves[1:]:
        every = every.unionByName(part)
    trace = numbered(every.withColumnRenamed("turn", "pos")).withColumn("n", F.substring_index("move", ":", -1).cast("int")).drop("pos")
    challenges = challenges.drop("turn")
    return Artifacts(out, challenges, trace, summary(out, challenges, trace))


def _list(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))
