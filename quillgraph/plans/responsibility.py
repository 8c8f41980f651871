"""Responsibility plans: seeds, a budgeted walk, units and what was left out.

The walk goes level by level.  A level's events are one join of the frontier with the
edges.  Firsts of edges and nodes are aggregates; the new nodes and edges that budgets can take
are the first so many of an order, and only these rows, whose number the budgets bound, reach
the driver.  What was left out stays a DataFrame, labelled by where it lies in the order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph as g
from ..operators import walk
from ..operators.search import lexical_score, search

SEED_KINDS = ("memory", "session", "skill")
#: What a request finds, and what stands in where nothing is found.
FALLBACK_KINDS = (*SEED_KINDS, "source_document")


@dataclass(frozen=True)
class Limits:
    nodes: int = 24
    edges: int = 48
    hops: int = 2
    chars: int = 12000
    tokens: int = 3000
    confidence: float = 0.0
    days: int | None = None
    kinds: tuple[str, ...] | None = None


def _named(nodes: DataFrame, explicit: list[str]):
    """Whether a node is named by its id or, where there is one, its source key."""
    by_id = F.col("id").isin(list(explicit))
    return by_id | F.coalesce(F.col("source_key").isin(list(explicit)), F.lit(False)) if "source_key" in nodes.columns else by_id


def seeds(nodes: DataFrame, request: str, limits: Limits, explicit: list[str] = (), changed: DataFrame | None = None, stop=text.PLAN_STOP_WORDS) -> DataFrame:
    """(id, score, reasons) of the best five; ``nodes`` has content.

    100 for each point of lexical score, 10000 for explicit ids, 20 for changed
    ones, which count without a request or with a match only.
    """
    words = text.query_tokens(request, stop)
    lexical = lexical_score(F.col("label"), F.col("content"), F.coalesce("metadata", F.lit("")), words)
    rows = nodes.select("id", "kind", lexical.alias("lexical"), _named(nodes, explicit).alias("explicit"))
    if changed is not None:
        marks = changed.select(F.col("id").alias("c_id")).distinct()
        rows = rows.join(marks, F.col("id") == F.col("c_id"), "left").withColumn("changed", F.col("c_id").isNotNull()).drop("c_id")
    else:
        rows = rows.withColumn("changed", F.lit(False))
    rows = rows.withColumn("changed", F.col("changed") & ((F.lit(not words)) | (F.col("lexical") > 0)))
    score = F.col("lexical") * 100 + F.when(F.col("explicit"), 10000).otherwise(0) + F.when(F.col("changed"), 20).otherwise(0)
    reasons = F.array_compact(F.array(F.when(F.col("explicit"), "explicit-id"), F.when(F.col("changed"), "changed-source"), F.when(F.col("lexical") > 0, "lexical-match")))
    found = rows.where(F.col("explicit") | F.col("kind").isin(*SEED_KINDS)).select("id", score.alias("score"), reasons.alias("reasons")).where("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(min(5, limits.nodes))


@dataclass
class Plan:
    nodes: DataFrame       # id, depth, chars, tokens, seed
    edges: DataFrame       # id, depth
    exclusions: DataFrame  # reason, node, edge
    units: DataFrame       # unit_key, depth, seed, nodes
    exhausted: dict[str, bool]
    seeds: DataFrame       # id, score, reasons, in order


def _after(at: tuple[int, str]):
    """Events later in a level than (position, edge)."""
    return (F.col("pos") > at[0]) | ((F.col("pos") == at[0]) & (F.col("id") > at[1]))


def build(nodes: DataFrame, edges: DataFrame | walk.Adjacency, request: str, scope: str, project: str | None, now: str, limits: Limits = Limits(), explicit: list[str] = (), changed: DataFrame | None = None) -> Plan:
    """The plan for a request.  ``nodes`` has id, kind, scope, project, label, content, metadata, modified; a null content is a node without a revision."""
    spark = nodes.sparkSession
    seen = nodes.select("*", g.eligible(scope, project).alias("in_scope"), g.fresh(F.col("modified"), now, limits.days).alias("is_fresh"), F.coalesce(F.length("content"), F.lit(-1)).alias("size"))
    able = seen.where("in_scope and is_fresh and size >= 0")
    found = seeds(able, request, limits, explicit, changed)
    first = [(r["id"], r["score"], r["reasons"]) for r in found.collect()]
    if not first and limits.nodes > 0:
        low = able.where(F.col("kind").isin(*FALLBACK_KINDS)).agg(F.min("id")).first()[0]
        first = [(low, 1, ["deterministic-fallback"])] if low else []
    start = spark.createDataFrame(first, "id string, score int, reasons array<string>")
    picked: dict[str, tuple] = {}
    used: dict[str, int] = {}
    left_out: set[tuple] = set()
    flags = dict.fromkeys(("nodes", "edges", "hops", "chars", "tokens"), False)
    room = {"chars": limits.chars, "tokens": limits.tokens}

    def admit(node: str, info: dict, depth: int, edge: str | None, seed: bool) -> bool:
        """Take a node if the budgets allow; its text may be cut."""
        if node in picked:
            return True
        def no(reason: str, flag: str | None = None) -> bool:
            left_out.add((reason, node, edge))
            if flag:
                flags[flag] = True
            return False
        if len(picked) >= limits.nodes:
            return no("node-budget", "nodes")
        if not info["in_scope"]:
            return no("scope-mismatch")
        if info["size"] < 0:
            return no("missing-revision")
        if not info["is_fresh"]:
            return no("freshness-limit")
        if room["chars"] <= 0:
            return no("character-budget", "chars")
        if room["tokens"] <= 0:
            return no("token-budget", "tokens")
        chars = min(info["size"], room["chars"], 4 * room["tokens"])
        if chars < info["size"]:
            flags["chars"] |= chars == room["chars"]
            flags["tokens"] |= chars == 4 * room["tokens"]
        cost = max(1, -(-chars // 4))
        room["chars"] -= chars
        room["tokens"] -= cost
        picked[node] = (depth, chars, cost, seed)
        return True

    facts = {r["id"]: r.asDict() for r in seen.join(F.broadcast(spark.createDataFrame([(x[0],) for x in first], "id string")), "id").select("id", "in_scope", "is_fresh", "size").collect()} if first else {}
    for node, *_ in first:
        admit(node, facts[node], 0, None, True)
    order = list(picked)
    adjacency = edges if isinstance(edges, walk.Adjacency) else walk.Adjacency.of(edges)
    # nodes that the request names but may not see
    refused = F.when(~F.col("in_scope"), "scope-mismatch").when(F.col("size") < 0, "missing-revision").when(~F.col("is_fresh"), "freshness-limit")
    parts = [seen.where(_named(seen, explicit)).select(refused.alias("reason"), F.col("id").alias("node"), F.lit(None).cast("string").alias("edge")).where("reason is not null")]

    def full() -> bool:
        return len(picked) >= limits.nodes or room["chars"] <= 0 or room["tokens"] <= 0

    for level in range(limits.hops + 1):
        if not order:
            break
        events = adjacency.around(order)
        kind_ok = F.col("kind").isin(*limits.kinds) if limits.kinds is not None else F.lit(True)
        fit = kind_ok & (F.col("confidence") >= limits.confidence)
        reason = F.when(~kind_ok, "edge-kind-filter").otherwise("confidence-filter")
        parts.append(events.where(~fit).select(reason.alias("reason"), F.lit(None).cast("string").alias("node"), F.col("id").alias("edge")))
        if level == limits.hops:
            over = events.where(fit).select(F.lit("hop-limit").alias("reason"), F.col("dst").alias("node"), F.col("id").alias("edge"))
            flags["hops"] = not over.isEmpty()
            parts.append(over)
            break
        # kind and confidence first; of edges not yet walked each one's first event counts
        raw = events.where(fit)
        if used:
            raw = raw.join(F.broadcast(spark.createDataFrame([(e,) for e in used], "id string")), "id", "left_anti")
        raw = raw.join(seen.select(F.col("id").alias("dst"), "in_scope", "is_fresh", "size"), "dst")
        fresh = raw.groupBy("id").agg(F.min(F.struct("pos", "dst", "in_scope", "is_fresh", "size")).alias("e")).select("id", "e.*")
        able, known = F.col("in_scope") & F.col("is_fresh") & (F.col("size") >= 0), F.col("dst").isin(*picked)
        closed, chosen = (-1, "") if full() else None, []
        if not full():
            # new nodes in order of their first event, until the budgets are used up
            new = fresh.where(able & ~known).groupBy("dst").agg(F.min(F.struct("pos", "id")).alias("at"), F.first("size").alias("size"))
            left = dict(room)
            for r in new.orderBy("at").limit(limits.nodes - len(picked)).collect():
                if left["chars"] <= 0 or left["tokens"] <= 0:
                    break
                chosen.append(r["dst"])
                chars = min(r["size"], left["chars"], 4 * left["tokens"])
                left["chars"], left["tokens"] = left["chars"] - chars, left["tokens"] - max(1, -(-chars // 4))
        free = limits.edges - len(used)
        rows = fresh.where(known | F.col("dst").isin(*chosen)).orderBy("pos", "id").limit(free).collect() if free > 0 else []
        order = []
        for r in rows:
            if r["dst"] not in picked:
                admit(r["dst"], r.asDict(), level + 1, r["id"], False)
                order.append(r["dst"])
                if full():
                    closed = (r["pos"], r["id"])
            used[r["id"]] = level + 1
        last = (rows[-1]["pos"], rows[-1]["id"]) if rows else (-1, "")
        spent = _after(last) if len(used) >= limits.edges else F.lit(False)
        shut = _after(closed) if closed else F.lit(False)
        nodes_shut = shut if len(picked) >= limits.nodes else F.lit(False)
        why = F.when(spent, "edge-budget").when(nodes_shut, "node-budget").when(~F.col("in_scope"), "scope-mismatch").when(F.col("size") < 0, "missing-revision").when(
            ~F.col("is_fresh"), "freshness-limit").when(shut & F.lit(room["chars"] <= 0), "character-budget").otherwise("token-budget")
        taken = F.broadcast(spark.createDataFrame([(e,) for e in used], "id string"))
        # every event of an edge that was not walked has its own record
        rest = raw.join(taken, "id", "left_anti").select(why.alias("reason"), F.col("dst").alias("node"), F.col("id").alias("edge"))
        parts.append(rest)
        met = {r["reason"] for r in rest.select("reason").distinct().collect()}  # ten at most
        for flag, name in (("nodes", "node"), ("edges", "edge"), ("chars", "character"), ("tokens", "token")):
            flags[flag] |= f"{name}-budget" in met
    chosen = spark.createDataFrame([(n, *v) for n, v in picked.items()], "id string, depth int, chars int, tokens int, seed boolean")
    edge_rows = spark.createDataFrame(list(used.items()), "id string, depth int")
    out = spark.createDataFrame(sorted(left_out, key=str), "reason string, node string, edge string")
    for part in parts:
        out = out.unionByName(part)
    out = out.distinct().orderBy("reason", "node", "edge")
    return Plan(chosen.orderBy("depth", "id"), edge_rows.orderBy("id"), out, units(chosen, nodes), flags, start)


@dataclass
class Retrieval:
    plan: Plan
    nodes: DataFrame  # the hydrated nodes
    candidates: int   # nodes that the request and the ids named
    hydrated_nodes: int
    hydrated_edges: int


def plan(nodes: DataFrame, adjacency: walk.Adjacency, request: str, scope: str, project: str | None, now: str, limits: Limits = Limits(), explicit: list[str] = (), changed: DataFrame | None = None) -> Retrieval:
    """The plan for a request from a stored graph, of which only candidates and what lies around them are read.

    Candidates are the best hits of the request, ids named, and changed nodes; if there is none, the first
    visible node.  Their seeds are hydrated: a walk over all kinds of edges that takes eight times the
    plan's budgets at most.  The plan is then made of these nodes and edges alone.
    """
    spark = nodes.sparkSession
    most = max(16, min(1000, 4 * limits.nodes))
    pool = nodes.where(g.eligible(scope, project) & F.col("kind").isin(*FALLBACK_KINDS))
    ids = search(pool, request, most).select("id").unionByName(nodes.where(_named(nodes, explicit)).select("id"))
    if changed is not None:
        ids = ids.unionByName(nodes.join(changed.select("id"), "id", "left_semi").select("id"))
    known = [r["id"] for r in ids.distinct().orderBy("id").collect()]  # at most ``most`` hits, besides what the request itself names
    if not known:
        low = pool.agg(F.min("id")).first()[0]
        known = [low] if low is not None else []

    def only(wanted: list[str]) -> DataFrame:
        return nodes.join(F.broadcast(spark.createDataFrame([(x,) for x in wanted], "id string")), "id", "left_semi")

    none = walk.Adjacency(adjacency.steps.where(F.lit(False)), adjacency.buckets)
    first = build(only(known), none, request, scope, project, now, replace(limits, edges=0, hops=0), explicit, changed)
    seeds_ = [r["id"] for r in first.seeds.collect()]
    found = walk.hydrate(nodes, adjacency, known, seeds_, limits.hops, max(100, min(4000, 8 * limits.nodes)), max(200, min(12_000, 8 * limits.edges)))
    some = only(list(found.nodes))
    taken = F.broadcast(spark.createDataFrame([(e,) for e in found.edges], "id string"))
    near = walk.Adjacency(adjacency.steps.join(taken, "id", "left_semi"), adjacency.buckets)
    final = build(some, near, request, scope, project, now, limits, explicit, changed)
    return Retrieval(final, some, len(known), len(found.nodes), len(found.edges))


def units(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Selected nodes in units, with kind and state.

    A seed memory is its own unit; other memories, evidence and documents go by their
    source if they name one; any other node alone; projects have none.  A unit is
    awake if a seed is in it, sleeping one step away, else deferred; its expansion are
    its nearest nodes.
    """
    path = F.get_json_object("metadata", "$.sourcePath")
    rows = chosen.join(nodes.select("id", "kind", "label", "metadata"), "id").where("kind <> 'project'")
    alone = F.col("seed") & (F.col("kind") == "memory")
    cluster = ~alone & path.isNotNull() & F.col("kind").isin("memory", "evidence", "source_document")
    key = F.when(cluster, F.concat(F.lit("source:"), path)).otherwise(F.col("id"))
    kind = F.when(cluster, "source-cluster").when(F.col("kind").isin("memory", "session", "skill"), F.col("kind")).otherwise("resource")
    found = rows.groupBy(key.alias("unit_key"), kind.alias("kind")).agg(
        F.min("depth").alias("depth"), F.bool_or("seed").alias("seed"), F.array_sort(F.collect_list("id")).alias("nodes"), F.collect_list(F.struct("depth", "id")).alias("at"))
    near = F.array_sort(F.transform(F.filter("at", lambda x: x["depth"] == F.col("depth")), lambda x: x["id"]))
    return found.select("unit_key", "kind", "depth", "seed", "nodes", near.alias("expansion"), F.when(F.col("seed"), "awake").when(F.col("depth") == 1, "sleeping").otherwise("deferred").alias("state"))


def current(plan_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, problem): selected nodes that are gone, or whose revision is another by now; empty if the plan still holds."""
    now = nodes.select("id", F.col("current_revision_id").alias("now"))
    j = plan_nodes.select("id", "revision_id").join(now, "id", "left")
    return j.select("id", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("revision_id"), "changed").alias("problem")).where("problem is not null")


def context(plan: Plan, nodes: DataFrame, limit: int) -> DataFrame:
    """Chunks of the plan's nodes under a character limit, in plan order; projects and empty texts have none."""
    rows = plan.nodes.join(nodes.select("id", "kind", "content"), "id").where("kind <> 'project' and chars > 0")
    w = Window.orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)  # a plan has few rows
    left = F.lit(limit) - F.coalesce(F.sum("chars").over(w), F.lit(0))
    return rows.select("id", "depth", F.greatest(F.least("chars", left), F.lit(0)).cast("int").alias("take"), "content").where("take > 0").select("id", "depth", F.expr("substring(content, 1, take)").alias("text"))
