"""Bounded walks and plans beside the same told as a queue, edge by edge."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import walk
from quillgraph.plans import responsibility

NODE = "id string, kind string, scope string, project string, label string, content string, metadata string, modified string"
EDGE = "id string, source_node_id string, target_node_id string, kind string, confidence double"
NOW = "2026-07-10T00:00:00Z"


def random_graph(rng, n, m, hub=0.0):
    nodes = [(f"n{i}", "memory", "global" if rng.random() < 0.8 else "project", rng.choice(["/p", "/q"]), f"n{i}", None if rng.random() < 0.05 else "x" * rng.randrange(0, 60), "{}",
              NOW if rng.random() < 0.85 else "2020-01-01T00:00:00Z") for i in range(n)]
    def end():
        return "n0" if rng.random() < hub else f"n{rng.randrange(n + 1)}"  # now and then a node that is not there
    edges = [(f"e{k:03d}", end(), end(), rng.choice(["SUPPORTS", "DUPLICATES"]), rng.choice([0.2, 0.9])) for k in rng.sample(range(999), m)]
    return nodes, sorted(edges)


def visible(node):
    return node[2] == "global" or node[3] == "/p"


def around(edges, node):
    return [e for e in edges if node in e[1:3]]


def other(e, node):
    return e[2] if e[1] == node else e[1]


def neighbours_by_queue(nodes, edges, root, depth, max_nodes, max_edges, kinds, least):
    by = {n[0]: n for n in nodes}
    edges = [e for e in edges if (kinds is None or e[3] in kinds) and e[4] >= least]
    found, used, queue, cut = {root: 0}, [], [root], {"nodes": False, "edges": False, "depth": False}
    while queue:
        at = queue.pop(0)
        page = max(1, max_edges - len(used) + 1)
        mine = around(edges, at)
        cut["edges"] |= len(mine) > page
        for e in mine[:page]:
            n = other(e, at)
            if n not in by or not visible(by[n]):
                continue
            if found[at] + 1 > depth:
                cut["depth"] = True
                continue
            if e[0] not in used:
                if len(used) >= max_edges:
                    cut["edges"] = True
                    continue
                used.append(e[0])
            if n not in found:
                if len(found) >= max_nodes:
                    cut["nodes"] = True
                    used.remove(e[0])
                    continue
                found[n] = found[at] + 1
                queue.append(n)
    return found, set(used), cut


def hydrate_by_queue(nodes, edges, known, seeds, hops, max_nodes, max_edges):
    by = {n[0] for n in nodes}
    records, used, depth, queue = dict.fromkeys([*known, *seeds]), {}, dict.fromkeys(seeds, 0), list(seeds)
    while queue:
        at = queue.pop(0)
        if depth[at] >= hops:
            continue
        for e in around(edges, at)[:max(1, max_edges - len(used))]:
            if len(used) >= max_edges:
                break
            used[e[0]] = True
            n = other(e, at)
            if n not in records and n in by and len(records) < max_nodes:
                records[n] = None
            if n in records and depth.get(n, 99) > depth[at] + 1:
                depth[n] = depth[at] + 1
                queue.append(n)
    return {n: depth.get(n) for n in records}, set(used)


def plan_by_queue(nodes, edges, seed, lim):
    by = {n[0]: n for n in nodes}
    picked, used, out, flags = {}, {}, set(), dict.fromkeys(("nodes", "edges", "hops", "chars", "tokens"), False)
    chars = tokens = 0

    def take(n, depth, edge):
        nonlocal chars, tokens
        if n in picked:
            return True
        x = by[n]
        for bad, reason, flag in ((len(picked) >= lim.nodes, "node-budget", "nodes"), (not visible(x), "scope-mismatch", None), (x[5] is None, "missing-revision", None), (x[7] != NOW, "freshness-limit", None),
                                  (chars >= lim.chars, "character-budget", "chars"), (tokens >= lim.tokens, "token-budget", "tokens")):
            if bad:
                if flag:
                    flags[flag] = True
                out.add((reason, n, edge))
                return False
        most = min(lim.chars - chars, 4 * (lim.tokens - tokens))
        size = min(len(x[5]), most)
        if size < len(x[5]):
            flags["chars"] |= most == lim.chars - chars
            flags["tokens"] |= most == 4 * (lim.tokens - tokens)
        picked[n] = (depth, size)
        chars, tokens = chars + size, tokens + max(1, -(-size // 4))
        return True

    queue = [seed] if seed in by and visible(by[seed]) and by[seed][5] is not None and by[seed][7] == NOW and take(seed, 0, None) else []
    while queue:
        at = queue.pop(0)
        for e in around(edges, at):
            n = other(e, at)
            if lim.kinds is not None and e[3] not in lim.kinds:
                out.add(("edge-kind-filter", None, e[0]))
            elif e[4] < lim.confidence:
                out.add(("confidence-filter", None, e[0]))
            elif picked[at][0] + 1 > lim.hops:
                flags["hops"] = True
                out.add(("hop-limit", n, e[0]))
            elif n in by:
                if e[0] not in used and len(used) >= lim.edges:
                    flags["edges"] = True
                    out.add(("edge-budget", n, e[0]))
                    continue
                new = n not in picked
                if take(n, picked[at][0] + 1, e[0]):
                    used.setdefault(e[0], picked[at][0] + 1)
                    if new:
                        queue.append(n)
    return picked, used, out, flags


@pytest.mark.parametrize("seed", range(6))
def test_neighbourhood_equals_the_queue(spark, seed):
    rng = random.Random(seed)
    nodes, edges = random_graph(rng, 25, 70, hub=0.3 if seed % 2 else 0.0)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    root = next(x[0] for x in nodes if visible(x))
    args = (rng.choice([0, 1, 2, 3]), rng.choice([1, 4, 10, 100]), rng.choice([0, 3, 8, 20, 300]), rng.choice([None, ["SUPPORTS"]]), rng.choice([0.0, 0.5]))
    got = walk.neighbourhood(n, e, root, *args[:3], "project", "/p", *args[3:])
    want = neighbours_by_queue(nodes, edges, root, *args)
    assert ({r["id"]: r["depth"] for r in got.nodes.collect()}, {r["id"] for r in got.edges.collect()}, got.truncated) == want


@pytest.mark.parametrize("seed", range(5))
def test_hydration_equals_the_queue(spark, tmp_path, seed):
    rng = random.Random(seed)
    nodes, edges = random_graph(rng, 25, 70, hub=0.3 if seed % 2 else 0.0)
    n = spark.createDataFrame(nodes, NODE)
    stored = walk.Adjacency.write(spark.createDataFrame(edges, EDGE), str(tmp_path / "a"), 8)
    known, seeds = ["n7", "n9", "n3"], ["n0", "n3"]
    args = (rng.choice([1, 2, 3]), rng.choice([5, 12, 100]), rng.choice([6, 15, 40, 200]))
    got = walk.hydrate(n, stored, known, seeds, *args)
    assert (got.nodes, set(got.edges)) == hydrate_by_queue(nodes, edges, known, seeds, *args)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_the_queue(spark, seed):
    rng = random.Random(seed)
    nodes, edges = random_graph(rng, 20, 50, hub=0.2)
    lim = responsibility.Limits(rng.choice([3, 8, 24]), rng.choice([2, 9, 48]), rng.choice([1, 2, 3]), rng.choice([60, 200, 12000]), rng.choice([20, 3000]), rng.choice([0.0, 0.5]), 30, rng.choice([None, ("SUPPORTS",)]))
    root = next(x[0] for x in nodes if visible(x) and x[5] is not None and x[7] == NOW)
    p = responsibility.build(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), "", "project", "/p", NOW, lim, [root])
    picked, used, out, flags = plan_by_queue(nodes, edges, root, lim)
    assert {r["id"]: (r["depth"], r["chars"]) for r in p.nodes.collect()} == picked
    assert {r["id"]: r["depth"] for r in p.edges.collect()} == used
    assert {tuple(r) for r in p.exclusions.collect()} == out and p.exhausted == flags


def test_bucketed_walk_reads_few_partitions(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "SUPPORTS", 1.0) for i in range(200)], EDGE)
    stored = walk.Adjacency.write(e, str(tmp_path / "a"), 64)
    near = stored.around(["n5", "n6"])
    assert {r["id"] for r in near.collect()} == {"e4", "e5", "e6"}
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text


def test_roots_out_of_scope_are_refused(spark):
    n = spark.createDataFrame([("a", "memory", "project", "/other", "a", "t", "{}", None)], NODE)
    e = spark.createDataFrame([], EDGE)
    with pytest.raises(PermissionError):
        walk.neighbourhood(n, e, "a", scope="project", project="/p")
    with pytest.raises(LookupError):
        walk.neighbourhood(n, e, "b", scope="project", project="/p")


def test_plan_from_a_stored_graph(spark, tmp_path):
    """The plan made of hydrated nodes is the plan of the whole graph, where the caps don't bind; far nodes are not read."""
    rows = [(f"n{i:03d}", "memory", "global", None, "about storage" if i == 5 else f"label {i}", "text " * 4, "{}", NOW) for i in range(300)]
    nodes = spark.createDataFrame(rows, NODE)
    edges = spark.createDataFrame([(f"e{i:03d}", f"n{i:03d}", f"n{i + 1:03d}", "SUPPORTS", 0.9) for i in range(299)], EDGE)
    stored = walk.Adjacency.write(edges, str(tmp_path / "a"), 16)
    got = responsibility.plan(nodes, stored, "storage", "global", None, NOW, changed=spark.createDataFrame([("n100",)], "id string"))
    whole = responsibility.build(nodes, edges, "storage", "global", None, NOW, changed=spark.createDataFrame([("n100",)], "id string"))
    assert [tuple(r) for r in got.plan.nodes.collect()] == [tuple(r) for r in whole.nodes.collect()] and [r["id"] for r in got.plan.nodes.collect()] == ["n005", "n004", "n006", "n003", "n007"]
    assert got.candidates == 2 and got.hydrated_nodes == 6 and got.hydrated_edges == 4
    alone = responsibility.plan(nodes, stored, "no such words", "global", None, NOW, explicit=[])
    assert [(r["id"], r["reasons"]) for r in alone.plan.seeds.collect()] == [("n000", ["deterministic-fallback"])]
    assert alone.nodes.where(F.col("id") > "n002").count() == 0


def test_named_nodes_that_are_refused(spark):
    """What a request names but may not see is listed; a source key names a node too."""
    rows = [("a", "memory", "global", None, "a", "t", "{}", NOW, "k:a"), ("b", "memory", "project", "/q", "b", "t", "{}", NOW, "k:b"), ("c", "memory", "global", None, "c", None, "{}", NOW, "k:c"), ("d", "memory", "global", None, "d", "t", "{}", "2020-01-01T00:00:00Z", "k:d")]
    nodes = spark.createDataFrame(rows, NODE + ", source_key string")
    p = responsibility.build(nodes, spark.createDataFrame([], EDGE), "", "project", "/p", NOW, responsibility.Limits(days=30), ["k:a", "b", "c", "k:d"])
    assert [(r["id"], r["reasons"]) for r in p.seeds.collect()] == [("a", ["explicit-id"])]
    assert {tuple(r) for r in p.exclusions.collect()} == {("scope-mismatch", "b", None), ("missing-revision", "c", None), ("freshness-limit", "d", None)}
