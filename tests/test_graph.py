"""Sync, journal, store, search, plans and sources on small inputs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import identity, text
from quillgraph.operators import checks, evaluation, folds, graph, journal, linkage, search, sync
from quillgraph.operators.store import GraphStore
from quillgraph.plans import responsibility
from quillgraph.sources import files, memories, sessions, specs
from quillgraph.streaming import catalogue, journal_stream

ITEM = "source_adapter string, source_key string, kind string, scope string, project string, label string, content string, uri string, metadata string, source_modified_at string"
EDGE = "source_adapter string, source_key string, target_adapter string, target_key string, kind string, confidence double, derivation string, evidence_refs array<string>, metadata string, input_pos int"


def items(spark, content="Old memory body."):
    return spark.createDataFrame([("test", "memory:stable-key", "memory", "project", "/p", "Stable memory", content, None, "{}", None),
                                  ("test", "document:MEMORY.md", "source_document", "project", "/p", "MEMORY.md", "text", None, "{}", None)], ITEM)


def edges(spark, confidence=0.7):
    return spark.createDataFrame([("test", "memory:stable-key", "test", "document:MEMORY.md", "DERIVED_FROM", confidence, "test-source-reference", [], "{}", 0)], EDGE)


def ops(delta):
    return sorted((r["entity"], r["op"]) for r in delta.collect())


def test_golden_ids(spark):
    g, delta = sync.sync(items(spark), edges(spark), None, "2026-06-01")
    nodes = {r["source_key"]: r["id"] for r in g.nodes.collect()}
    assert nodes["memory:stable-key"] == "graph-node:8a1d5459e6b4ff9479c16771"
    assert nodes["document:MEMORY.md"] == "graph-node:f3f57a0f62109e42d5f4157a"
    def sha(*parts):
        return hashlib.sha256("".join(p + "\0" for p in parts).encode()).hexdigest()[:24]
    rev = "graph-revision:" + sha(nodes["memory:stable-key"], hashlib.sha256(b"Old memory body.\0").hexdigest(), sync.INDEXER)
    assert rev in {r["id"] for r in g.revisions.collect()}
    edge = "graph-edge:" + sha(nodes["memory:stable-key"], nodes["document:MEMORY.md"], "DERIVED_FROM", rev, "test-source-reference")
    assert [r["id"] for r in g.edges.collect()] == [edge]
    assert ops(delta) == [("edge", "created"), ("node", "created"), ("node", "created"), ("revision", "created"), ("revision", "created")]


def test_incremental_sync(spark):
    g, _ = sync.sync(items(spark), edges(spark), None, "2026-06-01")
    same, delta = sync.sync(items(spark), edges(spark), g, "2026-06-02")
    assert ops(delta) == [] and {r["indexed_at"] for r in same.revisions.collect()} == {"2026-06-01"}
    new, delta = sync.sync(items(spark, "New memory body."), edges(spark), g, "2026-06-02")
    assert [r["id"] for r in new.edges.collect()] != [r["id"] for r in g.edges.collect()]
    assert ops(delta) == [("edge", "created"), ("edge", "removed"), ("node", "updated"), ("revision", "created"), ("revision", "removed")]
    assert ops(sync.sync(items(spark), edges(spark, 0.9), g, "x")[1]) == [("edge", "updated")]
    one = items(spark).where("kind = 'source_document'")
    assert ops(sync.sync(one, edges(spark).limit(0), g, "x")[1]) == [("edge", "removed"), ("node", "removed"), ("revision", "removed")]
    assert sync.dangling(g).count() == 0
    with pytest.raises(ValueError):
        sync.sync(one, edges(spark), None, "x")
    with pytest.raises(ValueError):
        sync.sync(items(spark).union(items(spark)), edges(spark), None, "x")


def test_store_journal_and_stream(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert store.read() is None
    g, delta = sync.sync(items(spark), edges(spark), None, "a")
    store.write(g, delta, "/p", "a")
    h, delta = sync.sync(items(spark), edges(spark, 0.95), store.read(), "b")
    meta = store.write(h, delta, "/p", "b")
    assert (meta["version"], meta["sequence"]) == (2, 2)
    with pytest.raises(ValueError):
        store.write(h, delta, "/other", "c")
    last = journal.replay(store.journal(), 1)
    assert [(r["entity"], r["op"]) for r in last.collect()] == [("edge", "upsert")]
    assert [r["confidence"] for r in journal.hydrate(last, store.read().edges, "edge").collect()] == [0.95]
    assert journal.replay_state(store.journal(), 0, node_cap=1).first()["reset_required"]
    assert not journal.replay_state(store.journal(), 1).first()["reset_required"]
    seen = []
    q = journal_stream.replay_to(journal_stream.follow(spark, store.root), lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert set(seen) == {r["id"] for r in journal.replay(store.journal()).collect()}


def test_replay_equals_diff(spark):
    rng, state, rows = random.Random(3), {}, []
    for s in range(1, 40):
        for i in rng.sample(range(12), 3):
            op = rng.choice(["created", "updated", "removed"])
            rows.append((s, "node", op, i))
            state[i] = op
    got = {r["id"]: r["op"] for r in journal.replay(spark.createDataFrame(rows, "sequence int, entity string, op string, id int")).collect()}
    assert got == {i: "removed" if op == "removed" else "upsert" for i, op in state.items()}


def test_search(spark):
    rows = spark.createDataFrame([("a", "alpha topic", "beta beta", "x"), ("b", "none", "alpha gamma", "y"), ("c", "none", "delta", "z")], "id string, label string, content string, metadata string")
    assert [r["id"] for r in search.search(rows, "the alpha", 5).collect()] == ["a", "b"]
    assert search.search(rows, "the of", 5).count() == 0
    index = search.postings(rows)
    new = rows.withColumn("content", F.when(F.col("id") == "c", "omega").otherwise(F.col("content")))
    fresh = search.refresh(index, spark.createDataFrame([("c",)], "id string"), new)
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, search.postings(new).collect()))


def test_plan_budgets(spark):
    rows = [(f"n{i}", "memory", "global" if i != 4 else "project", None if i != 4 else "/other", f"node {i}", "word " * 20, "{}", None) for i in range(6)]
    nodes = spark.createDataFrame(rows, "id string, kind string, scope string, project string, label string, content string, metadata string, modified string")
    e = spark.createDataFrame([(f"e{i}", "n0", f"n{i}", "SUPPORTS", 0.6) for i in range(1, 6)] + [("e9", "n1", "n5", "SUPPORTS", 0.2)], "id string, source_node_id string, target_node_id string, kind string, confidence double")
    def go(**k):
        p = responsibility.build(nodes, e, "", "project", "/p", "2026-07-10T00:00:00Z", responsibility.Limits(**k), explicit=["n0"])
        return [r["id"] for r in p.nodes.collect()], {r["reason"] for r in p.exclusions.collect()}, p
    ids, why, p = go()
    assert ids == ["n0", "n1", "n2", "n3", "n5"] and "scope-mismatch" in why and not p.exhausted["nodes"] and not p.exhausted["edges"]
    assert len(go(nodes=2)[0]) == 2 and go(nodes=2)[2].exhausted["nodes"]
    assert go(edges=1)[2].edges.count() == 1 and go(edges=1)[2].exhausted["edges"]
    assert go(hops=0)[0] == ["n0"] and go(hops=0)[2].exhausted["hops"]
    ids, _, p = go(chars=150)
    assert sum(r["chars"] for r in p.nodes.collect()) == 150 and p.exhausted["chars"]
    assert go(tokens=30)[2].exhausted["tokens"]
    assert go(kinds=("DUPLICATES",))[0] == ["n0"] and go(confidence=0.5)[1] >= {"confidence-filter"}
    assert {r["state"] for r in p.units.collect()} == {"awake", "sleeping"}
    assert sum(len(r["text"]) for r in responsibility.context(p, nodes, 120).collect()) == 120


def test_reach(spark):
    e = spark.createDataFrame([(f"e{i}", "r", f"n{i}", "SUPPORTS", 1.0) for i in range(8)], "id string, source_node_id string, target_node_id string, kind string, confidence double")
    assert graph.reach(e, spark.createDataFrame([("n1",)], "id string"), 2).count() == 9


def hub(spark, bad):
    """A hub n0 whose first ``bad`` edges lead to stale nodes, the last to a fresh one; n0 and n1 are linked twice."""
    now = "2026-07-10T00:00:00Z"
    rows = [(f"n{i}", "memory", "global", None, f"n{i}", "text", None, now if i < 3 else "2020-01-01T00:00:00Z") for i in range(bad + 3)]
    nodes = spark.createDataFrame(rows, "id string, kind string, scope string, project string, label string, content string, metadata string, modified string")
    ends = [(f"e{i:05d}", f"n{i + 3}") for i in range(bad)] + [("f1", "n1"), ("f2", "n1"), ("f3", "n2")]
    return nodes, spark.createDataFrame([(e, "n0", n, "SUPPORTS", 1.0) for e, n in ends], "id string, source_node_id string, target_node_id string, kind string, confidence double")


def test_plan_sees_all_edges_of_a_hub(spark):
    nodes, e = hub(spark, 1300)
    p = responsibility.build(nodes, e, "", "global", None, "2026-07-10T00:00:00Z", responsibility.Limits(days=30, hops=1), explicit=["n0"])
    assert [r["id"] for r in p.nodes.collect()] == ["n0", "n1", "n2"] and {r["id"] for r in p.edges.collect()} == {"f1", "f2", "f3"}
    reasons = p.exclusions.groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in reasons} == {"freshness-limit": 1300, "hop-limit": 3}


def line(kind, **payload):
    return json.dumps({"timestamp": "2026-07-01T00:00:00Z", "type": kind, "payload": payload})


def test_session_segmentation(spark, tmp_path):
    log = [line("session_meta", id="s1", cwd="/p"), line("response_item", type="message", role="user", content="Fix the broken import"),
           line("response_item", type="function_call", name="shell"), line("response_item", type="function_call_output", output='{"exit_code": 2}'),
           line("response_item", type="message", role="assistant", content=[{"type": "t", "text": "done"}]), line("compacted"),
           line("response_item", type="message", role="user", content="<environment_context>x"), line("response_item", type="message", role="user", content="Implement the parser"), "not json"]
    (tmp_path / "rollout-1.jsonl").write_text("\n".join(log))
    parsed = sessions.parse_lines(sessions.read_logs(spark, str(tmp_path)))
    units = sessions.with_ids(sessions.segment(parsed), sessions.headers(parsed)).orderBy("ordinal").collect()
    assert [(u["start_line"], u["phase"], u["reasons"]) for u in units] == [(2, "diagnosis", ["goal-change"]), (8, "implementation", ["compaction", "goal-change", "diagnosis-to-implementation"])]
    assert units[0]["tools"] == {"shell": 1} and units[0]["failures"] == ["tool result failed with exit code 2"] and units[0]["outcomes"] == ["done"]
    assert parsed.where("bad").count() == 1 and units[0]["session_id"] == "s1" and units[0]["id"] != units[1]["id"]


def test_notes_skills_and_specs(spark, tmp_path):
    home = tmp_path / "memories"
    (home / "extensions/ad_hoc").mkdir(parents=True)
    (home / "MEMORY.md").write_text("# Group\napplies_to: cwd=/work/a and more\n## Fixes\n- Fix: restart it\n- plain (cwd=/w, thread_id=t1)\n# Other\n- loose preference\n")
    (home / "extensions/ad_hoc/n.md").write_text("just a note")
    rows = {r["id"]: r for r in memories.to_records(memories.read_notes(spark, str(home))).collect()}
    assert set(rows) == {"memory:MEMORY.md:4", "memory:MEMORY.md:5", "memory:MEMORY.md:7", "memory:extensions/ad_hoc/n.md:1"}
    first = rows["memory:MEMORY.md:4"]
    assert (first["heading"], first["project"], first["type"], first["scope"]) == ("Fixes", "/work/a", "procedural", "project")
    assert rows["memory:MEMORY.md:5"]["thread_id"] == "t1" and rows["memory:MEMORY.md:7"]["type"] == "operational" and rows["memory:MEMORY.md:7"]["scope"] == "global"
    for p in ("s/one", "s/plugins/cache/two"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "SKILL.md").write_text("x")
    assert [r["name"] for r in files.read_skills(spark, str(tmp_path / "s")).collect()] == ["one"]
    assert files.read_glob(spark, f"{home}/**.md").count() == 2
    assert specs.parse_spec("file:/a%20b?limit=3").value == "/a b" and specs.parse_spec("codex:skills").kind == "codex:skills"
    with pytest.raises(ValueError):
        specs.parse_spec("what:ever")


def test_linkage_and_routing(spark):
    claims = spark.createDataFrame([(1, 1, "The parser must reject unknown fields early"), (1, 2, "Cache invalidation happens nightly")], "run int, id int, body string")
    rows = spark.createDataFrame([(1, 7, "the parser must reject unknown fields early"), (1, 8, "invalidation of the cache happens"), (1, 9, "unrelated words only")], "run int, id int, body string")
    got = {r["row"]: (r["claim"], r["score"]) for r in linkage.best(linkage.match(claims, rows), claims.withColumn("place", F.col("id"))).collect()}
    assert got[7] == (1, 100) and got[8][0] == 2 and 9 not in got
    assert linkage.assign_once(linkage.match(claims, rows)).count() == 2
    cand = spark.createDataFrame([(1, 1, "never delete the archive without asking the owner first", ["r"], "keeps the archive intact")], "run int, id int, body string, refs array<string>, future string")
    mem = spark.createDataFrame([(1, 5, "delete the archive after asking the owner")], "run int, id int, body string")
    fin = spark.createDataFrame([(1, 6, "delete the archive asking owner first", "too_weak")], "run int, id int, body string, relation string")
    r = linkage.route(cand, mem, fin).first()
    assert (r["overlap_detected"], r["contradiction_risk"], r["weakness_detected"], r["high_impact"], r["survivors"]) == (True, True, False, True, 0)


def test_checks_and_evaluation(spark):
    p = spark.createDataFrame([(1, "create", ["a", "b"]), (2, "create", ["a", "z"]), (3, "drop", [])], "id int, action string, refs array<string>")
    allowed = spark.createDataFrame([("a",), ("b",)], "ref string")
    assert {(r["id"], r["ref"]) for r in checks.unsupported_refs(p, allowed).collect()} == {(2, "z"), (3, None)}
    typed = spark.createDataFrame([(10, "create", ["a", "b", "c"])], "id int, action string, refs array<string>")
    assert {r["id"] for r in checks.underived(p, typed).collect()} == {2, 3}
    runs = [spark.createDataFrame([x], "calls int, tokens int, citation_validity double, duplicate_rate double") for x in ((5, 1000, 1.0, 0.0), (2, 400, 1.0, 0.0))]
    r = checks.compare_runs(*runs).first()
    assert (round(r["call_reduction"], 3), round(r["token_reduction"], 3), r["passed"]) == (0.6, 0.6, True)
    h = spark.createDataFrame([("h1", "alpha beta gamma", "s1"), ("h2", "delta epsilon", "s2")], "id string, query string, target string")
    res = spark.createDataFrame([("h1", "u1", "s1", 1, "alpha beta text"), ("h2", "u2", "s9", 1, "none")], "holdout_id string, unit_id string, session_id string, rank int, text string")
    r = evaluation.evaluate(h, res).first()
    assert (r["recall"], r["durable_recall"], r["duplicate_rate"]) == (0.5, 0.5, 0.0)
    assert evaluation.fixture_nodes(spark, 1000).where("kind = 'memory'").count() == 429


def test_catalogue(spark):
    new = spark.createDataFrame([("a", 1, "1"), ("b", 2, "1"), ("c", 3, "9"), ("e", 1, "1")], "path string, size int, mtime_ns string")
    old = spark.createDataFrame([("a", 1, "1", True, True), ("b", 2, "1", False, False), ("c", 3, "1", True, True), ("d", 1, "1", True, True)], "path string, size int, mtime_ns string, content_indexed boolean, matches boolean")
    d = catalogue.decide(new, old)
    assert {r["path"]: r["action"] for r in d.collect()} == {"a": "hit", "b": "skip", "c": "probe", "d": "drop", "e": "probe"}
    assert catalogue.diagnostics(d).first()["cache_hits"] == 1


def test_budget_and_text(spark):
    df = spark.createDataFrame([(1, "a", 30), (2, "a", 30), (3, "a", 30)], "k int, g string, n int")
    assert [r["taken"] for r in folds.budget(df, F.col("n"), 50, ["k"], ["g"]).orderBy("k").collect()] == [30, 20, 0]
    one = spark.createDataFrame([("  Some   long\ttext here  ", "a\r\nb\rc")], "a string, b string")
    r = one.select(text.compact(F.col("a"), 12).alias("a"), text.normalise_newlines(F.col("b")).alias("b"), text.utf16_length(F.lit("a\U0001F600b")).alias("u"), identity.project_key(F.lit("/x/My Repo")).alias("k"), text.redact(F.lit("Bearer abc.def")).alias("s")).first()
    assert r["a"] == "Some long..." and r["b"] == "a\nb\nc" and r["u"] == 4 and r["k"].startswith("my-repo-") and r["s"] == "Bearer [redacted]"
    assert text.query_tokens("The we topic-17 of X") == ["topic-17"]
