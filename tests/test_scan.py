"""Listing, scope scans and source sets on files of the test's own."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import scan, sessions


def log(path, cwds, goal):
    rows = [{"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": path.stem[-1], "cwd": cwds[0]}}]
    rows += [{"timestamp": f"2026-01-01T00:00:0{i}Z", "type": "turn_context", "payload": {"cwd": c}} for i, c in enumerate(cwds[1:], 1)]
    rows.append({"timestamp": "2026-01-01T00:00:08Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": goal}})
    rows.append({"timestamp": "2026-01-01T00:00:09Z", "type": "response_item", "payload": {"type": "function_call_output", "output": "x" * 70_000}})
    path.write_text("\n".join(map(json.dumps, rows)))


def test_scopes_and_probe(spark, tmp_path):
    for name, cwds in (("a", ["/p"]), ("b", ["/other"]), ("c", ["/p", "/other"]), ("d", ["/other", "/else"])):
        log(tmp_path / f"rollout-{name}.jsonl", cwds, f"Fix the failing build of {name}")
    (tmp_path / "rollout-e.jsonl").write_text('{"type": "response_item"}\nno json')
    assert scan.list_sessions(spark, str(tmp_path)).count() == 5
    lines = sessions.read_logs(spark, str(tmp_path))
    rows = {r["session_id"]: r for r in scan.scopes(lines).collect()}
    assert rows["c"]["cwds"] == ["/other", "/p"] and rows["c"]["first_ts"].endswith("00:00Z") and rows["c"]["last_ts"].endswith("00:09Z")
    assert rows["a"]["long_lines"] == 1 and rows["a"]["headed"] and not rows["rollout-e"]["headed"]
    units, decided = scan.select_units(lines, F.col("cwd") == "/p")
    got = {r["path"][-7]: (r["scan"], r["reason"]) for r in decided.collect()}
    assert got == {"a": ("full", None), "b": ("header", "filter-mismatch"), "c": ("scope", "mixed-scope"), "d": ("scope", "filter-mismatch"), "e": ("header", "no-header")}
    one = scan.scan_counts(decided, units).first()
    assert (one["candidate_files"], one["full_scans"], one["mixed_scope_rejected"], one["selected_units"]) == (5, 1, 1, 1)
    assert {r["scan"] for r in scan.probe(scan.scopes(lines)).collect()} == {"full", "header"}


def test_sets_and_artifacts(spark, tmp_path):
    (tmp_path / "one.md").write_text("# T\n- a note")
    docs = scan.load_set(spark, "file", str(tmp_path / "one.md"), "s0")
    assert docs.count() == 1 and scan.union_first([docs, docs]).count() == 1
    with pytest.raises(ValueError):
        scan.load_set(spark, "codex:sessions", "x", "s1")
    rows = spark.createDataFrame([(1, "x")], "id int, body string")
    scan.write_artifact(rows, str(tmp_path / "run"), "claims")
    assert scan.read_artifact(spark, str(tmp_path / "run"), "claims", "id int, body string").collect() == rows.collect()
    assert scan.read_artifact(spark, str(tmp_path / "run"), "none", "id int").count() == 0


def test_days_of_sessions(spark):
    rows = spark.createDataFrame([("2026-07-09T00:00:00Z",), ("2026-06-01T00:00:00Z",), ("no time",), (None,)], "t string")
    young = (lambda days: [r[0] for r in rows.select(scan.within_days(rows["t"], "2026-07-10T00:00:00Z", days)).collect()])
    assert young(7) == [True, False, True, True] and young(0) == young(None) == [True] * 4
