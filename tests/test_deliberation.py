"""The artifacts of many runs beside one run told step by step."""

import random

import pytest

from quillgraph.operators import deliberation

MESSAGE = "run string, pos int, message string, step string, phase string, status string, agent string"
ROW = "run string, message string, list string, `index` int, body string, refs array<string>, targets array<string>, action string, confidence double, relation string, rationale string, reason string"
KINDS = {"duplicate": "duplicate", "too_weak": "evidence_gap", "contradiction": "conflict", "refinement": "scope_risk", "supersession": "staleness"}
WORDS = "storage format parser cache index schema token window bucket planner".split()


def tokens(s):
    return {w for w in s.split() if len(w) >= 4}


def score(claim, body):
    if not body:
        return 0
    if claim == body:
        return 100
    if body in claim or claim in body:
        return 90
    if claim[:80] in body:
        return 80
    a, b = tokens(claim), tokens(body)
    if not a or not b:
        return 0
    r = len(a & b) / min(len(a), len(b))
    return 70 if r >= 0.6 else 45 if r >= 0.35 else 20 if r >= 0.2 else 0


def find(claims, row):
    same = [c for c in claims if set(c["refs"]) & set(row["refs"])]
    found = []
    for c in claims:
        s = score(c["body"], row["body"]) + (45 if set(c["targets"]) & set(row["targets"]) else 0)
        s += 15 if len(same) == 1 and same[0] is c else 0
        found.append((s + (8 if c["place"] == row["index"] + 1 else 0), c))
    found.sort(key=lambda x: -x[0])
    if not found or found[0][0] <= 0 or len(found) > 1 and found[0][0] == found[1][0] < 60:
        return None
    return found[0][1]


def by_hand(run, messages, rows):
    done = [m for m in messages if m["status"] == "succeeded"]
    def first(step, phase):
        mine = [m for m in done if m["step"] == step]
        return next((m for m in mine if m["phase"] == phase), mine[0] if mine else None)
    def of(m, name):
        return [r for r in rows if m and r["message"] == m["message"] and r["list"] == name]
    claims, trace, challenges = [], [], []
    for m in done:
        if m["step"] == "claim-scout":
            claims += [{"place": 0, "body": r["body"], "refs": r["refs"], "targets": [], "action": None, "confidence": None, "status": "proposed", "reason": None} for r in of(m, "candidates")]
    for i, c in enumerate(claims):
        c["place"] = i + 1
        c["body"] = c["body"] or f"Unnamed claim {i + 1}"
        trace.append(("claim", i + 1, c["body"]))
    for r in of(first("proposal-editor", "typed-proposal"), "typed"):
        c = find(claims, r)
        if c:
            c.update(action=r["action"], targets=r["targets"], confidence=r["confidence"])
    final = first("decision-synthesizer", "proposal-synthesis")
    def resolution(c):
        for r in of(final, "rejected"):
            if score(c["body"], r["body"]):
                return r["reason"] or r["rationale"] or "Rejected during proposal synthesis."
        for r in of(final, "proposals"):
            if score(c["body"], r["body"]):
                return r["rationale"] or "Accepted into final proposal synthesis."
    for m in (first("memory-cartographer", "memory-cartography"), first("evidence-auditor", "preflight-critique")):
        for r in of(m, "findings"):
            c = find(claims, r)
            if not c:
                continue
            if r["relation"] == "novel":
                c["status"] = "endorsed" if c["status"] == "proposed" else c["status"]
                trace.append(("endorsement", c["place"], r["rationale"] or "Claim was endorsed as novel."))
            elif r["relation"] in KINDS:
                c["status"], why = "challenged", resolution(c)
                c["reason"] = why or c["reason"]
                text = r["rationale"] or f"{r['relation']} relationship raised for claim."
                challenges.append((c["place"], KINDS[r["relation"]], "resolved" if why else "open", text, why))
                trace.append(("challenge", c["place"], text))
    taken, own = [], final and final["phase"] == "proposal-synthesis"
    for name in ("proposals", "rejected"):
        for r in of(final, name):
            free = [c for c in claims if not own or c["place"] not in taken]
            c = find(free or claims, r)
            if not c:
                continue
            if own:
                taken.append(c["place"])
                if name == "proposals":
                    c.update(status="accepted", reason=r["rationale"], action=r["action"] or c["action"], targets=r["targets"], confidence=c["confidence"] if r["confidence"] is None else r["confidence"])
                else:
                    c.update(status="rejected", reason=r["reason"] or r["rationale"])
            trace.append(("handoff", c["place"], r["rationale"] or "Claim was handed off as a proposal candidate.") if name == "proposals" else ("challenge", c["place"], r["reason"] or r["rationale"] or "Claim was rejected."))
    for c in claims:
        c["status"] = "unresolved" if c["status"] == "proposed" else c["status"]
    return claims, challenges, trace


def random_run(rng, run):
    def body():
        return " ".join(rng.sample(WORDS, rng.randrange(2, 6))) if rng.random() < 0.9 else None
    def row(message, name, i):
        return dict(run=run, message=message, list=name, index=i, body=body(), refs=[f"r{rng.randrange(6)}"] if rng.random() < 0.6 else [], targets=[f"t{rng.randrange(4)}"] if rng.random() < 0.5 else [],
                    action=rng.choice([None, "create", "update"]), confidence=rng.choice([None, 0.5, 0.9]), relation=rng.choice([None, "novel", "other", *KINDS]),
                    rationale=rng.choice([None, f"why {i}"]), reason=rng.choice([None, f"because {i}"]))
    messages, rows = [], []
    plan = [("claim-scout", "candidate-proposal", "candidates", 5), ("claim-scout", "late", "candidates", 3), ("proposal-editor", rng.choice(["typed-proposal", "draft"]), "typed", 4), ("memory-cartographer", "memory-cartography", "findings", 5),
            ("evidence-auditor", "preflight-critique", "findings", 5), ("evidence-auditor", "second", "findings", 3), ("decision-synthesizer", rng.choice(["proposal-synthesis", "proposal-synthesis", "draft"]), "proposals", 5)]
    for k, (step, phase, name, n) in enumerate(plan):
        if k and rng.random() < 0.1:
            continue
        m = dict(run=run, pos=k, message=f"m{k}", step=step, phase=phase, status="failed" if k and rng.random() < 0.1 else "succeeded", agent=f"{step}-agent")
        messages.append(m)
        rows += [row(m["message"], name, i) for i in range(rng.randrange(1, n + 1))]
        if name == "proposals":
            rows += [row(m["message"], "rejected", i) for i in range(rng.randrange(0, 4))]
    return messages, rows


def test_artifacts_equal_the_steps_of_each_run(spark):
    rng, messages, rows, want = random.Random(4), [], [], {}
    while len(want) < 40:
        run = f"run{len(want)}"
        m, r = random_run(rng, run)
        heard = {x["message"] for x in m if x["status"] == "succeeded"}
        claims = sum(x["list"] == "candidates" and x["message"] in heard for x in r)
        if sum(x["list"] in ("proposals", "rejected") for x in r) > claims:
            continue
        messages, rows = messages + m, rows + r
        want[run] = by_hand(run, m, r)
    got = deliberation.artifacts(spark.createDataFrame([tuple(m.values()) for m in messages], MESSAGE), spark.createDataFrame([tuple(r.values()) for r in rows], ROW))
    claims = {run: [] for run in want}
    for r in got.claims.orderBy("run", "place").collect():
        claims[r["run"]].append({k: r[k] for k in ("place", "body", "refs", "targets", "action", "confidence", "status", "reason")})
    assert {r: [(a, b) for a, b in zip(claims[r], want[r][0]) if a != b] for r in want if claims[r] != want[r][0]} == {}
    ledger = {run: [] for run in want}
    for r in sorted(got.challenges.collect(), key=lambda r: int(r["challenge"].split(":")[2])):
        ledger[r["run"]].append((int(r["claim"].split(":")[2]), r["kind"], r["status"], r["rationale"], r["resolution"]))
    assert ledger == {run: w[1] for run, w in want.items()}
    trace = {run: [] for run in want}
    for r in got.trace.orderBy("run", "n").collect():
        trace[r["run"]].append((r["kind"], int(r["claim"].split(":")[2]), r["summary"]))
    assert trace == {run: w[2] for run, w in want.items()}
    counts = {r["run"]: r for r in got.summary.collect()}
    for run, (c, h, t) in want.items():
        r = counts[run]
        assert (r["claims"], r["accepted_claims"], r["rejected_claims"], r["challenged_claims"], r["challenges"], r["unresolved_challenges"], r["moves"]) == (
            len(c), *[sum(x["status"] == s for x in c) for s in ("accepted", "rejected", "challenged")], len(h), sum(x[2] == "open" for x in h), len(t))


def test_turns_when_all_claims_are_taken(spark, tmp_path):
    claims = spark.createDataFrame([("r", "a", 1, "storage format parser", [], []), ("r", "b", 2, "cache index schema", [], [])], "run string, id string, place int, body string, refs array<string>, targets array<string>")
    rows = [("r", str(i), i + 1, b, [], [], i) for i, b in enumerate(["storage format parser", "storage format parser cache index schema", "cache index schema", "storage format"])]
    df = spark.createDataFrame(rows, "run string, id string, place int, body string, refs array<string>, targets array<string>, turn int")
    assert {(r["row"], r["claim"]) for r in deliberation.take_turns(claims, df, str(tmp_path / "w")).collect()} == {("0", "a"), ("1", "b"), ("2", "b"), ("3", "a")}


@pytest.mark.parametrize("part", ["messages", "rows"])
def test_nothing_comes_of_nothing(spark, part):
    m, r = random_run(random.Random(1), "x")
    messages, rows = spark.createDataFrame([tuple(x.values()) for x in m], MESSAGE), spark.createDataFrame([tuple(x.values()) for x in r], ROW)
    got = deliberation.artifacts(messages.where("false") if part == "messages" else messages, rows.where("false") if part == "rows" else rows)
    assert got.claims.count() == got.challenges.count() == got.trace.count() == 0
