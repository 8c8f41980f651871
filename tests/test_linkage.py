"""Containment and claim linkage beside plain loops."""

import random
import time

import pytest

from quillgraph.operators import containment, deliberation, linkage


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "ab é𝄞"
    outer = [(rng.randrange(3), f"o{i}", "".join(rng.choice(letters) for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    inner = []
    for i in range(150):
        run, _, text = rng.choice(outer)
        lo = rng.randrange(len(text) + 1)
        part = text[lo:lo + rng.choice((0, 1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 130))]
        inner.append((run if rng.random() < 0.8 else 1, f"i{i}", part if rng.random() < 0.8 else part[:40] + "b" + part[40:]))
    outer += [(0, "null", None), outer[0]]
    inner += [(0, "null", None), inner[0]]
    got = containment.held(spark.createDataFrame(outer, "run int, outer string, text string"), spark.createDataFrame(inner, "run int, inner string, part string"))
    want = {(r, o, i) for r, o, t in outer for q, i, p in inner if r == q and t and p and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100


def test_containment_of_nothing(spark):
    outer = spark.createDataFrame([], "run int, outer string, text string")
    inner = spark.createDataFrame([(1, "a", "b")], "run int, inner string, part string")
    assert containment.held(outer, inner).count() == 0
    assert containment.held(inner.toDF("run", "outer", "text"), inner.where("false")).count() == 0


def test_containment_is_linear(spark):
    """Ten times the text costs far less than a hundred times as much: 800,000 characters in a few seconds."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(800_000))
    outer = spark.createDataFrame([(1, "o", text)], "run int, outer string, text string")
    inner = spark.createDataFrame([(1, "i", text[500_000:500_090]), (1, "j", text[700_000:700_010]), (1, "k", text[100:160] + "zz")], "run int, inner string, part string")
    containment.held(outer.limit(0), inner).count()
    began = time.perf_counter()
    assert sorted(r["inner"] for r in containment.held(outer, inner).collect()) == ["i", "j"]
    assert time.perf_counter() - began < 30


def test_ties_go_to_the_first_claim(spark):
    """Claims 2 and 10 have the same body: both score 100, and the one that comes first wins, not the one whose id sorts first."""
    body = "the very same body of a claim about storage formats"
    claims = [("r", f"claim:r:{p}", p, body if p in (2, 10) else f"another body number{p} altogether different", [f"x{p}"], [f"t{p}"]) for p in range(1, 12)]
    rows = [("r", "f", 40, body, ["none"], ["none"]), ("r", "g", 41, None, ["x3"], ["t9"]), ("r", "h", 42, None, ["none"], ["none"])]
    c = spark.createDataFrame(claims, "run string, id string, place int, body string, refs array<string>, targets array<string>")
    r = spark.createDataFrame(rows, "run string, id string, place int, body string, refs array<string>, targets array<string>")
    got = {x["row"]: (x["claim"], x["score"]) for x in deliberation.find_claims(c, r).collect()}
    assert got == {"f": ("claim:r:2", 100), "g": ("claim:r:9", 45)}


def test_scores_by_rule(spark):
    """Each step of the body score: equal, within, head within, shares of common tokens; ties under 60 have no claim."""
    long = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    claims = [(1, "a", 1, long), (1, "b", 2, "quebec romeo sierra tango uniform"), (1, "c", 3, "twin token body"), (1, "d", 4, "twin token body")]
    rows = [(1, "equal", long.upper()), (1, "within", "quebec  romeo sierra"), (1, "around", "x " + long + " y"), (1, "head", "zz " + long[:80] + " zulu yankee"),
            (1, "seventy", "romeo quebec tango whiskey xray"), (1, "few", "sierra victor whiskey xray yankee"), (1, "tied", "token twin other words here"), (1, "none", "nothing shared")]
    c = spark.createDataFrame(claims, "run int, id string, place int, body string")
    got = {x["row"]: (x["claim"], x["score"]) for x in linkage.best(linkage.match(c, spark.createDataFrame(rows, "run int, id string, body string")), c).collect()}
    assert got == {"equal": ("a", 100), "within": ("b", 90), "around": ("a", 90), "head": ("a", 80), "seventy": ("b", 70), "few": ("b", 20), "tied": ("c", 70)}


def test_texts_meet_only_where_one_holds_the_other(spark):
    """Pairs that share tokens are scored by counts: 200 claims and 300 rows of 40,000 characters, whose 60,000 pairs with texts would be 2.4 GB."""
    words = " ".join(f"common{i}" for i in range(12))
    claims = [(1, f"c{i}", i, f"claim{i:04d} {words} alone{i:04d}") for i in range(200)]
    rows = [(1, f"r{i}", f"claim{i % 200:04d} {words} " + "padding " * 5000) for i in range(300)]
    c, r = spark.createDataFrame(claims, "run int, id string, place int, body string"), spark.createDataFrame(rows, "run int, id string, body string")
    linkage.match(c.limit(1), r.limit(1)).count()
    began = time.perf_counter()
    scores = linkage.match(c, r)
    assert {x["score"]: x["count"] for x in scores.groupBy("score").count().collect()} == {70: 60_000 - 300, 80: 300}
    assert time.perf_counter() - began < 20


def test_bodies_are_folded_once(spark):
    """The joins read folded bodies that are written once; rows longer than every claim have no ends looked up."""
    c = spark.createDataFrame([(1, "a", "short claim about tokens")], "run int, id string, body string")
    r = spark.createDataFrame([(1, "x", "claim  about"), (1, "y", "a much longer row than any claim of the run " * 3)], "run int, id string, body string")
    met = linkage.match(c, r)
    assert "regexp_replace" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x) for x in met.collect()} == {(1, "x", "a", 90), (1, "y", "a", 20)}
