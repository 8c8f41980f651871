"""Turns told inside tasks: as many jobs for long runs as for short ones, and the same claims as in rounds."""

import random

import pytest

from quillgraph.operators import containment, deliberation

from test_deliberation import WORDS

COLUMNS = "run string, id string, place int, body string, refs array<string>, targets array<string>"


def sides(spark, runs, n, seed=1):
    rng = random.Random(seed)
    body = (lambda: " ".join(rng.sample(WORDS, rng.randrange(2, 6))))
    some = (lambda c, k, p: [f"{c}{rng.randrange(k)}"] if rng.random() < p else [])
    claims = [(f"run{r}", f"c{i}", i + 1, body(), some("r", 6, 0.6), []) for r in range(runs) for i in range(n)]
    rows = [(f"run{r}", str(i), i + 1, body(), some("r", 6, 0.6), some("t", 4, 0.5), i) for r in range(runs) for i in range(n + 2)]
    return spark.createDataFrame(claims, COLUMNS), spark.createDataFrame(rows, COLUMNS + ", turn int")


@pytest.mark.parametrize("turns", [deliberation.take_turns, deliberation.type_in_turn])
def test_turns_are_the_same_in_rounds(spark, tmp_path, turns):
    claims, rows = sides(spark, 12, 5)
    told = sorted(turns(claims, rows, str(tmp_path / "a")).collect())
    assert told == sorted(turns(claims, rows, str(tmp_path / "b"), group=0).collect()) and len(told) > 40


@pytest.mark.parametrize("turns", [deliberation.take_turns, deliberation.type_in_turn])
def test_jobs_do_not_grow_with_the_rows_that_compete(spark, tmp_path, turns):
    def jobs(n):
        # every row would take the first claim, and shares its target with all
        claims = spark.createDataFrame([("r", f"c{i}", i + 1, "storage format parser", [], []) for i in range(n)], COLUMNS)
        rows = spark.createDataFrame([("r", str(i), i + 1, "storage format parser", [], ["t"], i) for i in range(n)], COLUMNS + ", turn int")
        group = f"{turns.__name__}-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert turns(claims, rows, str(tmp_path / group)).count() == n
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(3) + 2


def test_keys_with_much_text_hold_the_same(spark, monkeypatch):
    rng = random.Random(3)
    text = (lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(n))))
    outer = spark.createDataFrame([(k % 3, k, text(200)) for k in range(60)], "run int, outer int, text string")
    inner = spark.createDataFrame([(k % 3, k, text(8 if k % 2 else 100)) for k in range(60)], "run int, inner int, part string")
    near = sorted(containment.held(outer, inner).collect())
    want = sorted({(o["run"], o["outer"], i["inner"]) for o in outer.collect() for i in inner.collect() if o["run"] == i["run"] and i["part"] and i["part"] in o["text"]})
    assert near == want and len(want) > 100
    for limit in (0, 20 * 2000):
        monkeypatch.setattr(containment, "NEAR", limit)
        assert sorted(containment.held(outer, inner).collect()) == want
