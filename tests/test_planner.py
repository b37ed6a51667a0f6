"""Levels of plans against the executor of the same module, and what steps are told."""

from __future__ import annotations

import random

import pytest

from lodemill.operators import planner


def executed(plan: dict[int, list]) -> dict[int, int]:
    """Levels as the executor runs the steps."""
    level: dict[int, int] = {}
    out = planner.execute([planner.Task(s, "T", "", tuple(d)) for s, d in plan.items()], lambda t, before: level.setdefault(t.step, 1 + max((level[d] for d in before), default=-1)))
    assert set(out.results) == set(level) and out.blocked == set(plan) - set(level)
    return level


def found(spark, plan: dict[int, list], **how) -> dict[int, int]:
    rows = spark.createDataFrame([(s, d) for s, d in plan.items()], "step int, dependencies array<int>")
    got = [(r["step"], r["level"]) for r in planner.levels(rows, **how).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


BEHIND_A_CYCLE = {1: [], 4: [1, 8], 5: [4], 6: [5], 8: [9], 9: [8]}


@pytest.mark.parametrize("gathered", [0, planner.GATHERED])
def test_steps_behind_a_cycle_have_no_level(spark, gathered):
    assert found(spark, BEHIND_A_CYCLE, gathered=gathered) == executed(BEHIND_A_CYCLE) == {1: 0}
    for plan in ({1: [1], 2: [1], 3: [99]}, {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [4, 99], 6: [8], 7: [6], 8: [7]}):
        assert found(spark, plan, gathered=gathered) == executed(plan)


def test_long_chains_and_diamonds(spark):
    chain = {k: [k - 1] if k else [] for k in range(1000)}
    assert found(spark, chain) == {k: k for k in range(1000)}
    diamonds = {0: []} | {3 * k + j: [3 * k] if j < 3 else [3 * k + 1, 3 * k + 2] for k in range(20) for j in (1, 2, 3)}
    assert found(spark, diamonds) == executed(diamonds) and max(found(spark, diamonds).values()) == 40
    short = {k: [k - 1] if k else [] for k in range(6)}
    assert found(spark, short, gathered=2) == executed(short)


@pytest.mark.parametrize("gathered", [9, planner.GATHERED])
def test_many_plans(spark, gathered):
    rng = random.Random(5)
    plans = {p: {s: [rng.randrange(8) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))] for s in rng.sample(range(8), rng.randint(1, 7))} for p in [None, *"abcdefghijklmnopqrstuvwxyz"]}
    rows = [(p, s, d) for p, plan in plans.items() for s, d in plan.items()]
    rows += rows[:20] + [("a", None, [1]), (None, None, None), ("z2", 1, None), ("z2", 2, [None, 1])]
    plans["z2"] = {1: [], 2: [1]}
    frame = spark.createDataFrame(rows, "plan string, step long, dependencies array<long>")
    got = sorted((str(r["plan"]), r["step"], r["level"]) for r in planner.levels(frame, "plan", gathered=gathered).collect())
    assert got == sorted((str(p), s, n) for p, plan in plans.items() for s, n in executed(plan).items())
    assert planner.levels(frame.limit(0), "plan").count() == 0


def test_prompts_as_of_one_step(spark):
    tasks = spark.createDataFrame([("p", 1, "one", None), ("p", 2, "two", [1, 1]), ("p", 3, "three", [2, 1, 99]), ("p", 4, "four", [3])], "plan string, step int, description string, dependencies array<int>")
    results = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "plan string, step int, result string")
    got = {r["step"]: r["prompt"] for r in planner.prompts(tasks, results, spark.createDataFrame([("p", "why?")], "plan string, question string")).collect()}
    said = {1: "a", 2: "b"}
    assert set(got) == {1, 2, 3}
    for step, name, deps in ((1, "one", []), (2, "two", [1]), (3, "three", [1, 2])):
        assert got[step] == planner.step_prompt(planner.Task(step, "T", name), "why?", {d: said[d] for d in deps})


def test_plans_are_gathered_by_one_shuffle(spark):
    rows = [(1, 2, [1, 9, None]), (1, 1, None), (1, 2, [1]), (None, 5, []), (1, 3, [2, 2]), (1, 4, [4])]
    found = planner.levels(spark.createDataFrame(rows, "plan long, step long, dependencies array<long>"), "plan")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (None, 5, 0)]
