"""Plans of steps that depend on each other: their levels, what each step is told, and their execution.

Levels of all plans of a table are found together, by peeling: a step leaves when all of its dependencies have left, and the
round in which it leaves is its level. Plans of an ordinary size are peeled each in one go where their steps are gathered;
steps of plans that are too large for that leave round by round, by anti-joins on the dependencies that are left.
Execution submits the steps of a level together, each of which may start Spark jobs of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps and dependencies of a plan that one task may hold.
GATHERED = 100_000


def levels(tasks: DataFrame, plan: str | None = None, gathered: int = GATHERED) -> DataFrame:
    """``step``, ``level`` (and ``plan`` before them, if there is one) of ``tasks(step, dependencies)``.

    A step's level is the longest chain of dependencies before it, 0 without any. Steps on a cycle, and all behind one, have
    no level and no row. Dependencies that are no steps of the plan are ignored, as are null ones; rows of one step add up
    their dependencies; a step on itself is a cycle. Null steps are left out; rows whose plan is null are one plan.
    """
    from lodemill.sources.tables import written

    own = [plan] if plan else []
    part = [F.col(f"`{c}`").alias("plan") for c in own] or [F.lit(0).alias("plan")]
    rows = tasks.select(*part, F.col("step"), F.explode_outer("dependencies").alias("dep")).where("step is not null")
    rows = written(rows, "steps")  # (plan, step, dep), dep null for steps without
    large = written(rows.groupBy("plan").agg(F.count("*").alias("n")).where(F.col("n") > gathered).select("plan"), "large")
    named = lambda out: out.select(*[F.col("plan").alias(c) for c in own], "step", "level")
    if large.isEmpty():
        return named(_peeled(rows))
    same = lambda x, y, on: x["plan"].eqNullSafe(y["plan"]) & on
    small = rows.join(large, same(rows, large, F.lit(True)), "left_anti")
    big = written(rows.join(large, same(rows, large, F.lit(True)), "left_semi").distinct(), "big")
    nodes = written(big.select("plan", "step").distinct(), "nodes")
    known = nodes.withColumnRenamed("step", "known")
    edges = big.where("dep is not null").join(known, same(big, known, big["dep"] == known["known"]), "left_semi")
    return named(_peeled(small).unionByName(_peeled_in_rounds(nodes, edges)))


def _peeled(steps: DataFrame) -> DataFrame:
    """Levels of plans that are gathered each in a row, from ``plan, step, dep``, the last null for a step without; rows may repeat."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    rows = steps.groupBy("plan").agg(F.collect_list(F.struct("step", "dep")).alias("edges")).select("plan", "edges.step", "edges.dep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, steps, level = [], [], []
            for k, (s, d) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for step, at in _peel(s, d):
                    owner.append(k)
                    steps.append(step)
                    level.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(steps, batch.column(1).type.value_type), pa.array(level, pa.int32())], ["plan", "step", "level"])

    return rows.mapInArrow(run, f"plan {kinds['plan']}, step {kinds['step']}, level int")


def _peel(steps: list, deps: list) -> Iterator[tuple]:
    """Each step and its level, from steps and a dependency beside each; those that are null or no steps are ignored."""
    waits, behind, level = dict.fromkeys(steps, 0), defaultdict(list), 0
    for step, dep in zip(steps, deps, strict=True):
        if dep in waits:  # a pair that comes twice is waited for, and met, twice
            waits[step] += 1
            behind[dep].append(step)
    ready = [s for s, n in waits.items() if not n]
    while ready:
        yield from ((s, level) for s in ready)
        after = []
        for s in (s for d in ready for s in behind[d]):
            waits[s] -= 1
            if not waits[s]:
                after.append(s)
        ready, level = after, level + 1


def _peeled_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of plans of any size: in each round the dependencies on what has just left go, and steps with none left leave.

    Rounds are as many as the longest chain has steps. Each reads the dependencies that are left, and writes those that it
    has not used up.
    """
    from lodemill.sources.tables import written

    on = lambda x, y, a, b: x["plan"].eqNullSafe(y["plan"]) & (x[a] == y[b])
    ready = written(nodes.join(edges, on(nodes, edges, "step", "step"), "left_anti"), "level0")
    found, level, left = [ready.withColumn("level", F.lit(0))], 0, edges
    while not ready.isEmpty():
        level += 1
        used = ready.select(F.col("plan").alias("_plan"), F.col("step").alias("_step"), F.lit(True).alias("used"))
        marked = written(left.join(used, left["plan"].eqNullSafe(used["_plan"]) & (left["dep"] == used["_step"]), "left").select("plan", "step", "dep", "used"), f"edges{level}")
        left = marked.where("used is null").drop("used")
        freed = marked.where("used").select("plan", "step").distinct()
        ready = written(freed.join(left, on(freed, left, "step", "step"), "left_anti"), f"level{level}")
        found.append(ready.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, found)


def prompts(tasks: DataFrame, results: DataFrame, questions: DataFrame, plan: str = "plan") -> DataFrame:
    """``plan``, ``step`` and ``prompt``: what a model is told of each step whose dependencies have given results.

    ``tasks(plan, step, description, dependencies)``, ``results(plan, step, result)``, ``questions(plan, question)``. A prompt
    holds the question, the results of the step's dependencies in their order, and what is to do; a step with a dependency
    that is known but has no result has no row. Dependencies that are no steps of the plan are ignored. Rows of one step add
    up their dependencies; of several descriptions, or results, the least is taken.
    """
    steps = tasks.groupBy(plan, "step").agg(F.min("description").alias("description"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("dependencies", F.array())))).alias("dependencies"))
    known = results.groupBy(plan, "step").agg(F.min("result").alias("result"))
    there = steps.select(plan, "step").join(known, [plan, "step"], "left").withColumnRenamed("step", "dep")
    line = F.concat(F.lit("step "), F.col("dep").cast("string"), F.lit(": "), F.col("result").cast("string"))
    said = steps.select(plan, "step", F.explode("dependencies").alias("dep")).join(there, [plan, "dep"]).groupBy(plan, "step")
    said = said.agg(F.array_sort(F.collect_list(F.struct("dep", line.alias("line")))).alias("earlier"), F.bool_and(F.col("result").isNotNull()).alias("whole"))
    asked = steps.select(plan, "step", "description").join(said, [plan, "step"], "left").where("coalesce(whole, true)").join(questions, plan)
    earlier = F.array_join(F.transform("earlier", lambda e: e["line"]), "\n")
    text = F.concat(F.lit("question: "), F.col("question"), F.coalesce(F.concat(F.lit("\n"), earlier), F.lit("")), F.lit("\ntask: "), F.col("description"))
    return asked.select(plan, "step", text.alias("prompt"))


@dataclass
class Task:
    step: int
    tool: str = "AUTO"
    description: str = ""
    dependencies: tuple[int, ...] = ()


@dataclass
class Outcome:
    """What the steps gave; steps that failed, that were blocked by one, or that lie on a cycle are not among the results."""

    results: dict[int, Any] = field(default_factory=dict)
    failed: dict[int, Exception] = field(default_factory=dict)
    blocked: set[int] = field(default_factory=set)
    aborted: bool = False

    @property
    def last(self) -> Any:
        return self.results[max(self.results)] if self.results else None


def execute(tasks: list[Task], run: Callable[[Task, dict[int, Any]], Any], on_failure: Callable[[Task, Exception, int], tuple[str, str | None]] | None = None, threads: int = 8) -> Outcome:
    """Run all steps whose dependencies have given results, level by level.

    ``on_failure`` gets the task, the error and the attempts so far, and says RETRY, SWITCH_TOOL with a tool, CLARIFY or
    ABORT; ABORT ends the plan after its level. Unknown dependencies are ignored.
    """
    known = {t.step for t in tasks}
    waiting = {t.step: (t, {d for d in t.dependencies if d in known}) for t in tasks}
    out = Outcome()

    def one(task: Task) -> Any:
        attempts = 0
        while True:
            attempts += 1
            try:
                return run(task, {d: out.results[d] for d in task.dependencies if d in out.results})
            except Exception as error:
                action, tool = on_failure(task, error, attempts) if on_failure else ("FAIL", None)
                if action == "RETRY":
                    continue
                if action == "SWITCH_TOOL" and tool and tool != task.tool:
                    task, attempts = Task(task.step, tool, task.description, task.dependencies), 0
                    continue
                if action == "ABORT":
                    out.aborted = True
                raise

    with ThreadPoolExecutor(threads) as pool:
        while not out.aborted and (ready := [t for t, d in waiting.values() if d <= out.results.keys()]):
            for t in ready:
                del waiting[t.step]
            futures = [(t, pool.submit(one, t)) for t in ready]
            for t, f in futures:
                try:
                    out.results[t.step] = f.result()
                except Exception as error:
                    out.failed[t.step] = error
    out.blocked = set(waiting)
    return out


class ToolRegistry:
    """Tools by name."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable[[str], Any]] = {}

    def register(self, name: str, tool: Callable[[str], Any]) -> None:
        self._tools[name] = tool

    def names(self) -> tuple[str, ...]:
        return tuple(self._tools)

    def run(self, name: str, text: str) -> Any:
        return self._tools[name](text)


def step_prompt(task: Task, question: str, results: dict[int, Any]) -> str:
    """What a model is told of a step: the question, what earlier steps gave, and what to do."""
    earlier = "\n".join(f"step {k}: {v}" for k, v in sorted(results.items()))
    return f"question: {question}\n{earlier}\ntask: {task.description}" if earlier else f"question: {question}\ntask: {task.description}"
