"""Typed plans over registered sources: selection, steps, guarded SQL, answer (AGT-01..10, ARR-10, JN-11)."""

from __future__ import annotations

import enum
import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.plans.guard import check

MAX_ROWS, DEPENDENCY_ROWS, ANSWER_ROWS, RETRIES = 1000, 3, 10, 1


# The kinds of sources and operations, and the field names of a plan, as planners write them.
class SourceType(enum.Enum):
    SQL = "sql"
    API = "api"
    SPREADSHEETS = "spreadsheets"

    @classmethod
    def _missing_(cls, value):
        return cls.SPREADSHEETS if value in ("excel", "spreadsheet") else None


class Operation(enum.Enum):
    FILTER = "filter"
    AGGREGATION = "aggregation"
    LOOKUP = "lookup"
    COMPARISON = "comparison"
    LIST = "list"


class Status(enum.Enum):
    SUCCESS = "success"
    EMPTY = "empty"
    ERROR = "error"


class Provider(Protocol):
    """What a language model must offer; none is shipped."""

    def chat(self, system: str, user: str) -> str: ...


@dataclass
class Step:
    id: int
    description: str
    source_id: str
    source_type: SourceType
    operation: Operation
    depends_on: list[int] = field(default_factory=list)
    sql: str | None = None


@dataclass
class StepResult:
    step_id: int
    status: Status
    source_id: str
    rows: list[dict] = field(default_factory=list)
    sql: str | None = None
    error: str | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass
class Response:
    query: str
    answer: str
    steps: list[Step]
    results: list[StepResult]
    cited: list[str]
    seconds: dict[str, float]
    selected: list[str] = field(default_factory=list)

    @property
    def has_unanswered_steps(self) -> bool:
        return any(r.status is not Status.SUCCESS for r in self.results)

    def display(self) -> str:
        """Three layers as text: selected sources, plan with query, rows and error of each step, answer with its sources (AGT-10).

        Results are matched to steps by id; a step without one is pending.
        """
        by_id = {r.step_id: r for r in self.results}
        out = [f"# {self.query}", "", "## Fontes selecionadas", *([f"- {c}" for c in self.selected] or ["- none"]), "", "## Plano"]
        for s in self.steps:
            r = by_id.get(s.id)
            out.append(f"{s.id}. [{r.status.value if r else 'pending'}] {s.operation.value} {s.source_id}: {s.description}")
            if r:
                out.append(f"   consulta: {r.sql or '-'}")
                out.append(f"   linhas: {r.row_count}")
                if r.error:
                    out.append(f"   erro: {r.error}")
        out += ["", "## Resposta", self.answer, "", f"Fontes consultadas: {', '.join(self.cited) or 'none'}"]
        return "\n".join(out)


def json_object(text: str) -> dict:
    """The first JSON object in a model's answer (STR-16)."""
    m = re.search(r"\{.*\}", text, re.DOTALL)
    if not m:
        raise ValueError("no JSON object in the answer")
    return json.loads(m.group())


def parse_plan(text: str) -> list[Step]:
    """Typed steps of {"steps": [...]}; missing fields and unknown kinds raise (ARR-10)."""
    steps = []
    for s in json_object(text)["steps"]:
        depends = s.get("depends_on") or []
        steps.append(Step(int(s["id"]), s["description"], s["source_id"], SourceType(s["source_type"]), Operation(s["operation"]), [int(d) for d in (depends if isinstance(depends, list) else [depends])], s.get("sql")))
    return steps


def in_order(steps: list[Step]) -> list[Step]:
    """Steps after those they depend on; unknown dependencies are ignored, a cycle raises."""
    left, done, out = {s.id: s for s in steps}, set(), []
    while left:
        ready = [s for s in left.values() if all(d in done or d not in left for d in s.depends_on)]
        if not ready:
            raise ValueError(f"steps depend on each other: {sorted(left)}")
        for s in ready:
            out.append(s)
            done.add(s.id)
            del left[s.id]
    return out


# ---------------------------------------------------------------- the five operations as plans
def op_filter(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def op_aggregation(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def op_lookup(df: DataFrame, other: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """df with columns of other by key; rows without a partner stay."""
    return df.join(other.select(*on, *columns).dropDuplicates(on), on, "left")


def op_comparison(expected: DataFrame, existing: DataFrame, on: list[str], value: str) -> DataFrame:
    """expected, existing and their difference by key; a negative difference is a deficit."""
    both = expected.select(*on, F.col(value).alias("expected")).join(existing.select(*on, F.col(value).alias("existing")), on, "full_outer")
    filled = both.withColumns({"expected": F.coalesce("expected", F.lit(0)), "existing": F.coalesce("existing", F.lit(0))})
    return filled.withColumn("difference", F.col("existing") - F.col("expected")).withColumn("deficit", F.col("difference") < 0)


def op_list(df: DataFrame, columns: list[str], order: list[str], n: int | None = None) -> DataFrame:
    out = df.select(*columns).distinct().orderBy(*order)
    return out if n is None else out.limit(n)


# ---------------------------------------------------------------- execution
def execute_sql(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> StepResult:
    """Guarded query of at most max_rows rows; errors come back as a status, never as an exception (AGT-07, SRT-04)."""
    verdict = check(spark, sql)
    if not verdict.allowed:
        return StepResult(0, Status.ERROR, "", sql=sql, error=verdict.reason)
    try:
        rows = [r.asDict(recursive=True) for r in spark.sql(sql.rstrip().rstrip(";")).limit(max_rows).collect()]
    except Exception as e:
        return StepResult(0, Status.ERROR, "", sql=sql, error=str(e).split("\n")[0][:500])
    return StepResult(0, Status.SUCCESS if rows else Status.EMPTY, "", rows, sql)


class Agent:
    """Answers questions over temporary views; selector, planner, SQL writer and answerer are given or simple defaults."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame], select: Callable[[str], list[str]], plan: Callable[[str, list[str]], list[Step]], write_sql: Callable[[Step, dict[int, StepResult], str | None], str] | None = None, answer: Callable[[str, list[Step], list[StepResult]], str] | None = None, executable: frozenset[SourceType] = frozenset({SourceType.SQL})):
        self.executable = executable  # kinds of steps that are run; others end with an error (AGT-06)
        self.spark, self.sources = spark, dict(sources)
        self.select, self.plan = select, plan
        self.write_sql = write_sql or (lambda step, before, error: step.sql or f"SELECT * FROM {view_name(step.source_id)}")
        self.answer = answer or template_answer
        for sid, df in self.sources.items():
            df.createOrReplaceTempView(view_name(sid))

    def selected(self, query: str) -> list[str]:
        """Known ids of the selection, all sources if none is left (AGT-02, PRJ-07)."""
        return [s for s in dict.fromkeys(self.select(query)) if s in self.sources] or list(self.sources)

    def run_step(self, step: Step, before: dict[int, StepResult]) -> StepResult:
        """One step with one more try on a failed query; a failed query text is not tried again (AGT-05)."""
        if step.source_id not in self.sources:
            return StepResult(step.id, Status.ERROR, step.source_id, error=f"unknown source {step.source_id}")
        if step.source_type not in self.executable:
            return StepResult(step.id, Status.ERROR, step.source_id, error=f"no executor for {step.source_type.value} is implemented")
        context = {d: before[d] for d in step.depends_on if d in before}
        error, result = None, None
        for _ in range(RETRIES + 1):
            try:
                sql = self.write_sql(step, {k: StepResult(r.step_id, r.status, r.source_id, r.rows[:DEPENDENCY_ROWS], r.sql, r.error) for k, r in context.items()}, error)
            except Exception as e:
                return StepResult(step.id, Status.ERROR, step.source_id, error=f"no query: {e}")
            result = execute_sql(self.spark, sql)
            result.step_id, result.source_id = step.id, step.source_id
            if result.status is not Status.ERROR:
                break
            error = result.error
        return result

    def query(self, text: str) -> Response:
        seconds, at = {}, time.perf_counter()

        def lap(name: str) -> None:
            nonlocal at
            seconds[name], at = time.perf_counter() - at, time.perf_counter()

        chosen = self.selected(text)
        lap("select")
        steps = self.plan(text, chosen)
        lap("plan")
        results: dict[int, StepResult] = {}
        for s in in_order(steps):
            results[s.id] = self.run_step(s, results)
        lap("execute")
        listed = [results[s.id] for s in steps]
        said = self.answer(text, steps, listed)
        lap("answer")
        cited = list(dict.fromkeys(r.source_id for r in listed if r.status is Status.SUCCESS))
        return Response(text, said, steps, listed, cited, seconds, chosen)


def view_name(source_id: str) -> str:
    return re.sub(r"\W+", "_", source_id)


def template_answer(query: str, steps: list[Step], results: list[StepResult]) -> str:
    """Plain answer from at most ANSWER_ROWS rows of each successful step (AGT-08)."""
    lines = []
    for s, r in zip(steps, results):
        if r.status is Status.SUCCESS:
            lines.append(f"{s.description}: {r.row_count} rows")
            lines += ["  " + ", ".join(f"{k}={v}" for k, v in row.items()) for row in r.rows[:ANSWER_ROWS]]
        else:
            lines.append(f"{s.description}: {r.status.value}" + (f" ({r.error})" if r.error else ""))
    return "\n".join(lines)
