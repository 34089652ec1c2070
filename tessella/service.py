"""Questions to answers: one engine with its resources, its handlers and its callbacks, all of which may be replaced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.query import Compiler, Plan, PlanError
from tessella.plans.schema import anchored_plan, question_plan
from tessella.plans.vocabulary import COMMERCE, Vocabulary, iri

#: Phases a question goes through, and ways a query may be transformed.
PHASES = ("route", "plan", "run", "answer")
MODES = ("identity", "rewrite", "hyde")


@dataclass
class Resources:
    """Models from outside. ``embed``: texts to vectors; ``rerank``: a query and texts to (place, score); ``transform``: a query and a mode to a query."""

    embed: Callable[[list[str]], list[list[float]]] | None = None
    rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None
    transform: Callable[[str, str], str] | None = None


def transformed(query: str, mode: str, resources: Resources) -> dict[str, str]:
    """The query for each side: ``sparse`` and ``dense``. A hypothetical answer (hyde) is for the dense side only; a rewriting for both.

    An unknown mode, a missing model and an empty answer raise: a query is never silently another.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "identity":
        return {"sparse": query, "dense": query}
    if resources.transform is None:
        raise ValueError(f"{mode} needs a model")
    new = resources.transform(query, mode)
    if not isinstance(new, str) or not new.strip():
        raise ValueError("a transformed query must say something")
    return {"sparse": query if mode == "hyde" else new, "dense": new}


@dataclass
class Answer:
    """What came of a question: its status (answered, empty, unresolved), the plan, the rows and the text."""

    status: str
    plan: Plan | None = None
    rows: DataFrame | None = None
    text: str = ""


@dataclass
class Engine:
    """Answers questions over one folder. ``handlers`` take a question before the router does and return an ``Answer`` or None."""

    spark: SparkSession
    folder: str
    vocabulary: Vocabulary = COMMERCE
    resources: Resources = field(default_factory=Resources)
    handlers: list[Callable[[str], Answer | None]] = field(default_factory=list)
    on_phase: Callable[[str, Any], None] | None = None
    on_text: Callable[[str], None] | None = None

    def _phase(self, name: str, what: Any = None) -> None:
        if self.on_phase:
            self.on_phase(name, what)

    def mention(self, question: str, tables: tuple[str, ...] = ("region", "nation")) -> tuple[str, Any] | None:
        """The entity of some small tables whose label a question says: the longest, of equal ones the first table's; matched where the labels are."""
        from pyspark.sql import functions as F

        best = None
        for t in tables:
            found = self.vocabulary.label(self.spark, self.folder, t).where((F.length("label") >= 4) & F.contains(F.lit(question.upper()), F.upper("label")))
            hit = found.orderBy(F.desc(F.length("label")), "label").first()
            if hit and (best is None or len(hit.label) > best[0]):
                best = (len(hit.label), t, hit.key)
        return best[1:] if best else None

    def plan(self, question: str) -> Plan | None:
        """The router: a plan from the one entity a question names, else from its turn of phrase."""
        plan = question_plan(self.vocabulary, question)
        if plan and (anchor := self.mention(question)):
            return anchored_plan(self.vocabulary, anchor, plan.target) or plan
        return plan

    def ask(self, question: str, show: int = 5) -> Answer:
        """The answer to a question. Its text names the first ``show`` rows; the rows themselves are a frame."""
        self._phase("route", question)
        for h in self.handlers:
            if (given := h(question)) is not None:
                self._phase("answer", given)
                return given
        plan = self.plan(question)
        self._phase("plan", plan)
        if plan is None:
            return Answer("unresolved", text="No plan fits the question.")
        try:
            rows = Compiler(self.vocabulary, self.spark, self.folder).run(plan)
        except PlanError as e:
            return Answer("unresolved", plan, text=str(e))
        self._phase("run", plan)
        some = rows.limit(show).collect()
        lines = [" ".join(str(x) for x in r) for r in some]
        for x in lines:
            if self.on_text:
                self.on_text(x + "\n")
        out = Answer("answered" if some else "empty", plan, rows, "\n".join(lines))
        self._phase("answer", out)
        return out


def described(v: Vocabulary, spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``entity``, ``property``, ``value``: every datatype fact of a table's entities, in one pass."""
    from pyspark.sql import functions as F

    own = [(n, p.value) for n, p in sorted(v.properties.items()) if p.table == table and not p.range_table and not p.inverse_of]
    facts = F.array(*[F.struct(F.lit(n).alias("property"), F.expr(x).cast("string").alias("value")) for n, x in own])
    return v.rows(spark, folder, table).select(iri(table, "key").alias("entity"), F.inline(facts)).where("value is not null")
