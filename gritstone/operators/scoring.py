"""Answers to questions turned into issues, severities, weights and rankings.

Answers come long, as (unit, question, value). All arithmetic over a unit's answers happens in one pass after a single
shuffle by unit: the answers become a map, and the questions, a short list known to the driver, are expressions over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity bands by rounded expectation; fixed values.
BANDS = ("P3", "P2", "P1", "P0")
#: Issue types that count as wrong rather than badly shaped; fixed values.
CORRECTNESS = ("defect", "security")


@dataclass(frozen=True)
class Question:
    """What a question raises: an issue of ``type`` under ``label`` (its own name by default), as likely as the answer, times the
    answer to ``when``; ``on_true`` False turns the answer round, ``strongest`` keeps the likeliest per type only, ``floor`` is a
    probability or one per model prefix with a ``default``."""

    name: str
    type: str | None = None
    label: str | None = None
    when: str | None = None
    on_true: bool = True
    strongest: bool = False
    floor: float | dict[str, float] = 0.0
    languages: tuple[str, ...] = field(default=())


def own_floor(floor: float | dict[str, float], model: Column) -> Column:
    """A question's floor for a model: of several prefixes of the model's name the longest decides, else the default."""
    if not isinstance(floor, dict):
        return F.lit(float(floor))
    out = F.lit(float(floor["default"]))
    for prefix in sorted((p for p in floor if p != "default"), key=len):
        out = F.when(model.startswith(prefix), F.lit(float(floor[prefix]))).otherwise(out)
    return out


def floor_for(floor: Column, run_floor: float) -> Column:
    """The higher of a question's and the run's floor; a run at zero shows everything."""
    return F.lit(0.0) if run_floor == 0 else F.greatest(floor, F.lit(float(run_floor)))


def answer_map(answers: DataFrame, unit: str, question: str, value: str) -> DataFrame:
    """``(unit, answers)``: one map of answers per unit; of an answer given twice the highest counts."""
    once = answers.where(f"`{unit}` IS NOT NULL AND `{question}` IS NOT NULL AND `{value}` IS NOT NULL").groupBy(unit, question).agg(F.max(value).alias(value))
    return once.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(question, value))).alias("answers"))


def raise_issues(units: DataFrame, unit: str, questions: Sequence[Question], run_floor: float = 0.0, model: Column | None = None) -> DataFrame:
    """``(unit, question, type, label, probability, floor)`` of every issue above its floor; ``units`` has ``answers``."""
    model = F.lit(None).cast("string") if model is None else model
    options = []
    for seq, q in enumerate(questions):
        if q.type is None:
            continue
        own = F.element_at("answers", q.name)
        gate = F.coalesce(F.element_at("answers", q.when), F.lit(0.0)) if q.when else F.lit(1.0)
        raised = own * gate if q.on_true else 1 - own
        options.append(
            F.struct(
                F.lit(q.name).alias("question"), F.lit(q.type).alias("type"), F.lit(q.label or q.name).alias("label"), raised.alias("probability"),
                floor_for(own_floor(q.floor, model), run_floor).alias("floor"), F.lit(q.strongest).alias("strongest"), F.lit(seq).alias("seq"),
            )
        )
    raised = units.select(unit, F.explode(F.filter(F.array(*options), lambda i: i["probability"] > i["floor"])).alias("i")).select(unit, "i.*")
    best = Window.partitionBy(unit, "type", "strongest").orderBy(F.desc("probability"), "seq")
    return raised.withColumn("n", F.row_number().over(best)).where("n = 1 OR NOT strongest").drop("n", "strongest", "seq")


def severity(masses: Column) -> Column:
    """A struct of ``expected``, ``predicted`` (3 less that), ``band`` and ``likeliest`` from a map of level to probability mass."""
    entries = F.map_entries(masses)
    expected = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["key"].cast("double") * e["value"])
    best = F.element_at(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].cast("int").alias("k")))), 1)["k"]
    bands = F.array(*(F.lit(b) for b in BANDS))
    band = lambda i: F.try_element_at(bands, (i + 1).cast("int"))
    return F.struct(expected.alias("expected"), (3 - expected).alias("predicted"), band(F.floor(expected + 0.5)).alias("band"), band(best).alias("likeliest"))


def issue_weights(issues: DataFrame, unit: str, expected: DataFrame) -> DataFrame:
    """``(unit, correctness, design, weight)``: expected trouble, correctness weighed by the unit's expected severity (1 where it
    has none) and design as itself. ``expected`` is ``(unit, expected)``."""
    right = F.col("type").isin(*CORRECTNESS)
    sums = issues.groupBy(unit).agg(F.sum(F.when(right, F.col("probability")).otherwise(0.0)).alias("correctness"), F.sum(F.when(~right, F.col("probability")).otherwise(0.0)).alias("design"))
    weight = F.col("correctness") * F.coalesce("expected", F.lit(1.0)) + F.col("design")
    return sums.join(expected, unit, "left").withColumn("weight", weight).drop("expected")


def matches(issues: DataFrame, unit: str, clauses: Sequence[tuple[str, str]]) -> DataFrame:
    """Units that match a filter: clauses of one key are alternatives, different keys must all hold."""
    keys: dict[str, list[str]] = {}
    for key, value in clauses:
        keys.setdefault(key, []).append(value)
    held = [F.bool_or(F.col(key).isin(*values)) for key, values in keys.items()]
    return issues.groupBy(unit).agg(*(h.alias(f"k{i}") for i, h in enumerate(held))).where(" AND ".join(f"k{i}" for i in range(len(held))) or "true").select(unit)


def filter_strength(issues: DataFrame, unit: str, clauses: Sequence[tuple[str, str]]) -> DataFrame:
    """``(unit, strength)``: the likeliest match per key, multiplied over the keys; 0 where a key matches nothing."""
    keys: dict[str, list[str]] = {}
    for key, value in clauses:
        keys.setdefault(key, []).append(value)
    best = [F.coalesce(F.max(F.when(F.col(key).isin(*values), F.col("probability"))), F.lit(0.0)) for key, values in keys.items()]
    strength = best[0]
    for b in best[1:]:
        strength = strength * b
    return issues.groupBy(unit).agg(strength.alias("strength"))


def merge_passes(readings: DataFrame, unit: str, order: str, lead: str, follow: Sequence[str], grows: Sequence[str], first: Sequence[str]) -> DataFrame:
    """One row per unit from several passes over it: ``grows`` take the maximum, ``follow`` the values of the pass with the highest
    ``lead`` (of equals the first), ``first`` those of the first pass."""
    top = F.struct(F.coalesce(lead, F.lit(float("-inf"))), -F.col(order))
    return readings.groupBy(unit).agg(
        *(F.max(c).alias(c) for c in grows), *(F.max_by(c, top).alias(c) for c in follow), *(F.min_by(c, order).alias(c) for c in first), F.count(F.lit(1)).alias("passes")
    )


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 10) -> DataFrame:
    """Page ``number`` from 1 of ``size`` rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def usage_cost(usage: DataFrame, model: str, tokens: str, prices: dict[str, float | None]) -> DataFrame:
    """Requests, tokens and dollars per model; a model without a price has a null cost."""
    price = F.lit(None).cast("double")
    for name, dollars in prices.items():
        if dollars is not None:
            price = F.when(F.col(model) == name, F.lit(dollars)).otherwise(price)
    return usage.groupBy(model).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).withColumn("cost", F.round(F.col("tokens") * price / 1e6, 9))
