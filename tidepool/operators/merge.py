"""The final action of a row: the gravest of its checks' actions, with all reasons in order of gravity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import ConfiguredCheck

#: Actions by gravity, and the views by their action.
PRIORITY = {"keep": 0, "review": 1, "drop": 2, "restricted": 3}
BUCKETS = {"clean": "keep", "review": "review", "dropped": "drop", "restricted": "restricted"}


def final_columns(parts: Sequence[tuple[str, Column, Column]]) -> dict[str, Column]:
    """From (name, action, reason) in operator order. Hits are sorted by priority; among equals the operator order holds."""

    def entry(i: int, name: str, action: Column, reason: Column) -> Column:
        weight = F.lit(0)
        for a, p in PRIORITY.items():
            weight = F.when(F.lower(F.trim(action)) == a, -p).otherwise(weight)
        return F.struct(F.coalesce(weight, F.lit(0)).alias("p"), F.lit(i).alias("i"), F.lit(name).alias("name"), F.coalesce(reason, F.lit("")).alias("reason"))

    if not parts:
        return {"final_action": F.lit("keep"), "final_reason": F.lit(""), "triggered_operator_names": F.lit("")}
    hits = F.array_sort(F.filter(F.array(*[entry(i, *x) for i, x in enumerate(parts)]), lambda h: h["p"] < 0))
    top = F.coalesce(F.try_element_at(hits, F.lit(1))["p"], F.lit(0))
    action = F.lit("keep")
    for a, p in PRIORITY.items():
        action = F.when(top == -p, a).otherwise(action)
    reasons = F.filter(F.transform(hits, lambda h: h["reason"]), lambda r: r != "")
    return {"final_action": action, "final_reason": F.array_join(reasons, "; "), "triggered_operator_names": F.array_join(F.transform(hits, lambda h: h["name"]), ";")}


def merge_actions(evaluated: DataFrame, checks: Sequence[ConfiguredCheck]) -> DataFrame:
    return evaluated.withColumns(final_columns([(c.check.qualified, F.col(c.check.action_column), F.col(c.check.reason_column)) for c in checks]))


def bucket(merged: DataFrame, kind: str) -> DataFrame:
    """clean, review, dropped, restricted, or full: the first four are disjoint and together the last."""
    if kind == "full":
        return merged
    if kind not in BUCKETS:
        raise ValueError(f"unknown view {kind!r}")
    return merged.where(F.col("final_action") == BUCKETS[kind])


def action_summary(merged: DataFrame) -> DataFrame:
    """One row: total and the rows of each final action."""
    return merged.agg(F.count("*").alias("total"), *[F.count_if(F.col("final_action") == a).alias(n) for n, a in BUCKETS.items()])


def operator_summary(evaluated: DataFrame, checks: Sequence[ConfiguredCheck]) -> DataFrame:
    """A row for each check with the number of rows of each action; one aggregation over the table."""
    sums = [F.count_if(F.col(c.check.action_column) == a).alias(f"{c.name}__{a}") for c in checks for a in PRIORITY]
    one = evaluated.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c.name).alias("operator"), *[F.col(f"{c.name}__{a}").alias(a) for a in PRIORITY]) for c in checks])
    return one.select(F.inline(rows))
