"""Named parts of an evaluation: what a name stands for, and task configurations that include and group others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut

KINDS = ("model", "metric", "aggregation", "filter", "task")
_known: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Keep a function under a name of its kind; a name is given once."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")

    def keep(f: Callable) -> Callable:
        if (kind, name) in _known:
            raise ValueError(f"{kind} {name} is taken")
        _known[kind, name] = f
        return f

    return keep


def named(kind: str, name: str) -> Callable:
    """The function of that name."""
    try:
        return _known[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} {name}; there are {', '.join(names(kind))}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)


register("metric", "exact")(lambda predicted, gold: (F.trim(F.lower(predicted)) == F.trim(F.lower(gold))).cast("double"))
register("metric", "contains")(lambda predicted, gold: F.contains(F.lower(predicted), F.lower(gold)).cast("double"))
register("metric", "same_length")(lambda predicted, gold: (F.length(predicted) == F.length(gold)).cast("double"))
register("aggregation", "mean")(F.avg)
register("aggregation", "median")(F.median)
register("aggregation", "sum")(F.sum)
register("filter", "strip")(F.trim)
register("filter", "lowercase")(F.lower)
register("filter", "first_word")(lambda c: F.substring_index(F.trim(c), " ", 1))


def evaluate(rows: DataFrame, filters: list[str], metrics: list[tuple[str, str]], predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """One row: each (metric, aggregation) by name over the replies after the named filters, as metric_aggregation."""
    reply = F.col(predicted)
    for f in filters:
        reply = named("filter", f)(reply)
    return rows.agg(*[named("aggregation", a)(named("metric", m)(reply, F.col(gold))).alias(f"{m}_{a}") for m, a in metrics])


def resolve(configs: DataFrame, deepest: int = 20) -> DataFrame:
    """(name, settings): configurations (name, include, settings) with what they include filled in, own settings first.

    A chain of includes is followed a step a round, all configurations together. A cycle, or a name that isn't there, is an error.
    """
    known = {r[0] for r in configs.select("name").collect()}
    if missing := {r[0] for r in configs.select("include").where("include is not null").collect()} - known:
        raise KeyError(f"included but not there: {', '.join(sorted(missing))}")
    up = configs.select(F.col("name").alias("include"), F.col("include").alias("next"), F.col("settings").alias("more"))
    at = configs
    for _ in range(deepest):
        if not at.where("include is not null").limit(1).count():
            return at.select("name", "settings")
        joined = at.join(up, "include", "left")
        rest = F.map_filter(F.coalesce("more", F.create_map().cast("map<string, string>")), lambda k, v: ~F.map_contains_key("settings", k))
        at = cut(joined.select("name", F.col("next").alias("include"), F.map_concat("settings", rest).alias("settings")), "configs")
    raise ValueError(f"includes go deeper than {deepest}, or in a circle")


def members(groups: DataFrame, deepest: int = 20) -> DataFrame:
    """(group, task): the tasks of each group (group, member), groups among the members opened up."""
    at, done = groups.select("group", F.col("member").alias("task")), None
    inner = groups.select(F.col("group").alias("task"), "member")
    for _ in range(deepest):
        leaf = at.join(inner.select("task").distinct(), "task", "left_anti").select("group", "task")
        done = leaf if done is None else done.unionByName(leaf)
        at = cut(at.join(inner, "task").select("group", F.col("member").alias("task")), "groups")
        if not at.limit(1).count():
            return done.distinct()
    raise ValueError(f"groups go deeper than {deepest}, or in a circle")
