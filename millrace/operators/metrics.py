"""Metrics over entities that are joined by declared links: metric, dimension, grain and filter as one DataFrame.

A link leads from many rows of one entity to at most one row of another. From a metric's entity only such steps are
taken, so no row is counted twice; what lies behind a step the other way is refused. Metrics of several entities are
aggregated apart, each to the asked dimensions, and united then, so their rows are never joined with each other.
Where several ways lead to an entity none is guessed: leave links out, or name the entity twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.errors import InvalidInput
from millrace.functions.expressions import col
from millrace.operators.checked_sql import checked_expression

GRAINS = ("year", "quarter", "month", "week", "day", "hour")
# How a metric is made from rows, and from the parts that rows of one link were aggregated to.
_WHOLE = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "count_distinct": F.count_distinct}
_PARTS = {"sum": [(F.sum, F.sum)], "min": [(F.min, F.min)], "max": [(F.max, F.max)], "count": [(F.count, F.sum)],
          "mean": [(F.sum, F.sum), (F.count, F.sum)]}


@dataclass(frozen=True)
class Link:
    """`many` rows hold the key of one row of `one`; `on`: (column of many, column of one) pairs."""

    name: str
    many: str
    one: str
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Metric:
    """`func` over a SQL expression of the entity's columns; count without an expression counts rows."""

    entity: str
    func: str
    expression: str | None = None


def _ways(links: list[Link], start: str, goal: str, seen: tuple[str, ...] = ()) -> list[list[Link]]:
    if start == goal:
        return [[]]
    return [[link, *rest] for link in links if link.many == start and link.one not in (*seen, start)
            for rest in _ways(links, link.one, goal, (*seen, start))]


def way(links: Iterable[Link], start: str, goal: str) -> list[Link]:
    """The links from `start` to `goal`: the only way there is, else an error."""
    found = _ways(list(links), start, goal)
    if not found:
        back = " (it lies behind many rows for one, which would count rows several times)" if _ways(list(links), goal, start) else ""
        raise InvalidInput(f"no link leads from {start} to {goal}{back}")
    if len(found) > 1:
        shown = [" > ".join(link.name for link in x) for x in found]
        raise InvalidInput(f"several ways lead from {start} to {goal}: {shown}; leave links out")
    return found[0]


def repeated_keys(entities: dict[str, DataFrame], links: Iterable[Link]) -> DataFrame:
    """(link, keys): how many keys of a link's one side stand in several rows. Such a link would multiply rows.

    NULL in a key never joins and isn't counted.
    """
    def of(link: Link) -> DataFrame:
        one = entities[link.one]
        keys = one.select(*(col(one, c).alias(f"k{i}") for i, (_, c) in enumerate(link.on))).dropna()
        twice = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return twice.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(link.name).alias("link"), "keys")

    return reduce(DataFrame.unionByName, [of(link) for link in links])


def _place(name: str) -> tuple[str, str]:
    entity, _, column = name.partition(".")
    return entity, column


def measure(entities: dict[str, DataFrame], links: Iterable[Link], metrics: dict[str, Metric], dimensions: dict[str, str] | None = None,
            grain: dict[str, tuple[str, str]] | None = None, filters: Iterable[tuple[str, str]] = (), without: Iterable[str] = (),
            aggregate_first: bool = False) -> DataFrame:
    """One row per combination of dimensions that any metric has rows for, NULL being a value of its own.

    `dimensions`: {result column: "entity.column"}; `grain`: {result column: ("entity.column", unit)}, cut to that unit;
    `filters`: (entity, SQL expression), which keep the rows whose row of that entity passes; `without`: names of links to
    leave out. A row without a partner has NULL dimensions there. Counts are 0 where an entity has no rows, other metrics NULL.

    With `aggregate_first` rows are aggregated by the keys of their links before they are joined (map-side first): worth
    it where the other side is too large to be sent around or few keys hold most rows. Not for count_distinct.
    """
    if not metrics:
        raise InvalidInput("ask for a metric at least")
    places = {**{n: (*_place(p), None) for n, p in (dimensions or {}).items()}, **{n: (*_place(p), unit) for n, (p, unit) in (grain or {}).items()}}
    taken = [n.lower() for n in [*(dimensions or {}), *(grain or {}), *metrics]]
    if len(set(taken)) < len(taken):
        raise InvalidInput("result columns need names of their own")
    named = {m.entity for m in metrics.values()} | {e for e, _, _ in places.values()} | {e for e, _ in filters}
    if unknown := sorted(named - set(entities)):
        raise InvalidInput(f"unknown entities {unknown}")
    for m in metrics.values():
        if m.func not in _WHOLE or (m.expression is None and m.func != "count"):
            raise InvalidInput(f"{m.func} of {m.expression} is no metric")
        if aggregate_first and m.func not in _PARTS:
            raise InvalidInput(f"{m.func} can't be aggregated before a join")
    if bad := [u for _, _, u in places.values() if u not in (None, *GRAINS)]:
        raise InvalidInput(f"unknown grain {bad}")
    out = set(without)
    used = [link for link in links if link.name not in out]
    parts = [_of_entity(entities, used, start, {n: m for n, m in metrics.items() if m.entity == start}, places, list(filters), aggregate_first)
             for start in dict.fromkeys(m.entity for m in metrics.values())]
    whole = parts[0]
    if len(parts) > 1:
        # A row per entity and combination at most: united and folded by the dimensions, where NULL meets NULL.
        united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        whole = united.groupBy(*places).agg(*(F.max(n).alias(n) for n in metrics))
    counts = [n for n, m in metrics.items() if m.func.startswith("count")]
    return whole.select(*places, *(F.coalesce(n, F.lit(0).cast("bigint")).alias(n) if n in counts else F.col(n) for n in metrics))


def _of_entity(entities, links, start, metrics, places, filters, aggregate_first) -> DataFrame:
    ways = {e: way(links, start, e) for e in {*(e for e, _, _ in places.values()), *(e for e, _ in filters)}}
    steps = list(dict.fromkeys(link for path in sorted(ways.values(), key=len) for link in path))
    # All columns get new names, so entities may share names; only those that are needed are read.
    new: dict[tuple[str, str], str] = {}
    for e, c in [*((e, c) for e, c, _ in places.values()), *((x.many, a) for x in steps for a, _ in x.on), *((x.one, b) for x in steps for _, b in x.on)]:
        new.setdefault((e, c), f"c{len(new)}")

    def rows(entity: str, *more: Column) -> DataFrame:
        df = entities[entity]
        kept = reduce(lambda x, text: x.filter(checked_expression(x, text)), [text for e, text in filters if e == entity], df)
        return kept.select(*(col(kept, c).alias(n) for (e, c), n in new.items() if e == entity), *more)

    source = entities[start]
    values = [(F.lit(1) if m.expression is None else checked_expression(source, m.expression)).alias(f"v{i}") for i, m in enumerate(metrics.values())]
    joined = rows(start, *values)
    first = aggregate_first and bool(steps)
    if first:
        own = [n for (e, _), n in new.items() if e == start]
        joined = joined.groupBy(*own).agg(*(f(f"v{i}").alias(f"v{i}_{k}") for i, m in enumerate(metrics.values()) for k, (f, _) in enumerate(_PARTS[m.func])))
    strict = {e for e, _ in filters}
    for link in steps:
        one = rows(link.one)
        same = [joined[new[link.many, a]] == one[new[link.one, b]] for a, b in link.on]
        joined = joined.join(one, same, "inner" if link.one in strict else "left")
    keys = [(F.col(new[e, c]) if unit is None else F.date_trunc(unit, F.col(new[e, c]))).alias(n) for n, (e, c, unit) in places.items()]

    def total(i: int, m: Metric) -> Column:
        if not first:
            return _WHOLE[m.func](f"v{i}")
        made = [f(f"v{i}_{k}") for k, (_, f) in enumerate(_PARTS[m.func])]
        return made[0] if len(made) == 1 else F.try_divide(*made)

    return joined.groupBy(*keys).agg(*(total(i, m).alias(n) for i, (n, m) in enumerate(metrics.items())))
