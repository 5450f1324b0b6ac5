"""Budgets on calendar windows: usage, status, first crossing, and a replay of admissions.

Spend is what the ledger settled plus holds that are still open and younger than 15 minutes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from millrace.errors import InvalidInput
from millrace.operators.components import components
from millrace.operators.ledger import with_cost
from millrace.operators.ordered import CHUNK, HOT_ROWS, by_order, chunked, running, split_hot
from millrace.operators.prompts import estimate_tokens
from millrace.session import checkpointed, partitions_for, stored, unused

# Scopes, periods, and how long a hold may stay open.
SCOPES = ("project", "user", "connection", "agent")
PERIODS = ("day", "month")
HOLD_MINUTES = 15

# Calls a single task may walk in order for one window.
SMALL_WINDOW = 100_000

# Calls that hang on each other through shared budgets and that a single task may walk in order.
WALK_ROWS = 10_000_000

# A part with a larger share of the calls than one in so many has a task for itself.
ALONE = 64


def window_start(period: str, at: Column) -> Column:
    if period not in PERIODS:
        raise InvalidInput(f"period must be one of {PERIODS}")
    return F.date_trunc(period, at)


def _scoped(calls: DataFrame) -> DataFrame:
    """One row per call and scope it counts against."""
    scopes = [F.struct(F.lit(s).alias("scope_type"), F.col(f"{s}_id").cast("string").alias("scope_id"))
              for s in SCOPES if f"{s}_id" in calls.columns]
    return calls.select("ts", F.col("cost_micros").alias("micros"), F.inline(F.array(*scopes))).filter(
        "scope_id IS NOT NULL")


def window_usage(calls: DataFrame, holds: DataFrame, now: Column) -> DataFrame:
    """Per scope: micros and calls since the start of this day and this month.

    Calls and holds meet in one aggregation, so there is one shuffle, of pre-summed rows.
    """
    month, day = window_start("month", now), window_start("day", now)
    open_holds = holds.filter(
        F.col("settled_micros").isNull()
        & (F.col("ts") > now - F.expr(f"INTERVAL {HOLD_MINUTES} MINUTES"))
        & (F.col("ts") >= month)
    ).select("ts", F.col("estimated_micros").alias("micros"), "scope_type",
             F.col("scope_id").cast("string").alias("scope_id"))
    facts = _scoped(calls.filter(F.col("ts") >= month)).unionByName(open_holds)
    today = F.col("ts") >= day
    zero = F.lit(0).cast("bigint")
    return facts.groupBy("scope_type", "scope_id").agg(
        F.coalesce(F.sum(F.when(today, F.col("micros"))), zero).alias("day_micros"),
        F.count_if(today).alias("day_calls"),
        F.coalesce(F.sum("micros"), zero).alias("month_micros"),
        F.count("*").alias("month_calls"),
    )


def status(quotas: DataFrame, usage: DataFrame, estimate: int = 0, calls: int = 0) -> DataFrame:
    """Where every budget stands, or would stand with one more call of `estimate` micros (`calls=1`).

    Every budget of a scope is judged, daily and monthly alike; cost is looked at before calls.
    """
    day = F.col("period") == "day"
    pick = lambda what: F.coalesce(F.when(day, F.col(f"day_{what}")).otherwise(F.col(f"month_{what}")), F.lit(0))
    judged = (
        quotas.withColumn("scope_id", F.col("scope_id").cast("string"))
        .join(usage, ["scope_type", "scope_id"], "left")
        .withColumns({"spent_micros": (pick("micros") + estimate).cast("bigint"),
                      "calls": (pick("calls") + calls).cast("bigint")})
        .drop("day_micros", "day_calls", "month_micros", "month_calls")
    )
    exceeded = F.when(F.col("spent_micros") > F.col("limit_cost_micros"), "cost").when(
        F.col("calls") > F.col("limit_calls"), "calls")
    return judged.withColumn("exceeded", exceeded).withColumn(
        "blocked", exceeded.isNotNull() & (F.col("action") == "block"))


def crossings(calls: DataFrame, scope: str, period: str, limit_micros: int | None = None,
              limit_calls: int | None = None, order: tuple[str, str] = ("ts", "id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The one call per scope and window that takes it over the limit."""
    keyed = calls.filter(F.col(scope).isNotNull()).select(
        scope, window_start(period, F.col(order[0])).alias("window_start"), *order, "cost_micros")
    keys = [scope, "window_start"]
    summed = by_order(keyed, keys, list(order), {"spent_micros": F.col("cost_micros"), "calls": F.lit(1)}, hot_rows=hot_rows)
    spent, count = F.col("spent_micros"), F.col("calls")
    over_cost = F.lit(False) if limit_micros is None else spent > limit_micros
    over_calls = F.lit(False) if limit_calls is None else count > limit_calls
    dimension = F.when(over_cost, "cost").when(over_calls, "calls")
    first_cost = F.lit(False) if limit_micros is None else spent - F.col("cost_micros") <= limit_micros
    first_calls = F.lit(False) if limit_calls is None else count - 1 <= limit_calls
    return summed.withColumn("exceeded", dimension).filter(
        ((F.col("exceeded") == "cost") & first_cost) | ((F.col("exceeded") == "calls") & first_calls))


def replay(calls: DataFrame, keys: list[str], order: list[str], cost: str, limit_cost: str | None = None,
           limit_calls: str | None = None, small_window: int = SMALL_WINDOW) -> DataFrame:
    """Which calls a blocking budget admits, in order, per window. Adds `admitted`.

    A refused call holds nothing, so a running sum over all calls is wrong. Windows of up to
    `small_window` calls are walked one call after the other, many windows per task; larger ones go
    through `_in_passes`, which no window size can overload. `limit_cost` and `limit_calls` name columns
    that are constant per window; NULL means no limit. `order` ends in a unique column. A cost that is NULL or
    negative counts as 0; under a negative limit nothing is admitted.
    """
    lead = [c for c in calls.columns if c.startswith("_")]
    if lead:  # names the passes use for themselves
        aside = dict(zip(lead, unused(calls, *(f"user{c}" for c in lead))))
        put = lambda c: aside.get(c, c)
        out = replay(calls.withColumnsRenamed(aside), [put(k) for k in keys], [put(o) for o in order], put(cost),
                     put(limit_cost), put(limit_calls), small_window)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})
    ordinary, large = split_hot(calls, keys, small_window)
    walked = _one_by_one(ordinary, keys, order, cost, limit_cost, limit_calls)
    if large is None:
        return walked
    return walked.unionByName(_in_passes(large, keys, order, cost, limit_cost, limit_calls))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches arrive in window and call order; only the running state passes from batch to batch. The last
    four columns are the window, the cost and the two limits."""
    window, spent, count = None, 0, 0
    for batch in batches:
        helpers = [batch.column(i).to_pylist() for i in range(batch.num_columns - 4, batch.num_columns)]
        admitted = []
        for here, cost, limit, calls in zip(*helpers):
            if here != window:
                window, spent, count = here, 0, 0
            ok = (limit is None or spent + cost <= limit) and (calls is None or count < calls)
            admitted.append(ok)
            if ok:
                spent, count = spent + cost, count + 1
        kept = range(batch.num_columns - 4)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(admitted, pa.bool_())],
            names=[*(batch.schema.names[i] for i in kept), "admitted"])


def _held(cost: str):
    return F.greatest(F.coalesce(F.col(cost).cast("bigint"), F.lit(0)), F.lit(0))


def _one_by_one(calls, keys, order, cost, limit_cost, limit_calls):
    number = lambda c: F.col(c).cast("bigint") if c else F.lit(None).cast("bigint")
    schema = T.StructType([*calls.schema.fields, T.StructField("admitted", T.BooleanType())])
    exact = {f"timestamp{zone}Format": "yyyy-MM-dd HH:mm:ss.SSSSSS" for zone in ("", "NTZ")}
    names = unused(calls, "_window", "_cost", "_limit", "_calls")
    values = (F.to_json(F.struct(*keys), exact), _held(cost), number(limit_cost), number(limit_calls))
    return (
        calls.select("*", *(v.alias(n) for n, v in zip(names, values)))
        .repartition(*keys).sortWithinPartitions(names[0], *order)
        .mapInArrow(_walk, schema)
    )


def _in_passes(calls, keys, order, cost, limit_cost, limit_calls):
    """The same verdicts for windows of any size.

    Each pass settles, for all windows at once, everything up to the point where a window's free room
    has halved: calls below half the room are sure to fit until then, so their running sum is exact, and
    the first larger call that fits beside them ends the pass. Calls above the room can never fit again.
    A window therefore needs at most log2(limit) passes, whatever its number of calls, no task ever holds
    a whole window, and rows leave as soon as they are settled.
    """
    place = F.struct(*order)
    base = chunked(calls, keys, order)
    none = F.lit(None).cast("bigint")
    limit = F.col(limit_cost).cast("bigint") if limit_cost else none
    rows = base.withColumns({"_room": limit, "_cost": _held(cost)})
    free = F.col("_room").isNull() | ((F.col("_cost") == 0) & (F.col("_room") >= 0))
    settled = [rows.filter(free).withColumn("_ok", F.lit(True))]
    pending = rows.filter(~free)
    while True:
        half = F.expr("(_room + 1) div 2")
        possible = pending.filter("_cost <= _room").withColumn("_small", F.col("_cost") < half)
        settled.append(pending.filter("_cost > _room").withColumn("_ok", F.lit(False)))
        summed = running(possible, keys, order, {"_sum": F.when(F.col("_small"), F.col("_cost")).otherwise(0)})
        left = F.col("_room") - F.col("_sum")
        ends_here = F.when(F.col("_small"), left < half).otherwise(F.col("_cost") <= left)
        after = left - F.when(F.col("_small"), 0).otherwise(F.col("_cost"))
        marked = summed.withColumns({"_ends": ends_here, "_after": after})
        ends = (
            marked.filter("_ends").groupBy(*keys)
            .agg(F.min(place).alias("_at"), F.min_by("_after", place).alias("_next"))
            .withColumnsRenamed({k: f"_k_{k}" for k in keys})
        )
        same = reduce(lambda a, b: a & b, [marked[k].eqNullSafe(ends[f"_k_{k}"]) for k in keys])
        verdict = F.when(F.col("_at").isNull() | (place < F.col("_at")), F.col("_small")).when(
            place == F.col("_at"), F.lit(True))
        judged, _ = stored(
            marked.join(ends, same, "left").withColumn("_ok", verdict)
            .drop("_ends", "_after", "_sum", "_small", "_at", *(f"_k_{k}" for k in keys)))
        settled.append(judged.filter("_ok IS NOT NULL").drop("_next"))
        pending = judged.filter("_ok IS NULL").withColumn("_room", F.col("_next")).drop("_ok", "_next")
        if not pending.take(1):
            break
    every = reduce(lambda a, b: a.unionByName(b), settled).drop("_room", "_cost")
    if limit_calls:
        counted = running(every, keys, order, {"_n": F.col("_ok").cast("int")})
        every = counted.withColumn(
            "_ok", F.col("_ok") & F.coalesce(F.col("_n") <= F.col(limit_calls), F.lit(True))).drop("_n")
    return every.withColumnRenamed("_ok", "admitted").drop(CHUNK)


# Stands for the day and month of a call without a time; they are windows like others.
_NO_DATE = -(1 << 31)


def _limits(budgets: DataFrame) -> DataFrame:
    """Per scope its budgets, in the order in which they are asked."""
    one = budgets.select("scope_type", F.col("scope_id").cast("string").alias("scope_id"), F.struct(
        "period", F.coalesce(F.col("period") == "day", F.lit(False)).alias("daily"), F.col("limit_cost_micros").cast("bigint").alias("cost"),
        F.col("limit_calls").cast("bigint").alias("calls"), (F.col("action") == "block").alias("blocks"),
        F.concat_ws(":", "scope_type", F.col("scope_id").cast("string"), "period").alias("said")).alias("budget"))
    return one.filter("budget.blocks IS NOT NULL").groupBy("scope_type", "scope_id").agg(F.sort_array(F.collect_set("budget")).alias("budgets"))


def _tied(groups: DataFrame, budgets: DataFrame, places: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """What hangs on each other. (part, node, budgets): a scope in a month with the budgets that can be passed in it, in the order in which they
    are asked. (part, group, calls, met): the nodes that a group of calls meets, in the order of the scopes. Nodes that share a group are one part.

    `groups`: group, month, calls, micros and a column for each scope in `places`. A budget that the whole month stays within, even
    with every call admitted, never refuses or warns, so it ties nothing together.
    """
    scopes = [F.struct(F.lit(n).alias("place"), F.lit(s).alias("scope_type"), F.col(f"{s}_id").cast("string").alias("scope_id")) for s, n in places.items()]
    scoped = groups.select("group", "month", "calls", "micros", F.inline(F.array(*scopes))).filter("scope_id IS NOT NULL")
    micros = F.when(F.count("micros") == F.count("*"), F.try_sum("micros"))  # NULL where the sum is beyond 64 bits
    totals = scoped.groupBy("scope_type", "scope_id", "month").agg(F.sum("calls").alias("n"), micros.alias("spent"))
    passable = lambda b: F.coalesce(F.col("n") > b["calls"], F.lit(False)) | (b["cost"].isNotNull() & F.coalesce(F.col("spent") > b["cost"], F.lit(True)))
    asked = totals.join(_limits(budgets), ["scope_type", "scope_id"]).withColumn("budgets", F.filter("budgets", passable)).filter(F.size("budgets") > 0)
    nodes = checkpointed(asked.select("scope_type", "scope_id", "month", "budgets", F.monotonically_increasing_id().alias("node")))
    ranked = F.sort_array(F.collect_list(F.struct("place", "node")))
    met = checkpointed(scoped.join(nodes.drop("budgets"), ["scope_type", "scope_id", "month"]).groupBy("group").agg(F.first("calls").alias("calls"), ranked["node"].alias("met")))
    parts = components(met.select(F.col("met")[0].alias("a"), F.explode("met").alias("b"))).withColumnRenamed("label", "part")
    return nodes.join(parts, "node").select("part", "node", "budgets"), met.join(parts, F.col("met")[0] == F.col("node")).select("part", "group", "calls", "met")


class _Together:
    """What the budgets of one part hold, call after call.

    The last five columns of a batch are the part, the group, the cost, the day and a text. Before the calls of a part come its nodes (a node in place of
    the group, cost -2, the budgets and what they held before as JSON) and its groups (cost -1, the nodes as JSON).
    """

    def __init__(self) -> None:
        self.part = None
        self._begin(None)

    def _begin(self, part: int | None) -> None:
        self.part, self.nodes, self.groups, self.held, self.before = part, {}, {}, {}, {}

    def _learn(self, number: int, kind: int, text: str) -> None:
        known = json.loads(text)
        if kind == -1:
            self.groups[number] = tuple([one for node in known for one in self.nodes[node][i]] for i in range(3))
            return
        held = self.held[number] = {}  # day, or None for the month -> spent, calls
        for h in known.get("held", ()):  # fields that are NULL are left out
            held[h.get("day")] = self.before[number, h.get("day")] = (h["spent"], h["count"])
        blocking, warning = [], []
        for b in known["budgets"]:
            (blocking if b["blocks"] else warning).append((b.get("cost", math.inf), b.get("calls", math.inf), b["daily"], b["said"], held))
        self.nodes[number] = (blocking, warning, [(daily, held) for daily in {b["daily"] for b in known["budgets"]}])

    def walk(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Yields (part, held, held before) of parts that end in this batch, then (refusals, warnings) of its calls."""
        at = batch.num_columns - 5
        columns = (batch.column(at + i).to_numpy(zero_copy_only=False).tolist() for i in range(4))
        text, refusals, warnings, none, nothing = batch.column(at + 4), [], [], [], (0, 0)
        for i, (part, group, cost, day) in enumerate(zip(*columns)):
            if part != self.part:
                yield from self.ended()
                self._begin(part)
            if cost < 0:
                self._learn(group, cost, text[i].as_py())
                continue
            blocking, warning, windows = self.groups[group]
            refusal, warned = None, none
            for limit, calls, daily, said, held in blocking:
                spent, count = held.get(day if daily else None, nothing)
                if spent + cost > limit or count >= calls:
                    refusal = said
                    break
            else:
                for limit, calls, daily, said, held in warning:
                    spent, count = held.get(day if daily else None, nothing)
                    if spent + cost > limit or count >= calls:
                        warned = [*warned, said]
                for daily, held in windows:
                    window = day if daily else None
                    spent, count = held.get(window, nothing)
                    held[window] = (spent + cost, count + 1)
            refusals.append(refusal)
            warnings.append(sorted(set(warned)) if warned else none)
        yield refusals, warnings

    def ended(self) -> Iterator[tuple]:
        if self.part is not None:
            yield self.part, self.held, self.before


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Together()
    for batch in batches:
        *_, (refusals, warnings) = state.walk(batch)
        at = batch.num_columns - 5
        calls = batch.filter(pc.greater_equal(batch.column(at + 2), 0))
        refused = pa.array(refusals, pa.string())
        yield pa.RecordBatch.from_arrays([*(calls.column(i) for i in range(at)), refused.is_null(), refused, pa.array(warnings, pa.list_(pa.string()))],
                                         names=[*batch.schema.names[:at], "admitted", "refused_by", "warnings"])


_ADDED = "part bigint, node bigint, day bigint, spent decimal(38,0), count bigint"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the calls of a part add to each window."""
    state = _Together()
    types = [("part", pa.int64()), ("node", pa.int64()), ("day", pa.int64()), ("spent", pa.decimal128(38, 0)), ("count", pa.int64())]

    def rows(ended):
        found = [(part, node, day, Decimal(spent - was[0]), count - was[1]) for part, held, before in ended for node, windows in held.items()
                 for day, (spent, count) in windows.items() if (was := before.get((node, day), (0, 0)))[1] != count]
        columns = list(zip(*found)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])

    for batch in batches:
        *ended, _ = state.walk(batch)
        yield rows(ended)
    yield rows(state.ended())


def _in_order(calls: DataFrame, groups: DataFrame, nodes: DataFrame, alone: list[int], place: list[str], names: list[str], walk, schema) -> DataFrame:
    """Walk the calls of each part in one task, after what is known of its groups (part, group, met) and nodes (part, node, budgets and maybe held).

    Parts named in `alone` have a task each; the others are dealt over the rest.
    """
    part, group, cost, day, text = names
    # As a text: Spark measures nested columns anew, up to the first row of a batch, with each row it hands to Python.
    row = lambda number, kind, known: [F.col("part").alias(part), F.col(number).alias(group), F.lit(kind).cast("bigint").alias(cost), F.lit(0).cast("bigint").alias(day), F.to_json(known, {"ignoreNullFields": "true"}).alias(text)]
    known = nodes.select(*row("node", -2, F.struct(*(c for c in nodes.columns if c in ("budgets", "held"))))).unionByName(groups.select(*row("group", -1, F.col("met"))))
    every = calls.unionByName(known, allowMissingColumns=True)
    rest = partitions_for(calls)
    number = F.array_position(F.array(*(F.lit(p) for p in alone)).cast("array<bigint>"), F.col(part))  # 0 if it isn't there
    task = F.when(number > 0, number - 1).otherwise(F.pmod(F.hash(part), F.lit(rest)) + len(alone)).cast("int")
    return (every.select(*(c for c in calls.columns if c not in names), *names)
            .repartitionById(rest + len(alone), task).sortWithinPartitions(part, F.least(cost, F.lit(0)), *place)
            .mapInArrow(walk, schema))


def _held_before(calls: DataFrame, groups: DataFrame, nodes: DataFrame, place: list[str], names: list[str]) -> tuple[DataFrame, list[int]]:
    """`nodes` with what their windows hold where the calls of a part begin, and all parts; parts with a node in common follow each other by number.

    Every part is walked as if what the last round found before it were all; the first one is right at once, so in each round one
    more of a row of parts is. A part is walked again only if what stands before it has changed.
    """
    part, day = names[0], names[3]
    slim = calls.select(*dict.fromkeys([*place, *names[:4]]))
    days = calls.groupBy(F.col(part).alias("part")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    inside = checkpointed(nodes.select("part", "node").join(days, "part"))
    every = [r["part"] for r in days.select("part").collect()]  # of `hot_rows` calls each
    held, added, again = None, calls.sparkSession.createDataFrame([], _ADDED), None

    def known(held):
        windows = F.collect_list(F.struct("day", "spent", "count")).alias("held")
        return nodes.join(held.groupBy("part", "node").agg(windows), ["part", "node"], "left")

    while again is None or again:
        of = lambda df, name="part": df if again is None else df.filter(F.col(name).isin(again))
        kept = added if again is None else added.filter(~F.col("part").isin(again))
        added = checkpointed(kept.unionByName(_in_order(of(slim, part), of(groups), of(nodes if held is None else known(held)), again or every, place, names, _added, _ADDED)))
        upto = inside.join(added.withColumnRenamed("part", "earlier"), "node").filter("earlier < part AND (day IS NULL OR day BETWEEN first AND last)")
        now = checkpointed(upto.groupBy("part", "node", "day").agg(F.sum("spent").cast("decimal(38,0)").alias("spent"), F.sum("count").alias("count")))
        other = now if held is None else now.exceptAll(held).unionByName(held.exceptAll(now))
        again, held = [r["part"] for r in other.select("part").distinct().collect()], now
    return known(held), every


def replay_together(calls: DataFrame, budgets: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts",), cost: str = "cost_micros",
                    hot_rows: int = WALK_ROWS) -> DataFrame:
    """Which calls are admitted where one call meets several budgets: day and month, of several scopes.

    Adds to `calls`: admitted; refused_by, the first blocking budget passed, as `scope_type:scope_id:period`, in the order of
    the scopes, or NULL; warnings, the passed budgets that only warn, for admitted calls. `calls` have a unique `key` and
    scope columns (`project_id`, ...) that may be null; they come in the order of `order`, then of `key`. `budgets`: scope_type,
    scope_id, period, limit_cost_micros, limit_calls (NULL: no limit), action (`block` or `warn`). A call that one
    budget refuses holds nothing in any. A call without a budget is admitted.

    Verdicts of different windows hang on each other through the calls they share. So calls are told apart by what ties them: scopes
    whose budgets can be passed in a month and that share a call are one part (`_tied`); calls without such a scope are admitted.
    One task walks the calls of a part in order. It holds two numbers per window and the scopes of each combination of scopes, not the calls.
    A part of more than `hot_rows` calls is cut in order into parts that one task each walks; what a window holds where one of them begins
    is found in rounds (`_held_before`), at most as many as there are parts in a row.
    """
    places = {s: n for n, s in enumerate(SCOPES) if f"{s}_id" in calls.columns}
    if not places:
        raise InvalidInput(f"calls need one of {[f'{s}_id' for s in SCOPES]}")
    *names, month, admitted, refused, warnings = unused(calls, "_part", "_group", "_cost", "_day", "_text", "_month", "admitted", "refused_by", "warnings")
    part, group, held, day, _ = names
    place, ids = [*order, key], [f"{s}_id" for s in places]
    date = lambda period: F.coalesce(F.unix_date(F.to_date(window_start(period, F.col("ts")))), F.lit(_NO_DATE)).cast("bigint")
    dated = calls.withColumns({held: _held(cost), day: date("day"), month: date("month")})
    every = checkpointed(dated.groupBy(F.col(month).alias("month"), *ids).agg(F.count("*").alias("calls"), F.try_sum(held).alias("micros"))
                         .withColumn("group", F.monotonically_increasing_id()))
    nodes, groups = _tied(every, budgets, places)
    total, tied = every.agg(F.sum("calls")).first()[0], groups.agg(F.sum("calls")).first()[0]
    at_month, at_group, at_part, *at_ids = unused(dated, "_at_month", "_at_group", "_at_part", *(f"_at_{c}" for c in ids))
    numbered = every.join(groups.select("part", "group"), "group").select(
        F.col("month").alias(at_month), F.col("group").alias(at_group), F.col("part").alias(at_part), *(F.col(c).alias(a) for c, a in zip(ids, at_ids)))
    same = reduce(lambda a, b: a & b, [dated[c].eqNullSafe(numbered[a]) for c, a in zip(ids, at_ids)], dated[month] == numbered[at_month])
    free = [F.lit(True).alias(admitted), F.lit(None).cast("string").alias(refused), F.array().cast("array<string>").alias(warnings)]
    if not tied:
        return calls.select("*", *free)
    schema = T.StructType([*calls.schema.fields, T.StructField(admitted, T.BooleanType()), T.StructField(refused, T.StringType()), T.StructField(warnings, T.ArrayType(T.StringType()))])
    rows = dated.join(numbered, same).select(*calls.columns, F.col(at_part).alias(part), F.col(at_group).alias(group), held, day)
    sizes = groups.groupBy("part").agg(F.sum("calls").alias("n")).filter(F.col("n") > min(hot_rows, tied // ALONE)).collect()  # at most ALONE + calls / hot_rows
    large = [r["part"] for r in sizes if r["n"] > hot_rows]
    of_large = sum(r["n"] for r in sizes if r["n"] > hot_rows)
    found = []
    if tied < total:
        found.append(dated.join(numbered, same, "left_anti").select(*calls.columns, *free))
    if of_large < tied:
        few = lambda df, name="part": df.filter(~F.col(name).isin(large)) if large else df
        found.append(_in_order(few(rows, part), few(groups), few(nodes), [r["part"] for r in sizes if r["n"] <= hot_rows], place, names, _verdicts, schema))
    if large:
        cut = rows.filter(F.col(part).isin(large)).repartitionByRange(-(-of_large // hot_rows), part, *place)
        cut = checkpointed(cut.withColumn(part, F.spark_partition_id().cast("bigint")))
        inside = checkpointed(cut.select(F.col(part).alias("part"), group).distinct().withColumnRenamed(group, "group").join(groups.drop("part", "calls"), "group"))
        at = checkpointed(inside.select("part", F.explode("met").alias("node")).distinct().join(nodes.drop("part"), "node"))
        found.append(_in_order(cut, inside, *_held_before(cut, inside, at, place, names), place, names, _verdicts, schema))
    return reduce(lambda a, b: a.unionByName(b), found)


def settle(holds: DataFrame, calls: DataFrame) -> DataFrame:
    """Close each hold with its call's cost: 0 for a cache hit, 0 for a hold whose call failed. A hold
    without an outcome stays open."""
    outcome = calls.select(
        F.col("id").alias("call_id"), F.lit(True).alias("_seen"),
        F.when(F.col("cache_hit") | (F.col("status") == "failed"), 0).otherwise(F.col("cost_micros"))
        .cast("bigint").alias("_actual"))
    return holds.join(outcome, "call_id", "left").withColumn(
        "settled_micros", F.when(F.col("_seen"), F.coalesce("_actual", F.lit(0).cast("bigint")))
        .otherwise(F.col("settled_micros"))).drop("_seen", "_actual")


def worst_case(requests: DataFrame, prices: DataFrame, text: str = "text", max_tokens: str = "max_tokens") -> DataFrame:
    """What to hold for a request: the price of its prompt plus every token it may answer with."""
    sized = requests.withColumns({"_in": estimate_tokens(F.col(text)), "_out": F.col(max_tokens).cast("bigint")})
    return with_cost(sized, prices, "_in", "_out").withColumnRenamed("cost_micros", "estimated_micros").drop("_in", "_out")
