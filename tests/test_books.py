import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput
from millrace.operators import audit, budgets, ledger, retention
from millrace.session import stored
from millrace.streaming import events as log


def test_cost_vectors(spark):
    calls = spark.createDataFrame(
        [("openai", "gpt-4o", 1000, 500, 6900, False), ("openai", "gpt-4o-mini", 1, 0, 0, False), ("openai", "gpt-4o-mini", 4, 0, 1, False),
         ("openai", "gpt-4o-mini", 5, 0, 1, False), ("x", "y", 10, 10, 0, True), ("echo", "echo-1", 9, 9, 0, False),
         ("openai", "gpt-4o", 10**12, 10**12, 11_500_000_000_000, False)],
        "provider string, model string, tokens_in bigint, tokens_out bigint, cost bigint, unknown boolean")
    for r in ledger.with_cost(calls, ledger.price_table(spark)).collect():
        assert (r["cost_micros"], r["pricing_unknown"]) == (r["cost"], r["unknown"])


CALLS = "id int, ts timestamp_ntz, project_id int, user_id int, provider string, model string, purpose string, tokens_in int, tokens_out int, cost_micros bigint, cache_hit boolean, status string, pricing_unknown boolean"


def call(i, ts, cost, user=1, **more):
    row = {"project_id": 1, "provider": "p", "model": "m", "purpose": "general", "tokens_in": 10, "tokens_out": 5, "cache_hit": False, "status": "ok", "pricing_unknown": False, **more}
    return (i, ts, row["project_id"], user, row["provider"], row["model"], row["purpose"], row["tokens_in"], row["tokens_out"], cost, row["cache_hit"], row["status"], row["pricing_unknown"])


DAY = dt.datetime(2024, 1, 10)


def test_usage_report(spark):
    hour = dt.timedelta(hours=1)
    calls = spark.createDataFrame([call(1, DAY, 100), call(2, DAY + hour, 250, user=None, cache_hit=True), call(3, DAY + 24 * hour, 999, status="failed")], CALLS)
    report = {r["key"]: r for r in ledger.usage_report(calls, DAY, DAY + 24 * hour, "user").collect()}
    assert report["total"]["cost_micros"] == 350 and report["unattributed"]["cache_hits"] == 1 and set(report) == {"1", "unattributed", "total"}
    after = ledger.usage_report(calls, DAY + 24 * hour, DAY + 48 * hour).collect()
    assert [(r["key"], r["calls"], r["errors"]) for r in after if not r["is_total"]] == [("2024-01-11", 1, 1)]
    empty = ledger.usage_report(calls, DAY - 48 * hour, DAY - 24 * hour).collect()
    assert len(empty) == 1 and empty[0]["is_total"] and empty[0]["calls"] == 0 and empty[0]["pricing_incomplete"] is False
    with pytest.raises(InvalidInput):
        ledger.usage_report(calls, DAY, DAY + hour, "colour")


def test_report_range():
    now = dt.datetime(2024, 6, 1)
    assert ledger.report_range(None, None, now) == (now - dt.timedelta(days=30), now)
    for bad in ((now, now), (now - dt.timedelta(days=367), now)):
        with pytest.raises(InvalidInput):
            ledger.report_range(*bad, now)


def test_window_usage_and_status(spark):
    now = dt.datetime(2024, 1, 10, 12)
    minutes = lambda n: now - dt.timedelta(minutes=n)
    calls = spark.createDataFrame([call(1, minutes(60), 100), call(2, now - dt.timedelta(days=5), 40), call(3, now - dt.timedelta(days=11), 7)], CALLS)
    holds = spark.createDataFrame(
        [("user", 1, minutes(5), 30, None), ("user", 1, minutes(15), 1000, None), ("user", 1, minutes(5), 1000, 3), ("user", 2, minutes(1), 9, None)],
        "scope_type string, scope_id int, ts timestamp_ntz, estimated_micros bigint, settled_micros bigint")
    usage = budgets.window_usage(calls, holds, F.lit(now).cast("timestamp_ntz"))
    found = {(r["scope_type"], r["scope_id"]): tuple(r)[2:] for r in usage.collect()}
    assert found[("user", "1")] == (130, 2, 170, 3) and found[("project", "1")] == (100, 1, 140, 2) and found[("user", "2")] == (9, 1, 9, 1)
    quotas = spark.createDataFrame(
        [("user", 1, "day", 130, None, "block"), ("user", 1, "month", 1000, 2, "warn"), ("user", 9, "day", 0, None, "block"), ("user", 1, "day", None, 1, "block")],
        "scope_type string, scope_id int, period string, limit_cost_micros bigint, limit_calls int, action string")
    shown = sorted(((r["period"], r["limit_cost_micros"], r["exceeded"], r["blocked"]) for r in budgets.status(quotas, usage).collect()), key=str)
    assert shown == sorted([("day", 130, None, False), ("month", 1000, "calls", False), ("day", 0, None, False), ("day", None, "calls", True)], key=str)
    assert {r["exceeded"] for r in budgets.status(quotas, usage, 1, 1).filter("period = 'day' AND limit_cost_micros = 130").collect()} == {"cost"}


def test_first_crossing_only(spark):
    rows = [call(i, DAY + dt.timedelta(minutes=i), 40) for i in range(6)]
    out = budgets.crossings(spark.createDataFrame(rows, CALLS), "user_id", "day", limit_micros=100).collect()
    assert [(r["id"], r["spent_micros"], r["exceeded"]) for r in out] == [(2, 120, "cost")]
    assert [r["id"] for r in budgets.crossings(spark.createDataFrame(rows, CALLS), "user_id", "month", limit_calls=4).collect()] == [4]


def sequential(rows, limit, most):
    admitted, spent, count = {}, {}, {}
    for key, at, i, cost in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ok = (limit is None or spent.get(key, 0) + (cost or 0) <= limit) and (most is None or count.get(key, 0) + 1 <= most)
        admitted[i] = ok
        if ok:
            spent[key] = spent.get(key, 0) + (cost or 0)
            count[key] = count.get(key, 0) + 1
    return admitted


@pytest.mark.parametrize("seed, limit, most, small", [
    (1, 100, None, 0), (2, 100, None, 60), (3, 37, 5, 0), (3, 37, 5, 1000), (4, None, 3, 0), (4, None, 3, 1000), (5, 0, None, 0), (6, 0, 2, 1000)])
def test_replay_like_one_by_one(spark, seed, limit, most, small):
    random.seed(seed)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", random.randint(0, 30), i, random.choice([0, 1, 2, 3, 7, 30, 64, 99, 100, 300, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, id int, cost bigint").withColumns(
        {"lim": F.lit(limit).cast("bigint"), "most": F.lit(most).cast("int")})
    out = budgets.replay(df, ["k"], ["at", "id"], "cost", "lim", "most", small_window=small)
    assert out.columns == [*df.columns, "admitted"]
    assert {r["id"]: r["admitted"] for r in out.collect()} == sequential(rows, limit, most)


def test_replay_slow_descent(spark):
    """Many small calls between ones that just do not fit: still a few passes."""
    rows = [("a", i, i, 1 if i % 2 else 200 - i // 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, id int, cost bigint").withColumn("lim", F.lit(210))
    out = budgets.replay(df, ["k"], ["at", "id"], "cost", "lim", small_window=10)
    assert {r["id"]: r["admitted"] for r in out.collect()} == sequential(rows, 210, None)


@pytest.mark.parametrize("small", [0, 1000])
def test_replay_has_one_rule_at_every_size(spark, small):
    """Negative costs count as 0, a negative limit admits nothing, windows 100 microseconds apart are two, and
    a caller's own columns may begin with an underscore."""
    at = lambda micros: dt.datetime(2024, 1, 1, 0, 0, 0, micros)
    rows = [(at(0), 1, -5, 5), (at(0), 2, 10, 5), (at(0), 3, 5, 5), (at(100), 4, 5, 5), (at(200), 5, 0, -1), (at(200), 6, None, -1)]
    df = spark.createDataFrame(rows, "_w timestamp, id int, _cost bigint, _room bigint")
    out = budgets.replay(df, ["_w"], ["id"], "_cost", "_room", small_window=small)
    assert out.columns == [*df.columns, "admitted"]
    assert {r["id"]: (r["admitted"], r["_cost"]) for r in out.collect()} == {
        1: (True, -5), 2: (False, 10), 3: (True, 5), 4: (True, 5), 5: (False, 0), 6: (False, None)}


def test_settle(spark):
    holds = spark.createDataFrame([(1, 50, None), (2, 50, None), (3, 50, None), (4, 50, None)], "call_id int, estimated_micros bigint, settled_micros bigint")
    calls = spark.createDataFrame([call(1, DAY, 30), call(2, DAY, 30, cache_hit=True), call(3, DAY, 30, status="blocked")], CALLS)
    assert {r["call_id"]: r["settled_micros"] for r in budgets.settle(holds, calls).collect()} == {1: 30, 2: 0, 3: 30, 4: None}


def test_message_copies(spark):
    df = spark.createDataFrame([("off", "a", "b"), ("redacted", "a", "b"), ("full", "a", "b"), ("full", "a", "a")], "audit_mode string, content_raw string, content_redacted string")
    assert sorted((r["audit_mode"], r["content_raw"] or "") for r in ledger.message_copies(df).collect()) == [("full", ""), ("full", "a"), ("redacted", "")]


def chain(n, step=1):
    rows, previous = [], audit.GENESIS
    for i in range(n):
        body = json.dumps({"n": i})
        own = hashlib.sha256((previous + body).encode()).hexdigest()
        rows.append([1 + i * step, previous, own, body])
        previous = own
    return rows


@pytest.mark.parametrize("break_it, expected", [
    (lambda r: None, (True, 2000, None, None)),
    (lambda r: r[1233].__setitem__(3, "{}"), (False, 1233, 3700, "row_hash mismatch")),
    (lambda r: r.pop(700), (False, 700, 2104, "prev_hash mismatch")),
    (lambda r: r.pop(0), (False, 0, 4, "prev_hash mismatch")),
    (lambda r: (r[5].__setitem__(1, "x"), r[9].__setitem__(3, "{}")), (False, 5, 16, "prev_hash mismatch")),
    (lambda r: (r[5].__setitem__(0, r[6][0]), r[6].__setitem__(0, 16)), (False, 5, 16, "prev_hash mismatch")),
])
@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_one_long_chain(spark, break_it, expected, hot_rows):
    rows = chain(2000, step=3)
    break_it(rows)
    df = spark.createDataFrame(rows, "seq bigint, prev_hash string, row_hash string, canonical string").repartition(6)
    assert tuple(audit.verify(df, hot_rows=hot_rows).first()) == expected


def test_canonical_row(spark):
    df = spark.createDataFrame(
        [("i", dt.datetime(2024, 1, 2, 3, 4, 5, 6), "u", None, "login", "user", "7", '{"b": 1, "a": ["é", null, {"z": true, "y": "q\\"q"}]}', None)],
        "id string, ts timestamp_ntz, actor_id string, project_id string, action string, object_kind string, object_id string, details string, ip string")
    payload = {"id": "i", "ts": "2024-01-02T03:04:05.000006+00:00", "actor_id": "u", "project_id": None, "action": "login", "object_kind": "user",
               "object_id": "7", "details": {"b": 1, "a": ["é", None, {"z": True, "y": 'q"q'}]}, "ip": None}
    assert df.select(audit.canonical()).first()[0] == json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_retention(spark):
    now = dt.datetime(2024, 6, 1)
    ages = lambda *days: spark.createDataFrame([(now - dt.timedelta(days=d), None if d > 300 else 1) for d in days], "ts timestamp_ntz, settled_micros int")
    at = F.lit(now).cast("timestamp_ntz")
    assert retention.keep_events(ages(1, 7, 8), at).count() == 2
    assert retention.keep_holds(ages(94, 96, 400), at).count() == 2
    assert retention.keep_cache(ages(-1, 0, 1).withColumnRenamed("ts", "expires_at"), at).count() == 1
    assert retention.keep_idempotency_keys(ages(0.5, 2).withColumnRenamed("ts", "created_at"), at).count() == 1
    listing = spark.createDataFrame(
        [("file:/x/projects/p/uploads/u1/a.csv", now - dt.timedelta(days=2)), ("file:/x/projects/p/uploads/u2/a.csv", now), ("file:/x/projects/p/datasets/d/v1/a.parquet", now - dt.timedelta(days=9))],
        "path string, modificationTime timestamp_ntz")
    assert [r["folder"] for r in retention.stale_uploads(listing, at).collect()] == ["projects/p/uploads/u1"]


EVENTS = "seq bigint, topic string, project_id int, user_id int"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, cursor = (str(tmp_path / n) for n in ("in", "out", "cursor"))
    members = spark.createDataFrame([(5, 1)], "user_id int, project_id int")
    batch = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    batch([(1, "jobs", 1, None), (2, "jobs", 2, None), (3, "jobs", 1, 6), (4, "other", 1, None), (5, "jobs", None, None), (6, "jobs", None, 5)])

    def run():
        stream = log.read_log(spark, source, spark.createDataFrame([], EVENTS).schema)
        log.tail(log.visible(log.of_topics(stream, ["jobs"]), 5, memberships=members), out, cursor)
        return sorted(r["seq"] for r in spark.read.parquet(out).collect())

    assert run() == [1, 5, 6]
    batch([(7, "jobs", 1, None), (8, "jobs", 2, None)])
    assert run() == [1, 5, 6, 7]
    everything = spark.read.parquet(source)
    assert sorted(r["seq"] for r in log.visible(everything, 5, admin=True).collect()) == [1, 2, 4, 5, 6, 7, 8]
    assert [r["seq"] for r in log.page(everything, 3, 2).collect()] == [4, 5]
    assert tuple(log.cursor_reset(everything, 0).first()) == (False, 0) and tuple(log.cursor_reset(everything.filter("seq > 4"), 1).first()) == (True, 8)


def _together_by_hand(calls, quotas):
    held, out = [], {}
    start = {"day": lambda t: t.date(), "month": lambda t: (t.year, t.month)}
    for c in sorted(calls, key=lambda c: (c[1], c[0])):
        refused, warned = None, set()
        for scope, who in (("project", c[2]), ("user", c[3])):
            for s, i, period, micros, most, action in sorted((q for q in quotas if q[0] == scope and who is not None and q[1] == str(who)), key=lambda q: q[2]):
                same = [h for h in held if h[2 if scope == "project" else 3] == who and start[period](h[1]) == start[period](c[1])]
                spent = sum(max(h[4] or 0, 0) for h in same) + max(c[4] or 0, 0)
                if (micros is not None and spent > micros) or (most is not None and len(same) + 1 > most):
                    if action == "block":
                        refused = refused or f"{scope}:{i}:{period}"
                    else:
                        warned.add(f"{scope}:{i}:{period}")
        if refused is None:
            held.append(c)
        out[c[0]] = (refused is None, refused, sorted(warned) if refused is None else [])
    return out


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (2, 20), (3, 10**6)])
def test_replay_together_like_one_by_one(spark, seed, hot):
    r = random.Random(seed)
    base = dt.datetime(2024, 1, 30)
    calls = [(i, base + dt.timedelta(minutes=r.randrange(0, 4000, 7)), r.choice([1, 1, 1, 2, None]), r.choice([5, 6, 7, 8, None]), r.choice([None, -3, 0, 1, 5, 10, 40, 90])) for i in range(300)]
    quotas = [("project", "1", "day", 400, None, "block"), ("project", "1", "month", 900, 60, "block"), ("project", "2", "month", None, 9, "block"), ("user", "5", "day", 90, 7, "block"),
              ("user", "6", "month", 300, None, "warn"), ("user", "6", "day", None, 5, "warn"), ("user", "7", "day", 60, None, "block"), ("user", "8", "day", -1, None, "block"), ("user", "99", "day", 0, 0, "block")]
    df = spark.createDataFrame([(*c, "mine") for c in calls], "id int, ts timestamp_ntz, project_id int, user_id int, cost_micros long, window string")
    limits = spark.createDataFrame(quotas, "scope_type string, scope_id string, period string, limit_cost_micros long, limit_calls long, action string")
    got = budgets.replay_together(df, limits, hot_rows=hot)
    assert got.columns == [*df.columns, "admitted", "refused_by", "warnings"]
    rows = got.collect()
    assert {x.id: (x.admitted, x.refused_by, x.warnings) for x in rows} == _together_by_hand(calls, quotas) and len(rows) == 300
    assert {x.admitted for x in budgets.replay_together(df, limits.limit(0)).collect()} == {True}
    assert budgets.replay_together(df.limit(0), limits).count() == 0


def test_replay_together_needs_a_scope(spark):
    with pytest.raises(InvalidInput):
        budgets.replay_together(spark.range(1), spark.createDataFrame([], "scope_type string, scope_id string, period string, limit_cost_micros long, limit_calls long, action string"))


def test_days_of_a_month_settle_side_by_side(spark, monkeypatch):
    """The days let through fewer calls than the month, so no day waits for the ones before it."""
    calls = [(d * 20 + n, dt.datetime(2024, 1, 1 + d, n), 1, 10) for d in range(28) for n in range(20)]
    df = spark.createDataFrame(calls, "id long, ts timestamp_ntz, project_id long, cost_micros long")
    limits = spark.createDataFrame([("project", "1", "day", 20, 2, "block"), ("project", "1", "month", 590, 58, "block")],
                                   "scope_type string, scope_id string, period string, limit_cost_micros long, limit_calls long, action string")
    written = []
    monkeypatch.setattr(budgets, "stored", lambda df: written.append(1) or stored(df))
    rows = budgets.replay_together(df, limits).collect()
    assert {r.id for r in rows if r.admitted} == {d * 20 + n for d in range(28) for n in range(2)} and len(rows) == len(calls)
    assert {r.refused_by for r in rows if not r.admitted} == {"project:1:day"}
    assert len(written) <= 5


LIMITS = "scope_type string, scope_id string, period string, limit_cost_micros long, limit_calls long, action string"


@pytest.mark.parametrize("hot", [10**6, 20])
def test_calls_that_fit_by_turns_are_not_a_pass_each(spark, monkeypatch, hot):
    """Every other call just does not fit, which only the exact sum before it tells."""
    calls = [(i, DAY + dt.timedelta(minutes=i), 1, 1 if i % 2 else 1001 - i // 2) for i in range(1, 61)]
    df = spark.createDataFrame(calls, "id long, ts timestamp_ntz, project_id long, cost_micros long")
    written = []
    for name in ("stored", "checkpointed"):
        monkeypatch.setattr(budgets, name, lambda df, real=getattr(budgets, name): written.append(1) or real(df))
    rows = budgets.replay_together(df, spark.createDataFrame([("project", "1", "month", 1000, None, "block")], LIMITS), hot_rows=hot).collect()
    assert {r.id for r in rows if r.admitted} == {i for i in range(1, 61) if i % 2} and len(rows) == 60
    assert len(written) <= (3 if hot == 10**6 else 20)


@pytest.mark.parametrize("hot", [10**6, 7])
def test_replay_together_in_another_order(spark, hot):
    """Windows come by turns, two projects share a user, month budgets run on where a part is cut, and a user of one call is free."""
    r = random.Random(5)
    ats = r.sample(range(6 * 24 * 60), 60)
    calls = [(i, dt.datetime(2024, 1, 29) + dt.timedelta(minutes=ats[i]), 1 + i % 2, 5 if i % 7 else 6, r.choice([None, 1, 20, 70])) for i in range(60)] + [(60, DAY, None, 9, 4)]
    quotas = [("project", "1", "day", 90, None, "block"), ("project", "2", "month", 300, 12, "block"), ("user", "5", "month", 300, None, "warn"), ("user", "5", "day", 150, 5, "block"),
              ("user", "9", "day", 4, 1, "block")]
    df = spark.createDataFrame([(*c, "mine") for c in calls], "id int, ts timestamp_ntz, project_id int, user_id int, cost_micros long, _part string")
    out = budgets.replay_together(df, spark.createDataFrame(quotas, LIMITS), order=(), hot_rows=hot)
    assert out.columns == [*df.columns, "admitted", "refused_by", "warnings"]
    held, expected = [], {}
    for c in calls:  # in the order of their ids
        sums = {}
        for scope, who, period, *_ in quotas:
            place = 2 if scope == "project" else 3
            if str(c[place]) == who:
                same = [h for h in held if h[place] == c[place] and (h[1].date() == c[1].date() if period == "day" else h[1].month == c[1].month)]
                sums[f"{scope}:{who}:{period}"] = (sum(h[4] or 0 for h in same) + (c[4] or 0), len(same) + 1)
        over = [(q[5], n) for q in quotas if (n := ":".join(q[:3])) in sums and (sums[n][0] > q[3] or (q[4] is not None and sums[n][1] > q[4]))]
        refused = next((n for action, n in sorted(over, key=lambda o: (not o[1].startswith("project"), o[1])) if action == "block"), None)
        expected[c[0]] = (refused is None, refused, [n for action, n in over if action == "warn"] if refused is None else [])
        if refused is None:
            held.append(c)
    assert {x.id: (x.admitted, x.refused_by, x.warnings) for x in out.collect()} == expected
    assert {refused for _, refused, _ in expected.values()} >= {None, "project:1:day", "project:2:month", "user:5:day"} and any(w for *_, w in expected.values())


def test_replay_together_takes_each_row_as_a_call(spark):
    """Rows that come twice hold twice; calls without a time share a window; sums may pass 64 bits."""
    most = 2**63 - 1
    df = spark.createDataFrame([(1, DAY, 1, 60), (1, DAY, 1, 60), (2, None, 1, 50), (3, None, 1, 60), (None, DAY, 1, 40), (4, DAY, 2, most), (5, DAY, 2, most), (6, DAY, 3, most), (7, DAY, 3, most)],
                               "id long, ts timestamp_ntz, user_id long, cost_micros long")
    limits = spark.createDataFrame([("user", "1", "day", 100, None, "block"), ("user", "2", "day", most, None, "block"), ("user", "3", "day", None, 2, "block")], LIMITS)
    rows = budgets.replay_together(df, limits).collect()
    assert sorted((r.id or 0, r.admitted) for r in rows) == [(0, True), (1, False), (1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True)]
