"""Ledger, budgets, traces, audit chain and retention, over a ledger derived from `events`.

Each event is a model call: its user, a provider and model by event type, token counts from its id, and a
price from the price table or from its value.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from millrace.operators import audit, budgets, ledger, retention
from millrace.suite import Suite, table

suite = Suite()

_NOW = "2024-01-20 12:30:00"
_START, _STOP = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 24)

# event type -> provider, model
_MODELS = {"click": ("openai", "gpt-4o"), "view": ("openai", "gpt-4o-mini"), "purchase": ("anthropic", "claude-sonnet-4"),
           "signup": ("echo", "echo-1"), "error": ("acme", "unlisted")}


def _case(i):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _MODELS.items()) + " END"


# Only columns both engines spell alike, so one text serves both.
_CALLS = f"""
    SELECT event_id AS id, ts, nullif(user_id, 7) AS user_id, user_id % 5 AS project_id, user_id % 3 AS connection_id,
      {_case(0)} AS provider, {_case(1)} AS model, CASE WHEN event_id % 10 = 0 THEN 'eval' ELSE 'general' END AS purpose,
      event_id % 4001 AS tokens_in, (event_id * 7) % 1009 AS tokens_out, event_id % 13 = 0 AS cache_hit,
      CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status,
      CAST(round(value * 10000) AS BIGINT) AS cost_micros, event_type = 'error' AS pricing_unknown, event_id % 997 AS trace_id,
      event_type, value, props FROM {{events}}"""
_SQL_CALLS = f"calls AS ({_CALLS.format(events='events')})"


def _calls(spark, sf):
    return spark.sql(_CALLS.format(events=f"parquet.`{sf}/events.parquet`"))


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@suite.add(f"""
    WITH {_SQL_CALLS}, p(price_key, i, o) AS (VALUES ('echo/echo-1', 0, 0), ('openai/gpt-4o', 2300000, 9200000), ('openai/gpt-4o-mini', 138000, 552000),
      ('anthropic/claude-sonnet-4', 2760000, 13800000), ('anthropic/claude-haiku-4-5', 736000, 3680000))
    SELECT id, CAST(coalesce((tokens_in * i + tokens_out * o + 500000) // 1000000, 0) AS BIGINT) AS cost_micros, i IS NULL AS pricing_unknown
    FROM calls LEFT JOIN p ON price_key = provider || '/' || model""")
def ledger_cost(spark, sf):
    calls = _calls(spark, sf).drop("cost_micros", "pricing_unknown")
    return ledger.with_cost(calls, ledger.price_table(spark)).select("id", "cost_micros", "pricing_unknown")


_MEASURES = """count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost_micros)::BIGINT AS cost_micros,
    count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE status != 'ok') AS errors, bool_or(pricing_unknown) AS pricing_incomplete"""


def _report_sql(key, where=""):
    return f"""
    WITH {_SQL_CALLS}, r AS (SELECT * FROM calls WHERE ts >= '2024-01-03' AND ts < '2024-01-24' {where})
    SELECT CASE WHEN grouping({key}) = 1 THEN 'total' ELSE coalesce(CAST({key} AS VARCHAR), 'unattributed') END AS key, grouping({key}) = 1 AS is_total,
      {_MEASURES} FROM r GROUP BY GROUPING SETS (({key}), ())"""


@suite.add(_report_sql("model"))
def usage_by_model(spark, sf):
    return ledger.usage_report(_calls(spark, sf), _START, _STOP, "model")


@suite.add(_report_sql("user_id", "AND project_id = 2"))
def usage_by_user(spark, sf):
    return ledger.usage_report(_calls(spark, sf), _START, _STOP, "user", project=2)


@suite.add(_report_sql("day").replace("SELECT * FROM calls", "SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM calls"))
def usage_by_day(spark, sf):
    return ledger.usage_report(_calls(spark, sf), _START, _STOP, "day")


@suite.add(_report_sql("provider"))
def usage_by_provider(spark, sf):
    return ledger.usage_report(_calls(spark, sf), _START, _STOP, "provider")


@suite.add(_report_sql("purpose"))
def usage_by_purpose(spark, sf):
    return ledger.usage_report(_calls(spark, sf), _START, _STOP, "purpose")


@suite.add(f"""
    WITH {_SQL_CALLS} SELECT trace_id, count(*) AS span_count, sum(cost_micros)::BIGINT AS total_cost_micros FROM calls GROUP BY trace_id""")
def trace_rollup(spark, sf):
    return ledger.trace_rollup(_calls(spark, sf))


@suite.add("""
    WITH m AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'redacted' ELSE 'full' END AS mode, replace(text, 'the', '<W>') AS redacted FROM conversations)
    SELECT conv_id, turn, md5(redacted) AS stored, md5(CASE WHEN mode = 'full' AND redacted != text THEN text END) AS raw FROM m WHERE mode != 'off'""")
def audit_copies(spark, sf):
    messages = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr("CASE conv_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'redacted' ELSE 'full' END").alias("audit_mode"),
        F.col("text").alias("content_raw"), F.replace("text", F.lit("the"), F.lit("<W>")).alias("content_redacted"))
    return ledger.message_copies(messages).select("conv_id", "turn", F.md5("content_redacted").alias("stored"), F.md5("content_raw").alias("raw"))


def _holds(spark, sf):
    """Sign-ups hold money: half are settled, the rest open; those before 12:15 of the day are abandoned."""
    return _calls(spark, sf).filter("event_type = 'signup'").select(
        F.lit("user").alias("scope_type"), F.col("user_id").alias("scope_id"), "ts", F.col("cost_micros").alias("estimated_micros"),
        F.when(F.col("id") % 2 == 0, F.col("cost_micros")).alias("settled_micros"), F.col("id").alias("call_id"))


_SQL_USAGE = f"""{_SQL_CALLS},
    s AS (SELECT ts, cost_micros AS m, unnest(['project', 'user', 'connection']) AS scope_type,
            unnest([CAST(project_id AS VARCHAR), CAST(user_id AS VARCHAR), CAST(connection_id AS VARCHAR)]) AS scope_id FROM calls
          WHERE event_type != 'signup' AND ts <= TIMESTAMP '{_NOW}'
          UNION ALL SELECT ts, cost_micros, 'user', CAST(user_id AS VARCHAR) FROM calls WHERE event_type = 'signup' AND id % 2 = 1
            AND ts > TIMESTAMP '{_NOW}' - INTERVAL 15 MINUTE AND ts <= TIMESTAMP '{_NOW}'),
    u AS (SELECT scope_type, scope_id, coalesce(sum(m) FILTER (WHERE ts >= '2024-01-20'), 0)::BIGINT AS day_micros,
            count(*) FILTER (WHERE ts >= '2024-01-20') AS day_calls, sum(m)::BIGINT AS month_micros, count(*) AS month_calls
          FROM s WHERE scope_id IS NOT NULL AND ts >= '2024-01-01' GROUP BY scope_type, scope_id)"""


def _usage(spark, sf):
    settled = _calls(spark, sf).filter((F.col("event_type") != "signup") & (F.col("ts") <= _now()))
    held = _holds(spark, sf).filter((F.col("ts") <= _now()) & F.col("scope_id").isNotNull())
    return budgets.window_usage(settled, held, _now())


@suite.add(f"WITH {_SQL_USAGE} SELECT * FROM u")
def budget_usage(spark, sf):
    return _usage(spark, sf)


@suite.add(f"""
    WITH {_SQL_USAGE}, q AS (SELECT 'user' AS scope_type, CAST(c_custkey AS VARCHAR) AS scope_id, unnest(['day', 'month']) AS period,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE unnest([500000, 30000000]) END AS lim, unnest([2, 50]) AS lim_calls, CASE WHEN c_custkey % 2 = 0 THEN 'block' ELSE 'warn' END AS action FROM customer),
    j AS (SELECT q.*, coalesce(CASE period WHEN 'day' THEN day_micros ELSE month_micros END, 0)::BIGINT + 10000 AS spent,
        coalesce(CASE period WHEN 'day' THEN day_calls ELSE month_calls END, 0)::BIGINT + 1 AS calls FROM q LEFT JOIN u USING (scope_type, scope_id)),
    e AS (SELECT *, CASE WHEN spent > lim THEN 'cost' WHEN calls > lim_calls THEN 'calls' END AS exceeded FROM j)
    SELECT scope_id, period, spent AS spent_micros, calls, exceeded, exceeded IS NOT NULL AND action = 'block' AS blocked FROM e""")
def budget_status(spark, sf):
    """A daily and a monthly budget per customer, both judged, for one more call of 10,000 micros."""
    customers = table(spark, sf, "customer")
    limit = lambda n: F.when(F.col("c_custkey") % 3 != 0, F.lit(n))
    quotas = customers.select(
        F.lit("user").alias("scope_type"), F.col("c_custkey").alias("scope_id"),
        F.when(F.col("c_custkey") % 2 == 0, "block").otherwise("warn").alias("action"),
        F.inline(F.array(
            F.struct(F.lit("day").alias("period"), limit(500_000).alias("limit_cost_micros"), F.lit(2).alias("limit_calls")),
            F.struct(F.lit("month").alias("period"), limit(30_000_000).alias("limit_cost_micros"), F.lit(50).alias("limit_calls")))))
    return budgets.status(quotas, _usage(spark, sf), estimate=10_000, calls=1).select(
        "scope_id", "period", "spent_micros", "calls", "exceeded", "blocked")


@suite.add(f"""
    WITH {_SQL_CALLS}, r AS (SELECT id, user_id, cost_micros, sum(cost_micros) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent
        FROM calls WHERE user_id IS NOT NULL)
    SELECT id, user_id, spent AS spent_micros FROM r WHERE spent > 2000000 AND spent - cost_micros <= 2000000""")
def budget_crossing(spark, sf):
    return budgets.crossings(_calls(spark, sf), "user_id", "day", limit_micros=2_000_000).select("id", "user_id", "spent_micros")


_REPLAY_SQL = f"""
    WITH RECURSIVE {_SQL_CALLS}, n AS (SELECT id, user_id, date_trunc('day', ts) AS w, cost_micros AS x, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, id) AS rn
        FROM calls WHERE user_id IS NOT NULL),
    a AS (SELECT id, user_id, w, rn, x <= 1500000 AS ok, CASE WHEN x <= 1500000 THEN x ELSE 0 END AS spent, CASE WHEN x <= 1500000 THEN 1 ELSE 0 END AS c FROM n WHERE rn = 1
      UNION ALL SELECT n.id, n.user_id, n.w, n.rn, a.spent + n.x <= 1500000 AND a.c + 1 <= 3, CASE WHEN a.spent + n.x <= 1500000 AND a.c + 1 <= 3 THEN a.spent + n.x ELSE a.spent END,
        CASE WHEN a.spent + n.x <= 1500000 AND a.c + 1 <= 3 THEN a.c + 1 ELSE a.c END FROM a JOIN n ON n.user_id = a.user_id AND n.w = a.w AND n.rn = a.rn + 1)
    SELECT id, user_id, ok AS admitted FROM a"""


def _replayed(spark, sf, **how):
    calls = _calls(spark, sf).filter("user_id IS NOT NULL").select(
        "id", "user_id", "ts", F.date_trunc("day", "ts").alias("window_start"), "cost_micros",
        F.lit(1_500_000).alias("limit_cost"), F.lit(3).alias("limit_calls"))
    return budgets.replay(calls, ["user_id", "window_start"], ["ts", "id"], "cost_micros", "limit_cost", "limit_calls", **how).select(
        "id", "user_id", "admitted")


@suite.add(_REPLAY_SQL)
def budget_replay(spark, sf):
    """A daily limit of 1.5 million micros and 3 calls per user; refused calls hold nothing."""
    return _replayed(spark, sf)


@suite.add(_REPLAY_SQL)
def budget_replay_long(spark, sf):
    """The same in passes over all windows at once, as for windows of any length."""
    return _replayed(spark, sf, small_window=0)


# A limit for each kind of budget, so that every one of them refuses some calls.
_LIMITS = {("project", "day"): (20_000_000, 60), ("project", "month"): (500_000_000, None), ("user", "day"): (1_200_000, 3), ("user", "month"): (15_000_000, 55)}


def _together_sql():
    held = lambda measure, who, since: f"coalesce(list_sum([{measure} FOR h IN s.held IF h.{who} = n.{who}{' AND h.day = n.day' if since == 'day' else ''}]), 0)"
    who = {"project": "project_id", "user": "user_id"}
    over = {}
    for (scope, period), (micros, calls) in _LIMITS.items():
        tests = [f"{held('h.x', who[scope], period)} + n.x > {micros}"] + ([f"{held('1', who[scope], period)} + 1 > {calls}"] if calls else [])
        over[scope, period] = f"coalesce(n.{who[scope]} IS NOT NULL AND ({' OR '.join(tests)}), false)"
    # A user's month only warns where the user's number is a multiple of 4.
    warns = "n.user_id % 4 = 0"
    month = over["user", "month"]
    first = " ".join(f"WHEN {test}{f' AND NOT ({warns})' if key == ('user', 'month') else ''} THEN '{key[0]}:' || n.{who[key[0]]} || ':{key[1]}'" for key, test in over.items())
    return f"""
    WITH RECURSIVE {_SQL_CALLS}, n AS (SELECT id, user_id, project_id, date_trunc('day', ts) AS day, cost_micros AS x, row_number() OVER (PARTITION BY project_id ORDER BY ts, id) AS rn FROM calls),
    s(project_id, rn, id, refused_by, warned, held) AS (
      SELECT DISTINCT project_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, CAST([] AS STRUCT(user_id BIGINT, project_id BIGINT, "day" TIMESTAMP, x BIGINT)[]) FROM n
      UNION ALL SELECT project_id, rn, id, refused_by, warned, CASE WHEN refused_by IS NULL THEN list_append(held, {{'user_id': user_id, 'project_id': project_id, 'day': day, 'x': x}}) ELSE held END
      FROM (SELECT n.project_id, n.rn, n.id, n.user_id, n.day, n.x, s.held, CASE {first} END AS refused_by, CASE WHEN {warns} AND {month} THEN 'user:' || n.user_id || ':month' ELSE '' END AS warned
            FROM s JOIN n ON n.project_id IS NOT DISTINCT FROM s.project_id AND n.rn = s.rn + 1))
    SELECT id, refused_by IS NULL AS admitted, refused_by, CASE WHEN refused_by IS NULL THEN warned ELSE '' END AS warnings FROM s WHERE rn > 0"""


def _together(spark, sf, **how):
    calls = _calls(spark, sf).select("id", "ts", "user_id", "project_id", "cost_micros")
    quotas = []
    for (scope, period), (micros, most) in _LIMITS.items():
        who = F.col(f"{scope}_id")
        action = F.when((who % 4 == 0), "warn").otherwise("block") if (scope, period) == ("user", "month") else F.lit("block")
        quotas.append(calls.filter(who.isNotNull()).select(F.lit(scope).alias("scope_type"), who.alias("scope_id"), F.lit(period).alias("period"), F.lit(micros).alias("limit_cost_micros"),
                                                           F.lit(most).cast("bigint").alias("limit_calls"), action.alias("action")).distinct())
    out = budgets.replay_together(calls, reduce(lambda a, b: a.unionByName(b), quotas), **how)
    return out.select("id", "admitted", "refused_by", F.array_join("warnings", ",").alias("warnings"))


@suite.add(_together_sql())
def budget_replay_together(spark, sf):
    """Daily and monthly budgets of projects and users at once: a call refused by one holds nothing in any."""
    return _together(spark, sf)


@suite.add(f"""
    WITH {_SQL_CALLS} SELECT id AS call_id, CASE WHEN cache_hit OR status = 'failed' THEN 0 ELSE cost_micros END::BIGINT AS settled_micros FROM calls""")
def budget_settlement(spark, sf):
    calls = _calls(spark, sf)
    holds = calls.select(F.col("id").alias("call_id"), (F.col("cost_micros") * 2).alias("estimated_micros"), F.lit(None).cast("bigint").alias("settled_micros"))
    return budgets.settle(holds, calls).select("call_id", "settled_micros")


@suite.add("""
    SELECT conv_id, turn, CAST(((length(text) + 3) // 4 * CASE role WHEN 'user' THEN 2300000 ELSE 138000 END
      + 512::BIGINT * CASE role WHEN 'user' THEN 9200000 ELSE 552000 END + 500000) // 1000000 AS BIGINT) AS estimated_micros FROM conversations""")
def budget_worst_case(spark, sf):
    requests = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.lit("openai").alias("provider"), F.when(F.col("role") == "user", "gpt-4o").otherwise("gpt-4o-mini").alias("model"), F.lit(512).alias("max_tokens"))
    return budgets.worst_case(requests, ledger.price_table(spark)).select("conv_id", "turn", "estimated_micros")


def _audit_rows(spark, sf):
    """Events as audit rows: time, actor, action, details."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("id"), "ts",
        F.col("user_id").cast("string").alias("actor_id"), F.lit(None).cast("string").alias("project_id"), F.col("event_type").alias("action"),
        F.lit("event").alias("object_kind"), F.col("event_id").cast("string").alias("object_id"), F.col("props").alias("details"),
        F.lit(None).cast("string").alias("ip"), "value")


_CANONICAL = """'{"action":"' || event_type || '","actor_id":"' || user_id || '","details":' || replace(props, ' ', '') || ',"id":"a-' || event_id
    || '","ip":null,"object_id":"' || event_id || '","object_kind":"event","project_id":null,"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"}'"""


@suite.add(f"SELECT event_id AS seq, sha256(repeat('0', 64) || {_CANONICAL}) AS row_hash FROM events")
def audit_row_hash(spark, sf):
    rows = _audit_rows(spark, sf)
    return rows.select("seq", audit.row_hash(F.lit(audit.GENESIS), audit.canonical()).alias("row_hash"))


# A chain per block of 64 rows bounds how much has to be hashed in order to make the log; checking has no
# such bound and is tested on one long chain too.
_BLOCK = 64


def _chained(spark, sf):
    """The audit rows as many chains, one per block; rows of high value were altered after hashing."""
    rows = _audit_rows(spark, sf).withColumn("canonical", audit.canonical()).select(
        F.expr(f"seq div {_BLOCK}").alias("chain"), "seq", "canonical", (F.col("value") > 300).alias("altered"))
    blocks = rows.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("seq", "canonical", "altered"))).alias("rows"))
    step = lambda made, row: F.concat(made, F.array(F.struct(
        row["seq"].alias("seq"), F.element_at(made, -1)["row_hash"].alias("prev_hash"),
        audit.row_hash(F.element_at(made, -1)["row_hash"], row["canonical"]).alias("row_hash"),
        F.when(row["altered"], F.concat(row["canonical"], F.lit(" "))).otherwise(row["canonical"]).alias("canonical"))))
    seed = F.array(F.struct(F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("prev_hash"),
                            F.lit(audit.GENESIS).alias("row_hash"), F.lit("").alias("canonical")))
    made = F.aggregate("rows", seed.cast("array<struct<seq:bigint,prev_hash:string,row_hash:string,canonical:string>>"), step)
    return blocks.select("chain", F.inline(F.slice(made, 2, 2 * _BLOCK)))


@suite.add(f"""
    WITH e AS (SELECT event_id // {_BLOCK} AS chain, event_id AS seq, value > 300 AS altered FROM events),
    f AS (SELECT chain, count(*) AS n, min(seq) FILTER (WHERE altered) AS bad FROM e GROUP BY chain)
    SELECT f.chain, bad IS NULL AS ok, count(e.seq) FILTER (WHERE bad IS NULL OR e.seq < bad) AS checked, bad AS first_bad_seq,
      CASE WHEN bad IS NOT NULL THEN 'row_hash mismatch' END AS reason FROM f JOIN e ON e.chain = f.chain GROUP BY ALL""")
def audit_verify(spark, sf):
    return audit.verify(_chained(spark, sf), chain=["chain"])


@suite.add(f"""
    SELECT (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS events,
      (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR) AS keys,
      (SELECT count(*) FROM events WHERE ts > TIMESTAMP '{_NOW}') AS cached,
      (SELECT count(*) FROM events WHERE event_type = 'signup' AND (event_id % 2 = 1 OR ts >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 95 DAY)) AS holds""")
def retention_kept(spark, sf):
    events = table(spark, sf, "events").select("ts", F.col("ts").alias("created_at"), F.col("ts").alias("expires_at"))
    later = F.lit("2024-04-20 00:00:00").cast("timestamp_ntz")
    kept = {
        "events": retention.keep_events(events, _now()), "keys": retention.keep_idempotency_keys(events, _now()),
        "cached": retention.keep_cache(events, _now()), "holds": retention.keep_holds(_holds(spark, sf), later),
    }
    counts = None
    for name, rows in kept.items():
        one = rows.select(F.lit(name).alias("rule"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy().agg(*(F.count_if(F.col("rule") == name).alias(name) for name in kept))
