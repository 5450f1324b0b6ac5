"""Model-call ledger: costs in integer micros, usage reports, trace rollups, stored message copies.

Money is never a float: a cost is a whole number of millionths, rounded half up once, on the total.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.errors import InvalidInput

# Prices per million tokens, in micros: (provider/model, in, out).
PRICES = (
    ("echo/echo-1", 0, 0),
    ("openai/gpt-4o", 2300000, 9200000),
    ("openai/gpt-4o-mini", 138000, 552000),
    ("anthropic/claude-sonnet-4", 2760000, 13800000),
    ("anthropic/claude-haiku-4-5", 736000, 3680000),
    ("ollama/qwen2.5", 0, 0),
    ("ollama/llama3.2", 0, 0),
)
CURRENCY = "EUR"
# Report groupings, default and longest range.
GROUPINGS = {
    "day": lambda: F.date_format("ts", "yyyy-MM-dd"),
    "model": lambda: F.col("model"),
    "user": lambda: F.col("user_id"),
    "provider": lambda: F.col("provider"),
    "purpose": lambda: F.col("purpose"),
}
UNATTRIBUTED = "unattributed"
DEFAULT_DAYS = 30
MAX_RANGE_DAYS = 366


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    """The prices as a table whose size Spark knows, so that joining it never shuffles the ledger."""
    rows = [F.struct(F.lit(key).alias("price_key"), F.lit(low).cast("bigint").alias("in_per_mtok"),
                     F.lit(high).cast("bigint").alias("out_per_mtok")) for key, low, high in prices]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _half_up_millionths(total: Column) -> Column:
    return F.round(total / F.lit(1_000_000).cast("decimal(7,0)"), 0).cast("bigint")


def with_cost(calls: DataFrame, prices: DataFrame, tokens_in: str = "tokens_in",
              tokens_out: str = "tokens_out") -> DataFrame:
    """Add cost_micros and pricing_unknown. A model without a price costs 0 and is flagged."""
    key = F.concat_ws("/", "provider", "model")
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    total = exact(tokens_in) * exact("in_per_mtok") + exact(tokens_out) * exact("out_per_mtok")
    return (
        calls.withColumn("price_key", key)
        .join(prices, "price_key", "left")
        .withColumn("pricing_unknown", F.col("in_per_mtok").isNull())
        .withColumn("cost_micros", F.coalesce(_half_up_millionths(total), F.lit(0).cast("bigint")))
        .drop("price_key", "in_per_mtok", "out_per_mtok")
    )


def report_range(start: dt.datetime | None, stop: dt.datetime | None, now: dt.datetime):
    """The half-open range of a report: the last 30 days by default, 366 days at most."""
    stop = stop or now
    start = start or stop - dt.timedelta(days=DEFAULT_DAYS)
    if start >= stop:
        raise InvalidInput("`from` must be before `to`")
    if (stop - start).days > MAX_RANGE_DAYS:
        raise InvalidInput(f"a report covers at most {MAX_RANGE_DAYS} days")
    return start, stop


_MEASURES = ("calls", "tokens_in", "tokens_out", "cost_micros", "cache_hits", "errors", "unpriced")


def usage_report(calls: DataFrame, start: dt.datetime, stop: dt.datetime, group_by: str = "day",
                 project: object | None = None) -> DataFrame:
    """Calls, tokens, cost, cache hits and errors per bucket, and a total row, over [start, stop).

    The ledger is read once, down to one row per bucket; the total sums those. An empty range still
    has its total, in zeros. `pricing_incomplete` on the total says that it is a floor.
    """
    if group_by not in GROUPINGS:
        raise InvalidInput(f"group_by must be one of {tuple(GROUPINGS)}")
    wanted = calls.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(stop)))
    if project is not None:
        wanted = wanted.filter(F.col("project_id") == project)
    buckets = wanted.groupBy(F.coalesce(GROUPINGS[group_by]().cast("string"), F.lit(UNATTRIBUTED)).alias("bucket")).agg(
        F.count("*").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_micros").alias("cost_micros"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if("pricing_unknown").alias("unpriced"),
    )
    place = lambda key, total: F.struct(key.alias("key"), F.lit(total).alias("is_total"))
    measures = [F.coalesce(F.col(m).cast("bigint"), F.lit(0).cast("bigint")).alias(m) for m in _MEASURES]
    twice = buckets.select(F.inline(F.array(place(F.col("bucket"), False), place(F.lit("total"), True))), *measures)
    nothing = calls.sparkSession.range(0, 1, 1, 1).select(
        F.lit("total").alias("key"), F.lit(True).alias("is_total"), *(F.lit(0).cast("bigint").alias(m) for m in _MEASURES))
    return twice.unionByName(nothing).groupBy("key", "is_total").agg(
        *(F.sum(m).alias(m) for m in _MEASURES[:-1]), (F.sum("unpriced") > 0).alias("pricing_incomplete"))


def trace_rollup(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        F.coalesce(F.sum("cost_micros"), F.lit(0)).cast("bigint").alias("total_cost_micros"),
    )


def message_copies(messages: DataFrame) -> DataFrame:
    """What is stored of each message under its call's audit_mode: nothing when `off`; the raw text only
    when `full`, and only where redaction changed it."""
    differs = F.col("content_raw") != F.col("content_redacted")
    return messages.filter(F.col("audit_mode") != "off").withColumn(
        "content_raw", F.when((F.col("audit_mode") == "full") & differs, F.col("content_raw")))
