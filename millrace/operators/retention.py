"""Retention: which rows stay. Each rule is a filter on time, pushed into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How long each kind of row is kept.
EVENT_DAYS = 7
IDEMPOTENCY_HOURS = 24
SETTLED_HOLD_DAYS = 95
UPLOAD_HOURS = 24


def _younger(column: str, now: Column, interval: str) -> Column:
    return F.col(column) >= now - F.expr(f"INTERVAL {interval}")


def keep_events(events: DataFrame, now: Column) -> DataFrame:
    return events.filter(_younger("ts", now, f"{EVENT_DAYS} DAYS"))


def keep_idempotency_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.filter(_younger("created_at", now, f"{IDEMPOTENCY_HOURS} HOURS"))


def keep_cache(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def keep_holds(holds: DataFrame, now: Column) -> DataFrame:
    """Open holds always stay; settled ones for 95 days."""
    return holds.filter(F.col("settled_micros").isNull() | _younger("ts", now, f"{SETTLED_HOLD_DAYS} DAYS"))


def stale_uploads(files: DataFrame, now: Column) -> DataFrame:
    """Upload folders with a file older than a day, from a listing of (path, modificationTime)."""
    folder = F.regexp_extract("path", r"(projects/[^/]+/uploads/[^/]+)", 1)
    return (
        files.withColumn("folder", folder)
        .filter((F.col("folder") != "") & ~_younger("modificationTime", now, f"{UPLOAD_HOURS} HOURS"))
        .select("folder").distinct()
    )
