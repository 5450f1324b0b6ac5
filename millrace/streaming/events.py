"""Tail an event log: a file stream with a topic filter and per-user visibility.

The checkpoint is the cursor: it moves past events the reader may not see. A batch page by `seq` gives
the same rows to callers that keep their own cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

# Fixed value: events per page.
PAGE = 500


def visible(events: DataFrame, user: object, admin: bool = False, memberships: DataFrame | None = None) -> DataFrame:
    """Events addressed to the user; events of a project the user belongs to (any project for an admin);
    events addressed to nobody in particular."""
    mine = F.coalesce(F.col("user_id") == F.lit(user), F.lit(False))
    general = F.col("user_id").isNull() & F.col("project_id").isNull()
    if admin or memberships is None:
        of_project = F.col("user_id").isNull() & F.col("project_id").isNotNull() & F.lit(admin)
        return events.filter(mine | general | of_project)
    projects = memberships.filter(F.col("user_id") == F.lit(user)).select(
        F.col("project_id").alias("_member_of")).distinct()
    joined = events.join(projects, events["project_id"] == projects["_member_of"], "left")
    member = F.col("user_id").isNull() & F.col("_member_of").isNotNull()
    return joined.filter(mine | general | member).drop("_member_of")


def of_topics(events: DataFrame, topics: list[str] | None) -> DataFrame:
    return events if topics is None else events.filter(F.col("topic").isin(topics))


def page(events: DataFrame, cursor: int, limit: int = PAGE) -> DataFrame:
    """The next events after the cursor, in order; the caller's next cursor is the last `seq` here, before
    any topic or visibility filter."""
    return events.filter(F.col("seq") > cursor).orderBy("seq").limit(limit)


def cursor_reset(events: DataFrame, cursor: int) -> DataFrame:
    """(reset, cursor): when rows after the cursor were already removed, start again from the head."""
    return events.agg(F.min("seq").alias("low"), F.coalesce(F.max("seq"), F.lit(0)).alias("head")).select(
        F.coalesce(F.lit(cursor) + 1 < F.col("low"), F.lit(False)).alias("reset"),
        F.when(F.coalesce(F.lit(cursor) + 1 < F.col("low"), F.lit(False)), F.col("head"))
        .otherwise(F.lit(cursor)).cast("bigint").alias("cursor"))


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000,
             glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def tail(events: DataFrame, out: str, checkpoint: str):
    """Drain what there is into parquet and stop; started again with the same checkpoint, it goes on from
    there."""
    query = (
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
