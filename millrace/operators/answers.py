"""Run a model answer per row: bounded concurrency, resumable results, answers shared by equal requests.

The answer function is the caller's: `answer(system, user) -> {"content", "cost_micros", "tokens_in",
"tokens_out"}`. It runs inside Spark tasks, a few calls at a time per task, on Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from millrace.errors import StepAborted
from millrace.operators.prompts import Plan, render
from millrace.session import checkpointed, require_columns

# Calls in flight per task, and refusals that stop the whole step.
IN_FLIGHT = 4
FATAL_CODES = ("quota-exceeded", "residency-blocked", "not-found", "unauthenticated")

Answer = Callable[[str, str], dict]


class AnswerFailed(Exception):
    """An answer function raises this to fail one row, or with a fatal code the whole step."""

    def __init__(self, detail: str, code: str | None = None):
        super().__init__(detail)
        self.detail, self.code = detail, code


def canonical_json(text: str) -> str:
    """Sorted, compact JSON; text that is not JSON stays as it is."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):  # also a number too long, or nesting too deep, to read
        return text


@F.pandas_udf(T.StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else canonical_json(t))


def coerce(mode: str, content: Column) -> Column:
    """What goes into the column: a bare label, canonical JSON, or the answer as it came."""
    if mode == "classify":
        strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return strip(F.regexp_replace(strip(content), '^"+|"+$', ""))
    return _canonical(content) if mode == "extract" else content


def _fields(df: DataFrame, key: list[str]) -> T.StructType:
    return T.StructType(
        [df.schema[k] for k in key]
        + [T.StructField("output", T.StringType()), T.StructField("error", T.StringType()),
           T.StructField("cost_micros", T.LongType()), T.StructField("tokens_in", T.LongType()),
           T.StructField("tokens_out", T.LongType()), T.StructField("fatal", T.StringType())]
    )


def _asker(key: list[str], system: str, answer: Answer):
    columns = [*key, "output", "error", "cost_micros", "tokens_in", "tokens_out", "fatal"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = []

        def one(user: str):
            if stopped:
                return None
            try:
                got = answer(system, user)
            except AnswerFailed as error:
                if error.code in FATAL_CODES:
                    stopped.append(error.code)
                    return None, error.detail, 0, 0, 0, error.code
                return None, error.detail, 0, 0, 0, None
            numbers = (int(got.get(n) or 0) for n in ("cost_micros", "tokens_in", "tokens_out"))
            return (str(got.get("content") or ""), None, *numbers, None)

        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            for batch in batches:
                rows = [(*place, *result)
                        for place, result in zip(batch[key].itertuples(index=False, name=None),
                                                 pool.map(one, batch["_user"]))
                        if result is not None]
                yield pd.DataFrame(rows, columns=columns)

    return ask


def ask_rows(df: DataFrame, key: list[str], prompt: Plan, answer: Answer) -> DataFrame:
    """One answer row per input row: key, output, error, cost_micros, tokens_in, tokens_out, fatal."""
    require_columns(df, key)
    asked = df.select(*key, render(df, prompt).alias("_user"))
    return asked.mapInPandas(_asker(key, prompt.system, answer), _fields(df, key)).withColumn(
        "output", coerce(prompt.mode, F.col("output")))


def _done(spark, path: str, key: list[str], retry_errors: bool) -> DataFrame | None:
    try:
        done = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return (done.filter("error IS NULL") if retry_errors else done).select(*key).distinct()


def run_rows(df: DataFrame, key: list[str], prompt: Plan, answer: Answer, results: str,
             slices: int = 1, retry_errors: bool = False) -> DataFrame:
    """Answer every row that `results` does not hold yet, then return the input with its answers.

    `key` is unique on the input. The work is cut into `slices` by key hash; each slice is one
    distributed job whose rows are appended when it is complete, so a run that dies pays again for one
    slice at most. A failed row counts as done unless `retry_errors`. A fatal refusal raises
    StepAborted once the rows answered before it are saved.
    """
    spark = df.sparkSession
    for part in range(slices):
        todo = df.filter(F.pmod(F.xxhash64(*key), F.lit(slices)) == part) if slices > 1 else df
        done = _done(spark, results, key, retry_errors)
        if done is not None:
            todo = todo.join(done, key, "left_anti")
        # Storing the answers is what makes each call happen once: the look for a fatal row and the save
        # both read the stored answers.
        answered = checkpointed(ask_rows(todo, key, prompt, answer))
        refusal = answered.filter("fatal IS NOT NULL").select("fatal").take(1)
        good = answered.filter("fatal IS NULL").drop("fatal").withColumn("saved_at", F.current_timestamp())
        if not refusal or not good.isEmpty():
            good.write.mode("append").parquet(results)
        if refusal:
            raise StepAborted(refusal[0][0])
    return with_answers(df, key, prompt.output, spark.read.parquet(results))


def with_answers(df: DataFrame, key: list[str], output: str, results: DataFrame) -> DataFrame:
    """Left join the answers: a failed row has a NULL output and its error text."""
    newest = F.max_by(F.struct("output", "error", "cost_micros", "tokens_in", "tokens_out"), "saved_at")
    latest = results.groupBy(*key).agg(newest.alias("_r"))
    return df.join(latest, key, "left").withColumns({
        output: F.col("_r.output"), f"{output}_error": F.col("_r.error"),
        "cost_micros": F.coalesce(F.col("_r.cost_micros"), F.lit(0)),
    }).drop("_r")


def distinct_requests(requests: DataFrame, request_hash: str, payload: list[str]) -> DataFrame:
    """One row per request hash. Equal requests combine before the shuffle, however many there are."""
    return requests.groupBy(request_hash).agg(*(F.min(c).alias(c) for c in payload))


def from_cache(requests: DataFrame, request_hash: str, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with `cache_hit`, `content`, `tokens_in`, `tokens_out` from unexpired entries.

    Expiry holds on read, and an entry without content is a miss.
    """
    usable = cache.filter((F.col("expires_at") > now) & F.col("content").isNotNull()).select(
        request_hash, "content", "tokens_in", "tokens_out")
    return requests.join(usable, request_hash, "left").withColumn("cache_hit", F.col("content").isNotNull())


def store_in_cache(cache: DataFrame, answers: DataFrame, request_hash: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The cache with fresh answers on top; the newest expiry wins per hash."""
    fresh = answers.select(request_hash, "content", "tokens_in", "tokens_out",
                           (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    both = cache.select(*fresh.columns).unionByName(fresh)
    newest = F.max_by(F.struct("content", "tokens_in", "tokens_out", "expires_at"), "expires_at")
    return both.groupBy(request_hash).agg(newest.alias("_e")).select(request_hash, "_e.*")
