"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even when a later step wanted the join's own partitioning.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """Write `df` as a table in the shared folder and go on from there; also its number of rows.

    Lineage is cut, a lost executor costs a re-read instead of a re-run, and what follows reads only
    the columns it needs and knows the table's real size when it picks a join. The count comes from the
    write itself.
    """
    spark = df.sparkSession
    path, seen = scratch_path(spark, "step"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["rows"])


def checkpointed(df: DataFrame) -> DataFrame:
    return stored(df)[0]


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """What runs inside hands rows to Python in Arrow batches that end at about `size` bytes, unless the session names a size itself.

    Spark's own 64 MB are held several times over by each task, in the executor's direct memory and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application stored in the shared folder. Call it when its results are written:
    frames that still read from there stop working."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, target_bytes: int = 256 << 20) -> int:
    """Partitions for a shuffle of `df`: what the session asks for, or more where its sources are larger
    than that many partitions should hold."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < 1 << 60)  # a source of unknown size says 2^63
    return max(least, -(-known // target_bytes))


def require_columns(df: DataFrame, names) -> None:
    from millrace.errors import InvalidInput

    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise InvalidInput(f"unknown column(s) {missing}; the input has {df.columns}")
