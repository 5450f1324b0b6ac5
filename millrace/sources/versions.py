"""Versioned datasets: one immutable parquet folder per version, one catalog row per commit.

A version exists once its row is in the catalog table; the row is written last, so a build that dies
leaves a folder nobody reads, which the orphan listing finds.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.errors import ChecksFailed, InvalidInput
from millrace.operators.checks import FAIL, Check, judge, measures
from millrace.operators.labels import LADDERS, column_labels
from millrace.operators.profile import profile
from millrace.sources.files import write_measured

SCHEMA = (
    "project string, dataset string, version bigint, location string, format string, schema string, "
    "row_count bigint, row_count_kind string, profile string, recipe_config_hash string, "
    "input_versions map<string,bigint>, config_snapshot string, created_at timestamp, "
    "classification string, bbn string, confidentiality string"
)
# Hours after which a claim or a folder without a catalog row is taken for a dead build's.
STALE_HOURS = 24.0


def version_path(root: str, project: str, dataset: str, version: int) -> str:
    return f"{root.rstrip('/')}/projects/{project}/datasets/{dataset}/v{version}"


def _catalog_path(root: str) -> str:
    return f"{root.rstrip('/')}/catalog/dataset_versions"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of committed versions; empty before the first commit."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_catalog_path(root))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(_catalog_path(root))


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    """(project, dataset, current_version): the newest commit."""
    return versions(spark, root).groupBy("project", "dataset").agg(F.max("version").alias("current_version"))


def current_version(spark: SparkSession, root: str, project: str, dataset: str) -> int:
    row = versions(spark, root).filter(
        (F.col("project") == project) & (F.col("dataset") == dataset)).agg(F.max("version")).first()
    return int(row[0] or 0)


def read_version(spark: SparkSession, root: str, project: str, dataset: str, version: int | None = None) -> DataFrame:
    wanted = version or current_version(spark, root, project, dataset)
    if not wanted:
        raise InvalidInput(f"{project}/{dataset} has no version yet")
    return spark.read.parquet(version_path(root, project, dataset, wanted))


def write_version(df: DataFrame, root: str, project: str, dataset: str, recipe_hash: str | None = None,
                  input_versions: dict[str, int] | None = None, config: dict[str, Any] | None = None,
                  with_profile: bool = True, labels: dict[str, str | None] | None = None,
                  checks: list[Check] | None = None) -> int:
    """Write the next version, check and profile it, then commit it. Returns the version.

    One build at a time writes a version: it holds a claim, and another one fails. The folder is
    overwritten, so a retry replaces what a dead attempt left. The written files, not the input, are what
    is counted and profiled. `labels` are the dataset's, by ladder.

    `checks` are measured in the write itself. One that fails ends the build with ChecksFailed, and neither
    folder nor catalog row is left; results of the others stand in the version's profile.
    """
    spark = df.sparkSession
    version = current_version(spark, root, project, dataset) + 1
    path = version_path(root, project, dataset, version)
    with _claimed(spark, path):
        if current_version(spark, root, project, dataset) >= version:
            raise InvalidInput(f"{path} was committed by another build meanwhile")
        return _commit(df, root, project, dataset, version, path, recipe_hash, input_versions, config, with_profile, labels or {}, checks or [])


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _claimed(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the file `<path>.claim`, which only one build can create. A claim older than STALE_HOURS is a dead
    build's and is taken over. The store must create files atomically, as HDFS and local disks do."""
    at, fs = _file_system(spark, f"{path}.claim")
    if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > STALE_HOURS * 3600:
        fs.delete(at, False)
    try:
        mine = fs.createNewFile(at)
    except Py4JJavaError as error:
        raise InvalidInput(f"{path} can't be claimed") from error
    if not mine:
        raise InvalidInput(f"{path} is being written by another build")
    try:
        yield
    finally:
        fs.delete(at, False)


def _commit(df, root, project, dataset, version, path, recipe_hash, input_versions, config, with_profile, own, checks) -> int:
    spark = df.sparkSession
    rows, values = write_measured(df, path, measures(df, checks))
    results = judge(checks, values)
    if any(r["status"] == FAIL for r in results):
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
        raise ChecksFailed(results)
    written = spark.read.parquet(path)
    if written.count() != rows:
        raise InvalidInput(f"{path} does not hold the {rows} rows that were written")
    shown = [r.asDict(recursive=True) for r in profile(written).collect()] if with_profile else []
    labels = column_labels(df.schema)
    schema = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": True,
               "classification": labels[f.name]} for f in written.schema.fields]
    row = (project, dataset, version, path, "parquet", json.dumps(schema), rows, "exact",
           json.dumps({"row_count": rows, "columns": shown, **({"checks": results} if checks else {})}), recipe_hash, input_versions or {},
           json.dumps(config or {}, ensure_ascii=False, default=str), dt.datetime.now(dt.timezone.utc),
           *(own.get(ladder) or steps[0] for ladder, steps in LADDERS.items()))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(_catalog_path(root))
    return version


def version_folders(files: DataFrame) -> DataFrame:
    """(project, dataset, version, folder) of every version folder in a listing of file paths."""
    pattern = r"^(.*projects/([^/]+)/datasets/([^/]+)/v(\d+))/"
    part = lambda i: F.regexp_extract("path", pattern, i)
    return (
        files.select(part(2).alias("project"), part(3).alias("dataset"), part(4).alias("v"), part(1).alias("folder"))
        .filter("v <> ''").withColumn("version", F.col("v").cast("bigint")).drop("v").distinct()
    )


def orphans(files: DataFrame, committed: DataFrame) -> DataFrame:
    """Folders of versions above the current one that have no catalog row."""
    known = committed.select("project", "dataset", "version")
    current = known.groupBy("project", "dataset").agg(F.max("version").alias("current"))
    return (
        version_folders(files).join(known, ["project", "dataset", "version"], "left_anti")
        .join(current, ["project", "dataset"], "left")
        .filter(F.col("version") > F.coalesce("current", F.lit(0))).drop("current")
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime) of the data files under `root`; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(root).select("path", "modificationTime")


def prune_orphans(spark: SparkSession, root: str, older_than_hours: float = STALE_HOURS) -> int:
    """Delete the orphan folders in which nothing was written for some hours, and return how many there were.
    A younger one may be a running build's, whose catalog row comes last."""
    files = list_files(spark, f"{root.rstrip('/')}/projects")
    before = F.current_timestamp() - F.make_dt_interval(hours=F.lit(0), secs=F.lit(older_than_hours * 3600))
    live = version_folders(files.filter(F.col("modificationTime") > before)).select("folder")
    found = orphans(files, versions(spark, root)).join(live, "folder", "left_anti").select("folder")
    removed = 0
    for row in found.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["folder"])
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed
