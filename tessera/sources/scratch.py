"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI; where it is unset and the master is local (tests), a local folder, which goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{os.getuid()}/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
        atexit.register(shutil.rmtree, base.removeprefix("file:"), ignore_errors=True)
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme and authority, as Spark and other readers understand it alike."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written elsewhere go with them."""
    delete_path(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


#: Paths of the tables that were made within each open scope of this thread, innermost last.
_scopes: ContextVar[tuple[dict[str, None], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if scopes := _scopes.get():
        scopes[-1][path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """materialize(), and how many rows were written (at least, if any), known without another job."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def drop(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again; any other DataFrame is left alone."""
    if path := getattr(df, "_scratch", None):
        delete_path(df.sparkSession, path)
        for made in _scopes.get():
            made.pop(path, None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for those given to the function that the block gets."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._scratch)
        return df

    made: dict[str, None] = {}
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in made:
            if path not in kept:
                delete_path(spark, path)
            elif outer := _scopes.get():
                outer[-1][path] = None
