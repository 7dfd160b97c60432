"""Getting this library to the executors' Python workers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import zipfile
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._tessera_shipped = True


PLAIN = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def release() -> None:
    """Give memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(function):
    """function, with release() at the end of its batches: workers outlive their tasks and wait beside those of later stages."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with this library at hand in the workers, for columns of any name."""
    ship_package(df.sparkSession)
    names, function = df.columns, releasing(function)
    if all(map(PLAIN.fullmatch, names)):
        return df.mapInArrow(function, schema)
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: function(b.rename_columns(names) for b in batches), schema)
