"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import materialize, scratch_path
from tessera.sources.shipping import map_arrow

__all__ = [
    "binary_rows", "bit_filter", "chunked", "extended", "irregular_keys", "keyed", "map_arrow", "materialize", "named", "only_keys", "others", "partition_id", "private", "scratch_path", "split_irregular", "table",
]

#: Text bytes that a Python task holds at once, besides one whole text.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its literal name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(docs: DataFrame, *outputs: str) -> list[str]:
    """The columns that are not named like an output, in any case of letters."""
    taken = {x.lower() for x in outputs}
    return [c for c in docs.columns if c.lower() not in taken]


def private(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(docs: DataFrame, kept: list[str], more: str) -> T.StructType:
    """The schema of kept columns and further ones (DDL)."""
    return T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(more).fields])


def keyed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(id long, text, more): the key must be a column of integers, anything else raises TypeError."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} must hold integers, not {kind.simpleString()}: number the rows and join the numbers back")
    return docs.select(named(key).cast("long").alias("id"), named(text).alias("text"), *more)


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def binary_rows(batch: pa.RecordBatch, key: int = 0, text: int = 1) -> tuple[list, list]:
    """Keys, and texts as UTF-8 bytes (None where null)."""
    return batch.column(key).to_pylist(), batch.column(text).cast(pa.binary()).to_pylist()


def chunked(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """(keys, texts as bytes) in lists of at most `limit` text bytes, or one longer text."""
    keys: list = []
    texts: list = []
    held = 0
    for batch in batches:
        for key, value in zip(*binary_rows(batch)):
            size = len(value) if value is not None else 0
            if keys and held + size > limit:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(value)
            held += size
    if keys:
        yield keys, texts


#: Keys (longs) that a join may send to every executor; about 16 MB as a hash table.
BROADCAST_KEYS = 500_000


def only_keys(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """docs whose key is (left_semi) or is not (left_anti) in keys (one column, named like the key, no nulls).

    keys must be cheap to count. Beyond BROADCAST_KEYS both sides are shuffled by key."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    right = keys.select(named(key).alias(other := private(docs, "_other")))
    return docs.join(F.broadcast(right) if small else right, named(key) == F.col(other), how)


def irregular_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several rows share."""
    counts = rows.filter(named(key).isNotNull()).select(named(key).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return materialize(counts.filter("n > 1").select(F.col("k").alias(key)), "irregular")


def split_irregular(docs: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(docs whose key is theirs alone, docs with a null key or one that several rows of `rows` share; None if there are none)."""
    shared = irregular_keys(rows, key)
    nulls = rows.filter(named(key).isNull()).limit(1).count()
    if not nulls and not shared.take(1):
        return docs, None
    alone = only_keys(docs.filter(named(key).isNotNull()), shared, key, "left_anti")
    return alone, only_keys(docs, shared, key).unionByName(docs.filter(named(key).isNull()))


#: Bytes of one slice of a bit filter.
SLICE_BYTES = 1 << 17


def bit_filter(rows: DataFrame, bits: int, places: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The OR of the bits that `places` names for each batch of rows, as bytes on the driver: `bits` / 8 of them.

    Every task sends the places that it sets, by slice, as 32-bit numbers or as a bitmap, whichever is shorter; slices
    are put together by as many tasks as there are."""
    width = min(bits, 8 * SLICE_BYTES)
    slices = -(-bits // width)

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(-(-bits // 8), np.uint8)
        for batch in batches:
            at = places(batch)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(slices):
            part = own[k * width // 8 : (k + 1) * width // 8]
            used = np.flatnonzero(part)
            if len(used):
                set_bits = np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u4").tobytes()
                short = len(set_bits) < len(part)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([short]), pa.array([set_bits if short else part.tobytes()], pa.binary())], names=["slice", "short", "bits"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, short, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = held.setdefault(k, np.zeros(-(-width // 8), np.uint8))
                if short:
                    at = np.frombuffer(data, "<u4").astype(np.int64)
                    np.bitwise_or.at(part, at >> 3, (1 << (at & 7)).astype(np.uint8))
                else:
                    part[: len(data)] |= np.frombuffer(data, np.uint8)
        for k, part in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "bits"])

    spread = map_arrow(rows, scatter, "slice int, short boolean, bits binary").repartitionById(slices, "slice")
    whole = np.zeros(-(-bits // 8), np.uint8)
    for row in map_arrow(spread, gather, "slice int, bits binary").toLocalIterator():
        start = row.slice * width // 8
        part = np.frombuffer(bytes(row.bits), np.uint8)[: len(whole) - start]
        whole[start : start + len(part)] |= part
    return whole
