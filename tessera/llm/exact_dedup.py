"""Exact dedup by a log-structured merge index of digests.

1. Flush. A task's memtable holds (digest, ids) of at most MEMTABLE_ROWS rows. A full memtable leaves the task as a run,
   sorted by digest, for the shared folder (Parquet). A run's last row is its Bloom filter, as the places that it sets;
   the filters of all runs have the same size.
2. Compaction. The places that at least two runs set are one filter of the digests that more than one run may have.
   Only those rows go on: they are dealt by digest, sorted, and merged in one stream, which keeps the smallest (or
   largest) id of a digest and adds up its rows. Digests of one run alone are in the index as they are.
3. Verification. A filter of the digests that stand for several rows is broadcast, documents are read again, and each
   task sends a digest's text once for each chunk; texts of a digest are compared byte by byte, in a stream. Digests with
   unequal texts (none for SHA-256) are grouped by their whole text instead, so the result is exact for any digest.
4. Result. Rows of runs that the compaction did not touch are answered in place; the others meet the index by digest.

A hot text is one row of each run, however many copies there are. Digests of very many runs (HOT_RUNS, or a share of
all, so that they are HOT_DIGESTS at most) are dealt over SALTS partitions wherever ids or texts move. Filters are
bounded by `filter_bits`; beyond that they let unique digests through, which costs shuffle and no result. Nothing but
filters and the hot digests reaches the driver.

Defined results: null text counts as empty. Null ids are kept and rank last: they stay only where no row of the group
has an id. Of rows that share both text and id exactly one is kept. No rows give no rows. Ids must be integers, else
TypeError. Other columns may have any name and type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, chunked, extended, keyed, map_arrow, materialize, named, only_keys, partition_id, private, split_irregular

MEMTABLE_ROWS = 20_000
#: Bits of each filter at most (8 MB), and places that a digest sets.
FILTER_BITS = 1 << 26
HASHES = 4
#: Runs from which a digest counts as hot, hot digests at most, and partitions over which one is dealt.
HOT_RUNS, HOT_DIGESTS, SALTS = 64, 10_000, 32

RUN_SCHEMA = "digest binary, run long, ids array<long>, best long, n long, places binary"
RUN_ARROW = pa.schema([("digest", pa.binary()), ("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64()), ("places", pa.binary())])
INDEX_SCHEMA = "digest binary, keep_id long, keep_run long, group_size long, n_runs long"
INDEX_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_run", pa.int64()), ("group_size", pa.int64()), ("n_runs", pa.int64())])
#: Rows of a batch that a task sends.
BLOCK = 10_000


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class BloomFilter:
    """Membership of digests; it may admit strangers but refuses no member."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros((bits + 7) // 8, np.uint8) if data is None else data

    def places(self, digests: list[bytes]) -> np.ndarray:
        mixed = b"".join(hashlib.blake2b(d, digest_size=8 * HASHES).digest() for d in digests)
        return (np.frombuffer(mixed, np.uint64) % np.uint64(self.bits)).astype(np.int64).reshape(len(digests), HASHES)

    def add(self, digests: list[bytes]) -> None:
        at = self.places(digests).reshape(-1)
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def admits(self, digests: list[bytes]) -> np.ndarray:
        at = self.places(digests)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class LsmIndex:
    """One task's memtable; each flush gives a sorted run of (digest, ids)."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS) -> None:
        self.memtable_rows = memtable_rows
        self.memtable: dict[bytes, list] = {}
        self.rows = 0

    def put(self, digest: bytes, key: int | None) -> list[tuple[bytes, list]]:
        """The run that this row fills, or nothing."""
        self.memtable.setdefault(digest, []).append(key)
        self.rows += 1
        return self.flush() if self.rows >= self.memtable_rows else []

    def flush(self) -> list[tuple[bytes, list]]:
        run = sorted(self.memtable.items())
        self.memtable, self.rows = {}, 0
        return run


def filter_size(members: int, most_bits: int) -> int:
    """Bits of a filter: a power of two, 12 or more for each member as far as most_bits (a power of two) goes."""
    if most_bits & (most_bits - 1) or most_bits < 8:
        raise ValueError("filter bits must be a power of two, 8 at least")
    return min(most_bits, max(1 << 13, 1 << (12 * members).bit_length()))


def best_of(ids: Iterable[int | None], keep: str) -> int | None:
    """The id that stays: smallest or largest, null only if there is no other."""
    return (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)


def build_runs(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, memtable_rows: int = MEMTABLE_ROWS, keep: str = "smallest", bits: int = FILTER_BITS) -> DataFrame:
    """One row for each digest and run, and one (digest null) with its filter: docs is (id, text)."""

    def written(run: list[tuple[bytes, list]], number: int) -> Iterator[pa.RecordBatch]:
        if not run:
            return
        for i in range(0, len(run), BLOCK):
            part = run[i : i + BLOCK]
            yield pa.record_batch([
                pa.array([d for d, _ in part], pa.binary()), pa.array([number] * len(part), pa.int64()), pa.array([k for _, k in part], pa.list_(pa.int64())),
                pa.array([best_of(k, keep) for _, k in part], pa.int64()), pa.array([len(k) for _, k in part], pa.int64()), pa.nulls(len(part), pa.binary()),
            ], schema=RUN_ARROW)
        places = np.unique(BloomFilter(bits).places([d for d, _ in run])).astype("<u4").tobytes()
        yield pa.record_batch([pa.nulls(1, pa.binary()), pa.array([number], pa.int64()), pa.nulls(1, RUN_ARROW.field("ids").type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([places], pa.binary())], schema=RUN_ARROW)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = LsmIndex(memtable_rows), partition_id() << 32
        for keys, texts in chunked(batches):
            for key, text in zip(keys, texts):
                if run := index.put(digest(text or b""), key):
                    yield from written(run, number)
                    number += 1
        yield from written(index.flush(), number)

    return map_arrow(docs, build, RUN_SCHEMA)


def repeated_filter(runs: DataFrame, bits: int) -> BloomFilter:
    """What two runs' filters or more have in common, slice by slice; filters fold to any smaller power of two."""
    width = min(bits, 1 << 20)
    slices = -(-bits // width)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's places by slice, those of several runs apart."""
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for places in batch.column(0).to_pylist():
                at = np.unique(np.frombuffer(places, "<u4") & np.uint32(bits - 1))
                twice[at[once[at]]] = True
                once[at] = True
        for k in range(slices):
            sets = [np.flatnonzero(x[k * width : (k + 1) * width]).astype("<u4").tobytes() for x in (once, twice)]
            if sets[0]:
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([sets[0]], pa.binary()), pa.array([sets[1]], pa.binary())], names=["slice", "once", "twice"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = held.setdefault(k, (np.zeros(width, bool), np.zeros(width, bool)))
                at = np.frombuffer(first, "<u4")
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(second, "<u4")] = True
        for k, (_, twice) in held.items():
            if twice.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    places = runs.filter("digest IS NULL").select("places")
    spread = map_arrow(places, scatter, "slice int, once binary, twice binary").repartitionById(slices, "slice")
    whole = BloomFilter(bits)
    for row in map_arrow(spread, gather, "slice int, bits binary").toLocalIterator():
        start = row.slice * width // 8
        part = np.frombuffer(bytes(row.bits), np.uint8)[: len(whole.data) - start]
        whole.data[start : start + len(part)] = part
    return whole


def _admitted(rows: DataFrame, known: BloomFilter) -> DataFrame:
    """rows with `shared`: whether the filter admits their digest."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("digest")
            admits = sent.value.admits(batch.column(at).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admits, pa.bool_())], names=[*batch.schema.names, "shared"])

    return map_arrow(rows, mark, extended(rows, rows.columns, "shared boolean"))


def compacted(runs: DataFrame, keep: str) -> DataFrame:
    """The index of run rows: one row for each digest, by one merge of the sorted rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None
        top: tuple = (None, 0, 0, 0)  # id, its run, rows, runs
        out: list[tuple] = []
        for batch in batches:
            for digest, run, best, n in zip(*(c.to_pylist() for c in batch.columns)):
                if digest != last:
                    if last is not None:
                        out.append((last, *top))
                    last, top = digest, (best, run, n, 1)
                    continue
                had, at, rows, count = top
                nearer = best is not None and (had is None or (best > had if keep == "largest" else best < had))
                if nearer or (best == had and run < at):
                    had, at = best, run
                top = had, at, rows + n, count + 1
            if len(out) >= BLOCK:
                yield _index_batch(out)
                out = []
        if last is not None:
            out.append((last, *top))
        if out:
            yield _index_batch(out)

    dealt = runs.select("digest", "run", "best", "n").repartition("digest").sortWithinPartitions("digest")
    return map_arrow(dealt, merge, INDEX_SCHEMA)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX_ARROW)], schema=INDEX_ARROW)


def _hot(index: DataFrame) -> frozenset[bytes]:
    """Digests of so many runs that their rows are dealt anew; at most HOT_DIGESTS, as their runs add up to all."""
    least = max(HOT_RUNS, (index.agg(F.sum("n_runs")).first()[0] or 0) // HOT_DIGESTS + 1)
    return frozenset(bytes(r.digest) for r in index.filter(F.col("n_runs") >= least).select("digest").toLocalIterator())


def _shared_filter(index: DataFrame, runs: DataFrame, most_bits: int) -> BloomFilter | None:
    """A filter of the digests that stand for more than one row; None if there are none."""
    several = index.filter("group_size > 1").select("digest").unionByName(runs.filter("n > 1").select("digest"))
    count = several.count()
    if not count:
        return None
    bits = filter_size(count, most_bits)
    empty = BloomFilter(bits)
    return BloomFilter(bits, bit_filter(several, bits, lambda batch: empty.places(batch.column(0).to_pylist()).reshape(-1) if batch.num_rows else np.empty(0, np.int64)))


def unequal_digests(docs: DataFrame, shared: BloomFilter, digest: Callable[[bytes], bytes], hot: frozenset[bytes] = frozenset()) -> DataFrame:
    """Byte verification: digests that stand for more than one text. Those of hot digests meet in SALTS places first."""
    sent = docs.sparkSession.sparkContext.broadcast((shared, hot))
    schema = "digest binary, salt int, bytes binary"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sent.value
        turn = partition_id()
        for _, own in chunked(batches):
            turn += 1
            digests = [digest(t or b"") for t in own]
            passed = np.flatnonzero(shared.admits(digests)).tolist()
            found = sorted({(digests[i], own[i] or b"") for i in passed})
            if found:
                yield pa.record_batch([pa.array([d for d, _ in found], pa.binary()), pa.array([turn % SALTS if d in hot else -1 for d, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary())], names=["digest", "salt", "bytes"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each digest and salt the first text, and the first that differs."""
        last, first, told = None, b"", False
        for batch in batches:
            out = []
            for d, salt, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, salt) != last:
                    last, first, told = (d, salt), text, False
                    if salt >= 0:
                        out.append((d, -1, text))
                elif text != first and not told:
                    told = True
                    out.append((d, -2, b""))
            if out:
                yield pa.record_batch([pa.array([d for d, _, _ in out], pa.binary()), pa.array([s for _, s, _ in out], pa.int32()), pa.array([t for _, _, t in out], pa.binary())], names=["digest", "salt", "bytes"])

    def compared(rows: DataFrame) -> DataFrame:
        return map_arrow(rows.repartition("digest", "salt").sortWithinPartitions("digest", "salt"), distinct, schema)

    found = compared(map_arrow(docs, texts, schema))
    if not hot:
        return found.filter("salt = -2").select("digest")
    found = materialize(found, "verified")  # one text of each hot digest and salt, and what differs already
    return found.filter("salt = -2").select("digest").unionByName(compared(found.filter("salt = -1")).filter("salt = -2").select("digest"))


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "smallest", digest: Callable[[bytes], bytes] = sha256, memtable_rows: int = MEMTABLE_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, digest."""
    docs = keyed(docs, key, text)
    runs = materialize(build_runs(docs, digest, memtable_rows, keep, filter_bits), "runs")
    rows = runs.filter("digest IS NOT NULL").select("digest", "run", "ids", "best", "n")
    known = repeated_filter(runs, filter_size(rows.count(), filter_bits))
    runs, rows = rows, _admitted(rows, known)
    index = materialize(compacted(rows.filter("shared"), keep), "index")
    alone = rows.filter("NOT shared")
    hot = _hot(index)
    shared = _shared_filter(index, runs, filter_bits)  # of the rows as they stand: one Python worker for each task
    odd = materialize(unequal_digests(docs, shared, digest, hot).distinct(), "unequal") if shared else None
    if odd is not None and odd.take(1):
        rest, own = index.join(odd, "digest", "left_anti"), alone.join(odd, "digest", "left_anti")
        return _by_index(rows, rest, own, hot).unionByName(_by_text(docs, odd, digest, keep)).withColumnRenamed("id", key)
    return _by_index(rows, index, alone, hot).withColumnRenamed("id", key)


def drop_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay. Where ids repeat, equal rows count once."""
    rows = materialize(exact_dedup(docs, key=key, text=text, **options), "copies")
    kept = rows.filter(F.col("kept") & named(key).isNotNull()).select(named(key))
    alone, others = split_irregular(docs, rows, key)
    out = only_keys(alone, kept, key)
    if others is None:
        return out

    at = others.columns.index(text)
    digest = options.get("digest", sha256)
    mark_name = private(others, "_digest")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [digest(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, mark_name])

    marked = map_arrow(others, mark, extended(others, others.columns, f"`{mark_name}` binary"))
    bytes_name = private(marked, "_bytes")
    marked = marked.withColumn(bytes_name, F.coalesce(named(text), F.lit("")))
    key_name, kept_name = private(marked, "_key"), private(marked, "_kept")
    stays = rows.filter("kept").select(named(key).alias(key_name), F.col("digest").alias(kept_name))
    marked = marked.join(stays, named(key).eqNullSafe(named(key_name)) & (named(mark_name) == named(kept_name)), "left_semi")
    return out.unionByName(marked.dropDuplicates([key, bytes_name]).drop(mark_name, bytes_name))


def _by_index(rows: DataFrame, index: DataFrame, alone: DataFrame, hot: frozenset[bytes]) -> DataFrame:
    """Ids of every run row with what the index says; in the run that stays, the first row of the best id is kept."""
    spark = rows.sparkSession
    single = alone.select("digest", "ids", "run", F.col("best").alias("keep_id"), F.col("run").alias("keep_run"), F.col("n").alias("group_size"))
    salted = rows.filter("shared").select("digest", "run", "ids")
    if hot:
        known = F.broadcast(spark.createDataFrame([(bytearray(d), True) for d in hot], "digest binary, hot boolean"))
        salted = salted.join(known, "digest", "left").select("digest", "run", "ids", F.when(F.col("hot"), F.pmod(F.xxhash64("run"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        spread = index.join(known, "digest", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        met = salted.join(spread, ["digest", "salt"])
    else:
        met = salted.join(index, "digest")
    both = single.unionByName(met.select("digest", "ids", "run", "keep_id", "keep_run", "group_size"))
    winner = F.when(F.col("run") == F.col("keep_run"), F.when(F.col("keep_id").isNull(), F.lit(1)).otherwise(F.array_position("ids", F.col("keep_id")))).otherwise(F.lit(0))
    out = both.withColumn("winner", winner).select("digest", "keep_id", "group_size", "winner", F.posexplode("ids").alias("at", "id"))
    return out.select("id", "keep_id", "group_size", (F.col("at") + 1 == F.col("winner")).alias("kept"), "digest")


def _by_text(docs: DataFrame, odd: DataFrame, digest: Callable[[bytes], bytes], keep: str) -> DataFrame:
    """Rows whose digest stands for several texts, grouped by the text itself."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunked(batches):
            own = [t or b"" for t in texts]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(own, pa.binary()), pa.array([digest(t) for t in own], pa.binary())], names=["id", "bytes", "digest"])

    rows = map_arrow(docs, digests, "id long, bytes binary, digest binary").join(odd, "digest", "left_semi")
    rows = materialize(rows.withColumn("run", F.monotonically_increasing_id()), "unequal_rows")
    best = F.col("id") if keep == "largest" else -F.col("id")
    top = rows.groupBy("bytes").agg(F.max_by(F.struct("id", "run"), F.struct(F.col("id").isNotNull(), best, -F.col("run"))).alias("top"), F.count("*").alias("group_size"))
    return rows.join(top, "bytes").select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("run") == F.col("top.run")).alias("kept"), "digest")
