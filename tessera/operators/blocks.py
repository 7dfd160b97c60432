"""Vectors as matrices: Arrow's list buffers are viewed as they are, and tables of vectors meet block by block.

A table of vectors is packed into blocks: rows of one matrix, its vectors' lengths beside it. Every block of questions
meets every block of the corpus once. Few questions (by bytes) are broadcast and the corpus is scanned where it lies;
beyond that the corpus is packed too, both are dealt over the rows and columns of tiles, four for each core, with four
times as many rows as columns, and an equi-join on the tile pairs them: a block is sent to a row or a column of tiles, whatever the
number of blocks, and a question has a result from each tile of its row only, of which there are few. Questions are dealt
one by one before they are packed, so that no row of tiles has more of them. Either way it is one plan, whatever the number of questions.

A vector without a direction takes no part: null, empty, of length zero, or with a null or non-finite component. Vectors
that meet must have one number of components; anything else is a ValueError that says so.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.scratch import materialize
from tessera.sources.shipping import map_arrow

#: Vectors of a block of questions and of the corpus, bytes of a block's matrix, of similarities that a task computes at
#: once, and of questions that are broadcast, at most.
QUESTION_ROWS, CORPUS_ROWS, BLOCK_BYTES, PRODUCT_BYTES, BROADCAST_BYTES = 4_096, 8_192, 16 << 20, 32 << 20, 32 << 20
#: Bytes of similarities that are looked at while they are in a core's cache.
CACHED_BYTES = 1 << 20


def matrix_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers, none of them null, as the rows of a matrix: a view of Arrow's buffer where no component is null."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} components in one column")
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=not flat.null_count).reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def lengths(matrix: np.ndarray) -> np.ndarray:
    """Euclidean lengths in doubles."""
    out = np.empty(len(matrix))
    for i in range(0, len(matrix), 4_096):
        part = matrix[i : i + 4_096].astype(np.float64)
        out[i : i + 4_096] = np.sqrt(np.einsum("ij,ij->i", part, part))
    return out


def directed(matrix: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
    """(rows that have a direction, their lengths)."""
    norms = lengths(matrix)
    real = np.isfinite(norms) & (norms > 0)
    return (slice(None), norms) if real.all() else (np.flatnonzero(real), norms[real])


class Gallery:
    """Corpus vectors: keys (an Arrow array), raw components and lengths."""

    def __init__(self, keys: pa.Array, matrix: np.ndarray, norms: np.ndarray) -> None:
        self.keys, self.matrix, self.norms = keys, matrix, norms

    @classmethod
    def of(cls, keys: pa.Array, lists: pa.Array) -> Gallery:
        matrix = matrix_of(lists)
        rows, norms = directed(matrix)
        whole = isinstance(rows, slice)
        return cls(keys if whole else keys.take(pa.array(rows)), matrix if whole else matrix[rows], norms)

    @cached_property
    def unit(self) -> np.ndarray:
        """Unit vectors in single precision."""
        return (self.matrix / self.norms[:, None]).astype(np.float32)

    def parts(self, questions: int) -> Iterator[Gallery]:
        """As many rows at once as PRODUCT_BYTES of similarities allow."""
        step = max(16, PRODUCT_BYTES // (4 * max(1, questions)))
        for i in range(0, len(self.norms), step):
            yield Gallery(self.keys.slice(i, step), self.matrix[i : i + step], self.norms[i : i + step])


class Questions:
    """Unit vectors of questions, with the columns that came along (an Arrow array each)."""

    def __init__(self, columns: dict[str, pa.Array], matrix: np.ndarray) -> None:
        self.columns, self.exact = columns, matrix
        self.rough = matrix.astype(np.float32)
        #: Rounding in single precision moves a cosine by less than this.
        self.slack = np.float32(1e-6 + 2.0**-22 * matrix.shape[1])

    def __len__(self) -> int:
        return len(self.exact)

    def estimates(self, gallery: Gallery, first: int = 0, last: int | None = None) -> np.ndarray:
        """(question, row): cosines in single precision, of all questions or a range of them."""
        if len(self) and self.exact.shape[1] != gallery.matrix.shape[1]:
            raise ValueError(f"questions of {self.exact.shape[1]} components meet vectors of {gallery.matrix.shape[1]}")
        return self.rough[first:last] @ gallery.unit.T

    def cosines(self, gallery: Gallery, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Cosines of pairs in doubles, rounded to 6 digits."""
        out = np.empty(len(q))
        for i in range(0, len(q), 8_192):
            own = row[i : i + 8_192]
            dots = np.einsum("ij,ij->i", self.exact[q[i : i + 8_192]], gallery.matrix[own].astype(np.float64))
            out[i : i + 8_192] = np.round(dots / gallery.norms[own], 6) + 0.0
        return out


class Kernel(Protocol):
    """What is to be found out about a block of questions."""

    def add(self, gallery: Gallery) -> None: ...

    def batch(self) -> pa.RecordBatch | None: ...


def pack(rows: DataFrame, embedding: str, block_rows: int) -> DataFrame:
    """(block, the other columns as arrays, width, single, norms, matrix): vectors that have a direction, in blocks, as they were stored."""
    others = [c for c in rows.columns if c != embedding]
    fields = [T.StructField("block", T.LongType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in others)]
    schema = T.StructType([*fields, T.StructField("width", T.IntegerType()), T.StructField("single", T.BooleanType()), T.StructField("norms", T.BinaryType()), T.StructField("matrix", T.BinaryType())])
    kinds = {c: to_arrow_type(rows.schema[c].dataType) for c in others}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []

        def block(number: int) -> pa.RecordBatch:
            columns = [pa.concat_arrays([h[0][i] for h in held]) for i in range(len(others))]
            widths = {h[1].shape[1] for h in held}
            if len(widths) > 1:
                raise ValueError(f"vectors of {min(widths)} and of {max(widths)} components in one column")
            matrix, norms = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(norms)], pa.int32()), c.cast(kinds[n])) for n, c in zip(others, columns)]
            plain = [pa.array([number], pa.int64()), *lists, pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.dtype == np.float32]), pa.array([norms.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())]
            return pa.record_batch(plain, names=["block", *others, "width", "single", "norms", "matrix"])

        size, number = 0, first
        for batch in batches:
            matrix = matrix_of(batch.column(batch.schema.get_field_index(embedding)))
            if matrix.dtype != np.float32:
                matrix = matrix.astype(np.float64)
            own, norms = directed(matrix)
            at = np.arange(len(matrix))[own]
            limit = max(1, min(block_rows, BLOCK_BYTES // max(1, 8 * matrix.shape[1])))
            while len(at):
                take = at[: limit - size]
                held.append(([batch.column(batch.schema.get_field_index(c)).take(pa.array(take)) for c in others], matrix[take], norms[: len(take)]))
                size, at, norms = size + len(take), at[len(take) :], norms[len(take) :]
                if size >= limit:
                    yield block(number)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(number)

    return map_arrow(rows, run, schema)


def _matrices(row: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The unit vectors of packed blocks, in doubles."""
    column = lambda n: row.column(row.schema.get_field_index(n)).to_pylist()
    for width, single, norms, matrix in zip(*map(column, ("width", "single", "norms", "matrix"))):
        raw = np.frombuffer(matrix, np.float32 if single else np.float64).reshape(-1, width)
        yield raw.astype(np.float64) / np.frombuffer(norms, np.float64)[:, None]


def _questions(rows: list[pa.RecordBatch], names: list[str], kinds: dict[str, pa.DataType]) -> Questions:
    columns = {c: pa.concat_arrays([pa.array([], kinds[c]), *(r.column(r.schema.get_field_index(c)).flatten().cast(kinds[c]) for r in rows)]) for c in names}
    parts = [m for r in rows for m in _matrices(r)]
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError(f"questions of {sorted({p.shape[1] for p in parts})} components")
    return Questions(columns, np.concatenate(parts) if parts else np.zeros((0, 0)))


def meet(corpus: DataFrame, questions: DataFrame, start: Callable[[Questions], Kernel], schema: T.StructType | str, *, key: str, embedding: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """What kernels find as blocks of questions meet the corpus (key, embedding); a question may be in several batches."""
    spark = corpus.sparkSession
    names = [c for c in questions.columns if c != embedding]
    kinds = {c: to_arrow_type(questions.schema[c].dataType) for c in names}
    key_kind = to_arrow_type(corpus.schema[key].dataType)
    seen = Observation()
    tiles = 4 * spark.sparkContext.defaultParallelism
    columns = max(1, math.isqrt(tiles // 4))
    rows = -(-tiles // columns)
    packed = pack(questions.filter(F.col(f"`{embedding}`").isNotNull()).repartition(rows), embedding, QUESTION_ROWS)
    blocks = materialize(packed.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("matrix") * F.when(F.col("single"), 2).otherwise(1)), F.lit(0)).alias("size")), "questions")
    scanned = corpus.select(F.col(f"`{key}`"), F.col(f"`{embedding}`")).filter(F.col(f"`{embedding}`").isNotNull())
    if seen.get["size"] <= broadcast_bytes:
        table = blocks.toArrow()
        sent = spark.sparkContext.broadcast(_questions([b for b in table.to_batches() if len(b)], names, kinds))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel = start(sent.value)
            for batch in batches:
                if len(batch) and len(sent.value):
                    for part in Gallery.of(batch.column(0).cast(key_kind), batch.column(1)).parts(len(sent.value)):
                        kernel.add(part)
            if (out := kernel.batch()) is not None:
                yield out

        return map_arrow(scanned, scan, schema)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda table: table.repartition(4 * tiles, "_row", "_column")  # noqa: E731 (a number of tasks that stays: tiles are small and dear)
    gallery = pack(scanned.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{embedding}`").alias("_vector")), "_vector", CORPUS_ROWS)
    gallery = gallery.select(F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int").alias("_column"), each(rows).alias("_row"), F.col("_key"), F.col("width").alias("_width"), F.col("single").alias("_single"), F.col("norms").alias("_norms"), F.col("matrix").alias("_matrix"))
    asked = blocks.select("block", *(F.col(f"`{c}`") for c in names), "width", "single", "norms", "matrix", F.shiftright("block", 32).cast("int").alias("_row"), each(columns).alias("_column"))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kernel, own = None, None, None
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            for i, (number, width, single, norms, matrix) in enumerate(zip(*(column(c).to_pylist() for c in ("block", "_width", "_single", "_norms", "_matrix")))):
                if number != last:  # pairs of one block of questions mostly follow each other
                    if kernel is not None and (out := kernel.batch()) is not None:
                        yield out
                    last, own = number, _questions([batch.slice(i, 1)], names, kinds)
                    kernel = start(own)
                rows = np.frombuffer(matrix, np.float32 if single else np.float64).reshape(-1, width)
                for part in Gallery(column("_key").slice(i, 1).flatten().cast(key_kind), rows, np.frombuffer(norms, np.float64)).parts(len(own)):
                    kernel.add(part)
        if kernel is not None and (out := kernel.batch()) is not None:
            yield out

    return map_arrow(dealt(asked).join(dealt(gallery).hint("merge"), ["_row", "_column"]), pairs, schema)
