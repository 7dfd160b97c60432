"""Hard-negative mining by a two-dimensional block matrix product.

Rows and anchors are dealt into blocks by label and id, and each block into chunks of `depth` dimensions. A panel (block,
chunk) of rows is sent along the blocks of anchors, a panel of anchors along the blocks of rows (as in SUMMA); where two
meet they give a partial tile of 64-bit scores. A task adds the partial tiles of its own chunks, the others are added
after a shuffle by tile. Only tiles of `ANCHORS` x `ROWS` scores are ever held, and of each the best few go on.

Two products: first anchors against rows of their own label, whose tiles give the positives; then against the rest, with
each anchor's windows of admitted scores sent along its tiles. Blocks hold labels of one bucket only, so the first product
skips the other buckets and the second one skips buckets of a single label: together they are one product. The number of
blocks follows the counts by bucket (a bounded table), so a label that a third of the rows share is many blocks.

Scores: each component x is floor(scale * x) as an integer, a score is an exact inner product. Products go through
doubles where they stay below 2**53, else through 64-bit integers; scores that could pass 63 bits raise OverflowError.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. A row is named by
id and label: rows that agree in both count once, with the smallest of their vectors; one id under several labels is
several rows, but never a positive of itself. Shorter vectors are continued with zeros. Anchors without a positive, and
positives without a negative in their window (as all with a score below 0), give no rows. Ids and labels must be
integers, else TypeError; other columns are left out. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_arrow, materialize, named

#: Rows and anchors of a tile, dimensions of a chunk, and classes of labels that blocks are made of.
ROWS, ANCHORS, DEPTH, BUCKETS = 4096, 256, 32, 64
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PANEL_SCHEMA = "side int, block int, chunk int, chunks int, bucket int, ids binary, labels binary, width int, data binary"
TILE_SCHEMA = "i int, j int, ids binary, labels binary, row_ids binary, row_labels binary, tile binary"
LEAST = np.iinfo(np.int64).min


def usable(rows: DataFrame, anchor: Column, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector, anchor): the rows that take part, one for each id and label."""
    for name in (key, label):
        if not isinstance(rows.schema[name].dataType, INTEGERS):
            raise TypeError(f"{name} must hold integers, not {rows.schema[name].dataType.simpleString()}")
    kind = rows.schema[vector].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    own = rows.select(
        named(key).cast("long").alias("id"), named(label).cast("long").alias("label"),
        (named(vector) if floats else named(vector).cast("array<double>")).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(~odd)
    return whole.groupBy("id", "label").agg(F.min("vector").alias("vector"), F.max("anchor").alias("anchor"))


class Grid:
    """How many blocks each bucket of labels has, on either side, and where they begin."""

    def __init__(self, rows: DataFrame, block_rows: int, block_anchors: int) -> None:
        found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("int")).alias("m"), (F.min("label") == F.max("label")).alias("one")).collect()
        self.of_rows, self.of_anchors, self.single = [0] * BUCKETS, [0] * BUCKETS, [False] * BUCKETS
        for r in found:
            self.of_rows[r.bucket], self.of_anchors[r.bucket], self.single[r.bucket] = -(-r.n // block_rows), -(-r.m // block_anchors), r.one
        self.first_row, self.first_anchor = ([sum(x[:b]) for b in range(BUCKETS)] for x in (self.of_rows, self.of_anchors))
        self.rows, self.anchors = sum(self.of_rows), sum(self.of_anchors)

    @staticmethod
    def at(values: list, bucket: str = "bucket") -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col(bucket) + 1)

    def block(self, side: int) -> Column:
        first, count = (self.first_anchor, self.of_anchors) if side else (self.first_row, self.of_rows)
        return (self.at(first) + F.pmod(F.xxhash64("id", "label"), F.greatest(self.at(count), F.lit(1)))).cast("int")

    def along(self, side: int, own: bool) -> Column:
        """Blocks of the other side that a panel is sent along: those of its own bucket, or all but single-labelled own ones."""
        first, count, total = (self.first_row, self.of_rows, self.rows) if side else (self.first_anchor, self.of_anchors, self.anchors)
        start, n = self.at(first), self.at(count)
        if own:
            return F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(F.array().cast("array<int>"))
        every = F.sequence(F.lit(0), F.lit(total - 1))
        return F.filter(every, lambda x: ~(self.at(self.single) & (x >= start) & (x < start + n)))


def panels(rows: DataFrame, grid: Grid, scale: int, depth: int) -> DataFrame:
    """Each block's integers in chunks of `depth` dimensions, by ascending id."""
    sides = F.array(F.struct(F.lit(0).alias("side"), grid.block(0).alias("block")), F.when(F.col("anchor"), F.struct(F.lit(1).alias("side"), grid.block(1).alias("block"))))
    dealt = rows.select("bucket", "id", "label", "vector", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("s.side", "s.block", "bucket", "id", "label", "vector")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (side, block), parts in _runs(batches, 2):
            own = pa.Table.from_batches(parts)
            ids, labels = (own.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
            numbers = whole_numbers(own.column("vector").combine_chunks(), scale)
            chunks = max(1, -(-numbers.shape[1] // depth))
            for chunk in range(chunks):
                part = numbers[:, chunk * depth : (chunk + 1) * depth]
                most = int(np.abs(part).max(initial=0))
                kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
                yield _batch(PANEL_SCHEMA, side, block, chunk, chunks, own.column("bucket")[0].as_py(), ids.tobytes(), labels.tobytes(), np.dtype(kind).itemsize, part.astype(kind).tobytes())

    return map_arrow(dealt.repartition("side", "block").sortWithinPartitions("side", "block", "id", "label"), cut, PANEL_SCHEMA)


def whole_numbers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of lists of numbers as a matrix; shorter lists go on with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("a scaled component does not fit into 62 bits")
    out = np.zeros((len(sizes), int(sizes.max(initial=0)) or 1), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray, chunks: int) -> np.ndarray:
    """a @ b.T in exact 64-bit integers, where the sum over all chunks surely fits."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound * chunks >= 1 << 63:
        raise OverflowError("a score may not fit into 64 bits")
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _runs(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows that agree in their first `width` columns, as slices; one run is held at a time."""
    last, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(width))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if held and keys[x] != last:
                yield last, held
                held = []
            last = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield last, held


def _batch(schema: str, *row) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.record_batch([pa.array([v], kinds[t]) for v, t in zip(row, types)], names=list(names))


def partial_tiles(blocks: DataFrame, grid: Grid, own: bool) -> DataFrame:
    """Products of the panels that meet, those of a task's own chunks added up."""
    left = blocks.filter("side = 1").select(F.col("block").alias("i"), F.explode(grid.along(1, own)).alias("j"), "chunk", "chunks", "ids", "labels", "width", "data")
    right = blocks.filter("side = 0").select(F.explode(grid.along(0, own)).alias("i"), F.col("block").alias("j"), "chunk", F.col("chunks").alias("row_chunks"), F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"), F.col("width").alias("row_width"), F.col("data").alias("row_data"))
    met = left.join(right, ["i", "j", "chunk"]).select("i", "j", "ids", "labels", "row_ids", "row_labels", F.greatest("chunks", "row_chunks").alias("chunks"), "width", "data", "row_width", "row_data")

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), parts in _runs(batches, 2):
            tile, names = None, None
            for part in parts:
                for r in part.to_pylist():
                    names = [r[c] for c in ("ids", "labels", "row_ids", "row_labels")]
                    a, b = (np.frombuffer(r[d], f"<i{r[w]}").reshape(len(n) // 8, -1).astype(np.int64) for d, w, n in (("data", "width", r["ids"]), ("row_data", "row_width", r["row_ids"])))
                    wide = min(a.shape[1], b.shape[1])
                    more = product(a[:, :wide], b[:, :wide], r["chunks"])
                    tile = more if tile is None else np.add(tile, more, out=tile)
            yield _batch(TILE_SCHEMA, i, j, *names, tile.tobytes())

    return map_arrow(met, multiply, TILE_SCHEMA)


class Tile:
    """Summed scores of one tile, rows by ascending id."""

    def __init__(self, parts: Iterable[dict]) -> None:
        self.scores = None
        for r in parts:
            if self.scores is None:
                self.ids, self.labels, row_ids, row_labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "row_ids", "row_labels"))
                self.scores = np.zeros((len(self.ids), len(row_ids)), np.int64)
            self.scores += np.frombuffer(r["tile"], np.int64).reshape(self.scores.shape)
        if self.scores is not None:
            order = np.lexsort((row_labels, row_ids))
            self.row_ids, self.row_labels, self.scores = row_ids[order], row_labels[order], self.scores[:, order]

    def positives(self, k: int) -> tuple[np.ndarray, ...]:
        """(anchor id, label, row id, score): the k best other rows of each anchor's label."""
        fits = (self.labels[:, None] == self.row_labels) & (self.ids[:, None] != self.row_ids)
        scores = np.where(fits, self.scores, LEAST)
        if scores.shape[1] > k:
            fits &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        a, r = np.nonzero(fits)
        order = np.lexsort((r, -scores[a, r], a))
        a, r = a[order], r[order]
        first = np.searchsorted(a, np.arange(len(self.ids)))
        keep = np.arange(len(a)) - first[a] < k
        a, r = a[keep], r[keep]
        return self.ids[a], self.labels[a], self.row_ids[r], self.scores[a, r]

    def negatives(self, windows: list[dict], k: int, low: tuple[int, int]) -> tuple[np.ndarray, ...]:
        """(anchor id, label, positive id, positive score, row id, row label, score): the k best of another label in each window."""
        place = {key: n for n, key in enumerate(zip(self.ids.tolist(), self.labels.tolist()))}
        at = np.array([place[w["anchor_id"], w["label"]] for w in windows], np.int64)
        high = np.array([w["score"] for w in windows], np.int64)
        least = np.array([-(-low[0] * w["score"] // low[1]) for w in windows], np.int64)
        bottom, top = np.full(len(self.ids), np.iinfo(np.int64).max), np.full(len(self.ids), LEAST)
        np.minimum.at(bottom, at, least)
        np.maximum.at(top, at, high)
        a, r = np.nonzero((self.scores >= bottom[:, None]) & (self.scores <= top[:, None]) & (self.labels[:, None] != self.row_labels))
        score = self.scores[a, r]
        order = np.lexsort((r, -score, a))
        a, r, score = a[order], r[order], score[order]
        first = np.searchsorted(a, np.arange(len(self.ids) + 1))
        picked, owner = [], []
        for n, (anchor, x, y) in enumerate(zip(at.tolist(), high.tolist(), least.tolist())):
            start, end = first[anchor], first[anchor + 1]
            start += np.searchsorted(-score[start:end], -x)
            end = min(end, start + k)
            own = np.arange(start, end)[score[start:end] >= y]
            picked.append(own)
            owner.append(np.full(len(own), n))
        p, n = np.concatenate([np.empty(0, np.int64), *picked]), np.concatenate([np.empty(0, np.int64), *owner])
        positive = np.array([w["positive_id"] for w in windows], np.int64)
        return self.ids[a[p]], self.labels[a[p]], positive[n], high[n], self.row_ids[r[p]], self.row_labels[r[p]], score[p]


POSITIVE_SCHEMA = "i int, anchor_id long, label long, positive_id long, score long"
NEGATIVE_SCHEMA = "anchor_id long, label long, positive_id long, positive_score long, negative_id long, negative_label long, negative_score long"


def _columns(schema: str, values: Iterable[np.ndarray]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.record_batch([pa.array(v, kinds[t]) for v, t in zip(values, types)], names=list(names))


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), scale: int = 256, depth: int = DEPTH, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, label, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    A window goes from low[0] / low[1] of the positive's score to that score, both included."""
    kept = usable(rows, anchor, key, label, vector)
    kept = materialize(kept.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")), "rows")
    grid = Grid(kept, block_rows, block_anchors)
    if not grid.anchors:
        return _result(kept.sparkSession.createDataFrame([], NEGATIVE_SCHEMA + ", rank int"))
    blocks = materialize(panels(kept, grid, scale, depth), "panels")

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, _), parts in _runs(batches, 2):
            found = Tile(r for p in parts for r in p.to_pylist()).positives(positives)
            yield _columns(POSITIVE_SCHEMA, (np.full(len(found[0]), i), *found))

    tiles = partial_tiles(blocks, grid, True).repartition("i", "j").sortWithinPartitions("i", "j")
    found = _first(map_arrow(tiles, best, POSITIVE_SCHEMA), ["anchor_id", "label"], [F.desc("score"), "positive_id"], positives)
    known = materialize(found.filter("score >= 0"), "positives")

    window = F.struct("anchor_id", "label", "positive_id", "score")
    asked = known.groupBy("i").agg(F.collect_list(window).alias("windows"))  # of one block of anchors
    asked = asked.select("i", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))).alias("j"), "windows")
    tiles = partial_tiles(blocks, grid, False)
    met = tiles.withColumn("windows", F.lit(None).cast(asked.schema["windows"].dataType)).unionByName(asked, allowMissingColumns=True)

    def mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, 2):
            windows: list[dict] = []

            def own(parts=parts, windows=windows) -> Iterator[dict]:
                for r in (r for p in parts for r in p.to_pylist()):
                    if r["windows"] is not None:
                        windows.extend(r["windows"])
                    else:
                        yield r

            tile = Tile(own())
            if windows and tile.scores is not None:
                yield _columns(NEGATIVE_SCHEMA, tile.negatives(windows, negatives, low))

    rows_found = map_arrow(met.repartition("i", "j").sortWithinPartitions("i", "j"), mine, NEGATIVE_SCHEMA)
    return _result(_first(rows_found, ["anchor_id", "label", "positive_id"], [F.desc("negative_score"), "negative_id", "negative_label"], negatives))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("anchor_id", "label", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
