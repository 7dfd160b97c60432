"""SimHash near-dedup with deletion-variant signatures.

A text's fingerprint has bit k set if more than half of its shingle hashes have it. Two fingerprints are linked at
`distance` or fewer differing bits. The 64 bits are cut into as few segments as leave one segment with at most one
differing bit (three for distance 4). Every segment yields, for each of its positions, the segment with that bit
deleted: two segments that differ in one bit at most share such a variant. Fingerprints meet in an equality grouping
of the 64 variants and are verified on all bits.

Equal fingerprints are one row before any of this, so copies cost nothing. Inside a variant's group the search does
not emit pairs but a spanning forest: a verified link is reported only where it joins two trees, at most one edge for
each member. Groups stream through in sorted order; a large one is first cut by equal blocks of its other bits, of which
any near pair shares one. A task contracts its links to stars, a bounded number at a time. Components come from those by
star contraction.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other. Null ids
stay; a component's id is its smallest non-null id. Repeated rows and ids stay row by row. No rows give no rows. Ids must
be integers, else TypeError; other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunked, extended, keyed, map_arrow, materialize, named, only_keys, private, split_irregular
from tessera.llm.components import connected_components, star_blocks

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Members of one variant's group whose pairs are compared by shifting instead of by search.
SMALL_GROUP = 48
#: Members from which a group is cut again before its pairs are compared.
LARGE_GROUP = 2_048
#: Edges in a batch.
BLOCK = 200_000


def shingles(text: bytes | None, k: int = SHINGLE_WORDS) -> list[bytes]:
    """Every run of k words (repeats included); the whole sequence if it is shorter; words end at ASCII white space."""
    words = text.lower().split() if text else []
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    own = shingles(text, k)
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunked(batches):
            own = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(own)], names=["id", "fp"])

    return map_arrow(keyed(docs, key, text), run, "id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one has at most one of `distance` differing bits."""
    count = distance // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: Column, distance: int) -> Column:
    """One number for each bit position: the position, and its segment's bits without it."""
    out = []
    for first, width in segments(distance):
        for bit in range(width):
            part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("long"))
            out.append(part.bitwiseOR(F.lit((first + bit) << 48).cast("long")) if width <= 48 else F.hash(F.lit(first + bit), part).cast("long"))
    return F.array(*out)


def _forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what lies within `distance` into trees: breadth first, each member found once."""
    rest = members.view(np.uint64)
    edges: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                edges.extend((int(at.view(np.int64)), int(x)) for x in found.view(np.int64))
                queue.extend(found)
                rest = rest[~near]
    return edges


def _parts(members: np.ndarray, position: int, distance: int) -> Iterator[np.ndarray]:
    """Groups that agree in one of distance + 1 blocks of the bits outside the variant's segment; all near pairs share one."""
    first, width = next(((a, w) for a, w in segments(distance) if a <= position < a + w), (0, 64))
    rest = [i for i in range(64) if not first <= i < first + width]
    for k in range(distance + 1):
        mask = sum(1 << i for i in rest[k * len(rest) // (distance + 1) : (k + 1) * len(rest) // (distance + 1)])
        block = members.view(np.uint64) & np.uint64(mask)
        order = np.argsort(block, kind="stable")
        yield from (x for x in np.split(members[order], np.flatnonzero(np.diff(block[order])) + 1) if len(x) > 1)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within `distance`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last group, which may go on, in pieces

        def edges() -> tuple[np.ndarray, np.ndarray]:
            return _edges_of(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]), distance)

        for batch in batches:
            key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or held and held[-1][0][-1] != key[-1]:
                held.append((key[:cut], fp[:cut]))
                yield edges()
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield edges()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in star_blocks(found(batches)):
            for i in range(0, len(a), BLOCK):
                yield pa.record_batch([a[i : i + BLOCK], b[i : i + BLOCK]], schema=EDGES)

    keyed = fps.select(F.explode(variants(F.col("fp"), distance)).alias("key"), "fp")
    return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), search, "a long, b long")


def _edges_of(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal keys; key is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    a, b = [], []
    large = sizes > SMALL_GROUP
    for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
        for own in _parts(fp[start : start + size], int(key[start]) >> 48, distance) if size > LARGE_GROUP else (fp[start : start + size],):
            for x, y in _forest(own, distance):
                a.append(x)
                b.append(y)
    found_a, found_b = [np.array(a, np.int64)], [np.array(b, np.int64)]
    row_size = np.repeat(np.where(large, 0, sizes), sizes)
    for shift in range(1, int(row_size.max(initial=0))):
        left = np.flatnonzero(row_size[:-shift] > shift)
        left = left[key[left] == key[left + shift]]
        near = np.bitwise_count((fp[left] ^ fp[left + shift]).view(np.uint64)) <= distance
        found_a.append(fp[left[near]])
        found_b.append(fp[left[near] + shift])
    return np.concatenate(found_a), np.concatenate(found_b)


def simhash_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: id, fp, root (the component's smallest fingerprint), component_id (its smallest id)."""
    rows = materialize(fingerprints(docs, key=key, text=text, k=k), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(links(fps, distance))
    joined = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = materialize(joined, "classes")
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(classes.join(lows, "root").select("fp", "root", "component_id"), "fp").select("id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component, the one whose id is the component's; all columns stay.

    Where that id is null or several rows share it, one of them stays."""
    rows = materialize(simhash_components(docs, key=key, text=text, **options), "components").withColumnRenamed("id", key)
    first = named(key).eqNullSafe(F.col("component_id"))
    alone, others = split_irregular(docs, rows, key)
    out = only_keys(alone, rows.filter(first & named(key).isNotNull()).select(named(key)).distinct(), key)
    if others is None:
        return out
    fp_name = private(others, "_fp")
    at, k = others.columns.index(text), options.get("k", SHINGLE_WORDS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, k) for t in batch.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, fp_name])

    marked = map_arrow(others, mark, extended(others, others.columns, f"`{fp_name}` long"))
    key_name, own_name, root_name = (private(marked, x) for x in ("_key", "_own", "_root"))
    roots = rows.filter(first).select(named(key).alias(key_name), F.col("fp").alias(own_name), F.col("root").alias(root_name)).distinct()
    marked = marked.join(roots, named(key).eqNullSafe(named(key_name)) & (named(fp_name) == named(own_name)))
    return out.unionByName(marked.dropDuplicates([root_name]).select(*map(named, docs.columns)))
