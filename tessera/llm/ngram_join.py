"""Jaccard join over word n-grams by set relations.

A document's set holds its distinct n-grams; two documents link when their sets' Jaccard similarity reaches a threshold.

1. Sets. Documents become sorted n-gram hashes in the shared folder; equal sets (128-bit digests) are one set from here on.
2. Repeated n-grams. How many sets an n-gram is in is counted by packed 32-bit keys, and n-grams of several sets go
   into bounded filters, one for each order of magnitude. A set links only if that share of its n-grams is repeated; the
   others are done. All levels are functions of the n-gram, so they order n-grams alike everywhere, rare ones first; the
   filters decide cost, never results.
3. Meeting places. Linked sets share an n-gram of their prefixes. N-grams that occur together need only one meeting
   place: each is named after the least min-hash of the sets that have it in their prefix, and a set goes once to each
   name of its prefix. A place of more than a cell's sets or n-grams is cut into blocks that meet in pairs.
4. A cell indexes its sets' prefixes. Lists are in order of size, in blocks that carry their largest size and first
   position: a block whose positions leave no room for the overlap needed is skipped whole. A probe's overlaps with all
   candidates, with some slack, are its computed answers. A set that differs from an answered one by less than that
   slack gets its answers from those: |S & X| <= |R & X| + |S - R|, so only X near enough to R are looked at again. Of
   links only those that join two trees are sent on, fewer than there are sets; components follow by star contraction.

Overlaps are those of 64-bit hashes of n-grams; the sizes returned count the n-grams themselves.

Defined results: null and empty texts have the empty set, which links with nothing, not even with itself. Texts of fewer
words than n are one n-gram. Rows are documents of their own, also when ids repeat; a component's id is its smallest
non-null id. Ids must be integers, else TypeError; other columns are left out. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunked, keyed, map_arrow, materialize, only_keys
from tessera.llm.components import connected_components
from tessera.llm.simhash import shingles
from tessera.llm.substring_dedup import HitFilter, _collect_filter, _grouped, _rows, bucket_of
from tessera.sources.scratch import drop

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 80
#: Sets and n-grams of a block; entries of an index block; a probe's slack is its size over SLACK. An answer that a derived
#: set needs has at least (threshold / 100 - 1 / SLACK) of the probe's size, from which the slack of index prefixes follows.
SETS, TOKENS, ENTRIES, SLACK = 1024, 1 << 21, 32, 10
#: N-grams of a chunk whose keys are packed together, and input n-grams for each bucket of keys.
CHUNK_TOKENS, BUCKET_TOKENS = 1 << 20, 4 << 20
#: Bytes of n-grams whose levels are looked up at once.
FILTERED_BYTES = 2 << 20
#: Numbers of sets from which an n-gram is of the next level, and bits of each level's filter at most.
LEVELS = (2, 16, 128, 1024)
FILTER_BITS = 1 << 29
MIXER = np.uint64(0xD6E8FEB86659FD93)

SET_SCHEMA = "id long, n long, high long, low long, tokens binary"
KEY_SCHEMA = "bucket int, keys binary, more binary, counts binary"
HIT_SCHEMA = "bucket int, keys binary, level int"
ACTIVE_SCHEMA = "node long, n int, least long, tokens binary, prefix array<long>"


def needed(a, b, threshold: int = THRESHOLD):
    """The least overlap of sets of a and b members that link."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(n, threshold: int, slack=0):
    """Members of which one is shared with any linking set, whose overlap may fall `slack` short."""
    return np.minimum(n, n - np.maximum(-(-threshold * n // 100) - slack, 1) + 1)


def token_sets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, high, low, tokens): the number of n-grams, a digest of the set, and its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunked(batches):
            rows = []
            for k, value in zip(keys, texts):
                own = set(shingles(value, words))
                tokens = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()
                rows.append({"id": k, "n": len(own), "high": digest[0], "low": digest[1], "tokens": tokens.tobytes()})
            yield from _rows(rows, SET_SCHEMA)

    return map_arrow(keyed(docs, key, text), run, SET_SCHEMA)


def _packed_keys(tokens: np.ndarray, buckets: int) -> Iterator[dict]:
    """32 bits of each distinct hash by bucket, and how often the repeated ones occur."""
    packed = (bucket_of(tokens, buckets).astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))
    key, counts = np.unique(packed, return_counts=True)
    cuts = np.searchsorted(key >> np.uint64(32), np.arange(buckets + 1))
    for b in range(buckets):
        own, n = key[cuts[b] : cuts[b + 1]].astype(np.uint32), counts[cuts[b] : cuts[b + 1]]
        if len(own):
            yield {"bucket": b, "keys": own[n == 1].tobytes(), "more": own[n > 1].tobytes(), "counts": n[n > 1].astype(np.int32).tobytes()}


def _repeated(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """(level, keys) of one bucket's keys that are in several sets."""
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    single, more = join("keys", np.uint32), join("more", np.uint32)
    keys = np.concatenate((single, more))
    times = np.concatenate((np.ones(len(single), np.int64), join("counts", np.int32)))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(times, first) if len(first) else first
    for level, least in enumerate(LEVELS):
        yield level, keys[first][total >= least]


def repetition_filters(sets: DataFrame, buckets: int, parts: int, most_bits: int) -> list[HitFilter]:
    """For each of LEVELS a filter that admits the n-grams of at least so many sets (and few others)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[np.ndarray]:
            held, size = [], 0
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    held.append(np.frombuffer(value, np.uint64))
                    size += len(held[-1])
                    if size >= CHUNK_TOKENS:
                        yield np.concatenate(held)
                        held, size = [], 0
            if held:
                yield np.concatenate(held)

        yield from _rows((row for tokens in chunks() for row in _packed_keys(tokens, buckets)), KEY_SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(({"bucket": b, "keys": keys.tobytes(), "level": level} for b, rows in _grouped(batches) for level, keys in _repeated(rows) if len(keys)), HIT_SCHEMA)

    keys = map_arrow(sets.select("tokens"), pack, KEY_SCHEMA).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    hits = materialize(map_arrow(keys, count, HIT_SCHEMA), "repeated")
    filters = [_collect_filter(hits.filter(F.col("level") == level).select("bucket", "keys"), buckets, most_bits) for level in range(len(LEVELS))]
    drop(hits)
    return filters


def levels_of(tokens: np.ndarray, filters: list[HitFilter]) -> np.ndarray:
    level = np.zeros(len(tokens), np.int8)
    left = np.arange(len(tokens))
    for f in filters:
        left = left[f.admits(tokens[left])]
        level[left] += 1
    return level


def active_sets(sets: DataFrame, filters, threshold: int) -> DataFrame:
    """The sets that may link: (node, n, least min-hash, n-grams rare ones first, repeated n-grams of the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, values in chunked(batches, FILTERED_BYTES):
            size = np.array([len(v) // 8 for v in values], np.int64)
            every = np.frombuffer(b"".join(values), np.uint64)
            levels = levels_of(every, filters.value)
            ends = np.cumsum(size)
            repeats = np.diff(np.concatenate(([0], np.cumsum(levels > 0)))[np.concatenate(([0], ends))])
            out = []
            for i in np.flatnonzero((size > 0) & (100 * repeats >= threshold * size)).tolist():
                n, single = int(size[i]), int(size[i] - repeats[i])
                tokens, level = every[ends[i] - n : ends[i]], levels[ends[i] - n : ends[i]]
                order = np.lexsort((tokens, level))
                mixed = (tokens ^ (tokens >> np.uint64(31))) * MIXER
                prefix = tokens[order[single : int(prefix_length(n, threshold))]]
                out.append({"node": nodes[i], "n": n, "least": int(mixed.min()) >> 1, "tokens": tokens[order].tobytes(), "prefix": prefix.view(np.int64).tolist()})
            if out:
                kinds = [("node", pa.int64()), ("n", pa.int32()), ("least", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return map_arrow(sets.select("node", "tokens"), run, ACTIVE_SCHEMA)


class Cell:
    """Sets that meet, by size, with an index of their prefixes."""

    def __init__(self, nodes: list[int], tokens: list[np.ndarray], threshold: int = THRESHOLD) -> None:
        order = sorted(range(len(nodes)), key=lambda i: (len(tokens[i]), nodes[i]))
        self.threshold = threshold
        self.nodes = np.array([nodes[i] for i in order], np.int64)
        self.sizes = np.array([len(tokens[i]) for i in order], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        _, local, counts = np.unique(np.concatenate([tokens[i] for i in order]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(order)), self.sizes)
        self.tokens = local[np.lexsort((local, counts[local], owner))]  # rare ones of the cell first
        place = np.arange(len(local)) - self.starts[owner]
        kept = (place < prefix_length(self.sizes, threshold, 100 * self.sizes // (SLACK * threshold - 100) + 1)[owner]) & (counts[self.tokens] > 1)
        by_list = np.lexsort((owner[kept], self.tokens[kept]))
        self.entry_set, self.entry_place, token = owner[kept][by_list], place[kept][by_list], self.tokens[kept][by_list]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
        length = np.diff(np.concatenate((first, [len(token)])))
        blocks = -(-length // ENTRIES)
        self.list_of = np.full(len(counts) + 1, -1)
        self.list_of[token[first]] = np.arange(len(first))
        self.list_blocks = np.concatenate(([0], np.cumsum(blocks)))
        inner = np.arange(blocks.sum()) - np.repeat(self.list_blocks[:-1], blocks)
        self.block_start = np.repeat(first, blocks) + inner * ENTRIES
        self.block_end = np.minimum(self.block_start + ENTRIES, np.repeat(first + length, blocks))
        if len(token):
            self.block_place = np.minimum.reduceat(self.entry_place, self.block_start)
            self.block_small, self.block_large = self.sizes[self.entry_set[self.block_start]], self.sizes[self.entry_set[self.block_end - 1]]
        self.mark = np.zeros(len(counts), np.int64)
        self.root = np.arange(len(nodes))
        self.probed = self.derived = self.skipped = 0

    def overlaps(self, s: int, others: np.ndarray) -> np.ndarray:
        """|S & X| for each X of others."""
        self.mark[self.tokens[self.starts[s] : self.starts[s + 1]]] = 1
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[others] - ends + sizes, sizes) + np.arange(ends[-1])
        found = np.add.reduceat(self.mark[self.tokens[at]], ends - sizes)
        self.mark[self.tokens[self.starts[s] : self.starts[s + 1]]] = 0
        return found

    def candidates(self, s: int) -> np.ndarray:
        """Other sets whose overlap with S may come within its slack of what links."""
        n = int(self.sizes[s])
        slack = n // SLACK
        own = self.tokens[self.starts[s] : self.starts[s] + int(prefix_length(n, self.threshold, slack))]
        lists = self.list_of[own]
        place = np.flatnonzero(lists >= 0)
        lists = lists[place]
        first, count = self.list_blocks[lists], self.list_blocks[lists + 1] - self.list_blocks[lists]
        if not count.sum():
            return np.empty(0, np.int64)
        ends = np.cumsum(count)
        block = np.repeat(first - ends + count, count) + np.arange(ends[-1])
        mine = np.repeat(place, count)
        room = np.minimum(n - mine, self.block_large[block] - self.block_place[block])
        fits = room >= needed(n, self.block_small[block], self.threshold) - slack
        self.skipped += int((~fits).sum())
        block, mine = block[fits], mine[fits]
        count = self.block_end[block] - self.block_start[block]
        ends = np.cumsum(count)
        at = np.repeat(self.block_start[block] - ends + count, count) + np.arange(count.sum())
        mine, found = np.repeat(mine, count), self.entry_set[at]
        room = np.minimum(n - mine, self.sizes[found] - self.entry_place[at])
        found = np.unique(found[room >= needed(n, self.sizes[found], self.threshold) - slack])
        return found[found != s]

    def links(self) -> list[tuple[int, int]]:
        """Edges between nodes that join all linked sets into trees."""
        edges: list[tuple[int, int]] = []
        answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        home = np.full(len(self.nodes), -1)
        difference = np.zeros(len(self.nodes), np.int64)
        for s in range(len(self.nodes) - 1, -1, -1):
            n = int(self.sizes[s])
            if home[s] >= 0:  # from a similar set's answers
                self.derived += 1
                r = int(home[s])
                known, overlap = answers[r]
                known = known[(overlap + difference[s] >= needed(n, self.sizes[known], self.threshold)) & (self.root[known] != self.root[s])]
                if not len(known):
                    continue
                overlap = self.overlaps(s, known)
            else:
                self.probed += 1
                known = self.candidates(s)
                if not len(known):
                    continue
                overlap = self.overlaps(s, known)
                sizes = self.sizes[known]
                apart = sizes - overlap  # members of X that S lacks; a smaller X also needs less to link
                reach = apart + -(-self.threshold * np.maximum(n - sizes, 0) // 100) + 1
                near = (reach <= n // SLACK) & (home[known] < 0) & (known < s)
                if near.any():
                    close = overlap >= needed(n, sizes, self.threshold) - n // SLACK
                    answers[s] = (np.append(known[close], s), np.append(overlap[close], n))
                    home[known[near]], difference[known[near]] = s, apart[near]
            for x in known[overlap >= needed(n, self.sizes[known], self.threshold)].tolist():
                if self.root[x] != self.root[s]:
                    edges.append((int(self.nodes[s]), int(self.nodes[x])))
                    self.root[self.root == self.root[x]] = self.root[s]
        return edges


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and n-grams of each run of equal (label, i, j)."""
    last, nodes, tokens = None, [], []
    for batch in batches:
        for *cell, node, value in zip(*(c.to_pylist() for c in batch.columns)):
            if nodes and cell != last:
                yield nodes, tokens
                nodes, tokens = [], []
            last = cell
            nodes.append(node)
            tokens.append(np.frombuffer(value, np.uint64))
    if nodes:
        yield nodes, tokens


def links(active: DataFrame, *, threshold: int = THRESHOLD, cell_sets: int = SETS, cell_tokens: int = TOKENS) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of all linked pairs."""
    entries = active.select("node", "n", "least", F.explode("prefix").alias("token"))
    labels = entries.groupBy("token").agg(F.min("least").alias("label"), F.count("*").alias("sets")).filter("sets > 1")
    places = materialize(entries.join(labels, "token").select("label", "node", "n").distinct(), "places")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(cell_sets)), F.ceil(F.sum("n") / F.lit(cell_tokens)))
    sizes = places.groupBy("label").agg(F.count("*").alias("sets"), blocks.cast("int").alias("blocks")).filter("sets > 1")
    sizes = sizes.select("label", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine")))
    dealt = places.join(sizes, "label").withColumn("mine", mine).select("label", "node", "mine", F.explode(others).alias("other"))
    dealt = dealt.select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    met = dealt.join(active.select("node", "tokens"), "node").select("label", "i", "j", "node", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for nodes, tokens in _cells(batches):
            edges += Cell(nodes, tokens, threshold).links()
            if len(edges) >= 50_000:
                yield _edges(edges)
                edges = []
        yield _edges(edges)

    return map_arrow(met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j"), run, "a long, b long")


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def ngram_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, cell_sets: int = SETS, cell_tokens: int = TOKENS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: id, n_ngrams, component_id."""
    spark = docs.sparkSession
    whole = materialize(token_sets(docs, key=key, text=text, words=words).withColumn("serial", F.monotonically_increasing_id()), "sets")
    rows = materialize(whole.drop("tokens"), "rows")
    full = rows.filter("n > 0")
    classes = materialize(full.groupBy("high", "low").agg(F.min("serial").alias("node"), F.min("id").alias("least_id")), "classes")
    copies = full.select("high", "low", "serial").join(classes.select("high", "low", "node"), ["high", "low"]).filter("serial <> node").select("serial")
    sets = only_keys(whole.filter("n > 0").select("serial", "tokens"), materialize(copies, "copies"), "serial", "left_anti").withColumnRenamed("serial", "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = full.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * parts, total // BUCKET_TOKENS)
    filters = repetition_filters(sets, buckets, parts, filter_bits)
    active = materialize(active_sets(sets, spark.sparkContext.broadcast(filters), threshold), "active")
    drop(whole)  # what goes on is a small part of it
    roots = connected_components(links(active, threshold=threshold, cell_sets=cell_sets, cell_tokens=cell_tokens)).withColumnRenamed("root", "tree")
    joined = classes.join(roots, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    known = materialize(joined, "trees")
    lows = known.groupBy("tree").agg(F.min("least_id").alias("component_id"))
    named_sets = known.join(lows, "tree").select("high", "low", "component_id")
    linked = full.select("id", "n", "high", "low").join(named_sets, ["high", "low"]).select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", F.col("n").alias("n_ngrams"), "component_id")
