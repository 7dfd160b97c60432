"""Ranked lexical search by Fagin's threshold algorithm.

1. Documents are read once. Each becomes a row of a forward index in the shared folder: its number of terms, and which
   terms of the items it holds how often. Numbers of documents, terms and documents with a term are counted over it.
2. The forward index is dealt into shards of bounded size. A task sorts a shard's entries of each term by impact and
   then, item by item, reads the lists of its terms round-robin from the top. Each new document is scored in full by a
   look-up in the forward index. The sum of the impacts last read bounds what is still unseen: once that threshold is
   strictly below the k-th score so far (of all shards of the task), the item is done there; equal scores are read on.
3. The k best rows of each item and task meet and are ranked.

Items come to the executors in blocks of at most `block_bytes` of text, each with its own pass; a block's counts by term
are all that the driver gets. Nothing depends on how documents are dealt: weights are global, ranks have a total order.

A term is a maximal run of ASCII letters and digits and characters beyond ASCII, only A-Z lower-cased. With N documents
that have terms, L terms in all and n in a document, m = 50 + (50 n N div L), a term in df documents weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), and its tf occurrences give w * (10**9 tf div (1000 tf + 20 m)).

Defined results: null and empty texts have no terms and are never found; items without a term of weight above 0 have no
rows. Rows that agree in item id and text are one item; other rows are items of their own, also of one id. Rows of one
document id are documents of their own; a null id counts as the smallest. Document ids must be integers, else TypeError;
item ids may have any type. Other columns are left out. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import chunked, keyed, map_arrow, materialize, named

K = 50
#: Text bytes of the items that are broadcast together; entries of a shard; entries that a list is read at a time.
BLOCK_BYTES, SHARD_ENTRIES, STEP = 8 << 20, 1 << 21, 32
NULL_ID = -(1 << 63)
FORWARD_SCHEMA = "id long, n long, terms binary, counts binary"
FOUND_SCHEMA = "item int, id long, score long"
#: Letters A-Z in lower case, letters, digits and bytes beyond ASCII as they are, all else a space.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_TERMS).split() if text else []


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(row)
        size += len(row[1].encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts): each document's number of terms, and its terms out of `number` (int32, ascending) with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for keys, texts in chunked(batches):
            sizes, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                own = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                own, times = np.unique(own[own >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(own.tobytes())
                counts.append(times.astype(np.int32).tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "counts"])

    return map_arrow(docs, run, FORWARD_SCHEMA)


def document_counts(forward: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        used = np.flatnonzero(held)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in map_arrow(forward.select("terms"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


class Best:
    """The k best (score, id) so far: higher scores, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= max(self.least, 1)
        if fits.any():
            scores, ids = np.concatenate((self.scores, scores[fits])), np.concatenate((self.ids, ids[fits]))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


class Shard:
    """Some documents' forward index and, for each term, their entries by impact."""

    def __init__(self, rows: list[tuple], n_terms: int, documents: int, words: int) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        parts = [np.frombuffer(r[2], np.int32) for r in rows]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.terms = np.concatenate(parts)
        tf = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]).astype(np.int64)
        m = np.array([50 + 50 * r[1] * documents // words for r in rows], np.int64)
        self.doc = np.repeat(np.arange(len(rows)), sizes)
        self.impact = 10**9 * tf // (1000 * tf + 20 * m[self.doc])
        order = np.lexsort((-self.impact, self.terms))
        self.list_docs, self.list_impacts = self.doc[order], self.impact[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(rows), bool)
        self.looked_up = 0

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Full scores of documents, each of which has entries, from the forward index."""
        self.looked_up += len(docs)
        first, sizes = self.starts[docs], self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])
        return np.add.reduceat(weight[self.terms[at]] * self.impact[at], ends - sizes)

    def search(self, item: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Add the shard's best documents for an item's terms; weight is 0 for all other terms."""
        starts, ends = self.lists[item], self.lists[item + 1]
        own = ends > starts
        starts, ends, weights = starts[own], ends[own], weight[item[own]]
        depth, step, read = 0, STEP, []
        while len(starts):
            spans = [np.arange(a + depth, min(a + depth + step, b)) for a, b in zip(starts.tolist(), ends.tolist())]
            docs = np.unique(self.list_docs[np.concatenate(spans)])
            docs = docs[~self.seen[docs]]
            if len(docs):
                self.seen[docs] = True
                read.append(docs)
                best.add(self.scores(docs, weight), self.ids[docs])
            depth += step
            left = starts + depth < ends
            starts, ends, weights = starts[left], ends[left], weights[left]
            if int((weights * self.list_impacts[starts + depth - 1]).sum()) < best.least:
                break
            step *= 2
        for docs in read:
            self.seen[docs] = False


def _shards(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    held, entries = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            entries += len(row[2]) // 4
            if entries >= limit:
                yield held
                held, entries = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(item id, rank, doc id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    documents = keyed(docs, key, text)
    asked = items.select(named(item_key).alias("item_id"), named(item_text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", asked.schema["item_id"].dataType)])
    parts = []
    for block in _item_blocks(asked, block_bytes):
        words = [sorted(set(terms_of(row.text.encode()))) for row in block]
        number = {t: n for n, t in enumerate(sorted(set().union(*words)))}
        if not number:
            continue
        found = _search_block(documents, [[number[t] for t in own] for own in words], number, k, shard_entries)
        names = spark.createDataFrame([(n, row.item_id) for n, row in enumerate(block)], kind)
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"))
    if not parts:
        parts = [spark.createDataFrame([], kind).select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score"))]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"item_id": item_key, "id": key})


def _search_block(documents: DataFrame, items: list[list[int]], number: dict[bytes, int], k: int, shard_entries: int) -> DataFrame:
    """(item, rank, id, score) of the items of one block."""
    forward = materialize(forward_index(documents, number), "forward")
    n_docs, n_words = forward.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(forward, len(number))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = forward.sparkSession.sparkContext.broadcast((weights, [np.array([t for t in own if weights[t] > 0], np.int32) for own in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = sent.value
        found = [Best(k) for _ in items]
        weight = np.zeros(len(weights), np.int64)
        for rows in _shards(batches, shard_entries):
            shard = Shard(rows, len(weights), n_docs, n_words)
            for item, best in zip(items, found):
                weight[item] = weights[item]
                shard.search(item, weight, best)
                weight[item] = 0
        for n, best in enumerate(found):
            if len(best.ids):
                yield pa.record_batch([pa.array(np.full(len(best.ids), n, np.int32)), pa.array(best.ids), pa.array(best.scores)], names=["item", "id", "score"])

    rows = forward.filter(F.octet_length("terms") > 0).select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "n", "terms", "counts")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = map_arrow(rows, run, FOUND_SCHEMA).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NULL_ID, F.col("id")).alias("id"), "score")
