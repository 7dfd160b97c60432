"""Exact cosine retrieval over stored vectors, and embedding of texts.

Questions and corpus meet as blocks of matrices (see blocks). A task estimates a block's cosines in single precision, drops what
surely lies below a question's k-th best so far, and computes the rest in doubles; only its k best go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.expressions import cosine, with_row
from tessera.operators.blocks import BROADCAST_BYTES, CACHED_BYTES, Gallery, Questions, matrix_of, meet
from tessera.operators.profile import ranked
from tessera.sources.scratch import materialize
from tessera.sources.shipping import map_arrow, ship_package

#: Predicate descriptions at most: they are one row that every question meets.
DESCRIPTIONS = 10_000
#: Model names whose embedding is the first token's vector (fixed values, matched in any case).
CLS_MODELS = ("sapbert", "pubmedbert", "medcpt")


def top_k(corpus: DataFrame, vector: Sequence[float], k: int, *, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to a vector, with sim; ties go to the smaller key. A vector without a direction, asked or stored, is near to nothing."""
    question = F.array(*[F.lit(float(x)) for x in vector])
    scored = corpus.withColumn("sim", F.round(cosine(embedding, question), 6)).filter("sim IS NOT NULL AND NOT isnan(sim)")
    return scored.orderBy(F.desc("sim"), key).limit(k)


def batched_top_k(corpus: DataFrame, questions: DataFrame, k: int, *, key: str = "id", question: str = "question_id", embedding: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(question, key, sim, rank): the k nearest rows of each question (question, embedding); sim rounded to 6 digits, ties to the smaller key.

    Every row is one of its own: questions of one id have k rows each, and rows of one key are ranked each. Questions and
    rows without a direction (see blocks) have no rows. The two columns must have different names."""
    if question == key:
        raise ValueError(f"questions and corpus are both named by {key}: rename one of them")
    asked = questions.select(F.col(f"`{question}`").alias("_name"), F.col(f"`{embedding}`").alias(embedding), F.monotonically_increasing_id().alias("_q"))
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField(question, questions.schema[question].dataType), T.StructField(key, corpus.schema[key].dataType), T.StructField("sim", T.DoubleType())])

    kind = to_arrow_type(corpus.schema[key].dataType)

    def start(block: Questions) -> Best:
        return Best(block, k, question, key, kind)

    best = meet(corpus, asked, start, schema, key=key, embedding=embedding, broadcast_bytes=broadcast_bytes)
    return ranked(best, ["_q"], [F.desc("sim"), F.col(f"`{key}`")], k).drop("_q")


def true_places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of booleans of which few are true: eight are looked at together."""
    flat = flags.ravel()
    whole = len(flat) - len(flat) % 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at = np.concatenate(((some[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))))
    return at[flat[at]]


class Best:
    """The k rows of highest similarity of each question; of equal ones those of smaller key (a null key is the smallest).

    Only similarities are compared as rows are added: `top` has each question's k best, and what reaches the least of them
    is held with its key. Keys are compared where ties leave more than k rows, and not before they are many."""

    def __init__(self, block: Questions, k: int, question: str, key: str, kind: pa.DataType) -> None:
        self.block, self.k, self.names, self.kind = block, k, (question, key), kind
        self.top = np.full((len(block), k), -np.inf)
        self.least = np.full(len(block), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size, self.settled = 0, True

    def add(self, gallery: Gallery) -> None:
        q, row = self._near(gallery)
        if not len(q):
            return
        sims = self.block.cosines(gallery, q, row)
        near = sims >= self.least[q]
        q, row, sims = q[near], row[near], sims[near]
        if not len(q):
            return
        self._raise(q, sims)
        near = sims >= self.least[q]
        self.held.append((q[near], sims[near], gallery.keys.take(pa.array(row[near]))))
        self.size, self.settled = self.size + int(near.sum()), False
        if self.size > 4 * self.k * len(self.block):
            self._drop()
            if self.size > 2 * self.k * len(self.block):
                self._settle()

    def _near(self, gallery: Gallery) -> tuple[np.ndarray, np.ndarray]:
        """(questions in order, rows) of pairs that may be among the k best: by estimates, a few questions at a time."""
        slack, width = self.block.slack, len(gallery.norms)
        least, found = (self.least - slack).astype(np.float32), [np.empty(0, np.int64)]
        step = max(1, CACHED_BYTES // (4 * max(1, width)))
        for i in range(0, len(self.block), step):
            rough, own = self.block.estimates(gallery, i, i + step), least[i : i + step, None]
            fits = rough >= own
            if width > self.k and np.count_nonzero(fits) > 4 * self.k * len(rough):
                fits = rough >= np.maximum(own, np.partition(rough, width - self.k, axis=1)[:, width - self.k, None] - 2 * slack)
            found.append(true_places(fits) + i * width)
        return np.divmod(np.concatenate(found), max(1, width))

    def _raise(self, q: np.ndarray, sims: np.ndarray) -> None:
        """Similarities of questions, in the order of q, go among the k best."""
        order = np.lexsort((-sims, q))
        own, first, places = np.unique(q, return_index=True, return_inverse=True)
        place = np.arange(len(q)) - first[places]
        width = min(self.k, int(place.max()) + 1)
        added = np.full((len(own), width), -np.inf)
        added[places[place < width], place[place < width]] = sims[order][place < width]
        best = np.partition(np.concatenate((self.top[own], added), axis=1), width, axis=1)[:, width:]
        self.top[own], self.least[own] = best, best.min(axis=1)

    def _drop(self) -> None:
        """What no longer reaches its question's k-th best goes."""
        q, sims = np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held])
        near = np.flatnonzero(sims >= self.least[q])
        keys = pa.concat_arrays([h[2] for h in self.held])
        self.held, self.size = [(q[near], sims[near], keys.take(pa.array(near)))], len(near)

    def _settle(self) -> None:
        """Ties are decided by key, so that no question has more than k rows; they are in order."""
        if self.settled:
            return
        self._drop()
        q, sims, keys = self.held[0]
        ranks = pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((ranks, -sims, q))
        kept = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        self.held, self.size, self.settled = [(q[kept], sims[kept], keys.take(pa.array(kept)))], len(kept), True

    @property
    def q(self) -> np.ndarray:
        self._settle()
        return self.held[0][0] if self.held else np.empty(0, np.int64)

    @property
    def keys(self) -> list:
        self._settle()
        return self.held[0][2].to_pylist() if self.held else []

    def batch(self) -> pa.RecordBatch | None:
        self._settle()
        if not self.size:
            return None
        q, sims, keys = self.held[0]
        at, names = pa.array(q), self.block.columns
        return pa.record_batch([names["_q"].take(at), names["_name"].take(at), keys.cast(self.kind), pa.array(sims)], names=["_q", self.names[0], self.names[1], "sim"])


def rank_of_target(corpus: DataFrame, questions: DataFrame, *, key: str = "id", question: str = "question_id", target: str = "target", embedding: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(question, target, rank): 1 + rows strictly nearer to the question than its target. Questions carry embedding and target.

    Each task only counts the rows above each question's own target; nothing is sorted. Every row of questions is one of
    its own; of several rows of the target's key the nearest one counts. Questions whose target is not in the corpus, or
    where one of the two has no direction, are left out."""
    asked = materialize(questions.select(F.col(f"`{question}`").alias("_name"), F.col(f"`{target}`").alias("_target"), F.col(f"`{embedding}`").alias("_vector"), F.monotonically_increasing_id().alias("_q")), "asked")
    goals = corpus.select(F.col(f"`{key}`").alias("_target"), F.col(f"`{embedding}`").alias("_row")).filter("_row IS NOT NULL")

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, rows = matrix_of(batch.column(1)).astype(np.float64), matrix_of(batch.column(2)).astype(np.float64)
            if len(batch) and wanted.shape[1] != rows.shape[1]:
                raise ValueError(f"questions of {wanted.shape[1]} components meet vectors of {rows.shape[1]}")
            norms = np.linalg.norm(wanted, axis=1) * np.linalg.norm(rows, axis=1)
            real = np.flatnonzero(np.isfinite(norms) & (norms > 0))
            goal = np.round(((wanted[real] / np.linalg.norm(wanted[real], axis=1)[:, None]) * rows[real]).sum(axis=1) / np.linalg.norm(rows[real], axis=1), 6) + 0.0
            yield pa.record_batch([batch.column(0).take(pa.array(real)), pa.array(goal)], names=["_q", "_goal"])

    met = asked.filter("_vector IS NOT NULL").join(goals, "_target").select("_q", "_vector", "_row")
    goal = map_arrow(met, nearness, "_q long, _goal double").groupBy("_q").agg(F.max("_goal").alias("_goal"))
    wanted = materialize(asked.join(goal, "_q"), "wanted")
    counts = meet(corpus, wanted.select("_q", "_goal", F.col("_vector").alias(embedding)), Above, "_q long, above long", key=key, embedding=embedding, broadcast_bytes=broadcast_bytes)
    ranks = counts.groupBy("_q").agg((F.sum("above") + 1).alias("rank"))
    return wanted.select("_q", F.col("_name").alias(question), F.col("_target").alias(target)).join(ranks, "_q").drop("_q")


class Above:
    """How many rows are strictly nearer to each question than its goal."""

    def __init__(self, block: Questions) -> None:
        self.block, self.goal = block, block.columns["_goal"].to_numpy()
        self.above = np.zeros(len(block), np.int64)

    def add(self, gallery: Gallery) -> None:
        rough, slack = self.block.estimates(gallery), self.block.slack
        high, low = (self.goal + 2 * slack).astype(np.float32)[:, None], (self.goal - 2 * slack).astype(np.float32)[:, None]
        sure = rough > high
        self.above += sure.sum(axis=1)
        q, row = np.nonzero((rough >= low) & ~sure)
        np.add.at(self.above, q, self.block.cosines(gallery, q, row) > self.goal[q])

    def batch(self) -> pa.RecordBatch | None:
        return pa.record_batch([self.block.columns["_q"], pa.array(self.above)], names=["_q", "above"]) if len(self.block) else None


def classify(questions: DataFrame, descriptions: DataFrame, *, question: str = "question_id", embedding: str = "embedding") -> DataFrame:
    """(question, predicate, score) for every predicate description (predicate, position, embedding).

    The descriptions, DESCRIPTIONS at most, are one row; more are an error."""
    listed = descriptions.select(F.struct("predicate", "position", F.col(embedding).alias("vector")).alias("d")).limit(DESCRIPTIONS + 1)
    row = listed.agg(F.collect_list("d").alias("_known"))
    row = row.select(F.when(F.size("_known") > DESCRIPTIONS, F.raise_error(F.lit(f"more than {DESCRIPTIONS} predicate descriptions"))).otherwise(F.col("_known")).alias("_known"))
    met = with_row(questions.select(question, F.col(embedding).alias("_q")), row).select(question, "_q", F.explode("_known").alias("_d"))
    return met.select(question, "_d.predicate", "_d.position", F.round(cosine("_q", F.col("_d.vector")), 6).alias("score"))


def within_margin(scores: DataFrame, margin: float, *, question: str = "question_id") -> DataFrame:
    """scores no further than margin below the question's best, the bound included, with predicate_rank."""
    best = F.max("score").over(Window.partitionBy(question))  # scores are dear: they are computed once
    near = scores.filter(F.col(question).isNotNull()).withColumn("_best", best).filter(F.col("score") >= F.col("_best") - F.lit(float(margin))).drop("_best")
    return ranked(near, [question], [F.desc("score"), F.col("position")], 1 << 30).withColumnRenamed("rank", "predicate_rank")


class Embedder(Protocol):
    """Texts to vectors; made once in each Python worker."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """A deterministic stand-in for a sentence model: signed counts of character n-grams in `dim` hashed places."""

    def __init__(self, dim: int = 256, n: int = 3) -> None:
        self.dim, self.n = dim, n

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            padded = f" {text.lower()} "
            for j in range(max(1, len(padded) - self.n + 1)):
                h = int.from_bytes(hashlib.blake2b(padded[j : j + self.n].encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out


def needs_cls(model: str) -> bool:
    """Whether a model's own pooling is to be replaced by the first token's vector."""
    return any(name in model.lower() for name in CLS_MODELS)


def transformer(model: str, device: str | None = None) -> Embedder:
    """A sentence-transformers model; the library is imported only here."""
    from sentence_transformers import SentenceTransformer, models

    if needs_cls(model):
        inner = models.Transformer(model)
        return SentenceTransformer(modules=[inner, models.Pooling(inner.get_word_embedding_dimension(), pooling_mode="cls")], device=device)
    return SentenceTransformer(model, device=device)


def embed_corpus(docs: DataFrame, make: Callable[[], Embedder], *, text: str = "text", batch: int = 128, max_rows: int | None = None, order: Sequence[str] = (), dimension: int | None = None) -> DataFrame:
    """docs with embedding array<float>: batches stream through, no corpus is held; docs with null or empty text are left out.

    With max_rows the first rows by `order`. All vectors must have `dimension` numbers, or without it those of a task the same."""
    docs = docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    if max_rows is not None:
        docs = docs.orderBy(*order).limit(max_rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, width = make(), dimension
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                found = np.asarray(model.encode(part[text].tolist()), np.float32)
                width = width or found.shape[1]
                if found.shape[1] != width:
                    raise ValueError(f"a vector of {found.shape[1]} numbers, expected {width}")
                yield part.assign(embedding=list(found))

    ship_package(docs.sparkSession)
    return docs.mapInPandas(run, f"{schema}, embedding array<float>")
