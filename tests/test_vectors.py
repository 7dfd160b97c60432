"""Blocks of vectors against plain numpy."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.operators.blocks import Gallery, Questions, matrix_of

DRAW = np.random.default_rng(3)
CORPUS = [(f"k{i % 90:02d}", DRAW.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)] + [("zero", [0.0] * 8), ("none", None), ("null", [1.0, None] + [0.0] * 6), ("nan", [float("nan")] * 8), (None, [1.0] * 8)]
ASKED = [(i % 20, f"k{i:02d}", DRAW.integers(-3, 4, 8).astype(float).tolist()) for i in range(40)] + [(50, "k01", [0.0] * 8), (51, "k02", None), (52, "nowhere", [1.0] * 8), (53, "zero", [1.0] * 8), (54, None, [1.0] * 8)]


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(CORPUS, "id string, embedding array<float>").withColumn("question_id", F.lit(1)).repartition(3)
    return corpus, spark.createDataFrame(ASKED, "question_id int, target string, embedding array<double>").withColumn("id", F.lit("x")).repartition(2)


def cosine(a, b):
    if a is None or b is None or None in b or not np.isfinite(b).all() or not any(a) or not any(b):
        return None
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("partitions", [1, 7])
def test_top_k_WHEN_ids_repeat_SHOULD_be_that_of_each_row(tables, broadcast, partitions):
    corpus, asked = tables
    got = sorted((r.question_id, r["rank"], r.id or "", r.sim) for r in vectors.batched_top_k(corpus.repartition(partitions), asked, 5, broadcast_bytes=broadcast).collect())
    want = []
    for q, _, vector in ASKED:
        near = sorted((-s, k or "") for k, v in CORPUS if (s := cosine(vector, v)) is not None)[:5]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(near, 1)]
    assert got == sorted(want) and len({q for q, *_ in got}) == 23


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_rank_WHEN_keys_repeat_SHOULD_be_that_of_the_nearest(tables, broadcast):
    corpus, asked = tables
    got = sorted((r.question_id, r.target, r["rank"]) for r in vectors.rank_of_target(corpus, asked, broadcast_bytes=broadcast).collect())
    want = []
    for q, target, vector in ASKED:
        sims = [(k, s) for k, v in CORPUS if (s := cosine(vector, v)) is not None]
        if own := [s for k, s in sims if k == target and k is not None]:
            want.append((q, target, 1 + sum(s > max(own) for _, s in sims)))
    assert got == sorted(want)


def test_questions_WHEN_zero_SHOULD_find_nothing_either_way(tables):
    corpus, asked = tables
    assert vectors.top_k(corpus, [0.0] * 8, 3).count() == vectors.batched_top_k(corpus, asked.filter("question_id = 50"), 3).count() == 0
    assert vectors.batched_top_k(corpus, asked.limit(0), 3).columns == ["question_id", "id", "sim", "rank"] and vectors.batched_top_k(corpus.limit(0), asked, 3).count() == 0


def test_columns_WHEN_named_alike_or_ragged_SHOULD_say_so(spark, tables):
    corpus, asked = tables
    with pytest.raises(ValueError, match="rename"):
        vectors.batched_top_k(corpus, asked, 3, question="id")
    with pytest.raises(Exception, match="components"):
        vectors.batched_top_k(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<float>").coalesce(1), asked, 3).collect()
    with pytest.raises(Exception, match="components"):
        vectors.batched_top_k(spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"), asked, 3).collect()


def test_plan_WHEN_questions_grow_SHOULD_stay_the_same(tables):
    corpus, asked = tables
    plan = lambda df: vectors.batched_top_k(corpus, df, 3, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(asked) == plan(asked.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300))))) == 2


def test_lists_WHEN_viewed_SHOULD_copy_nothing():
    flat = pa.array(np.arange(5_000 * 768, dtype=np.float32))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(5_001, dtype=np.int32) * 768), flat)
    began = time.perf_counter()
    matrix = matrix_of(lists)
    assert time.perf_counter() - began < 0.1 and np.shares_memory(matrix, flat.to_numpy()) and matrix_of(lists.slice(7, 3))[0, 0] == 7 * 768


def test_product_WHEN_pruned_SHOULD_cost_little_more_than_the_product():
    draw = np.random.default_rng(1)
    wanted, rows = draw.standard_normal((180, 768)), draw.standard_normal((40_000, 768)).astype(np.float32)
    block = Questions({"_q": pa.array(range(180)), "_name": pa.array(range(180))}, wanted / np.linalg.norm(wanted, axis=1)[:, None])
    gallery = Gallery(pa.array(np.arange(40_000)), rows, np.linalg.norm(rows.astype(np.float64), axis=1))
    best, began = vectors.Best(block, 20, "q", "k", pa.int64()), time.process_time()
    for part in gallery.parts(180):
        best.add(part)
    spent, began = time.process_time() - began, time.process_time()
    exact = np.round(block.exact @ (rows / gallery.norms[:, None]).T, 6)
    plain = time.process_time() - began
    assert spent < 4 * plain + 1
    for q in range(180):
        assert set(np.lexsort((np.arange(40_000), -exact[q]))[:20]) == {best.keys[i] for i in np.flatnonzero(best.q == q)}


def test_blocks_WHEN_many_SHOULD_be_sent_to_a_row_of_tiles_only(spark, tables, monkeypatch):
    from tessera.operators import blocks

    corpus, asked = tables
    met, real = [], blocks.map_arrow
    monkeypatch.setattr(blocks, "map_arrow", lambda df, *rest: (met.append(df), real(df, *rest))[1])
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        vectors.batched_top_k(corpus, asked, 3, broadcast_bytes=0)
        copies = met[-1].select("block", "_row", "_column").distinct().groupBy("block").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert copies <= 3  # the side of a square of 8 tiles, for 4 cores


def test_tiles_WHEN_small_SHOULD_stay_tasks_of_their_own(tables, monkeypatch):
    from tessera.operators import blocks

    corpus, asked = tables
    met, real = [], blocks.map_arrow
    monkeypatch.setattr(blocks, "map_arrow", lambda df, *rest: (met.append(df), real(df, *rest))[1])
    vectors.batched_top_k(corpus, asked, 3, broadcast_bytes=0)
    used = {r[0] for r in met[-1].select("block", F.spark_partition_id().alias("p")).select("p").distinct().collect()}
    assert len(used) > 4  # cores; Spark would put small partitions together


def test_best_WHEN_rows_are_tied_SHOULD_hold_a_bounded_number_and_the_smallest_keys():
    block = Questions({"_q": pa.array([0, 1]), "_name": pa.array([0, 1])}, np.eye(4)[:2])
    rows = np.tile(np.array([[1.0, 1.0, 0.0, 0.0]], np.float32), (3_000, 1))
    keys = pa.array([None if i == 2_999 else f"k{(i * 7) % 2_999:04d}" for i in range(3_000)])
    best = vectors.Best(block, 3, "q", "k", pa.string())
    for i in range(0, 3_000, 50):
        best.add(Gallery(keys.slice(i, 50), rows[i : i + 50], np.full(50, np.sqrt(2.0))))
        assert sum(len(h[0]) for h in best.held) <= 4 * 3 * 2 + 100
    out = best.batch().to_pydict()
    assert [out["k"][i] for i in range(6)] == [None, "k0000", "k0001"] * 2 and out["sim"] == [0.707107] * 6
