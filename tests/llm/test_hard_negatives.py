from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.hard_negatives import hard_negatives, product, whole_numbers



def brute(rows):
    """Every anchor against every row, in Python integers."""
    kept = {}
    for key, label, vector in rows:
        if key is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            kept[key, label] = min(kept.get((key, label), vector), vector)
    whole = {k: [int(np.floor(256 * float(x))) for x in v] for k, v in kept.items()}
    out = []
    for (a, label), own in whole.items():
        if a % 100:
            continue
        scored = [(k, m, sum(x * y for x, y in zip(own, v))) for (k, m), v in whole.items()]
        positives = sorted(((-s, k) for k, m, s in scored if m == label and k != a))[:5]
        for low, p in positives:
            fits = sorted((-s, k) for k, m, s in scored if m != label and 80 * -low <= 100 * s <= 100 * -low)[:5]
            out += [(a, p, r, k, -low, -s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, label int, embedding array<float>, score int").repartition(3)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, hard_negatives(table, F.col("vec_id") % 100 == 0, **options).select(*columns).collect()))


def table(seed, n, width=10, labels=4):
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal(width)
    vectors = np.round(centre + 0.8 * draw.standard_normal((n, width)), 2).astype(np.float32)
    return [(i * 20, int(draw.integers(labels)), [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("options", [{}, {"depth": 3, "block_rows": 16, "block_anchors": 4}])
def test_negatives_WHEN_compared_SHOULD_equal_brute_force(spark, options):
    rows = table(1, 240)
    got = found(spark, rows, **options)
    assert got == brute(rows) and len(got) > 300


def test_negatives_WHEN_a_label_is_hot_or_scores_tie_SHOULD_be_whole(spark):
    rows = [(k, 0 if i % 3 else m, v if i % 4 else [1.0, 0.5] + [0.0] * 8) for i, (k, m, v) in enumerate(table(2, 200))]
    got = found(spark, rows, block_rows=20, block_anchors=5)
    assert got == brute(rows) and len(got) > 100


def test_rows_WHEN_odd_SHOULD_take_no_part_or_count_once(spark):
    rows = table(3, 120)
    rows += [(None, 1, [1.0] * 10), (2001, None, [1.0] * 10), (2003, 1, None), (2005, 1, [None] + [1.0] * 9), (2007, 1, [float("nan")] * 10), (2009, 1, [float("inf")] * 10), rows[3], (100, 3, rows[5][2]), (300, rows[15][1], [5.0] * 10)]
    assert found(spark, rows, block_rows=16) == brute(rows)
    assert found(spark, rows[:0]) == [] and found(spark, [(101, 1, [1.0]), (102, 1, [1.0])]) == [] and found(spark, [(100, 1, [1.0])]) == []


def test_vectors_WHEN_short_or_empty_SHOULD_go_on_with_zeros(spark):
    rows = [(100, 1, [1.0, 2.0, 3.0]), (1, 1, [1.0]), (2, 2, [1.0, 0.0]), (3, 2, []), (4, 1, [])]
    assert found(spark, rows, depth=2) == brute(rows)
    with pytest.raises(TypeError, match="integers"):
        hard_negatives(spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<float>"), F.lit(True))


def test_product_WHEN_large_SHOULD_be_exact_or_raise():
    a = np.array([[2**31 - 1, 3]], np.int64)
    assert product(a, a, 1).tolist() == [[(2**31 - 1) ** 2 + 9]] and product(a % 1000, a % 1000, 1).tolist() == [[int(a[0, 0]) % 1000 * (int(a[0, 0]) % 1000) + 9]]
    with pytest.raises(OverflowError):
        product(a * 4, a, 1)
    assert whole_numbers(pa.array([[0.999, -0.001], []]), 256).tolist() == [[255, -1], [0, 0]]
