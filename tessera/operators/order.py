"""Exact order statistics and samples of groups of any size, by counts: no task holds a group, no row a list of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import materialize

#: Rows of a sample that a sort takes at once, and of the range of hashes that is still sorted beyond it.
SORTED_ROWS = 10_000
#: Hexadecimal digits by which the range of hashes is narrowed.
DIGITS = 4


def percentile(p: float) -> Callable[[Column], Column]:
    """The position of an interpolated percentile among n sorted values, from 0."""
    return lambda n: F.lit(float(p)) * (n - 1)


def upper_median(n: Column) -> Column:
    """Position n // 2."""
    return F.floor(n / 2).cast("double")


def order_statistics(values: DataFrame, by: Sequence[str], column: str, positions: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """(by, i, value): for each group and positions[i] the value at that place of the sorted non-null numbers.

    Between two places values are interpolated. Values are counted first, then dealt by range of (group, value); a
    partition's sums over those before it give each value's places, and every value picks the statistics it takes part in."""
    n, own = F.col("_n"), [F.col(c) for c in by]
    counts = values.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    dealt = materialize(counts.repartitionByRange(*own, F.col("_value")).withColumn("_part", F.spark_partition_id()), "counts")
    parts = dealt.groupBy(*by, "_part").agg(F.sum(n).alias("_in_part"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    keys = [(c, f"_key{i}") for i, c in enumerate(by)]
    sums = [F.coalesce(F.sum("_in_part").over(before), F.lit(0)).alias("_before"), F.sum("_in_part").over(Window.partitionBy(*own)).alias("_total")]
    parts = parts.select(*(F.col(c).alias(k) for c, k in keys), F.col("_part").alias("_own_part"), *sums)
    same = F.col("_part") == F.col("_own_part")
    for c, k in keys:
        same &= F.col(c).eqNullSafe(F.col(k))
    placed = dealt.join(parts, same)
    end = F.col("_before") + F.sum(n).over(Window.partitionBy("_part", *own).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.select(*by, "_value", "_total", (end - n).alias("_first"), end.alias("_end"))
    wanted = []
    for i, position in enumerate(positions):
        at = position(F.col("_total"))
        share = at - F.floor(at)
        wanted += [F.struct(F.lit(i).alias("i"), F.floor(at).alias("place"), (1.0 - share).alias("share")), F.struct(F.lit(i).alias("i"), F.ceil(at).alias("place"), share.alias("share"))]
    picked = placed.select(*by, "_value", F.explode(F.filter(F.array(*wanted), lambda w: (w["place"] >= F.col("_first")) & (w["place"] < F.col("_end")) & (w["share"] > 0))).alias("_w"))
    return picked.groupBy(*by, F.col("_w.i").alias("i")).agg(F.sum(F.col("_value") * F.col("_w.share")).alias("value"))


def hash_sample(table: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by the order of md5(key || seed), then key: the same rows whatever the partitions.

    Of more than SORTED_ROWS rows the last one's place is sought by counting hashes by their first digits, narrower and
    narrower, and what lies before it is filtered; only the last few rows are sorted. Rows of a null key come first."""
    hashed = table.withColumn("_h", F.coalesce(F.md5(F.concat(F.col(key), F.lit(seed))), F.lit(" " * 32)))
    if n <= SORTED_ROWS:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    start, left = "", n  # what is below start is in, and `left` rows of what begins with it
    for width in range(DIGITS, 33, DIGITS):
        inside = hashed.filter(F.startswith("_h", F.lit(start)))
        counts = sorted(tuple(r) for r in inside.groupBy(F.substring("_h", 1, width)).count().collect())  # 16 ** DIGITS at most, and nulls
        if sum(size for _, size in counts) <= left:
            return table
        for start, size in counts:  # noqa: B007
            if size > left:
                break
            left -= size
        if size <= SORTED_ROWS:
            break
    last = hashed.filter(F.startswith("_h", F.lit(start))).orderBy("_h", key).limit(left)
    return hashed.filter(F.substring("_h", 1, len(start)) < start).unionByName(last).drop("_h")
