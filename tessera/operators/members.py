"""Which rows may have an id of a large set: a filter of fixed size, made and asked by built-in functions.

An id is a bit by its hash; rows whose bit is unset are surely not of the set, so only the others need be exchanged and
compared. 2^27 bits are 16 MB in 2,048 rows, which is what a broadcast carries, whatever the set's size; more ids let more
rows through, which costs work but no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import materialize

#: Words of 64 bits in a row of the filter, and rows.
WORDS, ROWS = 1_024, 2_048


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(64 * WORDS * ROWS))


def sieve(ids: DataFrame) -> DataFrame:
    """(row, words): the filter of the set (one column, nulls left out), written out."""
    own = ids.toDF("id").filter("id IS NOT NULL").select(_bit(F.col("id")).alias("bit"))
    set_ = own.groupBy(F.expr("bit DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    every = ids.sparkSession.range(WORDS * ROWS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy((F.expr(f"word DIV {WORDS}")).cast("int").alias("row")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return materialize(rows.select("row", F.transform("all", lambda w: w["bits"]).alias("words")), "sieve")


def may_be_in(rows: DataFrame, filters: dict[str, DataFrame], flags: dict[str, str]) -> DataFrame:
    """rows with a boolean flags[c] for each column c: whether its value may be in the set of filters[c]; false for null."""
    columns = rows.columns
    for i, (c, made) in enumerate(filters.items()):
        rows = rows.withColumn("_bit", _bit(F.col(f"`{c}`"))).withColumn("_row", F.expr(f"CAST(_bit DIV {64 * WORDS} AS INT)"))
        rows = rows.join(F.broadcast(made.withColumnRenamed("row", "_row")), "_row")
        held = F.getbit(F.get("words", F.expr(f"CAST((_bit DIV 64) % {WORDS} AS INT)")), F.expr("CAST(_bit % 64 AS INT)")) == 1
        rows = rows.select(*(F.col(f"`{x}`") for x in columns), (F.col(f"`{c}`").isNotNull() & held).alias(flags[c]))
        columns = [*columns, flags[c]]
    return rows
