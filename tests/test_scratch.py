from __future__ import annotations

import threading

import pytest

from tessera.sources import scratch
from tessera.sources.scratch import clear_scratch, counted, drop, materialize, qualified, scope, shared_folder


def test_materialize_WHEN_read_SHOULD_have_no_lineage_and_keep_types(spark):
    df = spark.createDataFrame([(1, None, [1.0])], "a int, b string, c array<float>")
    again = materialize(df, "t")
    assert again.schema == df.schema and again.collect() == df.collect()
    assert "FileScan parquet" in again._jdf.queryExecution().executedPlan().toString()


def test_scratch_WHEN_cleared_SHOULD_be_empty(spark):
    kept = materialize(spark.range(3), "t")
    assert kept.count() == 3 and all(f.startswith(shared_folder(spark)) or f.removeprefix("file://").startswith(shared_folder(spark).removeprefix("file:")) for f in kept.inputFiles())
    clear_scratch(spark)
    spark.catalog.clearCache()
    assert not materialize(spark.range(1), "u").isEmpty()


def test_scope_WHEN_left_SHOULD_keep_only_what_was_asked_for(spark):
    with scope(spark) as keep:
        gone = materialize(spark.range(3), "a")
        kept, n = counted(spark.range(5), "b")
        keep(kept)
    assert n == 5 and kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(gone._scratch).count()
    drop(kept)
    drop(spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(kept._scratch).count()


def test_folder_WHEN_read_SHOULD_have_a_scheme(spark):
    assert shared_folder(spark).startswith("file:///") and qualified(spark, "/a/b") == "file:///a/b"


def test_scopes_WHEN_two_threads_have_one_open_SHOULD_keep_each_others_tables(spark):
    opened, closed, seen = threading.Barrier(2), threading.Event(), []

    def one():
        with scratch.scope(spark):
            mine = scratch.materialize(spark.range(3), "one")
            opened.wait(60)
            closed.wait(60)
            seen.append(mine.count())

    def two():
        with scratch.scope(spark):
            scratch.materialize(spark.range(2), "two")
            opened.wait(60)
        closed.set()

    threads = [threading.Thread(target=f) for f in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert seen == [3] and scratch._scopes.get() == ()
