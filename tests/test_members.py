"""Sets too large for a broadcast: edges are compared by filters first, and results stay those of a plain search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import members, profile
from tessera.operators.graph import Graph


@pytest.fixture(scope="module")
def drawn(spark):
    draw = np.random.default_rng(9)
    pairs = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 40, (120, 2))] + [("n1", "n1"), ("n1", None), (None, "n2"), ("n3", "n4"), ("n3", "n4")]
    nodes = spark.range(30).select(F.concat(F.lit("n"), "id").alias("id"))
    return pairs, Graph(nodes, spark.createDataFrame([(a, b, "p") for a, b in pairs], "subject string, object string, predicate string"))


def ends(df):
    return sorted(((r.subject, r.object) for r in df.collect()), key=str)


def test_sieve_WHEN_asked_SHOULD_miss_no_member_and_let_few_others_through(spark):
    made = members.sieve(spark.range(2_000).select(F.col("id").cast("string").alias("id")))
    asked = spark.range(4_000).select(F.col("id").cast("string").alias("x")).unionByName(spark.createDataFrame([(None,)], "x string"))
    told = {r.x: r.may for r in members.may_be_in(asked, {"x": made}, {"x": "may"}).collect()}
    assert len(told) == 4_001 and all(told[str(i)] for i in range(2_000)) and not told[None] and sum(told[str(i)] for i in range(2_000, 4_000)) < 20


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("size", [5, 28])
def test_edges_of_sets_WHEN_large_or_small_SHOULD_be_those_of_a_plain_search(drawn, monkeypatch, few, size):
    pairs, graph = drawn
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 500_000 if few else 3)
    ids, own = graph.nodes.orderBy(F.length("id"), "id").limit(size), {f"n{i}" for i in range(size)}
    assert ends(graph.induced_edges(ids)) == sorted((p for p in pairs if p[0] in own and p[1] in own), key=str)
    assert ends(graph.incident_edges(ids)) == sorted((p for p in pairs if p[0] in own or p[1] in own), key=str)
    assert ends(graph.dangling()) == sorted((p for p in pairs if not all(x is not None and int(x[1:]) < 30 for x in p)), key=str)


def test_edges_WHEN_few_ids_are_strange_SHOULD_not_be_exchanged_whole(drawn, monkeypatch):
    _, graph = drawn
    spread = Graph(graph.nodes, graph.edges.repartition(3))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 20)  # 28 members, a dozen strangers
    assert "strategy=merge" not in plan(spread.induced_edges(graph.nodes.limit(28))) and "strategy=merge" not in plan(spread.dangling())


def test_edges_WHEN_set_is_large_but_under_half_SHOULD_not_be_exchanged_whole(drawn, monkeypatch):
    _, graph = drawn
    spread = Graph(graph.nodes, graph.edges.repartition(3))
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 8)
    assert "strategy=merge" not in spread.induced_edges(graph.nodes.limit(10))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [500_000, 6, 2])
def test_edges_around_seeds_WHEN_any_number_is_broadcast_SHOULD_be_those_within_their_expansion(drawn, monkeypatch, most):
    pairs, graph = drawn
    own = {f"n{i}" for i in range(5)}
    around = own | {x for p in pairs if own & set(p) for x in p} - {None}
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", most)
    seeds = graph.nodes.orderBy(F.length("id"), "id").limit(5)
    assert ends(graph.induced_around(seeds.union(seeds))) == sorted((p for p in pairs if p[0] in around and p[1] in around), key=str)


def test_expansion_WHEN_set_is_small_SHOULD_be_broadcast_whatever_sparks_threshold(drawn, spark):
    _, graph = drawn
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.expand(graph.nodes.limit(3).select(F.lit(0).alias("key"), "id"))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_subset_WHEN_one_is_wanted_SHOULD_be_that_of_all(spark):
    from tessera.plans.queries import derived_graph

    graph = derived_graph(spark, "/root/testdata/sf0.001")
    every = profile.subset_sets(graph, "SUPP", ["7"]).filter("key = 'all_h1'").select("id")
    assert {r.id for r in profile.all_h1(graph, "SUPP").collect()} == {r.id for r in every.collect()}
