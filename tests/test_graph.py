"""A graph of a few nodes, whose answers can be counted by hand."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl, cut, profile, vectors
from tessera.operators.graph import Graph
from tessera.plans.queries import queries
from tessera.sources import readers
from tessera.sources.readers import PredicateCut, RelevanceCut

DATA = "/root/testdata/sf0.001"

NODES = "id string, category string, name string, deprecated string, in_taxon_label string, description string, synonym string"
EDGES = "subject string, object string, predicate string"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        ("D:1", "Disease", "first disease", None, None, "text", None), ("D:2", "Disease", "second disease", None, None, None, None),
        ("D:3", "Disease", "third disease", None, None, None, None), ("D:8", "Disease", "edgeless", None, None, None, None),
        ("D:9", "Disease", "old disease", "True", None, None, None), ("X:1", "Phenotype", "pain", None, None, None, None),
        ("X:2", "Phenotype", "fever", None, None, None, None), ("G:1", "Gene", "gene", None, "Mus musculus", None, None), ("loop", "Odd", None, None, None, None, None),
    ]
    edges = [
        ("D:1", "X:1", "has"), ("D:1", "X:2", "has"), ("D:1", "X:9", "has"), ("G:1", "D:1", "causes"), ("D:1", "D:2", "subclass"), ("D:3", "D:1", "subclass"),
        ("D:2", "X:1", "has"), ("loop", "loop", "self"), ("D:3", "X:1", "twice"), ("D:3", "X:1", "twice"), ("D:2", "X:2", None),
    ]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def traverse(graph, anchor, predicate):
    asked = graph.nodes.sparkSession.createDataFrame([(anchor, predicate)], "anchor string, predicate string")
    return rows(graph.traverse(asked).select("other_id", "name", "dir"))


def test_traverse_WHEN_out_SHOULD_keep_missing_neighbour(graph):
    assert traverse(graph, "D:1", "has") == [("X:1", "pain", "out"), ("X:2", "fever", "out"), ("X:9", None, "out")]


def test_traverse_WHEN_in_SHOULD_say_so(graph):
    assert traverse(graph, "D:1", "causes") == [("G:1", "gene", "in")]


def test_traverse_WHEN_both_directions_SHOULD_find_both(graph):
    assert traverse(graph, "D:1", "subclass") == [("D:2", "second disease", "out"), ("D:3", "third disease", "in")]


def test_traverse_WHEN_no_such_predicate_SHOULD_be_empty(graph):
    assert traverse(graph, "D:1", "none") == []


def test_traverse_WHEN_parallel_or_loop_SHOULD_repeat_and_be_out(graph):
    assert traverse(graph, "D:3", "twice") == [("X:1", "pain", "out")] * 2
    assert traverse(graph, "loop", "self") == [("loop", None, "out")]


def test_edge_count_WHEN_either_side_SHOULD_count_loop_once_and_keep_zero(graph, spark):
    asked = spark.createDataFrame([("D:1", "has"), ("D:1", "subclass"), ("loop", "self"), ("D:8", "has"), ("X:1", "twice")], "id string, predicate string")
    assert rows(graph.edge_count_of(asked)) == [("D:1", 5), ("D:8", 0), ("X:1", 2), ("loop", 1)]


def test_degree_WHEN_loop_SHOULD_add_two(graph):
    degree = dict(rows(graph.degree()))
    assert degree["loop"] == 2 and degree["D:1"] == 6 and degree["X:1"] == 4


def test_seeds_WHEN_deprecated_SHOULD_skip(graph):
    assert rows(graph.seeds("D", ["disease", "first"])) == [("disease", "D:1"), ("disease", "D:2"), ("disease", "D:3"), ("first", "D:1")]
    assert rows(graph.seeds("D", [])) == []


def test_counts_WHEN_both_ends_inside_SHOULD_count_once(graph, spark):
    sets = spark.createDataFrame([("a", "D:1"), ("a", "D:2"), ("a", "X:1"), ("b", "D:8"), ("c", "loop")], "key string, id string")
    counts = {r.key: (r.incident, r.induced) for r in graph.edge_counts(sets).collect()}
    ids = lambda key: sets.filter(f"key = '{key}'").select("id")
    assert counts == {"a": (10, 3), "b": (0, 0), "c": (1, 1)}
    for key, (incident, induced) in counts.items():
        assert graph.incident_edges(ids(key)).count() == incident and graph.induced_edges(ids(key)).count() == induced


def test_counts_WHEN_sets_are_many_SHOULD_join_the_edges_twice(spark):
    draw = np.random.default_rng(8)
    pairs = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 60, (400, 2))]
    own = Graph(spark.range(60).select(F.concat(F.lit("n"), "id").alias("id")), spark.createDataFrame([(a, b, "p") for a, b in pairs], "subject string, object string, predicate string"))
    members = {k: {f"n{i}" for i in draw.integers(0, 60, draw.integers(1, 30))} for k in range(300)}
    sets = spark.createDataFrame([(k, i) for k, ids in members.items() for i in ids], "key long, id string").repartition(3)
    counts = own.edge_counts(sets)
    assert {r.key: (r.incident, r.induced) for r in counts.collect()} == {k: (sum(a in ids or b in ids for a, b in pairs), sum(a in ids and b in ids for a, b in pairs)) for k, ids in members.items()}


def test_expand_WHEN_isolated_SHOULD_stay_only_if_kept(graph, spark):
    sets = spark.createDataFrame([(0, "D:8"), (0, "G:1")], "key int, id string")
    assert rows(graph.expand(sets).select("id")) == [("D:1",), ("D:8",), ("G:1",)]
    assert rows(graph.expand(sets, keep=False).select("id")) == [("D:1",), ("G:1",)]


def test_closure_WHEN_saturated_SHOULD_repeat_last_row(graph):
    hops = [tuple(r)[:4] for r in graph.closure(graph.nodes.filter("id = 'G:1'")).orderBy("hop").collect()]
    assert hops == [(1, 2, 2, 1), (2, 7, 5, 10), (3, 7, 0, 10)]


def test_closure_WHEN_no_seed_SHOULD_stop_at_hop_one(graph):
    assert [tuple(r)[:4] for r in graph.closure(graph.nodes.filter("false")).collect()] == [(1, 0, 0, 0)]


def test_closure_WHEN_hops_run_out_SHOULD_stop_there(graph):
    assert graph.closure(graph.nodes.filter("id = 'G:1'"), max_hops=1).count() == 1


def test_closure_WHEN_frontiers_are_large_SHOULD_exchange_no_edges(graph, spark, monkeypatch):
    from tessera.operators import graph as module

    level = spark.createDataFrame([("D:1",), ("loop",)], "id string")
    with module._bucketed(graph._incidences()) as adjacency:
        few = module.Graph._touched(adjacency, level, 2)
        monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            many = module.Graph._touched(adjacency, level, 2)
            plan = many._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        edges = plan[: plan.index("Bucketed: true")]
        assert "Exchange" not in edges[edges.rindex("SortMergeJoin") :] and plan.count("Exchange") == 2  # the frontier, and what it leads to
        assert rows(few) == rows(many) and ("loop", 1, 1) in rows(few)


def test_closure_WHEN_frontiers_are_large_SHOULD_broadcast_none_by_bytes(graph, spark, monkeypatch):
    from tessera.operators import graph as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    level = spark.createDataFrame([("D:1",), ("X:1",)], "id string")
    with module._bucketed(graph._incidences()) as adjacency:
        touched = module.Graph._touched(adjacency, level, 2)
        marked = touched.join(module.sent(level, 2), "id", "left")
        assert "Broadcast" not in marked._jdf.queryExecution().sparkPlan().toString()
        assert {r.id for r in touched.collect()} >= {"X:1", "D:2"}


@pytest.mark.parametrize("few", [True, False])
def test_neighbours_WHEN_many_ask_SHOULD_be_those_of_the_facts(graph, spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr("tessera.operators.graph.POINTS", 0)
        monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 0)
    asked = spark.createDataFrame([(1, "D:1", "has"), (1, "D:1", "subclass"), (2, "D:3", "twice"), (3, "D:1", None), (4, None, "has"), (5, "loop", "self"), (6, "NONE", "has")], "q int, anchor string, predicate string")
    got = rows(graph.neighbours(asked))
    assert got == rows(graph.traverse(asked).select("q", "anchor", "other_id").distinct()) and (2, "D:3", "X:1") in got and len(got) == 7


def test_candidates_WHEN_disambiguated_SHOULD_be_found_once(graph, spark):
    found, asked = spark.createDataFrame([(1, "D:1", 1)], "question_id int, id string, rank int"), []

    class Spied(Graph):
        def edge_count_of(self, requests):
            asked.append(requests)
            return super().edge_count_of(requests)

    chosen = spark.createDataFrame([(1, "has")], "question_id int, predicate string")
    assert rows(crawl.disambiguate(Spied(graph.nodes, graph.edges), found, chosen, "D")) == [(1, "D:1", 1, 3)]
    assert asked[0]._scratch  # written out before it is read twice


def test_candidates_WHEN_of_other_namespaces_SHOULD_be_counted_only_if_they_can_be_chosen(graph, spark):
    asked = []

    class Spied(Graph):
        def edge_count_of(self, requests):
            asked.extend(r.id for r in requests.select("id").distinct().collect())
            return super().edge_count_of(requests)

    found = candidates(spark, ["X:1", "D:8", "D:2", "G:1"]).unionByName(candidates(spark, ["X:1", "G:1"]).withColumn("question_id", F.lit(1)))
    chosen = spark.createDataFrame([(0, "has"), (1, "has")], "question_id int, predicate string")
    got = {r.question_id: (r.anchor, r.n_edges) for r in crawl.disambiguate(Spied(graph.nodes, graph.edges), found, chosen, "D").collect()}
    assert got == {0: ("D:2", 1), 1: ("X:1", 2)} and sorted(asked) == ["D:2", "D:8", "X:1"]


CRAWLED = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
STORED = [("D:1", [1.0, 0.1]), ("D:2", [0.1, 1.0]), ("D:3", [1.0, 1.0]), ("X:1", [1.0, 0.0]), ("G:1", [0.0, 1.0])]


@pytest.mark.parametrize("most", [500_000, 0])
def test_crawl_WHEN_many_ask_SHOULD_read_the_edges_once(graph, spark, monkeypatch, most):
    stored, asked = spark.createDataFrame(STORED, "id string, embedding array<double>"), spark.createDataFrame(CRAWLED, "question_id int, embedding array<double>")
    described = spark.createDataFrame([("has", 0, [1.0, 0.0]), ("twice", 1, [0.0, 1.0])], "predicate string, position int, embedding array<double>")
    rounds = [crawl.disambiguate(graph, crawl.anchors_of(stored, asked, 4), chosen := vectors.within_margin(vectors.classify(asked, described), 0.5), "D"), chosen]
    facts = rows(graph.traverse(rounds[0].select("question_id", "anchor").join(rounds[1].select("question_id", "predicate", "predicate_rank"), "question_id")))
    monkeypatch.setattr("tessera.operators.graph.POINTS", 0)
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", most)
    read, real = [], Graph.adjacency
    monkeypatch.setattr(Graph, "adjacency", lambda self, *edges: (read.append(self), real(self, *edges))[1])
    got = crawl.crawl(graph, stored, asked, described, "D", 0.5, 4)
    near = crawl.crawl_neighbours(graph, stored, asked, described, "D", 0.5, 4)
    assert len(read) == 2 and len(facts) > 3  # each crawl once
    assert sorted(map(str, got.select("question_id", "anchor", "predicate", "other_id", "dir").collect())) == sorted(str(r) for r in spark.createDataFrame(facts, "question_id int, anchor string, predicate string, rank int, other_id string, category string, name string, dir string").select("question_id", "anchor", "predicate", "other_id", "dir").collect())
    assert rows(near) == rows(got.select("question_id", "anchor", "other_id").distinct())


def test_facts_WHEN_edges_are_read_once_SHOULD_be_those_of_all_edges(graph, spark):
    asked = spark.createDataFrame([(1, "D:1", "has"), (2, "D:3", "twice"), (3, "loop", "self"), (4, "D:1", None)], "q int, anchor string, predicate string")
    near = graph.vicinity(asked.select(F.col("anchor").alias("id")), asked)
    assert near.around._scratch and near.around.filter("node NOT IN ('D:1', 'D:3', 'loop') OR predicate NOT IN ('has', 'twice', 'self')").count() == 0
    assert rows(near.traverse(asked)) == rows(graph.traverse(asked)) and rows(near.neighbours(asked)) == rows(graph.neighbours(asked))


@pytest.mark.parametrize("kinds", [63, 2])
def test_neighbours_WHEN_predicates_are_more_than_bits_SHOULD_be_the_same(graph, spark, monkeypatch, kinds):
    monkeypatch.setattr("tessera.operators.graph.KINDS", kinds)
    monkeypatch.setattr("tessera.operators.graph.POINTS", 0)
    asked = spark.createDataFrame([(1, "D:1", "has"), (1, "D:1", "subclass"), (2, "D:3", "twice"), (3, "loop", "self"), (3, "loop", None)], "q int, anchor string, predicate string")
    assert rows(graph.neighbours(asked)) == rows(graph.traverse(asked).select("q", "anchor", "other_id").distinct())


def test_closure_WHEN_graph_is_random_SHOULD_equal_a_plain_search(spark):
    draw = np.random.default_rng(4)
    pairs = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 120, (150, 2))] + [("n1", "n1"), ("n1", None), (None, "n2")]
    own = Graph(spark.range(130).select(F.concat(F.lit("n"), "id").alias("id")), spark.createDataFrame([(a, b, "p") for a, b in pairs], "subject string, object string, predicate string"))
    for hops in (2, 12):
        got = [tuple(r)[:4] for r in own.closure(own.nodes.filter("id IN ('n1', 'n5')"), hops).orderBy("hop").collect()]
        reached, want = {"n1", "n5"}, []
        for hop in range(1, hops + 1):
            more = {y for a, b in pairs if a and b for x, y in ((a, b), (b, a)) if x in reached} - reached
            reached = reached | more
            want.append((hop, len(reached), len(more) + (2 if hop == 1 else 0), sum(a in reached and b in reached for a, b in pairs)))
            if not more:
                break
        assert got == want


def test_dangling_WHEN_end_is_no_node_SHOULD_list(graph):
    assert rows(graph.dangling().select("subject", "object")) == [("D:1", "X:9")]


def test_cut_WHEN_namespace_taxon_or_node_is_missing_SHOULD_drop(graph):
    kept = cut.cut_graph(graph, ["D", "X", "G"])
    assert kept.edges.count() == 8 and "G:1" not in [r.id for r in kept.nodes.collect()]
    assert tuple(cut.audit_cut(kept, ["D", "X", "G"]).first()) == (5, 8, 0, 0)
    cut.assert_cut(cut.audit_cut(kept, ["D", "X", "G"]), nodes=5, edges=8)
    with pytest.raises(AssertionError):
        cut.assert_cut(cut.audit_cut(kept, ["D", "X", "G"]), nodes=6)
    with pytest.raises(AssertionError):
        cut.assert_cut(cut.audit_cut(kept, ["D"]))


def test_predicate_cut_WHEN_predicate_is_null_SHOULD_drop_only_if_cutting(graph):
    seeds = graph.nodes.filter("id = 'D:2'").select("id")
    got = {r.label: (r.h1_nodes, r.h1_edges) for r in cut.predicate_cuts(graph, [PredicateCut("all"), PredicateCut("cut", ("has",))], seeds).collect()}
    assert got == {"all": (4, 3), "cut": (2, 1)}


def test_relevance_cut_WHEN_category_is_dropped_SHOULD_count(graph):
    cuts = [RelevanceCut("all"), RelevanceCut("human", True), RelevanceCut("no phenotype", False, (), ("Phenotype",))]
    got = {r.label: (r.triples, r.anchors) for r in cut.relevance_cuts(graph, cuts, "D").collect()}
    assert got == {"all": (10, 3), "human": (9, 3), "no phenotype": (4, 3)}


def test_breakdown_WHEN_more_than_top_SHOULD_have_rest(graph):
    got = {r.bucket: r.n for r in profile.breakdown(graph.nodes, graph.nodes.category, top=1).collect()}
    assert got == {"Disease": 5, "(rest)": 4}


def test_sample_WHEN_partitions_differ_SHOULD_be_the_same(spark):
    table = spark.range(5000).selectExpr("concat('n:', id) AS id")
    samples = {tuple(rows(profile.hash_sample(table.repartition(n), "id", "13", 50))) for n in (1, 3, 17)}
    assert len(samples) == 1


def candidates(spark, ids):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(ids, 1)], "question_id int, id string, rank int")


@pytest.mark.parametrize(
    ("ids", "anchor", "n"),
    [(["X:1", "D:8", "D:2", "D:1"], "D:2", 1), (["X:1", "D:8", "D:9"], "D:8", 0), (["X:1", "G:1"], "X:1", 2)],
)
def test_disambiguate_WHEN_ranked_SHOULD_prefer_namespace_with_edges(graph, spark, ids, anchor, n):
    predicates = spark.createDataFrame([(0, "has")], "question_id int, predicate string")
    row = crawl.disambiguate(graph, candidates(spark, ids), predicates, "D").first()
    assert (row.anchor, row.n_edges) == (anchor, n)


def test_disambiguate_WHEN_no_candidates_SHOULD_be_empty(graph, spark):
    predicates = spark.createDataFrame([(0, "has")], "question_id int, predicate string")
    assert crawl.disambiguate(graph, candidates(spark, ["x"]).limit(0), predicates, "D").count() == 0


@pytest.mark.parametrize(("scores", "kept"), [((0.90, 0.50), 1), ((0.90, 0.88, 0.50), 2), ((0.90, 0.85), 2), ((0.90, 0.8499), 1)])
def test_margin_WHEN_near_the_best_SHOULD_keep(spark, scores, kept):
    table = spark.createDataFrame([(0, f"p{i}", i, s) for i, s in enumerate(scores)], "question_id int, predicate string, position int, score double")
    got = vectors.within_margin(table, 0.05).orderBy("predicate_rank").collect()
    assert [r.predicate for r in got] == [f"p{i}" for i in range(kept)]


def test_top_k_WHEN_tied_or_zero_SHOULD_take_smaller_key_and_skip(spark):
    table = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("c", [0.0, 1.0]), ("n", None)], "id string, embedding array<float>")
    assert [r.id for r in vectors.top_k(table, [1.0, 0.0], 2).collect()] == ["a", "b"]
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "question_id int, embedding array<float>")
    got = rows(vectors.batched_top_k(table, questions, 2).select("question_id", "rank", "id", "sim"))
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (2, 1, "c", 1.0), (2, 2, "a", 0.0)]
    assert vectors.batched_top_k(table, questions, 20).count() == 6
    assert vectors.batched_top_k(table, questions.limit(0), 2).count() == 0


def test_rank_WHEN_tied_SHOULD_count_only_what_is_nearer(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "b"), (2, [1.0, 0.0], "c"), (3, [1.0, 0.0], "none")], "question_id int, embedding array<float>, target string")
    assert rows(vectors.rank_of_target(table, asked)) == [(1, "b", 1), (2, "c", 3)]


def test_pooling_WHEN_model_is_biomedical_SHOULD_use_cls():
    assert vectors.needs_cls("cambridgeltl/SapBERT-from-PubMedBERT") and not vectors.needs_cls("all-MiniLM-L6-v2")


def test_points_WHEN_store_is_loaded_SHOULD_prune_both_layouts(graph, spark, tmp_path):
    readers.write_store(graph.nodes.select("id", "category", "name").dropDuplicates(["id"]), graph.edges.select("subject", "object", "predicate"), str(tmp_path / "s"))
    stored = readers.read_store(spark, str(tmp_path / "s"))
    asked = graph.edges.select(F.col("subject").alias("anchor"), "predicate").unionByName(graph.edges.select(F.col("object").alias("anchor"), "predicate")).filter("anchor IS NOT NULL AND predicate IS NOT NULL").distinct()
    assert rows(stored.traverse(asked)) == rows(Graph(graph.nodes.dropDuplicates(["id"]), graph.edges).traverse(asked))
    near, _ = stored.near(spark.createDataFrame([("D:1", "has")], "anchor string, predicate string"), "anchor")
    plan, files = near._jdf.queryExecution().executedPlan().toString(), near.inputFiles()
    assert all(any(layout in f for f in files) for layout in ("edges_by_subject", "edges_by_object"))
    assert "EqualTo(subject,D:1)" in plan and "EqualTo(object,D:1)" in plan and "Exchange" not in plan


def test_requests_WHEN_many_SHOULD_read_the_shards_that_they_meet_only(spark, tmp_path, monkeypatch):
    nodes = spark.range(400_000).select(F.concat(F.lit("N:"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("id"), F.lit("k").alias("category"), F.lit("n").alias("name"))
    edges = nodes.select(F.col("id").alias("subject"), F.concat(F.lit("N:"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(400_000)).cast("string"), 7, "0")).alias("object"), F.lit("p").alias("predicate"))
    hot = spark.range(20_000).select(F.lit("N:0300000").alias("subject"), F.concat(F.lit("N:"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("object"), F.lit("p").alias("predicate"))
    readers.write_store(nodes, edges.unionByName(hot), str(tmp_path / "s"), partitions=40)
    stored = readers.read_store(spark, str(tmp_path / "s"))
    asked = nodes.filter("id >= 'N:0100000' AND id < 'N:0200000'").select(F.col("id").alias("anchor"), F.lit("p").alias("predicate"))
    own = stored.layouts[0].met_by(asked.select("anchor"))
    files = lambda df: df.groupBy(F.input_file_name()).count().count()
    assert asked.count() == 100_000 and 8 <= files(own) <= 14 and files(stored.layouts[0].edges) == 40 and files(stored.layouts[0].of(["N:0000007"])) == 1
    found = stored.traverse(asked)
    assert found.filter("dir = 'out'").count() == 100_000 and found.count() == Graph(nodes, edges.unionByName(hot)).traverse(asked).count()
    assert stored.layouts[0].of(["N:0300000"]).count() == 20_001 and stored.layouts[0].met_by(spark.createDataFrame([("N:0300000",)], "id string")).filter("subject = 'N:0300000'").count() == 20_001
    written: list = []
    monkeypatch.setattr("tessera.operators.graph.counted", lambda *a: written.append(a))
    one = stored.traverse(asked.limit(1))
    assert one.count() >= 1 and not written and re.search(r"PartitionFilters: \[[^]]*_shard", one._jdf.queryExecution().executedPlan().toString())


def test_requests_WHEN_very_many_SHOULD_join(graph, spark, monkeypatch):
    asked = spark.createDataFrame([(f"D:{i}", "has") for i in range(30)], "id string, predicate string")
    few = rows(graph.edge_count_of(asked))
    monkeypatch.setattr("tessera.operators.graph.POINTS", 3)
    monkeypatch.setattr("tessera.operators.graph.BROADCAST_ROWS", 2)
    assert rows(graph.edge_count_of(asked)) == few and rows(graph.closure(graph.nodes.limit(1))) == rows(graph.closure(graph.nodes.limit(1)))


@pytest.mark.parametrize("size", [16, 1 << 25])
def test_batched_WHEN_compared_SHOULD_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr("tessera.operators.blocks.PRODUCT_BYTES", size)
    rng = np.random.default_rng(3)
    gallery = np.round(rng.normal(size=(120, 6)), 1)
    gallery[5] = 0
    gallery[10:20] = gallery[30]
    asked = np.concatenate((gallery[25:40], rng.normal(size=(5, 6))))
    frame = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>").repartition(3)
    got = sorted((r.question_id, r["rank"], r.id, r.sim) for r in vectors.batched_top_k(frame(gallery, "id"), frame(asked, "question_id"), 7).collect())
    want = []
    for q, v in enumerate(asked):
        sims = [(round(float(v @ g / np.linalg.norm(v) / np.linalg.norm(g)), 6) + 0.0, i) for i, g in enumerate(gallery) if np.any(g)]
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(sims, key=lambda x: (-x[0], x[1]))[:7])]
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    assert sum(a[2] == b[2] for a, b in zip(got, want)) > 0.97 * len(want)


def test_descriptions_WHEN_too_many_SHOULD_raise(spark, monkeypatch):
    monkeypatch.setattr("tessera.operators.vectors.DESCRIPTIONS", 2)
    described = spark.createDataFrame([(f"p{i}", i, [1.0, 0.0]) for i in range(3)], "predicate string, position int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "question_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 2"):
        vectors.classify(asked, described).collect()
    assert vectors.classify(asked, described.limit(2)).count() == 2


def ngram_vectors(texts, dim):
    """The hashed embedder over again, a dictionary of counts at a time."""
    import hashlib

    out = []
    for text in texts:
        counts = {}
        padded = " " + text.lower() + " "
        for at in range(max(1, len(padded) - 2)):
            number = int.from_bytes(hashlib.blake2b(padded[at : at + 3].encode("utf-8"), digest_size=8).digest(), "little")
            counts[number % dim] = counts.get(number % dim, 0.0) + (1.0 if number >= 1 << 63 else -1.0)
        out.append([counts.get(k, 0.0) for k in range(dim)])
    return np.array(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_embedded_corpus_WHEN_made_again_SHOULD_be_equal(spark):
    got = {r.id: r for r in queries()["embedded_corpus"](spark, DATA).collect()}
    texts = {r.id: r.text for r in queries()["node_text"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    want = ngram_vectors([texts[i] for i in got], 32)
    assert (np.array([got[i].embedding for i in got]) == want).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_synonym_eval_WHEN_ranked_in_numpy_SHOULD_be_equal(spark):
    gallery = queries()["synonym_gallery"](spark, DATA).collect()
    asked = queries()["synonym_queries"](spark, DATA).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit(ngram_vectors([q.query for q in asked], 256)) @ unit(ngram_vectors([g.name for g in gallery], 256)).T, 6)
    place = {g.id: i for i, g in enumerate(gallery)}
    ranks = np.array([1 + (row > row[place[q.target]]).sum() for row, q in zip(sims, asked)])
    [got] = queries()["synonym_eval"](spark, DATA).collect()
    assert got.n == len(asked) and abs(got.mrr - (1 / ranks).mean()) < 1e-3
    for k in (1, 5, 10):
        assert abs(got[f"recall_at_{k}"] - (ranks <= k).mean()) < 4 / len(ranks)
