"""Cutting a graph to what is relevant, and auditing the cut."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import human, namespace, with_row
from tessera.operators.graph import Graph
from tessera.sources.readers import PredicateCut, RelevanceCut
from tessera.sources.scratch import materialize

HUMAN = "Homo sapiens"


def with_endpoints(graph: Graph) -> DataFrame:
    """Edges whose two ends are nodes, with s_taxon, o_taxon, s_category, o_category."""
    side = lambda end, mark: graph.nodes.select(F.col("id").alias(end), F.col("in_taxon_label").alias(f"{mark}_taxon"), F.col("category").alias(f"{mark}_category"))
    return graph.edges.join(side("subject", "s"), "subject").join(side("object", "o"), "object")


def touched_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("id")).distinct()


def cut_graph(graph: Graph, allowlist: Sequence[str], species: str = HUMAN) -> Graph:
    """Edges of which both ends are nodes, lie in listed namespaces and belong to the species or to none; and their nodes."""
    listed = namespace("subject").isin(list(allowlist)) & namespace("object").isin(list(allowlist))
    kept = Graph(graph.nodes, graph.edges.filter(listed))
    edges = kept.induced_edges(graph.nodes.filter(human("in_taxon_label", species) & F.col("id").isNotNull()).select("id").distinct())
    nodes = graph.nodes.join(touched_nodes(edges), "id", "left_semi").select(*graph.nodes.columns)
    return Graph(nodes, edges)


def audit_cut(cut: Graph, allowlist: Sequence[str], species: str = HUMAN) -> DataFrame:
    """(nodes, edges, leaked_taxon, leaked_namespace): the leaks must be 0."""
    leaks = cut.nodes.agg(
        F.count("*").alias("nodes"), F.count_if(~human("in_taxon_label", species)).alias("leaked_taxon"),
        F.count_if(~namespace("id").isin(list(allowlist))).alias("leaked_namespace"),
    )
    return with_row(leaks, cut.edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "leaked_taxon", "leaked_namespace")


def assert_cut(audit: DataFrame, nodes: int | None = None, edges: int | None = None) -> None:
    """Raise unless nothing leaked and the counts are those expected, where given."""
    row = audit.first()
    if row.leaked_taxon or row.leaked_namespace:
        raise AssertionError(f"leaked: {row.leaked_taxon} by taxon, {row.leaked_namespace} by namespace")
    for name, expected in (("nodes", nodes), ("edges", edges)):
        if expected is not None and row[name] != expected:
            raise AssertionError(f"{name}: {row[name]}, expected {expected}")


def relevance_condition(cut: RelevanceCut, species: str = HUMAN) -> Column:
    """The conjunction that a cut asks for; without any, true. A null predicate passes no comparison; a null category passes."""
    parts: list[Column] = []
    if cut.drop_nonhuman:
        parts += [human("s_taxon", species), human("o_taxon", species)]
    parts += [F.col("predicate") != p for p in cut.drop_predicates]
    parts += [F.coalesce(F.col(f"{side}_category"), F.lit("")) != c for c in cut.drop_categories for side in "so"]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def relevance_cuts(graph: Graph, cuts: Sequence[RelevanceCut], prefix: str, species: str = HUMAN) -> DataFrame:
    """(label, nodes, triples, anchors, pct_anchors) of each scenario.

    The edges are joined once; each carries one bit for each cut that keeps it (63 cuts at most), and a node has the
    bits of all its edges, combined before and after one exchange by id."""
    if len(cuts) > 63:
        raise ValueError("at most 63 cuts at once")
    bit = lambda i: F.lit(1 << i).cast("long")
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(relevance_condition(c, species), bit(i)).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cuts)])
    edges = with_endpoints(graph).select("subject", "object", mask.alias("mask")).filter("mask <> 0")
    kept = lambda i: F.col("mask").bitwiseAND(bit(i)) != 0
    triples = edges.agg(*[F.count_if(kept(i)).alias(f"t{i}") for i in range(len(cuts))])
    ids = edges.select(F.explode(F.array("subject", "object")).alias("id"), "mask").groupBy("id").agg(F.bit_or("mask").alias("mask"))
    alive = graph.anchors(prefix).select("id", F.lit(True).alias("anchor"))
    counts = [c for i in range(len(cuts)) for c in (F.count_if(kept(i)).alias(f"n{i}"), F.count_if(kept(i) & F.coalesce("anchor", F.lit(False))).alias(f"a{i}"))]
    row = with_row(with_row(triples, ids.join(alive, "id", "left").agg(*counts)), alive.agg(F.count("*").alias("total")))
    rows = F.array(*[F.struct(F.lit(c.label).alias("label"), F.col(f"n{i}").alias("nodes"), F.col(f"t{i}").alias("triples"), F.col(f"a{i}").alias("anchors")) for i, c in enumerate(cuts)])
    share = F.round(F.try_divide(100.0 * F.col("r.anchors"), F.col("total")), 6).alias("pct_anchors")
    return row.select("total", F.explode(rows).alias("r")).select("r.*", share)


def predicate_cuts(graph: Graph, cuts: Sequence[PredicateCut], seeds: DataFrame) -> DataFrame:
    """(label, h1_nodes, h1_edges, h2_nodes, h2_edges) of the seeds' (id) neighbourhood under each cut.

    All cuts go through one plan: edges and nodes carry one bit for each cut (63 at most) that they belong to.
    A cut that drops something drops null predicates as well, as NOT IN does."""
    if len(cuts) > 63:
        raise ValueError("at most 63 cuts at once")
    none = F.lit(0).cast("long")
    bit = lambda i: F.lit(1 << i).cast("long")
    parts = [F.when(~F.col("predicate").isin(list(c.drop)), bit(i)).otherwise(none) if c.drop else bit(i) for i, c in enumerate(cuts)]
    edges = graph.pinned().edges.select("subject", "object", reduce(lambda x, y: x.bitwiseOR(y), parts).alias("cut")).filter("cut <> 0")

    def touched(nodes: DataFrame) -> DataFrame:
        """Edges with an end in the set, with the cuts (mask) under which they are."""
        side = lambda end: nodes.select(F.col("id").alias(end), F.col("mask").alias(f"{end}_mask"))
        both = edges.join(side("subject"), "subject", "left").join(side("object"), "object", "left")
        near = F.coalesce("subject_mask", none).bitwiseOR(F.coalesce("object_mask", none))
        return both.select("subject", "object", F.col("cut").bitwiseAND(near).alias("mask")).filter("mask <> 0")

    def grown(nodes: DataFrame, found: DataFrame) -> DataFrame:
        ends = found.select(F.explode(F.array("subject", "object")).alias("id"), "mask").unionByName(nodes)
        return ends.groupBy("id").agg(F.bit_or("mask").alias("mask"))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(*[F.count_if(F.col("mask").bitwiseAND(bit(i)) != 0).alias(f"{name}{i}") for i in range(len(cuts))])

    start = seeds.select("id").distinct().withColumn("mask", F.lit((1 << len(cuts)) - 1).cast("long"))
    first = materialize(grown(start, touched(start)), "first-hop")
    second = touched(first)
    row = reduce(with_row, [counts(first, "n"), counts(touched(start), "e"), counts(grown(first, second), "m"), counts(second, "f")])
    names = ("h1_nodes", "h1_edges", "h2_nodes", "h2_edges")
    rows = [F.struct(F.lit(c.label).alias("label"), *[F.col(f"{x}{i}").alias(n) for x, n in zip("nemf", names)]) for i, c in enumerate(cuts)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
