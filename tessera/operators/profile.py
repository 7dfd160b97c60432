"""Profiling a graph: composition, hubs, neighbourhood distributions, sparsity, pattern shapes, subsets, object usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expressions import absent, with_row
from tessera.operators.cut import HUMAN, with_endpoints
from tessera.operators.graph import BROADCAST_ROWS, Graph, met, sent
from tessera.operators.order import hash_sample, order_statistics, percentile
from tessera.sources.scratch import counted, materialize

TOP = 15
#: (low, high) of edge ends, both inclusive.
BUCKETS = ((1, 1), (2, 4), (5, 9), (10, 19), (20, 49), (50, 99), (100, 10**9))
DISTRIBUTION_PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
USAGE_PERCENTILES = (0.5, 0.75, 0.9, 0.99)
THRESHOLDS = (100_000, 500_000, 1_000_000, 2_000_000)
REST = "(rest)"


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.round(F.try_divide(100.0 * (F.col(part) if isinstance(part, str) else part), F.col(whole) if isinstance(whole, str) else whole), 6)


def breakdown(table: DataFrame, bucket: Column, top: int = TOP, none: str = "(none)") -> DataFrame:
    """(bucket, n, pct): the top buckets and, if there are more, the rest."""
    counts = table.groupBy(F.coalesce(bucket, F.lit(none)).alias("bucket")).agg(F.count("*").alias("n"))
    shown = counts.orderBy(F.desc("n"), "bucket").limit(top)
    total = counts.agg(F.sum("n").alias("total"))
    rest = with_row(shown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")), total).filter("shown < total").select(F.lit(REST).alias("bucket"), (F.col("total") - F.col("shown")).alias("n"))
    return with_row(shown.unionByName(rest), total).select("bucket", "n", percent("n", "total").alias("pct"))


def species_composition(graph: Graph, species: str = HUMAN) -> DataFrame:
    """(bucket, n, pct): edges between nodes by their ends' species; pct of all edges."""
    own = lambda side: F.coalesce(F.col(f"{side}_taxon"), F.lit(species)) == species
    bucket = (
        F.when(F.col("s_taxon").isNull() & F.col("o_taxon").isNull(), "both taxon-free")
        .when(own("s") & own("o"), "human (or taxon-free)")
        .otherwise("touches a non-human species")
    )
    counts = with_endpoints(graph).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return with_row(counts, graph.edges.agg(F.count("*").alias("total"))).select("bucket", "n", percent("n", "total").alias("pct"))


def hubs(graph: Graph, seeds: DataFrame, top: int = 20) -> DataFrame:
    """(id, name, category, deg): the top nodes by degree among the ends of edges that touch the seeds (id)."""
    frontier = graph.expand(seeds.select(F.lit(0).alias("key"), "id").distinct(), keep=False).select("id")
    named = frontier.join(graph.degree(), "id").join(graph.nodes.select("id", "name", "category"), "id")
    return named.orderBy(F.desc("deg"), "id").limit(top).select("id", "name", "category", "deg")


def hub_predicates(graph: Graph, seeds: DataFrame, hubs_: int = 5, top: int = 8) -> DataFrame:
    """(predicate, n): predicates on edges that touch the largest hubs, whether nodes or not."""
    frontier = graph.expand(seeds.select(F.lit(0).alias("key"), "id").distinct(), keep=False).select("id")
    largest = frontier.join(graph.degree(), "id").orderBy(F.desc("deg"), "id").limit(hubs_).select("id")
    counts = graph.incident_edges(largest).groupBy("predicate").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "predicate").limit(top)


def neighbourhoods(graph: Graph, prefix: str) -> DataFrame:
    """(id, h1_nodes, h2_edges_ub): distinct neighbours of each anchor, and the sum of their degrees; anchors without edges are absent."""
    ids, n = counted(graph.anchors(prefix).select("id"), "anchors")
    ends = graph.ends() if n <= BROADCAST_ROWS else met(graph.ends(), "id", ids, n)
    pairs = ends.join(sent(ids, n), "id").distinct()
    degree = graph.degree().withColumnRenamed("id", "other")
    return pairs.join(degree, "other").groupBy("id").agg(F.count("*").alias("h1_nodes"), F.sum("deg").alias("h2_edges_ub"))


def distribution(shape: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = DISTRIBUTION_PERCENTILES) -> DataFrame:
    """(stat, one double for each column): exact interpolated percentiles p50, p75, ..., and max."""
    long = shape.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("v.*")
    places = [*map(percentile, percentiles), lambda n: (n - 1).cast("double")]
    found = order_statistics(long, ["column"], "value", places)
    names = shape.sparkSession.createDataFrame([(i, f"p{100 * p:g}") for i, p in enumerate(percentiles)] + [(len(percentiles), "max")], "i int, stat string")
    wide = found.groupBy("i").agg(*[F.round(F.max(F.when(F.col("column") == c, F.col("value"))), 6).alias(c) for c in columns])
    return names.join(wide, "i", "left").select("stat", *columns)


def threshold_shares(shape: DataFrame, column: str = "h2_edges_ub", thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """(threshold, n, pct): rows strictly above each threshold, in one pass."""
    counts = shape.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) > t).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds])
    return counts.select("total", F.explode(rows).alias("r")).select("r.threshold", "r.n", percent("r.n", "total").alias("pct"))


def exact_second_hop(graph: Graph, shape: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, h1_edges, h2_edges, h2_edges_ub, ratio) for the sampled anchors (id): exact counts against the bound.

    h1_edges are edges on the anchor; h2_edges those on any of its neighbours. The sample is written out; shape should be."""
    sample = materialize(sample.select("id"), "sample")
    own = graph.edge_counts(sample.select(F.col("id").alias("key"), "id")).select(F.col("key").alias("id"), F.col("incident").alias("h1_edges"))
    frontier = sample.select("id").join(graph.ends(), "id").select(F.col("id").alias("key"), F.col("other").alias("id")).distinct()
    second = graph.edge_counts(frontier).select(F.col("key").alias("id"), F.col("incident").alias("h2_edges"))
    rows = sample.select("id").join(own, "id").join(second, "id").join(shape.select("id", "h2_edges_ub"), "id")
    return rows.withColumn("ratio", F.round(F.col("h2_edges_ub") / F.greatest("h2_edges", F.lit(1)), 6))


def sparsity(graph: Graph, prefix: str, buckets: Sequence[tuple[int, int]] = BUCKETS) -> DataFrame:
    """(bucket, terms, pct_terms, edge_ends, pct_edge_ends, has_description, median_description, median_synonym) by edge ends.

    Every bucket has a row; an empty one has no shares or medians. Parallel edges and both ends of a self-loop count."""
    ends = graph.ends().filter("other IS NOT NULL").groupBy("id").agg(F.count("*").alias("deg"))
    size = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    text = graph.anchors(prefix).select("id", size("description").alias("desc_len"), size("synonym").alias("syn_len"))
    label = lambda low, high: str(low) if low == high else f"{low}+" if high > 10**8 else f"{low}-{high}"
    bucket = F.coalesce(*[F.when(F.col("deg").between(a, b), i) for i, (a, b) in enumerate(buckets)])
    rows = text.join(ends, "id")
    counts = rows.groupBy(bucket.alias("i")).agg(
        F.count("*").alias("terms"), F.sum("deg").alias("edge_ends"), F.avg(F.when(F.col("desc_len") > 0, 1.0).otherwise(0.0)).alias("has_description"),
    )
    sizes = rows.select(bucket.alias("range"), F.explode(F.array(F.struct(F.lit("d").alias("of"), F.col("desc_len").alias("size")), F.struct(F.lit("s").alias("of"), F.col("syn_len").alias("size")))).alias("x")).select("range", "x.*")
    halves = order_statistics(sizes, ["range", "of"], "size", [percentile(0.5)])
    medians = halves.groupBy(F.col("range").alias("i")).agg(F.max(F.when(F.col("of") == "d", F.col("value"))).alias("median_description"), F.max(F.when(F.col("of") == "s", F.col("value"))).alias("median_synonym"))
    spark = graph.nodes.sparkSession
    names = spark.createDataFrame([(i, label(a, b)) for i, (a, b) in enumerate(buckets)], "i int, bucket string")
    totals = rows.agg(F.count("*").alias("all_terms"), F.sum("deg").alias("all_ends"))
    out = with_row(names.join(counts, "i", "left").join(medians, "i", "left").na.fill(0, ["terms", "edge_ends"]), totals)
    return out.select("bucket", "terms", percent("terms", "all_terms").alias("pct_terms"), "edge_ends", percent("edge_ends", "all_ends").alias("pct_edge_ends"),
                      F.round("has_description", 6).alias("has_description"), "median_description", "median_synonym")


def condensed(graph: Graph) -> tuple[Graph, DataFrame]:
    """(a graph with one edge for each pair of nodes, the pairs with their number of edges), grouped and written out once."""
    pairs = materialize(graph.pairs(), "pairs")
    return Graph(graph.nodes, pairs.select("subject", "object")), pairs


def pattern_shapes(graph: Graph, prefix: str, patterns: Sequence[str]) -> DataFrame:
    """(pattern, seeds, h1_nodes, h1_induced, h2_nodes, h2_induced, h2_incident, top_hub, top_hub_deg), a row for each pattern."""
    graph, pairs = condensed(graph)
    seeds = graph.seeds(prefix, patterns)
    first = materialize(graph.expand(seeds), "first-hop")
    second = materialize(graph.expand(first), "second-hop")
    size = lambda sets, name: sets.groupBy("key").agg(F.count("*").alias(name))
    near = graph.edge_counts(first, pairs).select("key", F.col("incident").alias("h2_incident"), F.col("induced").alias("h1_induced"))
    far = graph.edge_counts(second, pairs).select("key", F.col("induced").alias("h2_induced"))
    degree = pairs.select(F.explode(F.array("subject", "object")).alias("id"), "n").filter("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("deg"))
    hub = first.join(degree, "id").join(graph.nodes.select("id", "name"), "id").groupBy("key").agg(
        F.max_by(F.struct(F.coalesce(F.when(~absent("name"), F.col("name")), F.col("id")).alias("hub"), "deg"), F.struct("deg", F.col("id"))).alias("top"))
    names = graph.nodes.sparkSession.createDataFrame([(p,) for p in patterns], "key string")
    counts = ("seeds", "h1_nodes", "h1_induced", "h2_nodes", "h2_induced", "h2_incident")
    out = names
    for part in (size(seeds, "seeds"), size(first, "h1_nodes"), size(second, "h2_nodes"), near, far, hub):
        out = out.join(part, "key", "left")
    return out.na.fill(0, list(counts)).select(F.col("key").alias("pattern"), *counts, F.col("top.hub").alias("top_hub"), F.col("top.deg").alias("top_hub_deg"))


def subset_sets(graph: Graph, prefix: str, patterns: Sequence[str], pinned: Graph | None = None) -> DataFrame:
    """(key, id): the candidate subsets union_h1, union_h2 and all_h1; `pinned` is a graph of the same nodes and pairs, already written out."""
    graph = pinned or graph.pinned()
    union = graph.seeds(prefix, patterns).select(F.lit("union").alias("key"), "id").distinct()
    every = graph.anchors(prefix).select(F.lit("all").alias("key"), "id")
    first = materialize(graph.expand(union.unionByName(every)), "first-hop")
    second = graph.expand(first.filter("key = 'union'")).withColumn("key", F.lit("union_h2"))
    return materialize(first.withColumn("key", F.concat("key", F.lit("_h1"))).unionByName(second), "subsets")


def all_h1(graph: Graph, prefix: str) -> DataFrame:
    """(id): the subset all_h1 alone, from one reading of the edges."""
    return graph.expand(graph.anchors(prefix).select(F.lit("all").alias("key"), "id")).select("id")


def subset_sizes(graph: Graph, sets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(subset, nodes, induced); pairs as in edge_counts()."""
    sizes = sets.groupBy("key").agg(F.count("*").alias("nodes"))
    return sizes.join(graph.edge_counts(sets, pairs), "key").select(F.col("key").alias("subset"), "nodes", "induced")


def subset_table(graph: Graph, prefix: str, patterns: Sequence[str]) -> DataFrame:
    """subset_sizes() of subset_sets(), from one reading of the edges."""
    thin, pairs = condensed(graph)
    return subset_sizes(thin, subset_sets(graph, prefix, patterns, thin), pairs)


def subset_categories(graph: Graph, ids: DataFrame, prefix: str, top: int = 8) -> DataFrame:
    """(category, n) of the subset's nodes, the prefix removed, null as '?'."""
    counts = ids.join(graph.nodes.select("id", "category"), "id").groupBy(F.replace(F.coalesce("category", F.lit("?")), F.lit(prefix), F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(top)


def subset_predicates(graph: Graph, ids: DataFrame, prefix: str, top: int = 10) -> DataFrame:
    """(predicate, n) of the subset's induced edges."""
    return edge_predicates(graph.induced_edges(ids), prefix, top)


def edge_predicates(edges: DataFrame, prefix: str, top: int = 10) -> DataFrame:
    """(predicate, n) of edges, the prefix removed."""
    counts = edges.groupBy(F.replace("predicate", F.lit(prefix), F.lit("")).alias("predicate")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "predicate").limit(top)


def object_usage(graph: Graph, prefix: str, predicate: str) -> DataFrame:
    """(id, n_anchors): how many anchors point to each object by the predicate."""
    pairs = graph.edges.filter(F.col("predicate") == predicate).join(graph.anchors(prefix).select(F.col("id").alias("subject")), "subject")
    return pairs.groupBy(F.col("object").alias("id")).agg(F.countDistinct("subject").alias("n_anchors"))


def top_objects(graph: Graph, usage: DataFrame, prefix: str, top: int = TOP) -> DataFrame:
    """(id, name, n_anchors, pct): the most used objects that are nodes; pct of all anchors."""
    named = usage.join(graph.nodes.select("id", "name"), "id").orderBy(F.desc("n_anchors"), "id").limit(top)
    total = graph.anchors(prefix).agg(F.count("*").alias("total"))
    return with_row(named, total).select("id", "name", "n_anchors", percent("n_anchors", "total").alias("pct"))


def ranked(table: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return table.withColumn("rank", rank).filter(F.col("rank") <= k)
