"""Registered queries: each applies one operator to the graph derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import namespace, parse_synonyms
from tessera.operators import crawl, cut, evaluate, profile, quality, text, vectors
from tessera.operators.graph import Graph
from tessera.plans import settings as S
from tessera.sources.derived import ALLOWLIST, derived_graph, derived_vectors
from tessera.sources.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]


def graph_query(make: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(derived_graph(spark, sf_dir))


def cut_of(g: Graph) -> Graph:
    return cut.cut_graph(g, ALLOWLIST)


def seeds(g: Graph) -> DataFrame:
    return g.seeds(S.ANCHOR, S.PATTERNS).select("id").distinct()


def one_set(g: Graph) -> DataFrame:
    return g.expand(seeds(g).select(F.lit(0).alias("key"), "id"))


def requests(g: Graph, rows: list[tuple[str, str]], names: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame(rows, names)


def traversal(rows: list[tuple[str, str]]) -> Query:
    return graph_query(lambda g: g.traverse(requests(g, rows, "anchor string, predicate string")))


COUNTED = [(i, p) for i in ("SUPP:1", "PART:5", "CUST:2", "ORD:3", "ORD:97", "NATION:3", "NONE") for p in ("kg:supplies", "kg:contains", "kg:placed_by")]


def usage(g: Graph) -> DataFrame:
    return profile.object_usage(g, S.ANCHOR, "kg:supplies")


def second_hop_sample(g: Graph) -> DataFrame:
    shape = materialize(profile.neighbourhoods(g, S.ANCHOR), "shape")
    return profile.exact_second_hop(g, shape, profile.hash_sample(shape.select("id"), "id", "42", 12))


def synonyms(g: Graph) -> DataFrame:
    return g.nodes.filter("synonym IS NOT NULL").select("id", F.array_join(parse_synonyms("synonym"), "|").alias("parsed"), F.size(parse_synonyms("synonym")).cast("long").alias("n"))


# --- vectors -------------------------------------------------------------------------------------------------------


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_vectors(spark, sf_dir).select("id", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is asked."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("question_id"), "label", "embedding")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predicate, position, embedding): the centroid of each described label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("label") < len(S.DESCRIBED))
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    named = F.get(F.array(*[F.lit(p) for p in S.DESCRIBED]), F.col("label"))
    return centroids.select(named.alias("predicate"), F.col("label").alias("position"), "embedding")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id = 7").select("embedding").first()[0]
    return vectors.top_k(node_vectors(spark, sf_dir), question, 10).select("id", "sim")


def batched_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.batched_top_k(node_vectors(spark, sf_dir), questions(spark, sf_dir), S.TOP_K)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).withColumn("target", F.concat(F.lit("PART:"), (F.col("question_id") + 1).cast("string")))


def rank_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.rank_of_target(node_vectors(spark, sf_dir), targets(spark, sf_dir))


def synonym_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rank_quality(rank_of_target(spark, sf_dir))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_of_target(spark, sf_dir).withColumn("ns", F.concat(namespace("target"), F.pmod("question_id", F.lit(3)).cast("string")))
    return evaluate.rank_quality_by(ranks, "ns")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classify(questions(spark, sf_dir), descriptions(spark, sf_dir))


def predicate_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.within_margin(scores(spark, sf_dir), S.MARGIN).select("question_id", "predicate", "score", "predicate_rank")


def predicate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = questions(spark, sf_dir).select(F.col("question_id").alias("id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("type"))
    truth = spark.createDataFrame(list(S.TRUTH), "type string, predicate string")
    return evaluate.calibrate(cases, scores(spark, sf_dir).withColumnRenamed("question_id", "id"), truth)


def disambiguate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    chosen = vectors.within_margin(vectors.classify(asked, descriptions(spark, sf_dir)), S.MARGIN)
    found = crawl.anchors_of(node_vectors(spark, sf_dir), asked, S.CANDIDATES)
    return crawl.disambiguate(derived_graph(spark, sf_dir), found, chosen, S.ANCHOR)


def crawl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(derived_graph(spark, sf_dir), node_vectors(spark, sf_dir), questions(spark, sf_dir), descriptions(spark, sf_dir), S.ANCHOR, S.MARGIN, S.CANDIDATES)


def crawl_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_neighbours(derived_graph(spark, sf_dir), node_vectors(spark, sf_dir), questions(spark, sf_dir), descriptions(spark, sf_dir), S.ANCHOR, S.MARGIN, S.CANDIDATES)


# --- evaluation ----------------------------------------------------------------------------------------------------


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    both = [evaluate.gold_cases(g, types, prefix, S.SEED, S.PER_TYPE) for types, prefix in ((S.SUPPLIER_TYPES, "SUPP"), (S.CUSTOMER_TYPES, "CUST"))]
    return both[0].unionByName(both[1])


def gold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("id", "type", "question", "anchor", F.size("answer_entities").cast("long").alias("n_answers"))


def gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).select("id", F.explode("answer_entities").alias("answer"))


def gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gold_summary(gold(spark, sf_dir)).select("type", "cases", F.col("median_answers").cast("long").alias("median_answers"), F.col("max_answers").cast("long").alias("max_answers"))


def supplier_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cases, questions): supplier cases, each asked with its anchor's vector where there is one."""
    cases = materialize(evaluate.gold_cases(derived_graph(spark, sf_dir), S.SUPPLIER_TYPES, "SUPP", S.SEED, S.PER_TYPE), "cases")
    asked = cases.select(F.col("id").alias("question_id"), "anchor").join(node_vectors(spark, sf_dir).withColumnRenamed("id", "anchor"), "anchor")
    return cases, materialize(asked, "asked")


GOLD_TYPES = [t.name for t in S.SUPPLIER_TYPES]


def score_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, asked = supplier_gold(spark, sf_dir)
    found = vectors.batched_top_k(node_vectors(spark, sf_dir), asked, S.TOP_K).select(F.col("question_id").alias("id"), F.col("id").alias("key"))
    found = materialize(found, "found")
    return evaluate.means(evaluate.score(cases, evaluate.surfaced_nodes(found)), GOLD_TYPES)


def triple_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object, embedding): the mean of both ends' vectors, for distinct triples whose ends have one."""
    own = node_vectors(spark, sf_dir)
    triples = derived_graph(spark, sf_dir).edges.select("subject", "predicate", "object").distinct()
    joined = triples.join(own.select(F.col("id").alias("subject"), F.col("embedding").alias("a")), "subject").join(own.select(F.col("id").alias("object"), F.col("embedding").alias("b")), "object")
    return joined.select("subject", "predicate", "object", F.zip_with("a", "b", lambda x, y: (x.cast("double") + y.cast("double")) / 2).alias("embedding"))


def score_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, asked = supplier_gold(spark, sf_dir)
    triples = triple_vectors(spark, sf_dir).select(F.concat_ws("|", "subject", "predicate", "object").alias("key"), "embedding")
    found = materialize(vectors.batched_top_k(triples, asked, S.TOP_K, key="key"), "found")
    ends = found.select(F.col("question_id").alias("id"), F.split_part("key", F.lit("|"), F.lit(1)).alias("subject"), F.split_part("key", F.lit("|"), F.lit(3)).alias("object"))
    return evaluate.means(evaluate.score(cases, evaluate.surfaced_triples(ends)), GOLD_TYPES)


def score_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, asked = supplier_gold(spark, sf_dir)
    facts = crawl.crawl(derived_graph(spark, sf_dir).pinned(), node_vectors(spark, sf_dir), asked, descriptions(spark, sf_dir), S.ANCHOR, S.MARGIN, S.CANDIDATES)
    found = materialize(facts.select(F.col("question_id").alias("id"), "anchor", "other_id").distinct(), "found")
    return evaluate.means(evaluate.score_crawl(cases, found), GOLD_TYPES)


def synonym_queries(g: Graph) -> DataFrame:
    return evaluate.synonym_queries(g, "7", 500)


def synonym_gallery(g: Graph) -> DataFrame:
    return evaluate.with_targets(evaluate.synonym_gallery(g, "7", 1000), synonym_queries(g), g)


def synonym_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synonym evaluation with the hashed n-gram embedder (no SQL form)."""
    g = derived_graph(spark, sf_dir)
    gallery = vectors.embed_corpus(synonym_gallery(g), vectors.HashedNgrams, text="name")
    asked = vectors.embed_corpus(synonym_queries(g), vectors.HashedNgrams, text="query").withColumn("question_id", F.col("target"))
    ranks = vectors.rank_of_target(gallery, asked)
    return evaluate.rank_quality(ranks)


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node documents with hashed n-gram vectors (no SQL form)."""
    return vectors.embed_corpus(text.node_texts(derived_graph(spark, sf_dir)), partial(vectors.HashedNgrams, 32))


COMPOSITION = {
    "category": ("nodes", lambda: F.replace("category", F.lit(S.PREFIX), F.lit(""))), "species": ("nodes", lambda: F.col("in_taxon_label")),
    "predicate": ("edges", lambda: F.replace("predicate", F.lit(S.PREFIX), F.lit(""))), "knowledge_level": ("edges", lambda: F.col("knowledge_level")),
    "agent_type": ("edges", lambda: F.col("agent_type")), "source": ("edges", lambda: F.col("primary_knowledge_source")),
}


def queries() -> dict[str, Query]:
    q = graph_query
    made: dict[str, Query] = {
        "graph_nodes_count": q(lambda g: g.nodes.agg(F.count("*").alias("n"))),
        "graph_edges_by_predicate": q(lambda g: g.edges.groupBy("predicate").agg(F.count("*").alias("n"))),
        "cut_edges": q(lambda g: cut_of(g).edges), "cut_nodes": q(lambda g: cut_of(g).nodes),
        "cut_audit": q(lambda g: cut.audit_cut(cut_of(g), ALLOWLIST)),
        "relevance_cuts": q(lambda g: cut.relevance_cuts(g, S.RELEVANCE_CUTS, S.ANCHOR)),
        "predicate_cuts": q(lambda g: cut.predicate_cuts(g, S.PREDICATE_CUTS, seeds(g))),
        "degree": q(lambda g: g.degree()),
        "hub_top20": q(lambda g: profile.hubs(g, seeds(g))),
        "hub_predicates": q(lambda g: profile.hub_predicates(g, seeds(g))),
        "cut_hubs": q(lambda g: top_hubs(Graph(g.nodes, cut_of(g).edges))),
        "seeds_by_pattern": q(lambda g: g.seeds(S.ANCHOR, S.PATTERNS).withColumnRenamed("key", "pattern")),
        "expand_one_hop": q(lambda g: one_set(g).select("id")),
        "incident_edges": q(lambda g: g.incident_edges(seeds(g))),
        "induced_edges": q(lambda g: g.induced_around(seeds(g))),
        "traverse_out": traversal([("SUPP:1", "kg:supplies")]), "traverse_in": traversal([("CUST:1", "kg:placed_by"), ("PART:9", "kg:contains")]),
        "traverse_both": traversal([("NATION:3", "kg:located_in"), ("NATION:3", "kg:part_of"), ("REGION:1", "kg:part_of")]),
        "edge_count_of": q(lambda g: g.edge_count_of(requests(g, COUNTED, "id string, predicate string"))),
        "dangling_edges": q(lambda g: g.dangling()),
        "composition_endpoint_species": q(profile.species_composition),
        "neighbour_distribution": q(lambda g: profile.distribution(profile.neighbourhoods(g, S.ANCHOR), ["h1_nodes", "h2_edges_ub"])),
        "neighbourhoods": q(lambda g: profile.neighbourhoods(g, S.ANCHOR)),
        "threshold_shares": q(lambda g: profile.threshold_shares(profile.neighbourhoods(g, S.ANCHOR), thresholds=(1_000, 10_000, 20_000, 100_000))),
        "exact_h2_sample": q(second_hop_sample),
        "sparsity_buckets": q(lambda g: profile.sparsity(g, "PART")),
        "pattern_shape": q(lambda g: profile.pattern_shapes(g, S.ANCHOR, S.PATTERNS)),
        "subset_sizes": q(lambda g: profile.subset_table(g, S.ANCHOR, S.PATTERNS)),
        "subset_categories": q(lambda g: profile.subset_categories(g, profile.all_h1(g, S.ANCHOR), S.PREFIX)),
        "subset_predicates": q(lambda g: profile.edge_predicates(g.induced_around(g.anchors(S.ANCHOR)), S.PREFIX)),
        "object_usage": q(lambda g: profile.top_objects(g, usage(g), S.ANCHOR)),
        "object_usage_percentiles": q(lambda g: profile.distribution(usage(g), ["n_anchors"], profile.USAGE_PERCENTILES)),
        "closure_by_hop": q(lambda g: g.closure(g.nodes.filter(F.col("id") == S.START))),
        "node_text": q(text.node_texts), "triple_text": q(lambda g: text.triple_texts(g, S.PREFIX)), "text_stats": q(lambda g: text.corpus_stats(g, S.PREFIX)),
        "synonyms_parsed": q(synonyms),
        "cosine_topk": cosine_topk, "batched_topk": batched_topk, "rank_of_target": rank_of_target,
        "predicate_margin": predicate_margin, "predicate_calibration": predicate_calibration,
        "disambiguate_batch": disambiguate_batch, "crawl_facts": crawl_facts, "crawl_neighbours": crawl_neighbours,
        "gold_cases": gold_cases, "gold_answers": gold_answers, "gold_summary": gold_summary,
        "score_node": score_node, "score_triple": score_triple, "score_crawl": score_crawl,
        "synonym_mrr": synonym_mrr, "recall_at_k": recall_at_k, "synonym_queries": q(synonym_queries), "synonym_gallery": q(synonym_gallery),
        "synonym_eval": synonym_eval, "embedded_corpus": embedded_corpus,
        "unique_ids": q(lambda g: quality.unique_ids(g.nodes)), "dangling_count": q(quality.dangling_edges),
        "empty_docs": q(lambda g: quality.empty_documents(text.node_texts(g))),
        "row_parity": q(lambda g: quality.row_parity(g, text.triple_texts(g, S.PREFIX))),
        "leak_trivial": q(lambda g: quality.trivial_leaks(synonym_queries(g), g.nodes)),
        "leak_ambiguous": q(lambda g: quality.ambiguous_queries(synonym_queries(g), g.nodes)),
        "hash_sample": q(lambda g: profile.hash_sample(g.nodes.select("id", "category"), "id", "7", 1000)),
    }
    for name, (table, expression) in COMPOSITION.items():
        made[f"composition_{name}"] = q(lambda g, table=table, expression=expression: profile.breakdown(getattr(g, table), expression()))
    return made


def top_hubs(g: Graph, top: int = 20) -> DataFrame:
    """(id, name, category, deg): the nodes of highest degree."""
    named = g.degree().join(g.nodes.select("id", "name", "category"), "id")
    return named.orderBy(F.desc("deg"), "id").limit(top).select("id", "name", "category", "deg")


def entry(spark: SparkSession) -> DataFrame:
    return queries()["cut_hubs"](spark, "/root/testdata/sf0.001")
