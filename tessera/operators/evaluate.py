"""Gold sets from the graph itself, and scores against them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import namespace, normalised, parse_synonyms, present
from tessera.operators.graph import Graph
from tessera.operators.order import hash_sample, order_statistics, upper_median
from tessera.sources.readers import QuestionType

RECALL_AT = (1, 5, 10)
LEAST_PER_NAMESPACE = 20


def answer_pairs(graph: Graph, kind: QuestionType, prefix: str) -> DataFrame:
    """(anchor, answer) by a question type's direction, predicates and namespaces; parallel edges repeat."""
    anchor, answer = ("subject", "object") if kind.direction == "out" else ("object", "subject")
    edges = graph.edges.filter(F.col("predicate").isin(list(kind.predicates)) & F.col(anchor).startswith(f"{prefix}:") & F.col(answer).startswith(f"{kind.answer_ns}:"))
    return edges.select(F.col(anchor).alias("anchor"), F.col(answer).alias("answer"))


def gold_cases(graph: Graph, types: Sequence[QuestionType], prefix: str, seed: str, per_type: int) -> DataFrame:
    """(id, type, question, anchor, answer_entities): per type named anchors with enough answers, sampled by hash."""
    named = graph.anchors(prefix).filter(present("name")).select(F.col("id").alias("anchor"), "name")

    def cases(kind: QuestionType) -> DataFrame:
        pairs = answer_pairs(graph, kind, prefix).distinct()
        counts = pairs.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= kind.min_answers)
        chosen = hash_sample(counts.join(named, "anchor").select("anchor", "name"), "anchor", seed, per_type)
        answers = pairs.join(F.broadcast(chosen), "anchor").groupBy("anchor", "name").agg(F.sort_array(F.collect_set("answer")).alias("answer_entities"))
        question = F.replace(F.lit(kind.template), F.lit("{disease}"), F.col("name"))
        return answers.select(F.concat(F.lit(f"{kind.name}-"), F.col("anchor")).alias("id"), F.lit(kind.name).alias("type"), question.alias("question"), "anchor", "answer_entities")

    return reduce(DataFrame.unionByName, [cases(t) for t in types])


def gold_summary(cases: DataFrame) -> DataFrame:
    """(type, cases, median_answers, max_answers): of an even number the upper median."""
    sizes = cases.select("type", F.size("answer_entities").alias("answers"))
    median = order_statistics(sizes, ["type"], "answers", [upper_median]).select("type", F.col("value").cast("int").alias("median_answers"))
    counts = sizes.groupBy("type").agg(F.count("*").alias("cases"), F.max("answers").alias("max_answers"))
    return counts.join(median, "type").select("type", "cases", "median_answers", "max_answers")


def surfaced_nodes(ranked: DataFrame) -> DataFrame:
    """(id, hit): a node hit is the node itself."""
    return ranked.select("id", F.col("key").alias("hit")).distinct()


def surfaced_triples(ranked: DataFrame) -> DataFrame:
    """(id, hit): a triple surfaces both its ends."""
    return ranked.select("id", F.explode(F.array("subject", "object")).alias("hit")).distinct()


def score(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, type, recall, anchor_hit) of every case against (id, hit); recall is 0 without answers."""
    answers = cases.select("id", F.explode("answer_entities").alias("hit")).distinct()
    found = answers.join(hits.distinct(), ["id", "hit"]).groupBy("id").agg(F.count("*").alias("found"))
    anchors = cases.select("id", F.col("anchor").alias("hit")).join(hits.distinct(), ["id", "hit"]).select("id", F.lit(1.0).alias("anchor_hit")).distinct()
    rows = cases.join(found, "id", "left").join(anchors, "id", "left")
    recall = F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)), F.size(F.array_distinct("answer_entities"))), F.lit(0.0))
    return rows.select("id", "type", recall.alias("recall"), F.coalesce("anchor_hit", F.lit(0.0)).alias("anchor_hit"))


def score_crawl(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """As score(), with facts (id, anchor, other_id): recall over the neighbours, and whether the anchor is the right one."""
    hits = facts.select("id", F.col("other_id").alias("hit")).distinct()
    right = facts.select("id", F.col("anchor").alias("_anchor")).distinct()
    recall = score(cases, hits).drop("anchor_hit")
    exact = cases.select("id", "anchor").join(right, "id", "left").groupBy("id").agg(F.max(F.coalesce((F.col("anchor") == F.col("_anchor")).cast("double"), F.lit(0.0))).alias("anchor_hit"))
    return recall.join(exact, "id").select("id", "type", "recall", "anchor_hit")


def means(scores: DataFrame, types: Sequence[str]) -> DataFrame:
    """(type, n, recall, anchor_hit) per type and overall; a type without cases has 0."""
    spark = scores.sparkSession
    labelled = scores.select(F.explode(F.array("type", F.lit("overall"))).alias("type"), "recall", "anchor_hit")
    mean = labelled.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("anchor_hit"), 6).alias("anchor_hit"))
    names = spark.createDataFrame([(t,) for t in [*types, "overall"]], "type string")
    return names.join(mean, "type", "left").na.fill(0, ["n", "recall", "anchor_hit"])


def calibrate(cases: DataFrame, scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(type, true_score, distractor_score, gap): mean best score of a case's true predicates and of the others.

    scores: id, predicate, score; truth: type, predicate."""
    rows = cases.select("id", "type").join(scores, "id").join(truth.withColumn("true", F.lit(True)), ["type", "predicate"], "left")
    best = rows.groupBy("id", "type").agg(F.max(F.when(F.col("true"), F.col("score"))).alias("t"), F.max(F.when(F.col("true").isNull(), F.col("score"))).alias("d"))
    out = best.groupBy("type").agg(F.avg("t").alias("t"), F.avg("d").alias("d"))
    return out.select("type", F.round("t", 6).alias("true_score"), F.round("d", 6).alias("distractor_score"), F.round(F.col("t") - F.col("d"), 6).alias("gap"))


def synonym_gallery(graph: Graph, seed: str, size: int) -> DataFrame:
    """(id, name): a hashed sample of named nodes."""
    return hash_sample(graph.nodes.filter(present("name")).select("id", "name"), "id", seed, size)


def synonym_queries(graph: Graph, seed: str, n: int) -> DataFrame:
    """(query, target, ns): of 3n candidates with synonyms, in hash order, each one's first synonym that differs from its name; the first n."""
    named = graph.nodes.filter(present("name") & present("synonym")).select("id", "name", "synonym")
    candidates = hash_sample(named, "id", seed, 3 * n)
    other = F.get(F.filter(parse_synonyms("synonym"), lambda s: normalised(s) != normalised("name")), F.lit(0))
    queries = candidates.select("id", other.alias("query")).filter("query IS NOT NULL")
    return hash_sample(queries, "id", seed, n).select("query", F.col("id").alias("target"), namespace("id").alias("ns"))


def with_targets(gallery: DataFrame, queries: DataFrame, graph: Graph) -> DataFrame:
    """The gallery with every query's target."""
    targets = graph.nodes.join(queries.select(F.col("target").alias("id")).distinct(), "id", "left_semi").select("id", "name")
    return gallery.unionByName(targets).distinct()


def _quality(rank: Column) -> list[Column]:
    hits = [F.round(F.avg((rank <= k).cast("int")), 6).alias(f"recall_at_{k}") for k in RECALL_AT]
    return [F.count("*").alias("n"), F.round(F.avg(1.0 / rank), 6).alias("mrr"), *hits]


def rank_quality(ranks: DataFrame) -> DataFrame:
    """(n, mrr, recall_at_1, recall_at_5, recall_at_10) of ranks."""
    return ranks.agg(*_quality(F.col("rank")))


def rank_quality_by(ranks: DataFrame, by: str, least: int = LEAST_PER_NAMESPACE) -> DataFrame:
    """As rank_quality for each value that has at least `least` ranks, the most frequent first."""
    return ranks.groupBy(by).agg(*_quality(F.col("rank"))).filter(F.col("n") >= least).orderBy(F.desc("n"), by)

