"""From questions to facts in one plan: predicates, candidates, the anchor, its edges.

Everything is keyed by question, so a thousand questions cost one scan of vectors and one of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import namespace
from tessera.operators.graph import Graph
from tessera.operators.vectors import batched_top_k, classify, within_margin
from tessera.sources.scratch import materialize

CANDIDATES = 25


def anchors_of(vectors: DataFrame, questions: DataFrame, k: int = CANDIDATES, *, question: str = "question_id") -> DataFrame:
    """(question, id, sim, rank): candidate nodes of each question."""
    return batched_top_k(vectors, questions, k, question=question)


def eligible(candidates: DataFrame, prefix: str, *, question: str = "question_id") -> DataFrame:
    """(question, id, rank) that can be chosen: a question's candidates of the namespace or, if it has none, its first one."""
    own, place = namespace("id") == prefix, F.struct("rank", "id")
    listed = candidates.groupBy(question).agg(F.min(place).alias("first"), F.collect_set(F.when(own, place)).alias("own"))
    return listed.select(question, F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("first"))).alias("c")).select(question, "c.id", "c.rank")


def disambiguate(graph: Graph, candidates: DataFrame, predicates: DataFrame, prefix: str, *, question: str = "question_id") -> DataFrame:
    """(question, anchor, rank, n_edges): in rank order the first candidate of the namespace that has an edge with one
    of the question's predicates; else the first of the namespace; else the first. Questions without candidates have no row.

    Only what can be chosen is counted."""
    return choose(graph, eligible(candidates, prefix, question=question), predicates, prefix, question=question)


def choose(graph: Graph, listed: DataFrame, predicates: DataFrame, prefix: str, *, question: str = "question_id") -> DataFrame:
    """disambiguate() of eligible candidates."""
    wanted = listed.join(predicates.select(question, "predicate"), question, "left")
    counted = graph.edge_count_of(materialize(wanted, "wanted"))  # candidates are dear, and read more than once
    own = namespace("id") == prefix
    priority = F.when(own & (F.col("n_edges") > 0), 0).when(own, 1).otherwise(2)
    best = counted.groupBy(question).agg(F.min(F.struct(priority.alias("priority"), "rank", "id", "n_edges")).alias("best"))
    return best.select(question, F.col("best.id").alias("anchor"), F.col("best.rank").alias("rank"), F.col("best.n_edges").alias("n_edges"))


def crawl(graph: Graph, vectors: DataFrame, questions: DataFrame, descriptions: DataFrame, prefix: str, margin: float, k: int = CANDIDATES, *, question: str = "question_id") -> DataFrame:
    """(question, anchor, predicate, predicate_rank, other_id, category, name, dir): the facts, in predicate order by predicate_rank."""
    near, asked = requests(graph, vectors, questions, descriptions, prefix, margin, k, question=question)
    return near.traverse(asked)


def requests(graph: Graph, vectors: DataFrame, questions: DataFrame, descriptions: DataFrame, prefix: str, margin: float, k: int = CANDIDATES, *, question: str = "question_id") -> tuple[Graph, DataFrame]:
    """(the graph to ask, (question, anchor, predicate, predicate_rank)): what a crawl asks of the edges, written out.

    All edges are read once, for those of the candidates: they tell the anchors and hold the facts."""
    chosen = materialize(within_margin(classify(questions, descriptions, question=question), margin, question=question), "chosen")
    listed = materialize(eligible(anchors_of(vectors, questions, k, question=question), prefix, question=question), "eligible")
    near = graph.vicinity(listed.select("id"), chosen)
    found = choose(near, listed, chosen, prefix, question=question)
    return near, materialize(found.select(question, "anchor").join(chosen.select(question, "predicate", "predicate_rank"), question), "requests")


def crawl_neighbours(graph: Graph, vectors: DataFrame, questions: DataFrame, descriptions: DataFrame, prefix: str, margin: float, k: int = CANDIDATES, *, question: str = "question_id") -> DataFrame:
    """neighbours() of crawl(), without the facts."""
    near, asked = requests(graph, vectors, questions, descriptions, prefix, margin, k, question=question)
    return near.neighbours(asked.select(question, "anchor", "predicate"))


def neighbours(facts: DataFrame, *, question: str = "question_id") -> DataFrame:
    """(question, anchor, other_id) distinct."""
    return facts.select(question, "anchor", "other_id").distinct()
