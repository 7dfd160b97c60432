"""Documents from nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import present, readable, with_row
from tessera.operators.graph import Graph


def node_texts(graph: Graph) -> DataFrame:
    """(id, category, text): name, synonym field as it stands and description, joined by '. '; empty texts are dropped."""
    return graph.nodes.select("id", "category", F.concat_ws(". ", "name", "synonym", "description").alias("text")).filter(present("text"))


def triple_texts(graph: Graph, predicate_prefix: str) -> DataFrame:
    """(subject, predicate, object, text): 'subject name, predicate in words, object name' where both names are there."""
    side = lambda end, name: graph.nodes.filter(present("name")).select(F.col("id").alias(end), F.col("name").alias(name))
    named = graph.edges.select("subject", "predicate", "object").join(side("subject", "_s"), "subject").join(side("object", "_o"), "object")
    text = F.concat_ws(" ", "_s", readable("predicate", predicate_prefix), "_o")
    return named.select("subject", "predicate", "object", text.alias("text"))


def corpus_stats(graph: Graph, predicate_prefix: str) -> DataFrame:
    """(node_docs, nodes_dropped, with_description, avg_chars, triple_docs, triples_dropped); avg_chars over all nodes."""
    text = F.concat_ws(". ", "name", "synonym", "description")
    nodes = graph.nodes.agg(
        F.count_if(text != "").alias("node_docs"), F.count_if(text == "").alias("nodes_dropped"), F.count_if(present("description")).alias("with_description"),
        F.round(F.avg(F.length(text)), 6).alias("avg_chars"),
    )
    triples = triple_texts(graph, predicate_prefix).agg(F.count("*").alias("triple_docs"))
    edges = graph.edges.agg(F.count("*").alias("n_edges"))
    out = with_row(with_row(nodes, triples), edges)
    return out.withColumn("triples_dropped", F.col("n_edges") - F.col("triple_docs")).drop("n_edges")
