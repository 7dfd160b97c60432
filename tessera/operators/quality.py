"""Invariants of the built tables, each as a DataFrame of counts; check() raises where one is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import normalised, present, with_row
from tessera.operators.graph import Graph

MAX_AMBIGUITY = 0.05


def unique_ids(table: DataFrame, key: str = "id") -> DataFrame:
    """(rows, distinct_ids): equal where ids are unique."""
    return table.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_ids"))


def dangling_edges(graph: Graph) -> DataFrame:
    """(dangling): edges with an end that is no node."""
    return graph.dangling().agg(F.count("*").alias("dangling"))


def row_parity(graph: Graph, triples: DataFrame) -> DataFrame:
    """(triples, named_edges): a document for each edge between named nodes."""
    named = graph.nodes.filter(present("name")).select("id")
    return with_row(triples.agg(F.count("*").alias("triples")), graph.induced_edges(named).agg(F.count("*").alias("named_edges")))


def empty_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(empty_docs): null, empty or blank."""
    return docs.agg(F.count_if(F.col(text).isNull() | (F.trim(text) == "")).alias("empty_docs"))


def trivial_leaks(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaks): queries that spell their target's own name."""
    same = queries.join(nodes.select(F.col("id").alias("target"), "name"), "target").filter(normalised("query") == normalised("name"))
    return same.agg(F.count("*").alias("leaks"))


def ambiguous_queries(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(queries, ambiguous, rate): queries that spell another node's name."""
    names = nodes.filter(present("name")).select(F.col("id").alias("other"), normalised("name").alias("spelled")).distinct()
    asked = queries.select("query", "target", normalised("query").alias("spelled"))
    hits = asked.join(names, "spelled").filter("other <> target").select("query", "target").distinct()
    out = with_row(asked.agg(F.count("*").alias("queries")), hits.agg(F.count("*").alias("ambiguous")))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("ambiguous", "queries"), F.lit(0.0)), 6))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(differing): rows of one that the other lacks, as multisets."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"))


def check(graph: Graph, triples: DataFrame, docs: DataFrame) -> None:
    """Raise on repeated ids, dangling edges, missing or empty documents."""
    ids, parity = unique_ids(graph.nodes).first(), row_parity(graph, triples).first()
    broken = {
        "repeated ids": ids.rows - ids.distinct_ids, "dangling edges": dangling_edges(graph).first().dangling,
        "missing triples": abs(parity.triples - parity.named_edges), "empty documents": empty_documents(docs).first().empty_docs,
    }
    if found := {k: v for k, v in broken.items() if v}:
        raise AssertionError(f"broken: {found}")
