"""Schemas of the graph's inputs and outputs. Dumps are read as text throughout; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T


def text_columns(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_NODES = text_columns(["id", "name", "category", "deprecated", "in_taxon", "in_taxon_label", "description", "synonym"])
RAW_EDGES = text_columns(["subject", "object", "predicate", "knowledge_level", "agent_type", "primary_knowledge_source"])
GOLD = "id string, type string, question string, anchor string, answer_entities array<string>"
SYNONYM_QUERY = "query string, target string, ns string"
