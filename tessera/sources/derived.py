"""A property graph derived from the star-schema tables, for tests and registered queries.

Regions, nations, customers, suppliers, parts and orders are nodes; the foreign keys are edges. Orders whose key is a
multiple of 97 have no node, so some edges dangle. Vectors of `embeddings` stand for suppliers and parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import Graph

NODE_COLUMNS = ("id", "category", "name", "synonym", "description", "in_taxon_label", "deprecated")
EDGE_COLUMNS = ("subject", "object", "predicate", "knowledge_level", "agent_type", "primary_knowledge_source")
ALLOWLIST = ("CUST", "SUPP", "PART", "ORD", "NATION")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def _nodes(df: DataFrame, node_id: Column, category: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(node_id.alias("id"), F.lit(f"kg:{category}").alias("category"), *[columns.get(c, none).alias(c) for c in NODE_COLUMNS[2:]])


def derived_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    flag = lambda key, n: F.when(F.col(key) % n == 0, "True")
    taxon = F.when(F.col("s_suppkey") % 4 == 0, "Homo sapiens").when(F.col("s_suppkey") % 4 == 1, "Mus musculus")
    brand, kind = F.col("p_brand"), F.col("p_type")
    sets = [
        _nodes(_table(spark, sf_dir, "region"), _id("REGION", "r_regionkey"), "Region", name=F.col("r_name")),
        _nodes(_table(spark, sf_dir, "nation"), _id("NATION", "n_nationkey"), "Nation", name=F.col("n_name"),
               synonym=listed("[", F.lower("n_name"), ", N", F.col("n_nationkey").cast("string"), "]")),
        _nodes(_table(spark, sf_dir, "customer"), _id("CUST", "c_custkey"), "Customer", name=F.when(F.col("c_custkey") % 37 != 0, F.col("c_name")),
               synonym=listed("[", F.col("c_mktsegment"), "]"), deprecated=flag("c_custkey", 29)),
        _nodes(_table(spark, sf_dir, "supplier"), _id("SUPP", "s_suppkey"), "Supplier", name=F.col("s_name"), in_taxon_label=taxon, deprecated=flag("s_suppkey", 13)),
        _nodes(_table(spark, sf_dir, "part"), _id("PART", "p_partkey"), "Part", name=F.col("p_name"),
               synonym=listed("[", brand, ", '", brand, ", ", kind, "']"), description=F.when(F.col("p_partkey") % 3 == 0, listed(kind, " ", brand))),
        _nodes(_table(spark, sf_dir, "orders").filter("o_orderkey % 97 <> 0"), _id("ORD", "o_orderkey"), "Order",
               name=F.when(F.col("o_orderkey") % 41 != 0, listed("Order ", F.col("o_orderkey").cast("string")))),
    ]
    return reduce(DataFrame.unionByName, sets)


def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")

    def edges(df: DataFrame, subject: Column, object_: Column, predicate: str, *provenance: Column) -> DataFrame:
        own = [*provenance, none, none, none][:3]
        return df.select(subject.alias("subject"), object_.alias("object"), F.lit(f"kg:{predicate}").alias("predicate"), *[c.alias(n) for c, n in zip(own, EDGE_COLUMNS[3:])])

    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    levels = F.col("l_returnflag"), F.col("l_linestatus")
    sets = [
        edges(_table(spark, sf_dir, "nation"), _id("NATION", "n_nationkey"), _id("REGION", "n_regionkey"), "part_of"),
        edges(_table(spark, sf_dir, "customer"), _id("CUST", "c_custkey"), _id("NATION", "c_nationkey"), "located_in"),
        edges(_table(spark, sf_dir, "supplier"), _id("SUPP", "s_suppkey"), _id("NATION", "s_nationkey"), "located_in"),
        edges(orders, _id("ORD", "o_orderkey"), _id("CUST", "o_custkey"), "placed_by", none, none, F.col("o_orderpriority")),
        edges(items, _id("ORD", "l_orderkey"), _id("PART", "l_partkey"), "contains", *levels),
        edges(items, _id("SUPP", "l_suppkey"), _id("PART", "l_partkey"), "supplies", *levels),
    ]
    return reduce(DataFrame.unionByName, sets)


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(derived_nodes(spark, sf_dir), derived_edges(spark, sf_dir))


def derived_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, id, label, embedding): vector 5k stands for supplier k if there is one, any other k for part k if there is one."""
    vectors = _table(spark, sf_dir, "embeddings")
    suppliers = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("vec_id"), F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string")).alias("supplier"))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), _id("PART", "p_partkey").alias("part"))
    joined = vectors.join(suppliers, "vec_id", "left").join(parts, "vec_id", "left")
    return joined.select("vec_id", F.coalesce("supplier", "part").alias("id"), "label", "embedding").filter("id IS NOT NULL")
