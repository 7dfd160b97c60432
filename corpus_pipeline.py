"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir). What it returns is written as Parquet and read again as the next one's docs;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.byte_bpe import digests, encode
from tessera.llm.common import materialize, named, private, table
from tessera.llm.decontaminate import remove_documents
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.language_id import identify, train
from tessera.llm.queries import bpe_ranks
from tessera.llm.simhash import keep_one
from tessera.sources.scratch import drop, scope


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents without a letter go, however unsure their language is or if none could be learned."""
    model = train(docs)
    if model is None:
        return docs.filter(named("text").rlike(r"\p{L}"))
    return identify(docs, model, label=(label := private(docs, "_lang_pred")), score=private(docs, "_score")).filter(named(label) != "und").select(*map(named, docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(encode(docs, bpe_ranks)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the recurrent network; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope(spark) as keep:  # what a stage wrote on its way goes as soon as its output is there
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
