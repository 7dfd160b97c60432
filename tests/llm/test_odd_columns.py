"""Every operator on tables with column names that need quoting or clash with its own, with nulls, repeats and other key types."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm.byte_bpe import digests, encode
from tessera.llm.decontaminate import find_hits, remove_documents, remove_spans, with_counts
from tessera.llm.exact_dedup import drop_copies, exact_dedup
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.language_id import identify, train
from tessera.llm.lexical_search import search
from tessera.llm.ngram_join import ngram_components
from tessera.llm.pseudonyms import pseudonymise
from tessera.llm.queries import URL_RULES, bpe_ranks, word_tokenizer
from tessera.llm.simhash import keep_one, simhash_components
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_store import read_store, write_store
from tessera.llm.url_filter import filter_urls
from tessera.llm.warc import derivatives, page_responses

EXTRA = ["meta.x", "a b", "_best", "_digest", "_bytes", "_key", "_kept", "_fp", "_root", "_own", "_subject", "_found", "_other", "_lang_pred", "_n_words", "Host", "N_Words", "digest", "fp", "root", "ids", "id_", "score_", "sel`ect"]
ROWS = [(1, "one two three four five", "en"), (1, "one two three four five", "en"), (2, "ein zwei drei", "de"), (2, "another text of id two", "en"), (3, None, None), (None, "one two three four five", "en"), (None, None, "de"), (4, "", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, lang, Row(**{"f g": 1, "h.i": [t or ""]})) for i, t, lang in ROWS], "doc_id long, text string, lang string, `a struct` struct<`f g`: int, `h.i`: array<string>>")
    return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(EXTRA)]).repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(9, "ein zwei drei", 1)], "item_id long, text string, `n.n` int")


def whole(out, docs):
    """All of docs' columns are there, with their values and types."""
    for c in EXTRA:
        assert out.schema[c] == docs.schema[c] and {r[0] for r in out.select(F.col("`" + c.replace("`", "``") + "`")).collect()} <= {f"x{EXTRA.index(c)}"}
    assert out.schema["a struct"].dataType == docs.schema["a struct"].dataType
    return out.count()


def test_rows_WHEN_columns_are_odd_SHOULD_keep_them(docs, benchmark):
    n = len(ROWS)
    renamed = docs.withColumnRenamed("Host", "kept_host").withColumnRenamed("N_Words", "kept_words")
    assert pseudonymise(docs, b"k").count() == n and whole(pseudonymise(docs, b"k"), docs) == n
    assert whole(identify(docs, train(docs, steps=3)), docs) == n
    hits = with_counts(find_hits(renamed, benchmark))
    assert hits.count() == n and hits.filter("contaminated").count() == 1 and "meta.x" in hits.columns
    assert "N_Words" not in find_hits(docs, benchmark).columns  # named like an output
    judged = filter_urls(docs.withColumn("url", F.lit("http://a.com/x")), URL_RULES)
    assert judged.count() == n and "Host" not in judged.columns and judged.select("`_best`", "`_subject`").distinct().collect() == [Row(_best="x2", _subject="x10")]
    made = derivatives(page_responses(docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html")), "d").withColumn("a b", F.lit(1)), keep=("page_id", "a b"))
    assert made.count() == 2 * n and made.columns[:2] == ["page_id", "a b"]


def test_removals_WHEN_columns_are_odd_SHOULD_return_all_of_them(spark, docs, benchmark):
    assert whole(drop_copies(docs), docs) == 4 and drop_copies(docs).columns == docs.columns
    assert whole(keep_one(docs), docs) == 4 and keep_one(docs).columns == docs.columns
    assert whole(remove_documents(docs, benchmark), docs) == 7 and whole(remove_spans(docs, benchmark), docs) == 8
    for _, stage in pipeline.STAGES[:1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and whole(out, docs) == 5


KEYED = {
    "exact_dedup": lambda d: exact_dedup(d).select("doc_id"), "simhash": lambda d: simhash_components(d).select("id"), "byte_bpe": lambda d: digests(encode(d, bpe_ranks)).select("id"),
    "token_store": lambda d: read_store(d.sparkSession, write_store(d, word_tokenizer, 2, vocabulary=49_408)).select("id"), "substring_dedup": lambda d: substring_dedup(d).select("id"),
    "ngram_join": lambda d: ngram_components(d).select("id"),
}


@pytest.mark.parametrize("name", KEYED)
def test_keys_WHEN_integers_SHOULD_stay_and_else_raise(docs, name):
    assert sorted(str(r[0]) for r in KEYED[name](docs).collect()) == sorted(str(i) for i, _, _ in ROWS)
    assert KEYED[name](docs.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == len(ROWS)
    assert KEYED[name](docs.limit(0)).count() == 0
    with pytest.raises(TypeError, match="integers"):
        KEYED[name](docs.withColumn("doc_id", F.concat(F.lit("u-"), F.col("doc_id"))))


def test_searches_WHEN_columns_are_odd_SHOULD_find_the_same(docs, benchmark):
    plain, named = docs.select("doc_id", "text"), lambda rows: sorted(map(str, rows.collect()))
    odd = docs.drop("ids", "id_").withColumnsRenamed({"doc_id": "i d.x", "text": "te`xt"})
    asked = benchmark.withColumn("doc_id", F.lit(5)).withColumnsRenamed({"item_id": "item.id", "text": "a b"})
    found = search(odd, asked, key="i d.x", text="te`xt", item_key="item.id", item_text="a b")
    assert found.columns == ["item.id", "rank", "i d.x", "score"] and [r[2] for r in found.collect()] == [2]
    assert named(ngram_components(odd, key="i d.x", text="te`xt")) == named(ngram_components(plain))
    vectors = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") * 20).alias("vec.id"), (F.col("doc_id") % 2).cast("int").alias("la bel"), F.array(F.lit(1.0), F.col("doc_id") / 10).alias("embe`d"), F.lit("x").alias("id"), F.lit("y").alias("bucket"))
    rows = hard_negatives(vectors, F.col("`vec.id`") > 0, key="vec.id", label="la bel", vector="embe`d")
    assert rows.count() > 0 and set(rows.columns) >= {"anchor_id", "positive_id", "negative_id", "rank"}
