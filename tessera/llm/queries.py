"""The registered queries of the training-data operators: thin forms over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import digests, encode
from tessera.llm.common import table
from tessera.llm.decontaminate import find_hits, with_counts
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.language_id import held_out, identify, train
from tessera.llm.lexical_search import search
from tessera.llm.ngram_join import ngram_components
from tessera.llm.pseudonyms import pseudonymise
from tessera.llm.simhash import simhash_components
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_store import read_store, write_store
from tessera.llm.url_filter import Rule, filter_urls
from tessera.llm.warc import derivatives, page_responses

URL_RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


#: Production takes the key from its secret store; the registered query has a fixed one, so that its result can be checked.
PSEUDONYM_KEY = b"registered-query"
#: Pages carry no date of their own.
WARC_DATE = "2024-01-01T00:00:00Z"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return rows.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join("pii_kinds", ",").alias("kinds"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_counts(find_hits(docs, table(spark, sf_dir, "benchmark")))
    items = F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("hit_items", ","), "utf-8"), 256).alias("items_sha256")
    return hits.select("doc_id", "n_words", "n_hit", *items, "contaminated")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def bpe_ranks() -> str:
    """The rank file, on whichever machine this runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), bpe_ranks)).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derivatives(page_responses(table(spark, sf_dir, "pages"), WARC_DATE), keep=("page_id",))
    return rows.withColumn("block", F.decode("block", "utf-8"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_store(table(spark, sf_dir, "documents"), word_tokenizer, 2, vocabulary=49_408)
    return read_store(spark, manifest).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(table(spark, sf_dir, "documents"), hashed=True)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_components(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_ngrams").alias("n_shingles"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pseudonyms": op1_pseudonyms,
        "op2_url_filter": op2_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_warc": op7_warc,
        "op8_simhash": op8_simhash,
        "op9_token_store": op9_token_store,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_lexical_search": op12_lexical_search,
        "op13_ngram_join": op13_ngram_join,
        "pipeline": pipeline,
    }


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM cut
), urls AS (
  SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1), '') AS path FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM urls u LEFT JOIN best b USING (page_id)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), sizes AS (
  SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item FROM spots JOIN windows USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list(DISTINCT item ORDER BY item), ',') AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), spots AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM spots) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM repeated)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.line, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER best <= 5
"""

TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL
), sizes AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), reached AS (
  SELECT x AS doc_id, y AS other FROM links UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(w.doc_id, min(other)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id) GROUP BY w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op10_substring_dedup": OP10_SQL,
        "op11_hard_negatives": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_ngram_join": OP13_SQL,
    }
