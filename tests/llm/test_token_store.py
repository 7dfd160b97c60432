from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import word_tokenizer
from tessera.llm.token_store import PerfectHash, TokenStore, WordEncoder, fingerprints, read_store, write_store

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

PIECES = ["'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "re", "S", "Z1", "9", "½", "é", "É", " ", "　", "!", "$$", ",", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "́",
          "\x1c", "\x85", "😀", "​", "'S", "l", "e", "İ", "I", "̇", "Σ", "ς", "A", "»", "…", "̸", "=", "क़"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_tokenizer())


@pytest.mark.parametrize("width", [2, 4])
def test_words_WHEN_any_text_SHOULD_equal_the_library_on_the_whole(library, width, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_store.CACHE_WORDS", 700)
    random.seed(width)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 12))) for _ in range(8000)] + ["Plain words, in a LINE; again again!", "x" * 3000]
    own, end = WordEncoder(word_tokenizer(), width), (2).to_bytes(width, "little")
    got = [x for i in range(0, len(texts), 500) for x in own.encode([t.encode() for t in texts[i : i + 500]], end)]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, f"<u{width}").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_WHEN_built_SHOULD_be_minimal_and_turn_strangers_away(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash(table.sizes, table.words, table.rest)
    assert (again.slots(keys) == table.slots(keys)).all()
    prints = np.empty(len(keys), np.uint32)
    prints[table.slots(keys)] = fingerprints(keys)
    strangers = rng.integers(-(1 << 62), 1 << 62, 1000)
    slots = table.slots(strangers)
    assert ((slots >= 0) & (prints[slots] == fingerprints(strangers)) if len(keys) else np.zeros(1, bool)).sum() == 0


def test_hash_WHEN_levels_run_out_SHOULD_search_the_rest(monkeypatch):
    monkeypatch.setattr("tessera.llm.token_store.LEVELS", 1)
    keys = np.arange(500) * 7
    table = PerfectHash.build(keys)
    assert len(table.rest) and sorted(table.slots(keys).tolist()) == list(range(500))
    assert (table.slots(np.array([3, 3500])) < 500).all()


def test_store_WHEN_read_back_SHOULD_follow_key_order(spark, library):
    random.seed(3)
    rows = [(random.randint(-(10**12), 10**12), " ".join(random.choice(["one", "Two,", "é", "x9"]) for _ in range(random.randint(0, 50)))) for _ in range(300)]
    rows += [(None, "no key"), (7, None), (7, "again"), (8, "same"), (8, "same")]
    manifest = write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), word_tokenizer, 2, vocabulary=49_408)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in read_store(spark, manifest).collect())
    start, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    store = TokenStore(manifest)
    assert [x.tolist() for x in store.get(7)] == [[2], [*library.encode("again", add_special_tokens=False).ids, 2]]
    assert len(store.get(8)) == 2 and store.get(123456789) == [] and store.get(-(10**15)) == []


def test_store_WHEN_empty_SHOULD_have_no_rows(spark):
    manifest = write_store(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer, 2, vocabulary=49_408)
    assert read_store(spark, manifest).count() == 0 and TokenStore(manifest).get(1) == []


def test_words_WHEN_long_and_distinct_SHOULD_not_stay_in_the_cache(library, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_store.CACHE_BYTES", 50_000)
    rng = random.Random(4)
    own = WordEncoder(word_tokenizer(), 2)
    for size in (30, 2000):
        made = ["".join(rng.choice("abcdefg") for _ in range(size)) + random.choice(["", "!,"]) for _ in range(400)]
        for i in range(0, 400, 50):
            got = list(own.encode([t.encode() for t in made[i : i + 50]], b"\2\0"))
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in made[i : i + 50]]
        assert sum(200 + len(k) + len(v) for half in (own.young, own.old) for k, v in half.items()) < 300_000 and all(len(k) <= 256 for k in own.young)


def test_store_WHEN_one_key_is_most_rows_or_a_text_is_long_SHOULD_read_all_back(spark, library, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_store.READ_BYTES", 64)
    rows = [(7 if i % 3 else None, f"text number {i} " * (1 + i % 5)) for i in range(200)] + [(9, "long " * 200_000)]
    manifest = write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), word_tokenizer, 2, vocabulary=49_408)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in read_store(spark, manifest).collect())
    start, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((start, key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and len(TokenStore(manifest).get(7)) == sum(k == 7 for k, _ in rows)


def test_shards_WHEN_the_input_grows_SHOULD_keep_their_size(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    sizes = []
    for k in (1, 4):
        grown = docs.select((F.col("doc_id") * k).alias("doc_id"), "text") if k == 1 else docs.select(F.explode(F.sequence(F.col("doc_id") * k, F.col("doc_id") * k + k - 1)).alias("doc_id"), "text")
        manifest = write_store(grown, word_tokenizer, 2, vocabulary=49_408, shard_bytes=4_000).collect()
        sizes.append((len(manifest), sum(r.n_ids for r in manifest) / len(manifest)))
    assert sizes[0][0] >= 8 and 3 <= sizes[1][0] / sizes[0][0] <= 5 and 0.7 < sizes[1][1] / sizes[0][1] < 1.4
