from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.lexical_search import Best, Shard, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every item."""
    own = [(key, terms(t)) for key, t in docs]
    held = [(key, w) for key, w in own if w]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for key, w in held:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_words
            score = 0
            for t in set(terms(text)):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{int(300 * draw.random() ** 3)}" for _ in range(4_000)] + ["Über", "naïve", "x-y", "A1", "字"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 60)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "!? --"), (903, docs[0][1]), (903, docs[0][1]), (None, docs[1][1])]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 25)))) for i in range(25)] + [(70, None), (71, ""), (72, "unseen"), (73, "字 ÜBER über")]
    return docs, items


@pytest.mark.parametrize(("k", "entries", "block"), [(7, 1 << 21, 1 << 20), (3, 50, 1 << 20), (50, 900, 40)])
def test_search_WHEN_compared_SHOULD_equal_brute_force(spark, k, entries, block):
    docs, items = corpus(4)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(4)
    asked = spark.createDataFrame([*items, items[0]], "item_id int, text string")
    got = sorted(map(tuple, search(table, asked, k=k, shard_entries=entries, block_bytes=block).collect()), key=str)
    assert got == sorted(brute(docs, items, k), key=str)


def test_terms_WHEN_split_SHOULD_follow_the_pattern():
    for text in ("a.B_c'd", "É é ß_ß", "x\x00y\x7fz", "12a３", " a b", "tab\tnew\nline", "[x]{y}`z@"):
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_shard_WHEN_threshold_falls_SHOULD_stop_before_the_end():
    draw = np.random.default_rng(1)
    rows = []
    for i in range(3_000):
        own = np.flatnonzero(draw.random(6) < (0.9, 0.9, 0.9, 0.02, 0.02, 0.01))
        rows.append((i, 50, own.astype(np.int32).tobytes(), draw.integers(1, 4, len(own)).astype(np.int32).tobytes()))
    shard, best, weight = Shard([r for r in rows if r[2]], 6, 3_000, 150_000), Best(10), np.array([30, 20, 10, 4_000, 4_000, 5_000], np.int64)
    shard.search(np.arange(6, dtype=np.int32), weight, best)
    scores = [sum(int(weight[t]) * (10**9 * int(c) // (1000 * int(c) + 20 * 100)) for t, c in zip(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32))) for r in rows]
    assert sorted(scores, reverse=True)[:10] == best.scores.tolist() and shard.looked_up < 1_000 and not shard.seen.any()


def test_tables_WHEN_empty_or_keys_odd_SHOULD_be_defined(spark):
    docs, items = corpus(4)
    table = spark.createDataFrame(docs[:50], "doc_id int, text string")
    asked = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    assert {r.item_id[0] for r in search(table, asked).collect()} == {"i"}
    for a, b in ((table.limit(0), asked), (table, asked.limit(0)), (table.filter("doc_id < 0"), asked.limit(1)), (table, asked.filter("item_id = 'i71'"))):
        out = search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    with pytest.raises(TypeError, match="integers"):
        search(table.withColumn("doc_id", F.lit("x")), asked)
    one = spark.createDataFrame([(1, "a " * 1_000_000 + "b")], "doc_id int, text string")
    assert [tuple(r) for r in search(one, spark.createDataFrame([(1, "b")], "item_id int, text string")).collect()] == [tuple(x) for x in brute([(1, "a " * 1_000_000 + "b")], [(1, "b")], 50)]
