from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from tessera.llm.decontaminate import WindowSet, find_hits, remove_documents, remove_spans, with_counts, words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=13):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "日本", "x_y"]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, line(random.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "--- !"), (53, "Same text here"), (54, "same   TEXT, here")]
    texts = [None, "", "...", "w1"]
    for _ in range(60):
        parts = [line(random.randint(0, 40))]
        if random.random() < 0.6:
            body = words(random.choice(items)[1])
            a = random.randint(0, max(0, len(body) - 13))
            parts.append(", ".join(body[a : a + random.choice([12, 13, 20])]).upper())
        parts.append(line(random.randint(0, 300)))
        texts.append("\n".join(parts))
    texts += texts[5:9] + ["x Same-text.here y", " ".join(words(items[5][1]) * 3)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id long, text string"), dict(enumerate(texts)), items


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_hits_WHEN_compared_SHOULD_equal_brute_force(tables, block_words):
    docs, benchmark, texts, items = tables
    rows = with_counts(find_hits(docs, benchmark, block_words=block_words)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in rows}
    assert got == {i: brute(t, items) for i, t in texts.items()}


def test_removal_WHEN_spans_or_documents_SHOULD_leave_the_rest(spark):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A, one TWO; three! b"), (2, "clean"), (3, None), (4, "one two " * 40 + "one two three")], "doc_id long, text string")
    assert dict(map(tuple, remove_spans(docs, benchmark).collect())) == {1: "A, ! b", 2: "clean", 3: None, 4: "one two " * 40}
    assert sorted(r.doc_id for r in remove_documents(docs, benchmark).collect()) == [2, 3, 4]


def test_tables_WHEN_empty_SHOULD_give_no_hits(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in with_counts(find_hits(docs, none)).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]
    assert find_hits(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_windows_WHEN_hashes_clash_SHOULD_be_told_apart(monkeypatch):
    monkeypatch.setattr("tessera.llm.decontaminate.window_hashes", lambda codes, n: np.zeros(max(0, len(codes) - n + 1), np.uint64))
    items = [("a", b"one two three", False), ("b", b"four five six", False), ("c", b"one two three", False), ("d", b"six", False)]
    [(spans, found)] = WindowSet(items, 3).hits([words_of(b"x one two three four five six")])
    assert spans == [(1, 7)] and found == {0, 1, 2, 3}


def test_set_WHEN_block_is_full_SHOULD_take_bounded_memory():
    rng = np.random.default_rng(1)
    items = [(str(i), b" ".join(b"w%d" % x for x in rng.integers(0, 10**9, 10_000)), False) for i in range(20)]  # 200,000 words, hardly one twice
    tracemalloc.start()
    WindowSet(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_scan_WHEN_text_is_very_long_and_hot_SHOULD_stay_whole(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"a {item} b") for i in range(300)] + [(1000, "x " * 600_000 + item)], "doc_id long, text string")
    rows = {r.doc_id: r for r in with_counts(find_hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert len(rows) == 301 and all(r.n_hit == 20 for r in rows.values()) and not rows[1000].contaminated and rows[0].contaminated
