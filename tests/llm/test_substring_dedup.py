from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import substring_dedup as substring_dedup_module
from tessera.llm.rolling import window_hashes
from tessera.llm.substring_dedup import covered, substring_dedup, text_uid


def brute(docs, window):
    """Equal rows are one document; of one id with several texts the text with the smaller hash is earlier."""
    seen, out = set(), {}
    for doc in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, text_uid((d[1] or "").encode()))):
        words = [w.decode() for w in (doc[1] or "").encode().split()]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def made(window, seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(6 if window == 4 else 400)] + ["É", "a b"]
    base = [[random.choice(vocabulary) for _ in range(random.randint(0, 60))] for _ in range(8)]
    docs = []
    for _ in range(60):
        words = []
        for _ in range(random.randint(0, 3)):
            if random.random() < 0.6:
                own = random.choice(base)
                at = random.randint(0, max(0, len(own) - 5))
                words += own[at : at + random.randint(5, 40)]
            words += [random.choice(vocabulary) for _ in range(random.randint(0, 20))]
        docs.append((random.randint(0, 10**6) if random.random() < 0.95 else None, random.choice([" ", "\n", " \t "]).join(words) if random.random() < 0.97 else None))
    return docs + [docs[3], docs[3], docs[7], (docs[5][0], docs[6][1]), (1, ""), (10**7, "loop " * 300)]


@pytest.mark.parametrize("filter_bits", [1 << 29, 64])
@pytest.mark.parametrize("window", [4, 20])
def test_words_WHEN_repeated_SHOULD_go_as_by_brute_force(spark, window, filter_bits):
    docs = made(window, window)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string").repartition(4)
    rows = substring_dedup(df, window=window, chunk_bytes=600, filter_bits=filter_bits).collect()
    want = brute(docs, window)
    assert sum(w[1] for w in want.values()) > 40
    got = sorted(((r.id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in rows), key=str)
    assert got == sorted(((d[0], *want[d]) for d in docs), key=str)


def test_words_WHEN_splits_change_between_readings_SHOULD_still_go(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(40))
    for i in (1, 2):
        spark.createDataFrame([(i, passage)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def split(*values):
        for name, value in zip(names, values):
            spark.conf.set(name, value)

    try:
        for before, after in ((("2", "10k", "10k"), ("1", "128m", "1")), (("1", "128m", "1"), ("2", "10k", "10k"))):
            split(*before)
            out = substring_dedup(spark.read.parquet(f"{tmp_path}/docs"))
            split(*after)
            assert sorted((r.id, r.n_removed) for r in out.collect()) == [(1, 0), (2, 40)]
    finally:
        for name in names:
            spark.conf.unset(name)


def test_tables_WHEN_empty_SHOULD_have_no_rows(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_WHEN_windows_overlap_or_end_SHOULD_mark_each_word_once():
    assert covered(6, np.array([0, 1, 4, 4]), 2).tolist() == [True, True, True, False, True, True]
    assert covered(0, np.empty(0, np.int64), 2).tolist() == []


def test_hashes_WHEN_windows_are_equal_SHOULD_be_equal():
    codes = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    hashes = window_hashes(codes, 3)
    windows = [tuple(codes[i : i + 3].tolist()) for i in range(2998)]
    assert len(hashes) == 2998 and len({(w, h) for w, h in zip(windows, hashes.tolist())}) == len(set(windows)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("bits", [0, 1, 3, 64])
def test_windows_WHEN_hashes_clash_in_a_chunk_SHOULD_be_compared_by_words(monkeypatch, bits):
    whole = substring_dedup_module.window_hashes
    monkeypatch.setattr(substring_dedup_module, "window_hashes", lambda codes, length: whole(codes, length) & np.uint64((1 << bits) - 1))
    docs = [(i, (t or "").encode()) for i, t in made(4, 11) if i is not None]
    docs = list({i: (i, t) for i, t in docs}.values())
    every = substring_dedup_module.HitFilter(1 << 13, 4)
    every.data[:] = 255
    ids, texts = [i for i, _ in docs], [t for _, t in docs]
    found = substring_dedup_module.Candidates(substring_dedup_module.Chunk(texts), ids, [text_uid(t) for t in texts], every, 4)
    got = {(ids[d], p) for d, p, r in zip(found.doc.tolist(), found.place.tolist(), found.repeat.tolist()) if r}
    seen, want = set(), set()
    for i, t in sorted(docs):
        words = t.split()
        for p in range(len(words) - 3):
            key = tuple(words[p : p + 4])
            if key in seen:
                want.add((i, p))
            seen.add(key)
    assert got == want and len(want) > 100
