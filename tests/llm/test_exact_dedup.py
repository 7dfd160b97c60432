from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import BloomFilter, LsmIndex, build_runs, drop_copies, exact_dedup, repeated_filter, sha256

ROWS = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, ""), (None, "text 1"), (None, "only null"), (None, "only null"), (5, "text 5"), (7, "other"), (7, "other"), (9, "é" * 50_000)]


weak = lambda text: hashlib.sha256(text).digest()[:1]  # noqa: E731  workers get a lambda by value


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, digest string").repartition(5)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest", [sha256, weak])
def test_groups_WHEN_texts_are_equal_SHOULD_keep_one(spark, keep, digest):
    rows = exact_dedup(frame(spark), keep=keep, digest=digest, memtable_rows=4).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""])) for i, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == want
    kept = [(r.doc_id, r.keep_id) for r in rows if r.kept]
    assert len(kept) == len(groups) and all(a == b for a, b in kept)


@pytest.mark.parametrize("digest", [sha256, weak])
def test_drop_WHEN_ids_repeat_SHOULD_leave_one_row_for_each_text(spark, digest):
    rows = drop_copies(frame(spark), digest=digest)
    texts = sorted(r.text or "" for r in rows.collect())
    assert texts == sorted({t or "" for _, t in ROWS}) and rows.columns == ["doc_id", "text", "digest"]


def test_tables_WHEN_empty_or_unique_SHOULD_work(spark):
    assert exact_dedup(frame(spark).limit(0)).count() == 0 and drop_copies(frame(spark).limit(0)).count() == 0
    assert drop_copies(frame(spark, [(1, "a"), (2, "b")])).count() == 2


def test_memtable_WHEN_full_SHOULD_leave_as_a_sorted_run():
    index, runs = LsmIndex(memtable_rows=5), []
    for k in range(43):
        runs += [run] if (run := index.put(sha256(bytes([k % 9])), k)) else []
        assert index.rows < 5
    runs.append(index.flush())
    assert len(runs) == 9 and all([d for d, _ in run] == sorted({d for d, _ in run}) for run in runs)
    assert sorted(k for run in runs for _, ids in run for k in ids) == list(range(43))


def test_runs_WHEN_flushed_SHOULD_have_a_filter_each_and_share_what_repeats(spark):
    docs = spark.createDataFrame([(i, f"t{i % 30 if i < 60 else i}") for i in range(120)], "id long, text string").repartition(3)
    runs = build_runs(docs, memtable_rows=10, bits=1 << 14).cache()
    assert runs.filter("digest IS NULL").count() == runs.select("run").distinct().count() >= 12
    known = repeated_filter(runs, 1 << 14)
    several = [bytes(r.digest) for r in runs.filter("digest IS NOT NULL").groupBy("digest").count().filter("count > 1").collect()]
    unique = [sha256(f"t{i}".encode()) for i in range(60, 120)]
    assert several and known.admits(several).all() and known.admits(unique).sum() < 10


@pytest.mark.parametrize("digest", [sha256, weak])
def test_hot_text_WHEN_in_every_chunk_SHOULD_be_dealt_and_verified(spark, monkeypatch, digest):
    monkeypatch.setattr("tessera.llm.exact_dedup.HOT_RUNS", 2)
    rows = [(i, "hot " * 50 if i % 3 else f"text {i}") for i in range(300)]
    got = exact_dedup(frame(spark, rows).repartition(12), memtable_rows=3, digest=digest).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(got) == 300 and len(hot) == 200 and {r.keep_id for r in hot} == {1} and sum(r.kept for r in got) == 101


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_filters_WHEN_too_small_SHOULD_change_no_result(spark, bits):
    rows = [(i, f"text {i % 50}") for i in range(140)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows), memtable_rows=7, filter_bits=bits).collect()}
    assert got == {(i, i % 50, 3 if i % 50 < 40 else 2, i < 50) for i in range(140)}


def test_filter_WHEN_added_SHOULD_admit_all_members():
    members, strangers = [sha256(bytes([i])) for i in range(200)], [sha256(bytes([i, 1])) for i in range(200)]
    own = BloomFilter(4096)
    own.add(members)
    assert own.admits(members).all() and own.admits(strangers).sum() < 20
