from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tessera.llm.components import connected_components, contracted, star_blocks
from tessera.llm.simhash import _edges_of, fingerprint, keep_one, links, segments, simhash_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    fps, out = sorted(set(fps)), {}
    for f in fps:
        if f not in out:
            stack, out[f] = [f], f
            while stack:
                at = stack.pop()
                for g in fps:
                    if g not in out and (at ^ g).bit_count() <= distance:
                        out[g] = f
                        stack.append(g)
    return out


def test_fingerprint_WHEN_short_empty_or_long_SHOULD_equal_brute_force():
    random.seed(1)
    texts = [None, "", " \t\n", "one", "One two THREE", "É é a b", "a\u00a0b c d e", "\x1c a b c d", "x " * 70_000]
    texts += [" ".join(random.choice("abcdefgh") for _ in range(random.randint(1, 60))) for _ in range(100)]
    assert all(fingerprint(t and t.encode()) == brute_fingerprint(t) for t in texts)


def test_segments_WHEN_distance_is_four_SHOULD_be_three():
    assert segments(4) == [(0, 21), (21, 21), (42, 22)] and segments(2) == [(0, 32), (32, 32)]


@pytest.mark.parametrize("distance", [2, 4])
def test_links_WHEN_clustered_SHOULD_give_the_components_of_all_pairs(spark, distance):
    random.seed(distance)
    fps = {random.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(random.choice([1, 3, 90])):
            g = f
            for b in random.sample(range(64), random.randint(1, distance + 2)):
                g ^= 1 << b
            fps.add(g)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    edges = links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in signed], distance)
    groups = lambda of: sorted(sorted(x) for x in _by(of).values())
    assert groups({f: roots.get(f, f) for f in signed}) == groups({f: want[f & (1 << 64) - 1] for f in signed})


def _by(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out


def test_edges_WHEN_group_is_large_SHOULD_be_a_forest():
    fps = np.array([1 << i for i in range(60)] + [0], np.int64)
    a, b = _edges_of(np.zeros(61, np.int64), fps, 4)
    assert len(a) == len(b) == 60
    node, root = contracted([(a, b)])
    assert sorted(node.tolist()) == sorted(fps.tolist())[1:] and set(root.tolist()) == {0}


def test_components_WHEN_path_is_long_SHOULD_reach_the_smallest(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (51, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(3, "a b c d e f"), (1, "A b C d e f"), (2, None), (4, ""), (5, " "), (None, "only here with a null id"), (None, "only here with a null id"), (9, "x y z q r"), (9, "x y z q r"), (9, "entirely other words stand here now")]


def test_rows_WHEN_odd_SHOULD_have_components(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, fp int").repartition(3)
    got = sorted(((r.id, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 2), (4, 2), (5, 2), (None, None), (None, None), (9, 9), (9, 9), (9, 9)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, (r.text or "")[:4].lower()) for r in kept.collect()) == [(0, "only"), (1, "a b "), (2, ""), (9, "enti"), (9, "x y ")]
    assert simhash_components(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_stars_WHEN_in_blocks_or_paths_SHOULD_keep_components():
    rng = np.random.default_rng(5)
    for limit in (4, 50, 1 << 20):
        pairs = [(rng.integers(0, 300, 20), rng.integers(0, 300, 20)) for _ in range(8)] + [(np.arange(1000, 1400), np.arange(1001, 1401))]
        stars = list(star_blocks(iter(pairs), limit))
        whole = contracted(pairs)
        again = contracted(stars)
        assert sorted(zip(*map(np.ndarray.tolist, whole))) == sorted(zip(*map(np.ndarray.tolist, again)))
        assert set(whole[1][np.isin(whole[0], np.arange(1001, 1401))].tolist()) == {1000}


def test_edges_WHEN_group_is_cut_again_SHOULD_keep_components(monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 43, 30, dtype=np.uint64) << np.uint64(21)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            fps.add(c ^ sum(1 << int(i) for i in rng.choice(np.arange(21, 64), rng.integers(0, 4), replace=False)))
    members = np.array(sorted(fps), np.uint64).view(np.int64)
    key = np.full(len(members), 3 << 48, np.int64)
    plain = contracted([_edges_of(key, members, 4)])
    monkeypatch.setattr("tessera.llm.simhash.LARGE_GROUP", 100)
    cut = contracted([_edges_of(key, members, 4)])
    assert len(plain[0]) and sorted(zip(*map(np.ndarray.tolist, plain))) == sorted(zip(*map(np.ndarray.tolist, cut)))
