from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ngram_join import Cell, active_sets, links, ngram_components, repetition_filters, token_sets
from tessera.llm.queries import queries


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets):
    """Least id of each id's component, by comparing every pair that shares anything."""
    where, root = defaultdict(set), {i: i for i in sets}
    for i, own in sets.items():
        for g in own:
            where[g].add(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        for j in {j for g in own for j in where[g]} - {i}:
            both = len(own & sets[j])
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(draw, base, share):
    """A text with a share of its words replaced, and perhaps cut or continued."""
    words = [w if draw.random() > share else f"e{draw.randrange(400)}" for w in base]
    return words[draw.randrange(3) :] + [f"t{draw.randrange(9)}" for _ in range(draw.randrange(4))]


def corpus(seed, n):
    draw = random.Random(seed)
    bases = [[f"w{draw.randrange(300)}" for _ in range(draw.choice((4, 7, 20, 60, 200)))] for _ in range(12)]
    line = [f"c{i}" for i in range(30)]
    texts = [" ".join(edited(draw, draw.choice(bases), draw.choice((0, 0.005, 0.01, 0.03))) + (line if draw.random() < 0.3 else [])) for _ in range(n)]
    return dict(enumerate(texts + ["", "  ", None, "one", "ONE", "two words", "two\twords", texts[0], texts[0].upper()]))


@pytest.mark.parametrize("cell_sets", [8, 1024])
def test_components_WHEN_compared_SHOULD_equal_brute_force(spark, cell_sets):
    texts = corpus(5, 400)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_ngrams, r.component_id) for r in ngram_components(docs, cell_sets=cell_sets).collect()}
    sets = {i: grams(t) for i, t in texts.items()}
    want = components({i: s for i, s in sets.items() if s})
    assert got == {i: (len(s), want.get(i, i)) for i, s in sets.items()}
    assert len(set(want.values())) < 0.6 * len(want)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("threshold", [60, 80, 95])
def test_cell_WHEN_sets_are_random_SHOULD_join_all_linked_ones(seed, threshold):
    draw = np.random.default_rng(seed)
    tokens = []
    for _ in range(draw.integers(1, 5)):
        base = draw.integers(0, 2**63, draw.integers(2, 120)).astype(np.uint64)
        for _ in range(draw.integers(1, 40)):
            keep = base[draw.random(len(base)) > draw.choice((0, 0.02, 0.1, 0.3))]
            more = draw.integers(0, 300, draw.integers(0, 1 + len(base) // 6)).astype(np.uint64)
            tokens.append(np.unique(np.concatenate((keep, more, base[:1]))))
    cell = Cell(list(range(len(tokens))), tokens, threshold)
    root = list(range(len(tokens)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in cell.links():
        assert find(a) != find(b)  # a forest
        root[find(a)] = find(b)
    sets = [set(t.tolist()) for t in tokens]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= threshold * len(a | b):
                assert find(i) == find(j), (i, j)
    assert len({find(i) for i in range(len(sets))}) >= 1


def test_cell_WHEN_sets_are_alike_SHOULD_derive_and_skip():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, 400).astype(np.uint64)
    near = [np.unique(np.concatenate((base[draw.random(400) > 0.02], draw.integers(0, 2**63, 5).astype(np.uint64)))) for _ in range(120)]
    far = [np.unique(np.concatenate((base[:30], draw.integers(0, 2**63, n).astype(np.uint64)))) for n in range(20, 1_200, 20)]
    cell = Cell(list(range(180 - 1)), near + far)
    assert len(cell.links()) == 119 and cell.derived > 100 and cell.probed + cell.derived == 179 and cell.skipped > 0


def test_edges_WHEN_a_group_is_large_SHOULD_not_be_pairs(spark):
    base = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join([*base[:60], f"x{i}", *base[60:]])) for i in range(600)], "doc_id long, text string")
    sets = token_sets(docs).withColumn("node", F.col("id"))
    active = active_sets(sets, spark.sparkContext.broadcast(repetition_filters(sets, 4, 4, 1 << 20)), 80)
    assert active.count() == 600 and links(active, cell_sets=100).count() < 600 * 6
    assert {r.component_id for r in ngram_components(docs).collect()} == {0}


def test_rows_WHEN_odd_SHOULD_have_defined_results(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (7, "a b c d e f"), (7, "A B c d e f"), (7, "else"), (None, None), (9, long), (8, long + " more"), (None, "null only")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(3)
    got = sorted(((r.id, r.n_ngrams, r.component_id) for r in ngram_components(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 1, 7), (None, 0, None), (9, 199_996, 8), (8, 199_997, 8), (None, 1, None)], key=str)
    assert ngram_components(docs.limit(0)).count() == 0
    with pytest.raises(TypeError, match="integers"):
        ngram_components(docs.withColumn("doc_id", F.lit("x")))


def test_query_WHEN_registered_SHOULD_be_the_operator():
    assert {"op11_hard_negatives", "op12_lexical_search", "op13_ngram_join"} <= set(queries())
