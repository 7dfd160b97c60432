"""The commands one after another, from a raw dump to scores."""

from __future__ import annotations

import os

import pytest

from tessera import cli
from tessera.operators import vectors
from tessera.sources import readers

CONFIG = """
namespace_allowlist: [D, X, G]
diseases: [flu, cold]
predicate_cuts: [{label: all, drop: []}, {label: less, drop: [k:has]}]
relevance_cuts: [{label: all}, {label: human, drop_nonhuman: true}]
types:
  - {name: sign, template: 'signs of {disease}', direction: out, predicates: [k:has], answer_ns: X, min_answers: 1}
margin: 0.9
predicates: {k:has: signs symptoms, k:causes: gene cause}
"""


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    global HOME
    path = tmp_path_factory.mktemp("home")
    HOME = str(path)
    nodes = ["id\tname\tcategory\tdeprecated\tin_taxon\tin_taxon_label\tdescription\tsynonym", "D:1\tflu\tk:D\t\t\t\tan illness\t[grippe]", "D:2\tcommon \"cold\"\tk:D\t\t\t\t\t",
             "X:1\tfever\tk:X\t\t\t\t\t[heat, 'high, hot']", "X:2\tcough\tk:X\t\t\t\t\t", "G:1\tgene\tk:G\t\t\tMus musculus\t\t", "Z:1\tother\tk:Z\t\t\t\t\t"]
    edges = ["subject\tobject\tpredicate\tknowledge_level\tagent_type\tprimary_knowledge_source", "D:1\tX:1\tk:has\ta\t\t", "D:1\tX:2\tk:has\ta\t\t", "D:2\tX:2\tk:has\t\t\t", "G:1\tD:1\tk:causes\t\t\t", "Z:1\tD:1\tk:has\t\t\t"]
    (path / "nodes.raw").write_text("\n".join(nodes) + "\n")
    (path / "edges.raw").write_text("\n".join(edges) + "\n")
    (path / "config.yaml").write_text(CONFIG)
    go = lambda *words: cli.run(spark, [*words, "--home", str(path), "--config", str(path / "config.yaml"), "--anchor", "D", "--predicate-prefix", "k:"])
    audit = go("extract", "--nodes", str(path / "nodes.raw"), "--edges", str(path / "edges.raw"), "--expect-nodes", "4", "--expect-edges", "3", "--tsv").first()
    assert tuple(audit) == (4, 3, 0, 0)
    assert go("text").first().triple_docs == 3 and go("load").first().rows == 4
    assert go("embed", "node").first().docs == 4 and go("embed", "triple").first().docs == 3
    assert go("gold").first().cases == 2
    return go


def test_extract_WHEN_count_is_unexpected_SHOULD_raise(home, tmp_path):
    with pytest.raises(Exception):
        home("extract", "--nodes", "none", "--edges", "none").collect()


def test_retrieve_WHEN_text_is_a_document_SHOULD_find_it(home):
    assert home("retrieve", "fever", "-k", "1").first().id == "X:1"
    assert home("retrieve", "flu has cough", "--corpus", "triple", "-k", "1").first()[:3] == ("D:1", "k:has", "X:2")


def test_crawl_WHEN_asked_SHOULD_find_anchor_and_facts(home):
    assert home("anchor", "flu").first().id == "D:1"
    assert home("disambiguate", "flu signs").first().anchor == "D:1"
    assert sorted(r.other_id for r in home("crawl", "flu signs symptoms").collect()) == ["X:1", "X:2"]
    assert sorted(r.name for r in home("traverse", "D:1", "k:has").collect()) == ["cough", "fever"]
    assert home("classify", "symptoms").first().predicate == "k:has" and home("classify", "--calibrate").count() == 1


@pytest.mark.parametrize("corpus", ["node", "triple", "crawl"])
def test_score_WHEN_gold_is_there_SHOULD_have_types_and_overall(home, corpus):
    assert {r.type: r.n for r in home("score", "--corpus", corpus).collect()} == {"sign": 2, "overall": 2}


def test_synonyms_and_throughput_WHEN_run_SHOULD_report(home):
    assert home("synonyms", "5", "5").first().n == 2 and home("throughput", "node").first().docs == 4


@pytest.mark.parametrize("what", cli.SHAPES)
def test_shape_WHEN_asked_SHOULD_have_rows(home, what):
    assert home("shape", what, "--usage-predicate", "k:has").count() > 0


def test_extract_WHEN_the_audit_fails_SHOULD_leave_the_old_tables(home, spark, tmp_path):
    path = home("traverse", "D:1", "k:has").inputFiles()  # the store is read
    with pytest.raises(AssertionError):
        home("extract", "--nodes", HOME + "/nodes.raw", "--edges", HOME + "/edges.raw", "--expect-nodes", "99")
    assert any("edges_by_subject" in f for f in path)
    tables = readers.Snapshots(spark, HOME)
    used = {place.split("/")[0] for place in tables.tables().values()}
    assert tables.table("nodes").count() == 4 and {f for f in os.listdir(HOME) if f.startswith("v-")} == used


def test_vectors_WHEN_asked_with_another_model_SHOULD_raise(home):
    with pytest.raises(ValueError, match="hashed"):
        home("retrieve", "fever", "--model", "other")


def test_vectors_WHEN_sizes_differ_SHOULD_raise(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="expected 7"):
        vectors.embed_corpus(docs, vectors.HashedNgrams, dimension=7).collect()
