"""The pipeline against plain Python, stage by stage."""

from __future__ import annotations

import os

import pytest
from test_decontaminate import brute
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as pipeline
from tessera.llm.language_id import LanguageModel
from tessera.llm.queries import bpe_ranks, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    line = "the quick brown fox jumps over the lazy dog and runs away from there every single day"
    other = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    item = " ".join(f"question{chr(97 + i)}" for i in range(15))
    rows = [
        (1, line, "en"), (2, line, "en"), (3, other, "en"), (4, other + " end", "en"), (5, "x y " + item, "en"), (6, None, "en"), (7, "12 34", "en"), (8, "le chat noir dort sur la table", "fr"),
        (8, "le chat noir dort sur la table", "fr"), (None, "un chien sans nom court", "fr"), (9, "kurz", None),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [("1", item)]


@pytest.mark.parametrize("languages", [0, 5, 40])
def test_language_stage_WHEN_unsure_SHOULD_drop_only_texts_without_letters(spark, monkeypatch, languages):
    model = LanguageModel([f"l{i}" for i in range(languages)]).freeze() if languages else None
    if model:
        model.out[:] = 0  # every language has 1/k
    monkeypatch.setattr(pipeline, "train", lambda docs: model)
    docs = spark.createDataFrame([(1, "der the le el", "a", "s", 13), (2, "日", None, "s", 1), (3, "12 !", "a", "s", 4), (4, None, "a", "s", 0), (5, "", "a", "s", 0)], COLUMNS)
    out = pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_stages_WHEN_run_SHOULD_keep_one_clean_document_of_each_group(spark, folder):
    path, rows, items = folder
    left = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t))]
    left = list({t: (i, t) for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0), reverse=True)}.values())
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    groups = {}
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        groups.setdefault(roots[brute_fingerprint(t)], (i, t))
    want = [(i, t) for i, t in groups.values() if not brute(t, items)[3]]
    got = pipeline.run(spark, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in want)
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe_ranks(), "rb"))}
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode_ordinary(t)) for i, t in want}


def test_stages_WHEN_not_last_SHOULD_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_queries_WHEN_counted_SHOULD_have_a_row_for_each_document(spark):
    n, pages = spark.read.parquet(f"{DATA}/documents.parquet").count(), spark.read.parquet(f"{DATA}/pages.parquet").count()
    for name, query in queries().items():
        rows = query(spark, DATA).count()
        if name in ("pipeline", "op11_hard_negatives", "op12_lexical_search"):  # a row for each document that stays, or for each hit
            assert 0 < rows < (n if name == "pipeline" else 50 * n)
        else:
            assert rows == {"op2_url_filter": pages, "op7_warc": 2 * pages}.get(name, n)
