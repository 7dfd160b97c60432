from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.expressions import cosine, parse_synonyms
from tessera.operators import evaluate, quality, text
from tessera.operators.graph import Graph
from tessera.sources import readers


@pytest.mark.parametrize(
    ("field", "items"),
    [
        ("[a, 'b, with comma', c]", ["a", "b, with comma", "c"]), ('["x", y ]', ["x", "y"]), ("[x's y, z]", ["xs y, z"]), ("[]", []), ("[a,,b]", ["a", "b"]),
        ("a, b", []), ("", []), (None, []), ("[", []), ("[ab", ["a"]), ("['it\"s', \"o'k\"]", ['it"s', "o'k"]),
    ],
)
def test_synonyms_WHEN_list_shaped_SHOULD_split_outside_quotes(spark, field, items):
    assert spark.createDataFrame([(field,)], "f string").select(parse_synonyms("f").alias("x")).first().x == items


def test_synonyms_WHEN_field_is_long_SHOULD_take_no_time(spark):
    field = "[" + ", ".join(f"'item {i}, with comma', plain {i}" for i in range(3_000)) + "]"
    frame = spark.createDataFrame([(field,)], "f string").repartition(1)
    began = time.time()
    got = frame.select(parse_synonyms("f").alias("x")).first().x
    assert len(field) > 100_000 and time.time() - began < 4 and got == [x for i in range(3_000) for x in (f"item {i}, with comma", f"plain {i}")]


def characters(text):
    """The list again, character by character."""
    if text is None or not text.startswith("["):
        return []
    out, item, quote = [], "", ""
    for c in text[1:-1]:
        if quote:
            quote, item = ("", item) if c == quote else (quote, item + c)
        elif c in "'\"":
            quote = c
        elif c == ",":
            out, item = [*out, item], ""
        else:
            item += c
    return [x for x in (y.strip(" \t\n\x0b\f\r") for y in [*out, item]) if x]


def test_synonyms_WHEN_random_SHOULD_equal_reading_by_characters(spark):
    draw = random.Random(9)
    fields = ["[" + "".join(draw.choices("ab ,,'\"\n\\$\x01\x02]é", k=draw.randint(0, 14))) + draw.choice(("]", "")) for _ in range(500)]
    got = spark.createDataFrame([(f,) for f in fields], "f string").select("f", parse_synonyms("f").alias("x")).collect()
    assert [(r.f, r.x) for r in got if r.x != characters(r.f)] == []


def test_dump_WHEN_quotes_and_backslashes_SHOULD_pass_unchanged(spark, tmp_path):
    (tmp_path / "dump.tsv").write_text('id\tname\nA:1\ta "quoted" \\ name\nA:2\t"open\n')
    assert [r.name for r in readers.read_dump(spark, str(tmp_path / "dump.tsv")).orderBy("id").collect()] == ['a "quoted" \\ name', '"open']


def test_export_WHEN_written_SHOULD_read_back(spark, tmp_path):
    df = spark.createDataFrame([("A:1", 'say "hi"\tnow'), ("A:2", "two\nlines"), ("A:3", None)], "id string, name string")
    readers.write_export(df, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_export(spark, str(tmp_path / "out"), df.schema).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [40, 170, 1 << 20])
def test_export_WHEN_read_in_splits_SHOULD_equal_the_multiline_reader(spark, tmp_path, size):
    draw = random.Random(size)
    words = ["a", "say \"hi\"", "two\nlines", "\n", "\"", "\"\"", "tab\there", "", None, "x\n\n\"y\"\n", "é ü", "long " * 30, "\n\"\n\"\n", "end\"", "\"start"]
    table = [(f"A:{i}", draw.choice(words), draw.choice(words)) for i in range(120)]
    df = spark.createDataFrame(table, "id string, name string, note string")
    readers.write_export(df.coalesce(2), str(tmp_path / "out"))
    plain = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, quote='"', escape='"', multiLine=True, schema=df.schema)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        n = spark.read.text(str(tmp_path / "out")).rdd.getNumPartitions()
        got = sorted(map(str, readers.read_export(spark, str(tmp_path / "out")).collect()))
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert got == sorted(map(str, plain.collect())) and len(got) == 120 and (n > 20 if size < 200 else n < 5)


def test_export_WHEN_lines_end_in_crlf_or_are_blank_SHOULD_read_the_same(spark, tmp_path):
    (tmp_path / "x.tsv").write_bytes(b'id\t"na ""me"""\r\n1\t"a\r\nb"\r\n\r\n2\tplain\r\n\n3\t\n4\t"no end of line"')
    got = readers.read_export(spark, str(tmp_path / "x.tsv"))
    assert got.columns == ["id", 'na "me"'] and sorted(map(tuple, got.collect())) == [("1", "a\r\nb"), ("2", "plain"), ("3", None), ("4", "no end of line")]


def test_json_lines_WHEN_blank_SHOULD_skip(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "target": "t", "ns": "n"}\n\n{"query": "b", "target": "u", "ns": "n"}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "q.jsonl"), "query string, target string, ns string").count() == 2


def test_json_lines_WHEN_malformed_SHOULD_raise(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"query": "a", "target": "t", "ns": "n"}\n{"query": "b", \n')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "query string, target string, ns string").collect()


def test_store_WHEN_ids_repeat_SHOULD_refuse(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    edges = spark.createDataFrame([("a", "b", "p")], "subject string, object string, predicate string")
    readers.write_store(nodes, edges, str(tmp_path / "s"))
    assert readers.Snapshots(spark, str(tmp_path / "s")).table("edges_by_object", "store").count() == 1
    with pytest.raises(ValueError):
        readers.write_store(nodes.union(nodes), edges, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        readers.open_table(spark, str(tmp_path / "none"), "store")


def test_config_WHEN_read_SHOULD_have_cuts_and_types(tmp_path):
    (tmp_path / "c.yaml").write_text(
        "namespace_allowlist: [A, B]\ndiseases: [x]\npredicate_cuts:\n  - {label: none, drop: []}\nrelevance_cuts:\n  - {label: w, drop_nonhuman: true}\n"
        "seed: 13\nper_type: 5\ntypes:\n  - {name: t, template: 'q {disease}', direction: out, predicates: [p], answer_ns: A, min_answers: 2}\nmargin: 0.1\npredicates:\n  p: words\n"
    )
    config = readers.load_config(str(tmp_path / "c.yaml"))
    assert config.namespace_allowlist == ("A", "B") and config.predicate_cuts[0].drop == () and config.relevance_cuts[0].drop_nonhuman
    assert config.types[0].predicates == ("p",) and config.descriptions == {"p": "words"} and (config.seed, config.margin, config.per_type) == ("13", 0.1, 5)


def test_cosine_WHEN_zero_SHOULD_be_null(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(cosine("a", "b").alias("c")).collect()] == [1.0, None]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "K", "Name", None, None, "about", "[other, Name]"), ("b", "K", None, None, None, None, None), ("c", "K", " ", None, None, None, ""), ("d", "K", "name", None, None, None, "[NAME , Else]")]
    edges = [("a", "d", "k:is_a"), ("a", "b", "k:is_a"), ("a", "c", "k:is_a")]
    columns = "id string, category string, name string, deprecated string, in_taxon_label string, description string, synonym string"
    return Graph(spark.createDataFrame(nodes, columns), spark.createDataFrame(edges, "subject string, object string, predicate string"))


def test_texts_WHEN_parts_are_missing_SHOULD_skip_null_only(graph):
    got = {r.id: r.text for r in text.node_texts(graph).collect()}
    assert got == {"a": "Name. [other, Name]. about", "c": " . ", "d": "name. [NAME , Else]"}
    assert sorted(r.text for r in text.triple_texts(graph, "k:").collect()) == ["Name is a  ", "Name is a name"]
    assert quality.row_parity(graph, text.triple_texts(graph, "k:")).first() == (2, 2)


def test_quality_WHEN_broken_SHOULD_raise(graph, spark):
    docs = text.node_texts(graph)
    quality.check(graph, text.triple_texts(graph, "k:"), docs)
    with pytest.raises(AssertionError):
        quality.check(graph, text.triple_texts(graph, "k:").limit(1), docs)
    assert quality.empty_documents(spark.createDataFrame([(None,), (" ",), ("x",)], "text string")).first().empty_docs == 2
    assert quality.same_rows(docs, docs.repartition(3)).first().differing == 0


def test_synonym_queries_WHEN_same_as_name_SHOULD_take_next(graph):
    queries = evaluate.synonym_queries(graph, "7", 10)
    assert sorted(map(tuple, queries.collect())) == [("Else", "d", "d"), ("other", "a", "a")]
    assert quality.trivial_leaks(queries, graph.nodes).first().leaks == 0
    assert tuple(quality.ambiguous_queries(queries, graph.nodes).first()) == (2, 0, 0.0)


def test_scores_WHEN_no_answers_or_type_SHOULD_be_zero(spark):
    cases = spark.createDataFrame([("1", "t", "q", "a", ["x", "y"]), ("2", "t", "q", "b", [])], "id string, type string, question string, anchor string, answer_entities array<string>")
    hits = spark.createDataFrame([("1", "x"), ("1", "a"), ("1", "x")], "id string, hit string")
    got = sorted(map(tuple, evaluate.score(cases, hits).collect()))
    assert got == [("1", "t", 0.5, 1.0), ("2", "t", 0.0, 0.0)]
    means = {r.type: (r.n, r.recall, r.anchor_hit) for r in evaluate.means(evaluate.score(cases, hits), ["t", "u"]).collect()}
    assert means == {"t": (2, 0.25, 0.5), "u": (0, 0.0, 0.0), "overall": (2, 0.25, 0.5)}


@pytest.mark.parametrize("values", [[3], [1, 2, 3, 4], [5, 5, 5, 1, None], [7] * 900 + [9, 1], list(range(101))])
def test_statistics_WHEN_counted_SHOULD_equal_sorting(spark, values):
    from tessera.operators.order import order_statistics, percentile, upper_median

    table = spark.createDataFrame([("g", v) for v in values] + [(None, 4), ("other", None)], "g string, v int").repartition(3)
    found = order_statistics(table, ["g"], "v", [percentile(0.5), percentile(0.9), upper_median, percentile(1.0)])
    got = {(r.g, r.i): r.value for r in found.collect()}
    own = sorted(v for v in values if v is not None)
    assert got == {(None, i): 4 for i in range(4)} | {("g", 0): np.percentile(own, 50), ("g", 1): pytest.approx(np.percentile(own, 90)), ("g", 2): own[len(own) // 2], ("g", 3): own[-1]}
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "collect_list" not in plan and "percentile" not in plan


@pytest.mark.parametrize("n", [0, 1, 50, 499, 700, 5_000])
def test_sample_WHEN_large_SHOULD_be_the_first_rows_by_hash(spark, monkeypatch, n):
    from tessera.operators import order

    monkeypatch.setattr(order, "SORTED_ROWS", 5)
    table = spark.range(700).select(F.when(F.col("id") > 4, F.concat(F.lit("k"), F.pmod("id", F.lit(500)))).alias("key"), "id").repartition(5)
    rows = sorted((hashlib.md5(f"{r.key}s".encode()).hexdigest() if r.key else "", r.key or "") for r in table.collect())
    sample = order.hash_sample(table, "key", "s", n)
    assert sorted(r.key or "" for r in sample.collect()) == sorted(k for _, k in rows[:n]) and sample.columns == ["key", "id"]
    if n == 499:
        plan = sample._jdf.queryExecution().optimizedPlan().toString()
        assert all(int(x) <= 5 for x in re.findall(r"GlobalLimit (\d+)", plan))


class Crash(Exception):
    pass


def test_snapshots_WHEN_a_commit_stops_at_any_step_SHOULD_leave_one_state(spark, tmp_path, monkeypatch):
    store = readers.Snapshots(spark, str(tmp_path / "t"))
    frame = lambda n: spark.range(n)

    def commit(n: int) -> None:
        version = store.begin()
        version.write(frame(n), "a")
        version.write(frame(n), "b")
        version.commit()

    state = lambda: (store.table("a").count(), store.table("b").count())
    commit(3)
    for step in ("put", "_put", "_replace", "after"):
        before = state()

        def stop(*args, **kwargs):
            raise Crash

        with monkeypatch.context() as patch, pytest.raises(Crash):
            if step == "put":
                patch.setattr(readers.Version, "put", stop)
            elif step == "after":
                whole = readers._replace
                patch.setattr(readers, "_replace", lambda *a: (whole(*a), stop()))
            else:
                patch.setattr(readers, step, stop)
            commit(before[0] + 1)
        assert state() == (before if step != "after" else (before[0] + 1,) * 2)
    old = store.table("a")
    commit(9)
    assert old.count() == 4 and state() == (9, 9)  # who read the old state goes on


def test_snapshots_WHEN_two_write_SHOULD_refuse_the_later_and_keep_other_tables(spark, tmp_path):
    store = readers.Snapshots(spark, str(tmp_path / "t"))
    one, two = store.begin(), store.begin()
    one.write(spark.range(1), "a")
    two.write(spark.range(2), "b")
    one.commit()
    with pytest.raises(RuntimeError, match="since"):
        two.commit()
    two.discard()
    three = store.begin()
    three.write(spark.range(3), "b")
    three.commit()
    three.discard()  # a committed version stays
    assert store.table("a").count() == 1 and store.table("b").count() == 3 and sorted(store.tables()) == ["a", "b"]
    four = store.begin()
    four.write(spark.range(4), "b")
    four.commit()
    assert store.vacuum(keep=0) == [three.name] and store.table("a").count() == 1 and store.table("b").count() == 4
    with pytest.raises(FileNotFoundError, match="run load"):
        store.table("c", "load")
