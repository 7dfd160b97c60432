"""Command line: python -m tessera.cli COMMAND ... --home DIR, over tables in one folder.

extract reads the raw dump and writes the audited cut; text, load and embed build on it; the rest ask questions,
build gold sets, score and profile. Every command prints a table, and is a few calls of the library.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import crawl, cut, evaluate, profile, quality, text, vectors
from tessera.operators.graph import Graph
from tessera.sources import readers
from tessera.sources.readers import Config, load_config
from tessera.sources.schemas import GOLD, SYNONYM_QUERY
from tessera.sources.scratch import counted

HASHED = "hashed"
KEYS = {"node": ("id", "category"), "triple": ("subject", "predicate", "object")}


class Home:
    """The folder's tables, and the session, settings and embedder to use with them."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args, self.path = spark, args, args.home.rstrip("/")
        self.config: Config = load_config(*args.config)
        self.tables = readers.Snapshots(spark, self.path)

    def table(self, name: str, hint: str) -> DataFrame:
        return self.tables.table(name, hint)

    def write(self, **tables: DataFrame) -> None:
        """Commit tables together."""
        version = self.tables.begin()
        try:
            for name, df in tables.items():
                version.write(df, name)
            version.commit()
        finally:
            version.discard()

    def graph(self) -> Graph:
        return Graph(self.table("nodes", "extract"), self.table("edges", "extract"))

    def store(self) -> Graph:
        """The store with both layouts of edges for look-ups, once it is loaded; else the extracted tables."""
        if not readers.Snapshots(self.spark, f"{self.path}/store").tables():
            return self.graph()
        return readers.read_store(self.spark, f"{self.path}/store")

    def embedder(self) -> Callable[[], vectors.Embedder]:
        model = self.args.model
        return vectors.HashedNgrams if model == HASHED else partial(vectors.transformer, model, self.args.device)

    def embed(self, texts: list[str]) -> DataFrame:
        """(question_id, question, embedding) of a few texts; ids from 0."""
        encoded = self.embedder()().encode(texts)
        rows = [(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, encoded))]
        return self.spark.createDataFrame(rows, "question_id long, question string, embedding array<float>")

    def vectors(self, corpus: str) -> DataFrame:
        """The corpus's vectors, which must come from the model that questions are embedded with."""
        rows = self.table(f"{corpus}_vectors", f"embed {corpus}")
        if f"{corpus}_model" in self.tables.tables():
            made = self.tables.table(f"{corpus}_model").first().model
            if made != self.args.model:
                raise ValueError(f"{corpus}_vectors were made with {made}, not {self.args.model}")
        return rows

    def descriptions(self) -> DataFrame:
        names, words = list(self.config.descriptions), list(self.config.descriptions.values())
        listed = self.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "question_id long, predicate string")
        return self.embed(words).join(listed, "question_id").select("predicate", F.col("question_id").alias("position"), "embedding")

    def chosen(self, questions: DataFrame) -> DataFrame:
        return vectors.within_margin(vectors.classify(questions, self.descriptions()), self.config.margin)

    def candidates(self, questions: DataFrame, k: int = crawl.CANDIDATES) -> DataFrame:
        return crawl.anchors_of(self.vectors("node").select("id", "embedding"), questions, k)


def extract(home: Home) -> DataFrame:
    a = home.args
    raw = Graph(readers.read_dump(home.spark, a.nodes), readers.read_dump(home.spark, a.edges))
    kept = cut.cut_graph(raw, home.config.namespace_allowlist)
    version = home.tables.begin()
    try:  # what fails leaves the old tables as they are
        written = Graph(version.write(kept.nodes, "nodes"), version.write(kept.edges, "edges"))
        cut.assert_cut(cut.audit_cut(written, home.config.namespace_allowlist), a.expect_nodes, a.expect_edges)
        version.commit()
    finally:
        version.discard()
    audit = cut.audit_cut(home.graph(), home.config.namespace_allowlist)
    for name in ("nodes", "edges") if a.tsv else ():
        readers.write_export(home.table(name, "extract"), f"{home.path}/{name}.tsv")
    return audit


def build_text(home: Home) -> DataFrame:
    graph = home.graph()
    home.write(node_text=text.node_texts(graph), triple_text=text.triple_texts(graph, home.args.predicate_prefix))
    return text.corpus_stats(graph, home.args.predicate_prefix)


def load(home: Home) -> DataFrame:
    graph = home.graph()
    readers.write_store(graph.nodes.select("id", "category", "name"), graph.edges.select("subject", "object", "predicate"), f"{home.path}/store")
    return quality.unique_ids(home.store().nodes)


def embed(home: Home) -> DataFrame:
    docs = home.table(f"{home.args.corpus}_text", "text")
    dimension = home.embedder()().encode(["x"]).shape[1]
    found = vectors.embed_corpus(docs, home.embedder(), max_rows=home.args.max_rows, order=KEYS[home.args.corpus], dimension=dimension)
    home.write(**{f"{home.args.corpus}_vectors": found, f"{home.args.corpus}_model": home.spark.createDataFrame([(home.args.model, dimension)], "model string, dimension int")})
    return home.vectors(home.args.corpus).agg(F.count("*").alias("docs"), F.max(F.size("embedding")).alias("dimension"))


def throughput(home: Home) -> DataFrame:
    """Documents a second on a hashed sample, embedded by all tasks after a warm-up, and what the whole corpus would take."""
    docs, n = home.table(f"{home.args.corpus}_text", "text"), home.args.sample
    sample = profile.hash_sample(docs.withColumn("_k", F.concat_ws("|", *KEYS[home.args.corpus])), "_k", "7", n).drop("_k")
    tasks = max(1, min(home.spark.sparkContext.defaultParallelism, n))
    sample, rows = counted(sample.repartition(tasks), "sample")
    embedded = lambda df: vectors.embed_corpus(df, home.embedder())
    embedded(sample.limit(16)).write.format("noop").mode("overwrite").save()
    began = time.time()
    embedded(sample).write.format("noop").mode("overwrite").save()
    rate, total = rows / max(time.time() - began, 1e-9), docs.count()
    dimension = home.embedder()().encode(["x"]).shape[1]
    return home.spark.createDataFrame([(total, float(rate), total / rate / 3600 if rate else 0.0, total * dimension * 4 / 2**30)], "docs long, docs_per_second double, hours double, gib double")


def retrieve(home: Home) -> DataFrame:
    rows = home.vectors(home.args.corpus)
    question = home.embed([" ".join(home.args.question)]).first().embedding
    key = F.concat_ws("|", *KEYS[home.args.corpus][:1 if home.args.corpus == "node" else 3])
    found = vectors.top_k(rows.withColumn("_k", key), question, home.args.k, key="_k")
    return found.select(*KEYS[home.args.corpus], "text", "sim")


def classify(home: Home) -> DataFrame:
    if home.args.calibrate:
        cases = gold_table(home)
        asked = home.embed([r.question for r in cases.orderBy("id").select("question").collect()])
        ids = home.spark.createDataFrame([(i, r.id) for i, r in enumerate(cases.orderBy("id").select("id").collect())], "question_id long, id string")
        truth = home.spark.createDataFrame([(t.name, p) for t in home.config.types for p in t.predicates], "type string, predicate string")
        return evaluate.calibrate(cases, vectors.classify(asked, home.descriptions()).join(ids, "question_id"), truth)
    asked = home.embed([" ".join(home.args.question)])
    kept = home.chosen(asked).select("predicate", F.lit(True).alias("kept"))
    return vectors.classify(asked, home.descriptions()).join(kept, "predicate", "left").orderBy(F.desc("score"), "position").select("predicate", "score", F.coalesce("kept", F.lit(False)).alias("kept"))


def anchor(home: Home) -> DataFrame:
    found = home.candidates(home.embed([" ".join(home.args.question)]), home.args.k)
    return found.join(home.graph().nodes.select("id", "category", "name"), "id", "left").orderBy("rank").select("rank", "id", "category", "name", "sim")


def disambiguate(home: Home) -> DataFrame:
    asked = home.embed([" ".join(home.args.question)])
    return crawl.disambiguate(home.store(), home.candidates(asked), home.chosen(asked), home.args.anchor)


def traverse(home: Home) -> DataFrame:
    asked = home.spark.createDataFrame([(home.args.node, home.args.predicate)], "anchor string, predicate string")
    return home.store().traverse(asked)


def run_crawl(home: Home) -> DataFrame:
    return _crawl(home, home.embed([" ".join(home.args.question)]))


def _crawl(home: Home, questions: DataFrame) -> DataFrame:
    return crawl.crawl(home.store(), home.vectors("node").select("id", "embedding"), questions, home.descriptions(), home.args.anchor, home.config.margin)


def gold(home: Home) -> DataFrame:
    cases = evaluate.gold_cases(home.graph(), home.config.types, home.args.anchor, home.config.seed, home.config.per_type)
    readers.write_json_lines(cases, f"{home.path}/gold")
    return evaluate.gold_summary(gold_table(home))


def gold_table(home: Home) -> DataFrame:
    return readers.read_json_lines(home.spark, f"{home.path}/gold", GOLD)


def _asked(home: Home) -> tuple[DataFrame, DataFrame]:
    """(cases, questions with vectors named by their case)."""
    cases = gold_table(home)
    rows = cases.orderBy("id").select("id", "question").collect()
    ids = home.spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], "question_id long, id string")
    return cases, home.embed([r.question for r in rows]).join(ids, "question_id").select(F.col("id").alias("question_id"), "embedding")


def score(home: Home) -> DataFrame:
    cases, asked = _asked(home)
    types = [t.name for t in home.config.types]
    if home.args.corpus == "crawl":
        return evaluate.means(evaluate.score_crawl(cases, _crawl(home, asked).withColumnRenamed("question_id", "id")), types)
    columns = KEYS[home.args.corpus][:1] if home.args.corpus == "node" else KEYS["triple"]
    corpus = home.vectors(home.args.corpus).withColumn("_k", F.to_json(F.struct(*columns)))
    found = vectors.batched_top_k(corpus.select("_k", "embedding"), asked, home.args.k, key="_k").select(F.col("question_id").alias("id"), F.from_json("_k", ", ".join(f"{c} string" for c in columns)).alias("k"))
    hits = evaluate.surfaced_nodes(found.select("id", F.col("k.id").alias("key"))) if home.args.corpus == "node" else evaluate.surfaced_triples(found.select("id", "k.subject", "k.object"))
    return evaluate.means(evaluate.score(cases, hits), types)


def synonyms(home: Home) -> DataFrame:
    graph, seed = home.graph(), "7"
    queries = evaluate.synonym_queries(graph, seed, home.args.n)
    readers.write_json_lines(queries, f"{home.path}/synonym_queries")
    queries = readers.read_json_lines(home.spark, f"{home.path}/synonym_queries", SYNONYM_QUERY)
    gallery = vectors.embed_corpus(evaluate.with_targets(evaluate.synonym_gallery(graph, seed, home.args.gallery), queries, graph), home.embedder(), text="name")
    asked = vectors.embed_corpus(queries, home.embedder(), text="query").withColumn("question_id", F.col("target"))
    ranks = vectors.rank_of_target(gallery, asked).join(queries.select("target", "ns"), "target")
    whole = evaluate.rank_quality(ranks).select(F.lit("overall").alias("ns"), "*")
    return whole.unionByName(evaluate.rank_quality_by(ranks, "ns"))


def shape(home: Home) -> DataFrame:
    g, c, a = home.graph(), home.config, home.args
    union = g.seeds(a.anchor, c.patterns).select("id").distinct()
    usage = partial(profile.object_usage, g, a.anchor, a.usage_predicate)
    made: dict[str, Callable[[], DataFrame]] = {
        "composition": lambda: profile.breakdown(getattr(g, a.table), F.col(a.column)), "species": lambda: profile.species_composition(g),
        "closure": lambda: g.closure(g.seeds(a.anchor, [a.pattern or c.patterns[0]]).select("id")).orderBy("hop"),
        "distribution": lambda: profile.distribution(profile.neighbourhoods(g, a.anchor), ["h1_nodes", "h2_edges_ub"]),
        "thresholds": lambda: profile.threshold_shares(profile.neighbourhoods(g, a.anchor)),
        "exact": lambda: profile.exact_second_hop(g, profile.neighbourhoods(g, a.anchor), profile.hash_sample(profile.neighbourhoods(g, a.anchor).select("id"), "id", "42", 12)),
        "hubs": lambda: profile.hubs(g, union, c.hub_list_size), "hub-predicates": lambda: profile.hub_predicates(g, union),
        "predicate-cuts": lambda: cut.predicate_cuts(g, c.predicate_cuts, union), "relevance": lambda: cut.relevance_cuts(g, c.relevance_cuts, a.anchor),
        "patterns": lambda: profile.pattern_shapes(g, a.anchor, c.patterns), "sparsity": lambda: profile.sparsity(g, a.anchor),
        "subsets": lambda: profile.subset_table(g, a.anchor, c.patterns), "usage": lambda: profile.top_objects(g, usage(), a.anchor),
        "usage-percentiles": lambda: profile.distribution(usage(), ["n_anchors"], profile.USAGE_PERCENTILES),
    }
    return made[a.what]()


SHAPES = ("composition", "species", "closure", "distribution", "thresholds", "exact", "hubs", "hub-predicates", "predicate-cuts", "relevance", "patterns", "sparsity", "subsets", "usage", "usage-percentiles")


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--home", required=True, help="folder of the tables")
    common.add_argument("--config", action="append", default=[], help="YAML settings; later files win")
    common.add_argument("--anchor", default="MONDO", help="namespace of anchors")
    common.add_argument("--predicate-prefix", default="biolink:")
    common.add_argument("--model", default=HASHED, help="sentence-transformers model, or 'hashed'")
    common.add_argument("--device")
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[Home], DataFrame]) -> argparse.ArgumentParser:
        command = commands.add_parser(name, parents=[common], help=(run.__doc__ or name).split("\n")[0])
        command.set_defaults(run=run)
        return command

    command = add("extract", extract)
    for option in ("--nodes", "--edges"):
        command.add_argument(option, required=True)
        command.add_argument(f"--expect-{option[2:]}", type=int)
    command.add_argument("--tsv", action="store_true", help="write quoted TSV as well")
    add("text", build_text)
    add("load", load)
    for name, run in (("embed", embed), ("throughput", throughput)):
        command = add(name, run)
        command.add_argument("corpus", nargs="?", choices=tuple(KEYS), default="node")
        command.add_argument("--max-rows", type=int)
        command.add_argument("--sample", type=int, default=3000)
    for name, run, k in (("retrieve", retrieve, 10), ("anchor", anchor, crawl.CANDIDATES), ("disambiguate", disambiguate, 0), ("crawl", run_crawl, 0), ("classify", classify, 0)):
        command = add(name, run)
        command.add_argument("question", nargs="*")
        command.add_argument("-k", type=int, default=k)
        command.add_argument("--corpus", choices=tuple(KEYS), default="node")
        command.add_argument("--calibrate", action="store_true")
    command = add("traverse", traverse)
    command.add_argument("node")
    command.add_argument("predicate")
    add("gold", gold)
    command = add("score", score)
    command.add_argument("--corpus", choices=(*KEYS, "crawl"), default="node")
    command.add_argument("-k", type=int, default=20)
    command = add("synonyms", synonyms)
    command.add_argument("n", nargs="?", type=int, default=2000)
    command.add_argument("gallery", nargs="?", type=int, default=20_000)
    command = add("shape", shape)
    command.add_argument("what", choices=SHAPES)
    command.add_argument("--pattern")
    command.add_argument("--table", choices=("nodes", "edges"), default="nodes")
    command.add_argument("--column", default="category")
    command.add_argument("--usage-predicate", default="biolink:has_phenotype")
    return out


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    args = parser().parse_args(arguments)
    return args.run(Home(spark, args))


def main() -> None:
    import sys

    parser().parse_args(sys.argv[1:])  # mistakes are told before Spark starts
    run(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:]).show(1000, truncate=False)


if __name__ == "__main__":
    main()
