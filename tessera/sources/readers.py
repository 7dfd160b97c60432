"""Reading and writing: tab-separated dumps and exports, JSON lines, Parquet, stores, YAML configuration."""

from __future__ import annotations

import csv
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.graph import BROADCAST_ROWS, Graph, Layout
from tessera.sources.schemas import text_columns
from tessera.sources.scratch import counted, materialize
from tessera.sources.shipping import map_arrow


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).first()[0].split("\t")


def read_dump(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw dump: tab, header, no quoting, all text; quotes and backslashes come through as they are."""
    schema = schema or text_columns(header(spark, path))
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", enforceSchema=False)


def read_export(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Our own exports: tab, header in each file, quoted where needed, quotes doubled, line breaks allowed inside quotes.

    Files are read in splits. A line break ends a record if the quotes up to it are even in number, so each split's parity,
    summed up over the splits before it, tells where its records begin; a record that crosses splits is put together
    from its pieces. A quote in a field that is not quoted is an error of the file. All columns are text without a schema."""
    if schema is None:
        schema = _header_columns(spark, path)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.option("lineSep", "\n").text(path).select(block.alias("b"), "value", F.monotonically_increasing_id().alias("line")).select("b.file", "b.start", "value", "line")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits, n = counted(counts.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1), "splits")
    if n <= BROADCAST_ROWS:
        known = lines.join(F.broadcast(splits.select("file", "start", "open")), ["file", "start"])
    else:
        known = lines.join(splits.select("file", "start", "open"), ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "line")
    pieces = materialize(map_arrow(known.select("file", "start", "open", "value"), _pieces, "file string, start long, place int, begins boolean, ends boolean, value string"), "records")
    # a record that crosses splits is a piece that begins only, pieces that do neither, and one that ends only
    parts = pieces.filter("NOT (begins AND ends)")
    chain = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0))
    crossing = parts.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("own"))
    joined = crossing.select("file", F.col("own")[0]["start"].alias("start"), F.col("own")[0]["place"].alias("place"), F.array_join(F.col("own.value"), "\n").alias("value"))
    records = pieces.filter("begins AND ends").select("file", "start", "place", "value").unionByName(joined)
    body = records.filter("NOT (start = 0 AND place = 0) AND value NOT IN ('', '\r')")
    parsed = body.select(F.from_csv(F.regexp_replace("value", "\r$", ""), schema.toDDL(), {"sep": "\t", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, whole or cut off at its ends: `place` counts them from the split's start."""
    last, held, begins, place, odd = None, [], True, 0, False
    out: list[tuple] = []
    names = ["file", "start", "place", "begins", "ends", "value"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        out.clear()
        return pa.record_batch(columns, names=names)

    for batch in batches:
        for file, start, opened, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != last:
                if held:
                    out.append((*last, place, begins, False, "\n".join(held)))
                last, held, begins, place, odd = (file, start), [], not opened, 0, opened
            held.append(value)
            odd ^= value.count('"') % 2 == 1
            if not odd:
                out.append((*last, place, begins, True, "\n".join(held)))
                held, begins, place = [], True, place + 1
        yield flush()
    if held:
        out.append((*last, place, begins, False, "\n".join(held)))
    yield flush()


def _header_columns(spark: SparkSession, path: str) -> T.StructType:
    first = spark.read.option("lineSep", "\n").text(path).filter("value <> ''").first()
    return text_columns(next(csv.reader([first[0].rstrip("\r")], delimiter="\t")) if first else [])


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are skipped; a malformed line is an error."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


class Snapshots:
    """A set of tables in a folder, of which readers always see one committed state.

    A version's tables are written into a folder of their own. A commit renames a new pointer, which names every table's
    folder, over the old one in one step; tables that a version does not write stay where they are. Until that step readers
    see the old state as a whole, from then on the new one, and a crash before or after it leaves one of the two. What no
    longer counts is deleted by vacuum(), never by a commit, so those who read an old state go on."""

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def tables(self) -> dict[str, str]:
        """Table names and their folders, as last committed."""
        pointer = f"{self.folder}/{self.POINTER}"
        return json.loads(_content(self.spark, pointer)) if exists(self.spark, pointer) else {}

    def table(self, name: str, hint: str = "its writer") -> DataFrame:
        """A committed table; one that is missing is an error that says which step makes it."""
        place = self.tables().get(name)
        if place is None:
            raise FileNotFoundError(f"{self.folder} has no {name}: run {hint} first")
        return self.spark.read.parquet(f"{self.folder}/{place}")

    def begin(self) -> Version:
        return Version(self)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions of which no table is current, but for the `keep` newest of them; what went, by name."""
        files, target = _files(self.spark, self.folder)
        used = {place.split("/")[0] for place in self.tables().values()}
        there = sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []
        idle = [v for v in there if v.startswith("v-") and v not in used]
        gone = idle[: max(0, len(idle) - keep)]
        for name in gone:
            files.delete(_files(self.spark, f"{self.folder}/{name}")[1], True)
        return gone


class Version:
    """Tables that are being written; commit() makes all of them current at once, discard() removes them."""

    def __init__(self, store: Snapshots) -> None:
        self.store, self.base, self.written = store, store.tables(), {}
        self.name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.put(df.write, name)

    def put(self, writer: DataFrameWriter, name: str) -> DataFrame:
        """Write by a prepared writer, and read back."""
        path = f"{self.store.folder}/{self.name}/{name}"
        writer.parquet(path)
        self.written[name] = f"{self.name}/{name}"
        return self.store.spark.read.parquet(path)

    def commit(self) -> None:
        """Refused if another version was committed since this one began; one writer at a time is taken for granted in between."""
        spark, store = self.store.spark, self.store
        if store.tables() != self.base:
            raise RuntimeError(f"{store.folder} was committed to since this version began")
        mark = f"{store.folder}/_{self.name}"
        _put(spark, mark, json.dumps({**self.base, **self.written}, sort_keys=True))
        _replace(spark, mark, f"{store.folder}/{store.POINTER}")

    def discard(self) -> None:
        if not any(place.startswith(f"{self.name}/") for place in self.store.tables().values()):
            files, target = _files(self.store.spark, f"{self.store.folder}/{self.name}")
            files.delete(target, True)


def _content(spark: SparkSession, path: str) -> str:
    files, target = _files(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    files, target = _files(spark, path)
    stream = files.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another one in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf, kind = spark.sparkContext._jsc.hadoopConfiguration(), getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    old, new = (files.makeQualified(path) for files, path in (_files(spark, source), _files(spark, target)))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(old, new, over)


def open_table(spark: SparkSession, path: str, hint: str) -> DataFrame:
    """A stored table; if it is missing, an error that says which step makes it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run {hint} first")
    return spark.read.parquet(path)


def write_store(nodes: DataFrame, edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """The query store's next version: unique nodes, and edges in two layouts, clustered by either end.

    A layout is dealt into shards by ranges of (end, other end), a folder and a sorted file each, so that an end that very
    many edges share is several shards; a table of the shards' bounds tells look-ups which to read. Within a file row
    groups are skipped by statistics and by a Bloom filter on the end."""
    spark = nodes.sparkSession
    repeated = nodes.groupBy("id").count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError("node ids are not unique")
    shards = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    version = Snapshots(spark, path).begin()
    version.put(nodes.repartitionByRange(shards, "id").sortWithinPartitions("id").write.option("parquet.bloom.filter.enabled#id", "true"), "nodes")
    for own, other in (("subject", "object"), ("object", "subject")):
        dealt = edges.repartitionByRange(shards, own, other).withColumn(SHARD, F.spark_partition_id()).sortWithinPartitions(SHARD, own, other)
        bloom = {f"parquet.bloom.filter.enabled#{own}": "true", "parquet.block.size": str(ROW_GROUP_BYTES)}
        table = version.put(dealt.write.options(**bloom).partitionBy(SHARD), f"edges_by_{own}")
        bounds = table.groupBy(SHARD).agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count("*").alias("edges"))
        version.write(bounds, f"shards_by_{own}")
    version.commit()


#: The column that a layout's folders are named by, and bytes of a row group, so that look-ups skip most of a file.
SHARD, ROW_GROUP_BYTES = "_shard", 16 << 20


def read_store(spark: SparkSession, path: str) -> Graph:
    """The store's current version as a graph: look-ups read the shards that they can meet, in the layout of their side."""
    store = Snapshots(spark, path)
    plain = lambda name: store.table(name, "load").drop(SHARD)
    layouts = tuple(Layout(store.table(f"edges_by_{own}"), own, store.table(f"shards_by_{own}"), SHARD) for own in ("subject", "object"))
    return Graph(plain("nodes"), plain("edges_by_subject"), layouts)


@dataclass(frozen=True)
class PredicateCut:
    label: str
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelevanceCut:
    label: str
    drop_nonhuman: bool = False
    drop_predicates: tuple[str, ...] = ()
    drop_categories: tuple[str, ...] = ()


@dataclass(frozen=True)
class QuestionType:
    name: str
    template: str
    direction: str
    predicates: tuple[str, ...]
    answer_ns: str
    min_answers: int


@dataclass(frozen=True)
class Config:
    """The profiling, question and predicate settings; each part may come from a file of its own."""

    namespace_allowlist: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    predicate_cuts: tuple[PredicateCut, ...] = ()
    relevance_cuts: tuple[RelevanceCut, ...] = ()
    hub_list_size: int = 20
    seed: str = "13"
    per_type: int = 60
    types: tuple[QuestionType, ...] = ()
    margin: float = 0.05
    descriptions: dict[str, str] = field(default_factory=dict)


def load_config(*paths: str) -> Config:
    """Read YAML files, later ones over earlier ones; unknown keys are ignored."""
    merged: dict[str, Any] = {}
    for path in paths:
        with open(path, encoding="utf-8") as file:
            merged.update(yaml.safe_load(file) or {})
    spread = lambda kind, rows: tuple(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}) for row in rows or ())
    plain = {k: merged[k] for k in ("hub_list_size", "per_type", "margin") if k in merged}
    return Config(
        namespace_allowlist=tuple(merged.get("namespace_allowlist") or ()), patterns=tuple(merged.get("diseases") or merged.get("patterns") or ()),
        predicate_cuts=spread(PredicateCut, merged.get("predicate_cuts")), relevance_cuts=spread(RelevanceCut, merged.get("relevance_cuts")),
        types=spread(QuestionType, merged.get("types")), seed=str(merged.get("seed", "13")), descriptions=_descriptions(merged.get("predicates")), **plain,
    )


def _descriptions(part: Any) -> dict[str, str]:
    if isinstance(part, dict):
        return dict(part)
    return {row["id"]: row["description"] for row in part or ()}
