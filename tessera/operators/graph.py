"""A directed labelled multigraph as two DataFrames, and set expansion, counting, closure and traversal over it.

Edges are rows; parallel edges all count. Node sets are (key, id) rows, so that many patterns, scenarios or documents
go through one plan whatever their number: the edges are read a fixed number of times, not once for each.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.expressions import absent, namespace, with_row
from tessera.operators.members import may_be_in, sieve
from tessera.sources.scratch import counted, delete_path, materialize, scratch_path
from tessera.sources.shipping import map_arrow

MAX_HOPS = 12
#: Requests that become constants of the plan, and rows of a side that is broadcast, at most.
POINTS, BROADCAST_ROWS = 1_000, 500_000
#: Namespaces and predicates that become conditions of the scan, at most; as many predicates are the bits of a number.
KINDS = 63
#: Parts that the edges of one id are dealt into.
SALTS = 8


def sent(rows: DataFrame, n: int) -> DataFrame:
    """Marked for broadcast if n rows are few, else for a merge: left alone, Spark goes by the files' bytes and broadcasts
    millions of short ids, or what is exploded from them."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows.hint("merge")


def sized(df: DataFrame, name: str) -> DataFrame:
    """df written out, and sent() by its number of rows."""
    return sent(*counted(df, name))


def met(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """rows whose column is one of n distinct ids (id); of more than a broadcast takes, rows of other ids may be left among them."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids.select(F.col("id").alias(column))), column, "left_semi").select(*rows.columns)
    return may_be_in(rows, {column: sieve(ids.select("id"))}, {column: "_may"}).filter("_may").select(*rows.columns)


def kinds_of(rows: DataFrame, value: Column) -> list[str] | None:
    """The distinct values in order, null left out; None if they are more than KINDS."""
    found = [r[0] for r in rows.select(value.alias("kind")).filter("kind IS NOT NULL").distinct().limit(KINDS + 1).collect()]
    return sorted(found) if len(found) <= KINDS else None


@contextmanager
def _bucketed(incidences: DataFrame) -> Iterator[DataFrame]:
    """(id, salt, other) as a table in buckets of (id, salt), in the shared folder; it goes at the end."""
    spark = incidences.sparkSession
    buckets, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"adjacency_{uuid.uuid4().hex}", scratch_path(spark, "adjacency")
    incidences.repartition(buckets, "id", "salt").write.bucketBy(buckets, "id", "salt").sortBy("id", "salt").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete_path(spark, path)


@dataclass(frozen=True)
class Layout:
    """Edges dealt into shards by ranges of one end; `bounds` has (shard, low, high) of each, both ends of the range included."""

    edges: DataFrame
    end: str
    bounds: DataFrame
    shard: str

    def met_by(self, ids: DataFrame) -> DataFrame:
        """The edges of the shards that ids (one column) can meet, as far as the bounds tell; other shards are not read.

        The bounds, one row for each shard, and the numbers of the shards that are met are all that the driver gets."""
        bounds = sorted((r.low.encode(), r.high.encode(), r[self.shard]) for r in self.bounds.filter("low IS NOT NULL").collect())
        lows, highs, numbers = ([b[i] for b in bounds] for i in range(3))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            for batch in batches:
                for value in batch.column(0).cast(pa.binary()).to_pylist():
                    if value is not None:  # bounds ascend at both ends
                        met.update(numbers[bisect_left(highs, value) : bisect_right(lows, value)])
            yield pa.record_batch([pa.array(sorted(met), pa.int32())], names=["shard"])

        found = [r.shard for r in map_arrow(ids, run, "shard int").distinct().collect()]
        return self.edges.filter(F.col(self.shard).isin(found)).drop(self.shard)

    def of(self, ids: Sequence[str]) -> DataFrame:
        """The edges of a few ids, which become conditions of the scan beside their shards."""
        bounds = self.bounds.filter("low IS NOT NULL").collect()
        found = [r[self.shard] for r in bounds if any(r.low.encode() <= i.encode() <= r.high.encode() for i in ids)]
        return self.edges.filter(F.col(self.shard).isin(found) & F.col(self.end).isin(list(ids))).drop(self.shard)


@dataclass(frozen=True)
class Graph:
    """nodes: id, category, name and further columns; edges: subject, object, predicate and further columns.

    layouts are the same edges dealt by subject and by object, where they are stored so."""

    nodes: DataFrame
    edges: DataFrame
    layouts: tuple[Layout, Layout] | None = None

    def pinned(self) -> Graph:
        """The same graph with its edges' subject, object and predicate written out once, for plans that read them many times."""
        return Graph(self.nodes, materialize(self.edges.select("subject", "object", "predicate"), "edges"))

    def ends(self) -> DataFrame:
        """(id, other) from either side; a self-loop twice."""
        return self.edges.select(F.col("subject").alias("id"), F.col("object").alias("other")).unionByName(
            self.edges.select(F.col("object").alias("id"), F.col("subject").alias("other"))
        )

    def adjacency(self, edges: DataFrame | None = None, turned: DataFrame | None = None) -> DataFrame:
        """(node, predicate, other, dir): each edge from either side, a self-loop only as `out`; from given edges for each side, or all."""
        edges, turned = self.edges if edges is None else edges, self.edges if turned is None else turned
        out = edges.select(F.col("subject").alias("node"), "predicate", F.col("object").alias("other"), F.lit("out").alias("dir"))
        back = turned.filter(~F.col("subject").eqNullSafe(F.col("object")))
        return out.unionByName(back.select(F.col("object").alias("node"), "predicate", F.col("subject").alias("other"), F.lit("in").alias("dir")))

    def near(self, requests: DataFrame, anchor: str) -> tuple[DataFrame, DataFrame]:
        """(the adjacency that requests (anchor, predicate, further columns) can meet, the requests to join with it).

        Few requests (POINTS at most) go along as a local table and their anchors become conditions of the scan. More are
        written out, and only the shards that they meet are read, where the edges are stored in shards; of those, edges whose
        node is in no anchor's namespace, or whose predicate is not asked for, are left out before the anchors are looked up."""
        few = requests.limit(POINTS + 1).collect()
        if len(few) <= POINTS:
            asked = F.broadcast(requests.sparkSession.createDataFrame(few, requests.schema))
            ids = sorted({r[anchor] for r in few if r[anchor] is not None})
            if self.layouts is not None:
                return self.adjacency(*(layout.of(ids) for layout in self.layouts)), asked
            return self.adjacency(self.edges.filter(F.col("subject").isin(ids)), self.edges.filter(F.col("object").isin(ids))), asked
        rows, n = counted(requests, "requests")
        ids, n_ids = counted(rows.select(F.col(anchor).alias("id")).filter("id IS NOT NULL").distinct(), "anchors")
        return self._touching(ids, n_ids, rows), sent(rows, n)

    def _touching(self, ids: DataFrame, n: int, asked: DataFrame) -> DataFrame:
        """The adjacency of n distinct ids by the predicates of asked; of very many ids others' may be left among it."""
        near = self.adjacency() if self.layouts is None else self.adjacency(*(layout.met_by(ids) for layout in self.layouts))
        if (spaces := kinds_of(ids, namespace("id"))) is not None:
            near = near.filter(reduce(Column.__or__, (F.col("node").startswith(s) for s in spaces), F.lit(False)))
        if (predicates := kinds_of(asked, F.col("predicate"))) is not None:
            near = near.filter(F.col("predicate").isin(predicates))
        return met(near, "node", ids, n)

    def vicinity(self, ids: DataFrame, asked: DataFrame) -> Graph:
        """The graph for several rounds of requests about ids (id) by the predicates of asked: their adjacency is written out once.

        Where the edges are stored in layouts, it is the same graph."""
        if self.layouts is not None:
            return self
        ids, n = counted(ids.select("id").filter("id IS NOT NULL").distinct(), "ids")
        return Vicinity(self.nodes, self.edges, None, materialize(self._touching(ids, n, asked), "vicinity"))

    def pairs(self) -> DataFrame:
        """(subject, object, n): edges from one to the other."""
        return self.edges.groupBy("subject", "object").agg(F.count("*").alias("n"))

    def degree(self) -> DataFrame:
        """(id, deg): edge ends at each id; one exchange after partial counts."""
        ids = self.edges.select(F.explode(F.array("subject", "object")).alias("id")).filter("id IS NOT NULL")
        return ids.groupBy("id").agg(F.count("*").alias("deg"))

    def anchors(self, prefix: str) -> DataFrame:
        """Nodes of a namespace that are not deprecated."""
        return self.nodes.filter(F.col("id").startswith(f"{prefix}:") & absent("deprecated"))

    def seeds(self, prefix: str, patterns: Sequence[str]) -> DataFrame:
        """(key, id): anchors whose lower-cased name contains the pattern, once for each pattern that fits."""
        fits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower("name"), p)) if patterns else F.array().cast("array<string>")
        return self.anchors(prefix).select(F.explode(fits).alias("key"), "id")

    def expand(self, sets: DataFrame, keep: bool = True) -> DataFrame:
        """(key, id): both ends of every edge that touches the set; with `keep` isolated members stay as well.

        A set of few ids is broadcast; of a large one the edges that it surely does not meet are left out first."""
        members, n = counted(sets.select("key", "id"), "sets")
        ends = self.ends() if n <= BROADCAST_ROWS else met(self.ends(), "id", members, n)
        touched = ends.join(sent(members, n), "id")
        if keep:
            return touched.select("key", F.col("other").alias("id")).unionByName(members).distinct()
        return touched.select("key", F.explode(F.array("id", "other")).alias("id")).distinct()

    def edge_counts(self, sets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """(key, incident, induced): edges with an end in the set, each once, and edges with both ends in it; (key, id) are distinct.

        Each id carries the sets it is in as bits, 63 to a word; an edge's bits are those of both ends together, counted by
        their value before they are spread over the sets. So the edges are joined twice, whatever the number of sets.
        Incident is the sum of out- and in-degrees less the edges counted twice. pairs() may be given, where it was written out."""
        sets, n_sets = counted(sets.select("key", "id"), "sets")
        ids, n_ids = counted(sets.select("id").distinct(), "ids")
        if pairs is None or n_ids <= BROADCAST_ROWS:  # few ids: only what is on them is grouped, or read again
            near = Graph(self.nodes, self.edges if pairs is None else pairs).incident_edges(ids, n_ids)
            pairs = materialize(Graph(self.nodes, near).pairs() if pairs is None else near, "pairs")
        keys, n = counted(sets.select("key").distinct().coalesce(1).select("key", F.monotonically_increasing_id().alias("no")), "keys")
        keys = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
        one = pairs.groupBy(F.col("subject").alias("id")).agg(F.sum("n").alias("n")).unionByName(pairs.groupBy(F.col("object").alias("id")).agg(F.sum("n").alias("n")))
        ends = one.join(sent(sets, n_sets), "id").groupBy("key").agg(F.sum("n").alias("ends"))
        words = sets.join(keys, "key").groupBy("id", F.expr("no DIV 63").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(no % 63 AS INT))")).alias("bits"))
        inner = pairs if n_ids <= BROADCAST_ROWS else may_be_in(pairs, *_both(sieve(ids))).filter("_s AND _o").select("subject", "object", "n")
        one_word = n <= 63  # then the bits are a number, not a map
        sets_of = F.max("bits") if one_word else F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits"))))
        member = materialize(words.groupBy("id").agg(sets_of.alias("sets")), "members")
        side = lambda end, mark: sent(member.select(F.col("id").alias(end), F.col("sets").alias(mark)), n_ids)
        shared = inner.join(side("subject", "a"), "subject").join(side("object", "b"), "object")
        if one_word:
            shared = shared.select(F.struct(F.lit(0).cast("long").alias("word"), F.col("a").bitwiseAND(F.col("b")).alias("bits")).alias("w"), "n").filter("w.bits <> 0")
        else:
            both = F.transform(F.map_entries("a"), lambda e: F.struct(e["key"].alias("word"), e["value"].bitwiseAND(F.coalesce(F.try_element_at("b", e["key"]), F.lit(0))).alias("bits")))
            shared = shared.select(F.filter(both, lambda w: w["bits"] != 0).alias("both"), "n").filter(F.size("both") > 0).groupBy("both").agg(F.sum("n").alias("n"))
            shared = shared.select(F.explode("both").alias("w"), "n")
        inside = shared.groupBy("w").agg(F.sum("n").alias("n"))
        own = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit("w.bits", i) == 1)
        inside = inside.select(F.explode(own).alias("bit"), "w", "n").groupBy((F.col("w.word") * 63 + F.col("bit")).alias("no")).agg(F.sum("n").alias("induced"))
        none = F.lit(0).cast("long")
        counts = keys.join(ends, "key", "left").join(inside, "no", "left")
        induced = F.coalesce("induced", none)
        return counts.select("key", (F.coalesce("ends", none) - induced).alias("incident"), induced.alias("induced"))

    def incident_edges(self, ids: DataFrame, n: int | None = None) -> DataFrame:
        """Edges with an end in ids (id, distinct), each once; n: how many, where ids are written out already."""
        ids, n = counted(ids, "ids") if n is None else (ids, n)
        return Graph(self.nodes, self._may_touch(ids, n))._marked(ids, n).filter("_s OR _o").select(*self.edges.columns)

    def induced_edges(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends in ids (id, distinct).

        A small set is broadcast. Of a larger one a filter tells the edges that may lie in it, if it has up to half of the
        nodes, and those are written out; then the few ids that these edges have and the set has not are found, from ids alone, and edges that
        meet none of them are sure without an exchange."""
        ids, n = counted(ids.select("id"), "ids")
        columns = self.edges.columns
        within = lambda edges, n=n: edges.join(sent(ids.withColumnRenamed("id", "subject"), n), "subject", "left_semi").join(sent(ids.withColumnRenamed("id", "object"), n), "object", "left_semi").select(*columns)
        if n <= BROADCAST_ROWS:
            return within(self.edges)
        whole = self.edges.filter("subject IS NOT NULL AND object IS NOT NULL")
        if 2 * n <= self.nodes.count():
            whole = materialize(may_be_in(self.edges, *_both(sieve(ids))).filter("_s AND _o").select(*columns), "told")
        near = Graph(self.nodes, whole)
        strangers, others = near.strangers(ids, n)
        if others <= BROADCAST_ROWS:
            return near._marked(strangers, others).filter("NOT (_s OR _o)").select(*columns)
        told = may_be_in(whole, *_both(sieve(strangers)))
        return told.filter("NOT (_s OR _o)").select(*columns).unionByName(within(told.filter("_s OR _o").select(*columns)))

    def induced_around(self, seeds: DataFrame) -> DataFrame:
        """Edges with both ends among seeds (id) and their neighbours, the set of expand().

        An edge that touches a seed has its other end there as well, so the seeds tell it; only edges between neighbours
        are looked up in the expanded set. Many seeds are not broadcast, and all edges are looked up."""
        seeds, n = counted(seeds.select("id").distinct(), "seeds")
        ids = self.expand(seeds.select(F.lit(0).alias("key"), "id")).select("id")
        if n > BROADCAST_ROWS:
            return self.induced_edges(ids)
        columns = self.edges.columns
        marked = Graph(self.nodes, self.edges.filter("subject IS NOT NULL AND object IS NOT NULL"))._marked(seeds, n)
        between = Graph(self.nodes, marked.filter("NOT (_s OR _o)").select(*columns))
        return marked.filter("_s OR _o").select(*columns).unionByName(between.induced_edges(ids))

    def strangers(self, ids: DataFrame, n: int) -> tuple[DataFrame, int]:
        """(id) of the edges' ends that are not among n ids (id, distinct), written out, and how many they are."""
        ends = self.edges.select(F.explode(F.array("subject", "object")).alias("id")).filter("id IS NOT NULL").distinct()
        return counted(ends.join(sent(ids.select("id"), n), "id", "left_anti"), "strangers")

    def _may_touch(self, ids: DataFrame, n: int) -> DataFrame:
        """The edges, without those that surely have no end among many ids."""
        if n <= BROADCAST_ROWS:
            return self.edges
        return may_be_in(self.edges, *_both(sieve(ids.select("id")))).filter("_s OR _o").select(*self.edges.columns)

    def _marked(self, ids: DataFrame, n: int) -> DataFrame:
        true = F.lit(True)
        own = self.edges.join(sent(ids.select(F.col("id").alias("subject"), true.alias("_s")), n), "subject", "left")
        own = own.join(sent(ids.select(F.col("id").alias("object"), true.alias("_o")), n), "object", "left")
        return own.withColumns({"_s": F.coalesce("_s", F.lit(False)), "_o": F.coalesce("_o", F.lit(False))})

    def closure(self, seeds: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
        """(hop, nodes, new_nodes, induced_edges, pct_nodes): growth hop by hop until nothing is added, the repeated row included.

        The edges are written out once, and no hop exchanges them: a small frontier is broadcast; at the first large one the
        adjacency is written in buckets of its ids, and large frontiers are dealt into the same buckets. Ids that very many
        edges share are several buckets. What a frontier
        touches lies in itself, in the level before or in the next one, so only those two are compared, and the edges that
        stay inside are counted on the way. `new` counts the seeds at the first hop."""
        spark = self.nodes.sparkSession
        pinned = Graph(self.nodes, materialize(self.edges.select("subject", "object").filter("subject IS NOT NULL AND object IS NOT NULL"), "edges"))
        plain, buckets = pinned._incidences(), None
        with ExitStack() as stack:
            start, n = counted(seeds.select("id").distinct(), "hop-0")
            level = start
            before, n_before, last, tables = None, 0, 0, []
            for hop in range(1, max_hops + 2):
                if n > BROADCAST_ROWS and buckets is None:
                    buckets = stack.enter_context(_bucketed(plain))
                touched = self._touched(buckets if n > BROADCAST_ROWS else plain, level, n)
                marks = level.select("id", F.lit(True).alias("own"))
                marks = marks if before is None else marks.unionByName(before.select("id", F.lit(False).alias("own")))
                seen = Observation()
                found = materialize(touched.join(sent(marks, n + n_before), "id", "left").observe(seen, F.count_if(F.col("own").isNull()).alias("n")), f"hop-{hop}")
                tables.append((hop, found))
                if hop > max_hops:
                    break
                last = hop
                before, n_before, level = level, n, found.filter("own IS NULL").select("id")
                n = seen.get["n"]  # how the next hop joins, and whether there is one; counts come from the tables
                if not n:
                    break
        rows = [start.agg(F.lit(1).alias("hop"), F.count("*").alias("new_nodes"), F.lit(0).cast("long").alias("new_edges"))]
        for hop, found in tables:  # a table of neighbours has the next level, and the edges of its own one and to the one before
            inside = F.coalesce(F.sum(F.when(F.col("own"), (F.col("n") + F.col("loops")) / 2).when(~F.col("own"), F.col("n"))), F.lit(0)).cast("long")
            rows.append(found.agg(F.lit(hop).alias("hop"), F.count_if(F.col("own").isNull()).alias("new_nodes"), F.lit(0).cast("long").alias("new_edges")))
            rows.append(found.agg(F.lit(max(1, hop - 1)).alias("hop"), F.lit(0).cast("long").alias("new_nodes"), inside.alias("new_edges")))
        added = reduce(DataFrame.unionByName, rows).filter(F.col("hop") <= last).groupBy("hop").agg(F.sum("new_nodes").alias("new_nodes"), F.sum("new_edges").alias("new_edges"))
        total = self.nodes.agg(F.count("*").alias("total"))
        sums = [F.sum(c).over(_up_to_hop()) for c in ("new_nodes", "new_edges")]
        rows = added.select("hop", sums[0].alias("nodes"), "new_nodes", sums[1].alias("induced_edges")).transform(with_row, total)
        return rows.select("hop", "nodes", "new_nodes", "induced_edges", F.round(F.try_divide(100.0 * F.col("nodes"), F.col("total")), 6).alias("pct_nodes"))

    def _incidences(self) -> DataFrame:
        """(id, salt, other): edges between ids from either side, a self-loop once; the salt splits what hangs on one id."""
        pair = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
        sides = F.when(F.col("subject") == F.col("object"), F.array(pair("subject", "object"))).otherwise(F.array(pair("subject", "object"), pair("object", "subject")))
        both = self.edges.filter("subject IS NOT NULL AND object IS NOT NULL").select(F.explode(sides).alias("e"))
        return both.select("e.id", F.pmod(F.hash("e.other"), F.lit(SALTS)).alias("salt"), "e.other")

    @staticmethod
    def _touched(adjacency: DataFrame, level: DataFrame, n: int) -> DataFrame:
        """(id, n, loops): what a level's edges lead to, with the number of edges, and of self-loops among them."""
        if n <= BROADCAST_ROWS:
            met = adjacency.join(F.broadcast(level), "id", "left_semi")
        else:
            salted = level.select("id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            met = adjacency.join(sent(salted, n), ["id", "salt"], "left_semi")
        return met.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("other")).alias("loops"))

    def traverse(self, requests: DataFrame) -> DataFrame:
        """Requests (anchor, predicate, further columns) with (other_id, category, name, dir) of each matching edge.

        Neighbours that are no nodes keep a null name; parallel edges repeat."""
        near, requests = self.near(requests, "anchor")
        near = near.select(F.col("node").alias("anchor"), "predicate", F.col("other").alias("other_id"), "dir")
        names = self.nodes.select(F.col("id").alias("other_id"), "category", "name")
        named = near.join(names, "other_id", "left")  # before requests that share an anchor repeat its edges
        return named.join(requests, ["anchor", "predicate"]).select(*requests.columns, "other_id", "category", "name", "dir")

    def neighbours(self, requests: DataFrame) -> DataFrame:
        """Requests (anchor, predicate, further columns) by all but predicate, with other_id of each matching edge, each once.

        An anchor's edges are brought to one row for each neighbour before requests meet them, so nothing is exchanged afterwards."""
        own = [c for c in requests.columns if c != "predicate"]
        near, requests = self.near(requests, "anchor")
        kinds = kinds_of(requests, F.col("predicate"))
        if kinds is None:
            all_of, shared = F.collect_set("predicate"), F.arrays_overlap("_has", "_wants")
        else:  # a predicate is a bit of a number
            bit = F.coalesce(*(F.when(F.col("predicate") == p, F.lit(1 << i).cast("long")) for i, p in enumerate(kinds)), F.lit(0).cast("long"))
            all_of, shared = F.bit_or(bit), F.col("_has").bitwiseAND(F.col("_wants")) != 0
        near = near.filter("predicate IS NOT NULL").groupBy(F.col("node").alias("anchor"), F.col("other").alias("other_id")).agg(all_of.alias("_has"))
        asked = requests.filter("predicate IS NOT NULL").groupBy(*own).agg(all_of.alias("_wants"))
        return near.join(sized(asked, "asked"), "anchor").filter(shared).select(*own, "other_id")

    def edge_count_of(self, requests: DataFrame) -> DataFrame:
        """Requests (id, predicate, further columns) grouped by all but predicate: n_edges on either side, a self-loop once.

        Ids without such edges keep a row with 0."""
        own = [c for c in requests.columns if c != "predicate"]
        near, wanted = self.near(requests.distinct(), "id")
        counts = near.groupBy(F.col("node").alias("id"), "predicate").agg(F.count("*").alias("n"))
        return wanted.join(counts, ["id", "predicate"], "left").groupBy(*own).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_edges"))

    def dangling(self) -> DataFrame:
        """Edges of which an end is no node, or null: those that meet an id that only edges name."""
        ids, n = counted(self.nodes.select("id").filter("id IS NOT NULL").distinct(), "nodes")
        strangers, n = self.strangers(ids, n)
        half = self.edges.filter("subject IS NULL OR object IS NULL")
        whole = Graph(self.nodes, self.edges.filter("subject IS NOT NULL AND object IS NOT NULL"))
        return whole.incident_edges(strangers, n).unionByName(half)


@dataclass(frozen=True)
class Vicinity(Graph):
    """A graph that is asked about some ids only; around is their adjacency."""

    around: DataFrame | None = None

    def near(self, requests: DataFrame, anchor: str) -> tuple[DataFrame, DataFrame]:
        return self.around, sized(requests, "requests")


def _both(made: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """One filter for both ends, as may_be_in() takes it."""
    return {"subject": made, "object": made}, {"subject": "_s", "object": "_o"}


def _up_to_hop() -> Column:
    """A window over one row for each hop (MAX_HOPS at most), so one partition is enough."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
