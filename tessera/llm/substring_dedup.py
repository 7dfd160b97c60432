"""Substring dedup with fixed-block anchors: words that repeat an earlier passage are removed.

Windows of `window` words are compared; blocks of half a window anchor the search. Reference blocks are the
non-overlapping blocks of every document (positions 0, b, 2b, ...); probes are all its rolling windows of b words.
Any window of 2b words holds a whole reference block, so two equal windows share a block hash that is both a reference
block and found twice. Three stages:

1. Anchors. Each task sorts the rolling block hashes of a chunk into buckets: 32 bits of each distinct hash, with one
   bit for "is a reference block" and one for "occurs again in the chunk", as packed rows. A bucket's task keeps hashes
   that are a reference block somewhere and occur twice. This is a filter: truncated hashes only add hits.
2. The hits go into one bounded Bloom filter. Documents are read again; every window that holds a hit is extended to
   its full length and hashed by two functions of its words (128 bits). Of equal windows in a chunk only the earliest goes out, packed per bucket; the
   later ones are known repeats at once, and their positions go out from the same task, packed per home partition. A
   bucket's task sorts (hash, document, position): all but the first of each hash repeat something earlier. Runs of
   repeated windows are the maximal repeats.
3. Their positions return to the documents, of which only those with hits are sent, and the covered words are cut.
   Which documents have hits depends on their own text only, so this reading may be split otherwise than stage 2's.

A passage that is in a third of all documents is one entry for each chunk and window, never a pair: extending every hit
against every other would be quadratic there, and extending it against one reference would miss repeats of another, so
the hits are extended to windows, equal windows meet, and their runs are the repeats. Within a chunk words are numbered and
windows of equal hashes compared by these numbers, all of a hash where two differ; across chunks windows are equal if both
hashes are, 128 bits of independent functions of the words (at 10**13 windows a false one is expected 1.5e-13 times).

The numbers of buckets and partitions follow the input's bytes, so that a task holds one bucket or the positions
of one home partition, of bounded size. The filter holds at most `filter_bits` bits; beyond about a tenth as many hits it admits
further windows, which stage 2 settles exactly.

Defined results: null text has no words. Rows that agree in both id and text are one document and get the same result;
rows of one id with different texts count as separate documents, ordered by text hash. Null ids come first. Ids must be
integers, else TypeError; other columns are left out. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, chunked, keyed, map_arrow, materialize
from tessera.llm.rolling import window_hashes

WINDOW = 20
#: Text bytes of one chunk, buckets for each partition, and input bytes for each bucket and each partition beyond the
#: session's number.
CHUNK_BYTES = 8 << 20
BUCKETS = 4
BUCKET_BYTES, PART_BYTES = 16 << 20, 256 << 20
#: Repeated windows of a task that are packed together, so that rows do not multiply with buckets and homes.
PACKED = 1 << 20
#: Bits of the filter of hits at most (64 MB), and bits for each hit.
FILTER_BITS = 1 << 29
BITS_PER_HIT = 12
PROBES = 4
NULL_ID = -(1 << 63)
SECOND, OTHER_SEED = np.uint64(0xD6E8FEB86659FD93), 0x5EED

ANCHOR_SCHEMA = "bucket int, keys binary, reference binary, again binary"
ENTRY_SCHEMA = "bucket int, uids binary, docs binary, sizes binary, low binary, high binary, at binary"
HOME_SCHEMA = "home int, uids binary, docs binary, sizes binary, at binary"
JUDGED_SCHEMA = "home int, id long, uid long, text binary, n_words long, n_removed long, kept binary"
FINAL_SCHEMA = "id long, n_words long, n_removed long, kept binary"


def text_uid(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") >> 1


class Chunk:
    """Documents' words one after another; windows that cross documents are masked. Words end at ASCII white space and are
    taken unchanged: `words` numbers the chunk's distinct words, `codes` are their 64-bit hashes."""

    def __init__(self, texts: list[bytes | None]) -> None:
        number: dict[bytes, int] = {}
        place, sizes = [], []
        for t in texts:
            own = t.split() if t else []
            number.update(zip(set(own).difference(number), count(len(number))))
            place.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
            sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        self.words = np.concatenate(place) if place else np.empty(0, np.int32)
        self.distinct = list(number)
        self.codes = self._coded(xxhash.xxh3_64_intdigest)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def _coded(self, digest: Callable[[bytes], int]) -> np.ndarray:
        return np.fromiter(map(digest, self.distinct), np.uint64, len(self.distinct))[self.words]

    def other_codes(self) -> np.ndarray:
        """Hashes of the words by another function."""
        return self._coded(lambda word: xxhash.xxh64_intdigest(word, OTHER_SEED))

    def hashes(self, length: int, codes: np.ndarray | None = None) -> np.ndarray:
        codes = self.codes if codes is None else codes
        return window_hashes(codes, length) if len(codes) >= length else np.empty(0, np.uint64)

    def valid(self, length: int) -> np.ndarray:
        """Starts of the windows that end inside their document."""
        own = np.maximum(self.sizes - length + 1, 0)
        return np.repeat(self.starts - np.concatenate(([0], np.cumsum(own)))[:-1], own) + np.arange(own.sum())

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document number, position in it) of chunk positions."""
        doc = np.searchsorted(self.starts, at, "right") - 1
        return doc, at - self.starts[doc]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _anchors(texts: list, window: int, buckets: int) -> Iterator[dict]:
    block = window // 2
    chunk = Chunk([t if t and t.count(b" ") + t.count(b"\n") + t.count(b"\t") + t.count(b"\r") + t.count(b"\x0b") + t.count(b"\x0c") >= window - 1 else None for t in texts])
    at = chunk.valid(block)
    if not len(at):
        return
    hashes = chunk.hashes(block)[at]
    reference = chunk.places(at)[1] % block == 0
    bucket = bucket_of(hashes, buckets)
    packed = (bucket.astype(np.uint64) << np.uint64(34)) | ((hashes & np.uint64(0xFFFFFFFF)) << np.uint64(2)) | reference.astype(np.uint64)
    packed.sort()
    key = packed >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((first[1:], [len(key)])) - 1
    is_reference = (packed[last] & np.uint64(1)).astype(bool)  # the flag sorts last
    again = last > first
    owner = (key[first] >> np.uint64(32)).astype(np.int64)
    value = key[first].astype(np.uint32)
    cuts = np.searchsorted(owner, np.arange(buckets + 1))
    for b in range(buckets):
        x, y = cuts[b], cuts[b + 1]
        if y > x:
            yield {"bucket": b, "keys": value[x:y].tobytes(), "reference": np.packbits(is_reference[x:y]).tobytes(), "again": np.packbits(again[x:y]).tobytes()}


def _rows(rows: Iterable[dict], schema: str, limit: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    arrow = _arrow_schema(schema)
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows of equal first column from sorted batches."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row[batch.schema.names[0]]
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _bucket_hits(rows: list[dict]) -> np.ndarray:
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    flags = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=len(k)) for r, k in zip(rows, keys)])
    key = np.concatenate(keys).astype(np.uint64)
    packed = (key << np.uint64(2)) | (flags("reference").astype(np.uint64) << np.uint64(1)) | flags("again").astype(np.uint64)
    packed.sort()
    key = packed >> np.uint64(2)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    reference = np.maximum.reduceat((packed >> np.uint64(1)) & np.uint64(1), first)
    again = np.maximum.reduceat(packed & np.uint64(1), first)
    count = np.diff(np.concatenate((first, [len(key)])))
    return key[first][(reference == 1) & ((again == 1) | (count > 1))].astype(np.uint32)


class HitFilter:
    """Bounded Bloom filter of (bucket, 32-bit key)."""

    def __init__(self, bits: int, buckets: int) -> None:
        self.bits, self.buckets = bits, buckets
        self.data = np.zeros(bits // 8, np.uint8)

    def _place(self, bucket: np.ndarray, key: np.ndarray, probe: int) -> np.ndarray:
        x = (bucket.astype(np.uint64) << np.uint64(32) | key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(probe) * ((x >> np.uint64(32)) | np.uint64(1))
        return ((x >> np.uint64(20)) & np.uint64(self.bits - 1)).astype(np.int64)

    def places(self, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.concatenate([self._place(bucket, key, probe) for probe in range(PROBES)])

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that the filter may hold."""
        left = np.arange(len(hashes))
        bucket, key = bucket_of(hashes, self.buckets), hashes & np.uint64(0xFFFFFFFF)
        for probe in range(PROBES):
            at = self._place(bucket[left], key[left], probe)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left


def _collect_filter(hits: DataFrame, buckets: int, most_bits: int) -> HitFilter:
    total = hits.agg(F.sum(F.octet_length("keys") / 4)).first()[0] or 0
    bits = min(most_bits, max(1 << 13, 1 << (int(total) * BITS_PER_HIT).bit_length()))
    whole, empty = HitFilter(bits, buckets), HitFilter(8, buckets)
    empty.bits = bits

    def places(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.empty(0, np.int64)]
        for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = np.frombuffer(keys, np.uint32)
            found.append(empty.places(np.full(len(key), bucket, np.int32), key))
        return np.concatenate(found)

    whole.data = bit_filter(hits, bits, places)
    return whole


def candidates_of(chunk: Chunk, hits: HitFilter, window: int) -> np.ndarray:
    """Chunk positions of the windows that hold a hit; a document's do not depend on the others of its chunk."""
    block = window // 2
    at10 = chunk.valid(block)
    if not len(at10):
        return np.empty(0, np.int64)
    hit = np.zeros(len(chunk.codes) + 1, np.int64)
    hit[at10[hits.admits(chunk.hashes(block)[at10])]] = 1
    before = np.concatenate(([0], np.cumsum(hit)))
    at = chunk.valid(window)
    return at[before[at + block + 1] - before[at] > 0]


class Candidates:
    """Windows of a chunk that may repeat: chunk positions, two hashes, and which repeat an earlier one of the chunk."""

    def __init__(self, chunk: Chunk, ids: list, uids: list, hits: HitFilter, window: int) -> None:
        self.at = at = candidates_of(chunk, hits, window)
        if not len(at):
            return
        self.doc, self.place = chunk.places(at)
        self.low = chunk.hashes(window)[at]
        self.high = chunk.hashes(window, chunk.other_codes())[at]
        rank = np.lexsort((np.array(uids, np.int64), np.array([NULL_ID if i is None else i for i in ids], np.int64)))
        order_of = np.empty(len(rank), np.int64)
        order_of[rank] = np.arange(len(rank))
        order = np.lexsort((self.place, order_of[self.doc], self.high, self.low))
        same = np.concatenate(([False], (self.low[order][1:] == self.low[order][:-1]) & (self.high[order][1:] == self.high[order][:-1])))
        windows = np.lib.stride_tricks.sliding_window_view(chunk.words, window)
        near, unlike = np.flatnonzero(same), np.zeros(len(same), bool)
        for i in range(0, len(near), 1 << 16):  # word by word
            own = near[i : i + (1 << 16)]
            clash = own[(windows[at[order[own]]] != windows[at[order[own - 1]]]).any(axis=1)]
            for start in np.unique(np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))[clash]).tolist():  # hashes agree, words don't
                end = start + 1 + int(np.argmin(np.append(same[start + 1 :], False)))
                known: set[bytes] = set()
                for k in range(start, end):
                    own_words = windows[at[order[k]]].tobytes()
                    unlike[k] = own_words not in known
                    known.add(own_words)
        same &= ~unlike
        self.repeat = np.zeros(len(at), bool)
        self.repeat[order[same]] = True


def _identified(ids: list, texts: list) -> tuple[list, list, list]:
    """Chunk rows with equal rows once: (ids, texts, uids)."""
    seen: dict[tuple, bytes | None] = {}
    for key, text in zip(ids, texts):
        seen.setdefault((key, text_uid(text)), text)
    return [k for k, _ in seen], list(seen.values()), [u for _, u in seen]


def _entries(ids: list, texts: list, hits: HitFilter, window: int, buckets: int, homes: int) -> Iterator[dict]:
    """The chunk's earliest windows for each bucket; its later repeats for each home, numbered on from the buckets."""
    ids, texts, uids = _identified(ids, texts)
    found = Candidates(Chunk(texts), ids, uids, hits, window)
    if not len(found.at):
        return
    out = np.flatnonzero(~found.repeat)
    low, high, doc, place = found.low[out], found.high[out], found.doc[out], found.place[out]
    bucket = ((high >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    keys, marks = np.array([NULL_ID if i is None else i for i in ids], np.int64), np.array(uids, np.int64)
    for b in range(buckets):
        own = order[cuts[b] : cuts[b + 1]]
        if len(own):
            first = np.flatnonzero(np.concatenate(([True], doc[own][1:] != doc[own][:-1])))
            yield {
                "bucket": b, "uids": marks[doc[own][first]].tobytes(), "docs": keys[doc[own][first]].tobytes(),
                "sizes": np.diff(np.concatenate((first, [len(own)]))).astype(np.int32).tobytes(),
                "low": low[own].tobytes(), "high": high[own].tobytes(), "at": place[own].astype(np.int32).tobytes(),
            }
    again = np.flatnonzero(found.repeat)
    doc, place = found.doc[again], found.place[again].astype(np.int32)
    for row in _by_home(marks[doc], keys[doc], place, homes):
        yield {"bucket": buckets + row.pop("home"), **row, "low": None, "high": None}


def home_of(uids: np.ndarray, docs: np.ndarray, homes: int) -> np.ndarray:
    """The partition that a document's repeats and text meet in; copies of a text have different ones."""
    mixed = (uids.astype(np.uint64) ^ (docs.astype(np.uint64) * SECOND)) * SECOND
    return ((mixed >> np.uint64(32)) % np.uint64(homes)).astype(np.int32)


def _bucket_repeats(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are not the first of their hash: text, document and position."""
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    sizes = join("sizes", np.int32)
    uid, doc = np.repeat(join("uids", np.int64), sizes), np.repeat(join("docs", np.int64), sizes)
    low, high, at = join("low", np.uint64), join("high", np.uint64), join("at", np.int32)
    order = np.lexsort((at, uid, doc, high, low))
    uid, doc, low, high, at = uid[order], doc[order], low[order], high[order], at[order]
    same = np.concatenate(([False], (low[1:] == low[:-1]) & (high[1:] == high[:-1])))
    head = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
    repeat = same & ~((doc == doc[head]) & (uid == uid[head]) & (at == at[head]))  # equal rows in two chunks are no repeat
    return uid[repeat], doc[repeat], at[repeat]


def _packed(found: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], homes: int) -> Iterator[dict]:
    """Windows of many buckets, PACKED or a bucket's at a time, as one row for each home partition."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in found:
        held.append(one)
        if sum(len(x[0]) for x in held) >= PACKED:
            yield from _by_home(*(np.concatenate(x) for x in zip(*held)), homes)
            held = []
    if held:
        yield from _by_home(*(np.concatenate(x) for x in zip(*held)), homes)


def _by_home(uid: np.ndarray, doc: np.ndarray, at: np.ndarray, homes: int) -> Iterator[dict]:
    """Positions in documents as one packed row for each home partition."""
    home = home_of(uid, doc, homes)
    order = np.lexsort((at, uid, doc, home))
    home, uid, doc, at = home[order], uid[order], doc[order], at[order]
    cuts = np.searchsorted(home, np.arange(homes + 1))
    for h in np.unique(home).tolist():
        own = slice(cuts[h], cuts[h + 1])
        u, d = uid[own], doc[own]
        first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (u[1:] != u[:-1]))))
        yield {"home": h, "uids": u[first].tobytes(), "docs": d[first].tobytes(), "sizes": np.diff(np.concatenate((first, [len(u)]))).astype(np.int32).tobytes(), "at": at[own].tobytes()}


class Repeats:
    """The repeated windows of one home partition's documents."""

    def __init__(self, rows: list[dict]) -> None:
        self.spans: dict[tuple[int, int], list[np.ndarray]] = {}
        for r in rows:
            at = np.frombuffer(r["at"], np.int32)
            ends = np.cumsum(np.frombuffer(r["sizes"], np.int32), dtype=np.int64).tolist()
            for doc, uid, a, b in zip(np.frombuffer(r["docs"], np.int64).tolist(), np.frombuffer(r["uids"], np.int64).tolist(), [0, *ends], ends):
                self.spans.setdefault((doc, uid), []).append(at[a:b])

    def of(self, doc: int, uid: int) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int32), *self.spans.get((doc, uid), ())])


def covered(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window starting at `at` covers."""
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(at)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + window, n), 1)
    return np.cumsum(edge)[:-1] > 0


def _finish(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, bytes]:
    if gone is None or not gone.any():
        return len(words), 0, b" ".join(words)
    kept = [w for w, x in zip(words, gone.tolist()) if not x]
    return len(words), len(words) - len(kept), b" ".join(kept)


def substring_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, filter_bits: int = FILTER_BITS, chunk_bytes: int = CHUNK_BYTES, hashed: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (the kept words joined by a space, or with `hashed` their SHA-256)."""
    if window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    docs = keyed(docs, key, text)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    buckets, homes = max(BUCKETS * parts, size // BUCKET_BYTES), parts

    def anchors(batches):
        yield from _rows((row for _, texts in chunked(batches, chunk_bytes) for row in _anchors(texts, window, buckets)), ANCHOR_SCHEMA)

    def bucket_hits(batches):
        yield from _rows(({"bucket": b, "keys": keys.tobytes()} for b, rows in _grouped(batches) if len(keys := _bucket_hits(rows))), "bucket int, keys binary")

    sorted_anchors = map_arrow(docs, anchors, ANCHOR_SCHEMA).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    hits = materialize(map_arrow(sorted_anchors, bucket_hits, "bucket int, keys binary"), "hits")
    shared = spark.sparkContext.broadcast(_collect_filter(hits, buckets, filter_bits))

    def entries(batches):
        yield from _rows((row for ids, texts in chunked(batches, chunk_bytes) for row in _entries(ids, texts, shared.value, window, buckets, homes)), ENTRY_SCHEMA)

    def repeats(batches):
        def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = np.frombuffer(r["sizes"], np.int32)
            return np.repeat(np.frombuffer(r["uids"], np.int64), sizes), np.repeat(np.frombuffer(r["docs"], np.int64), sizes), np.frombuffer(r["at"], np.int32)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for bucket, rows in _grouped(batches):
                if bucket >= buckets:  # known since the chunk
                    yield from map(unpacked, rows)
                else:
                    yield _bucket_repeats(rows)

        yield from _rows(_packed(found(), homes), HOME_SCHEMA)

    sorted_entries = map_arrow(docs, entries, ENTRY_SCHEMA).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    repeated = map_arrow(sorted_entries, repeats, HOME_SCHEMA)

    digest = (lambda kept: hashlib.sha256(kept).digest()) if hashed else (lambda kept: kept)

    def judge(batches):
        """Documents without candidates are done; the others go on with their text."""
        for ids, texts in chunked(batches, chunk_bytes):
            out = []
            own_ids, own_texts, uids = _identified(ids, texts)
            chunk = Chunk(own_texts)
            waiting = {(own_ids[d], uids[d]) for d in np.unique(chunk.places(candidates_of(chunk, shared.value, window))[0]).tolist()}
            marks = np.array([text_uid(t) for t in texts], np.int64)
            met_in = home_of(marks, np.array([NULL_ID if i is None else i for i in ids], np.int64), homes)
            for key, value, uid, home in zip(ids, texts, marks.tolist(), met_in.tolist()):
                if (key, uid) not in waiting:
                    n, gone, kept = _finish(value.split() if value else [], None)
                    out.append({"home": None, "id": key, "uid": None, "text": None, "n_words": n, "n_removed": gone, "kept": digest(kept)})
                else:
                    out.append({"home": home, "id": NULL_ID if key is None else key, "uid": uid, "text": value, "n_words": None, "n_removed": None, "kept": None})
            yield from _rows(out, JUDGED_SCHEMA, 2_000)

    judged = materialize(map_arrow(docs, judge, JUDGED_SCHEMA), "judged")
    done = judged.filter("uid IS NULL").select("id", "n_words", "n_removed", "kept")
    none = F.lit(None).cast("binary")
    back = repeated.select("home", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("uid"), none.alias("text"), "at", "uids", "docs", "sizes")
    waiting = judged.filter("uid IS NOT NULL").select("home", F.lit(1).alias("kind"), "id", "uid", "text", none.alias("at"), none.alias("uids"), none.alias("docs"), none.alias("sizes"))

    def cut(batches):
        """Of each home first its repeats, then its documents one after another."""
        home, packed, found = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["home"] != home:
                    home, packed, found = row["home"], [], None
                if row["kind"] == 0:
                    packed.append(row)
                    continue
                if found is None:
                    found, packed = Repeats(packed), []
                words = row["text"].split()
                at = found.of(row["id"], row["uid"]).astype(np.int64)
                n, gone, kept = _finish(words, covered(len(words), at, window))
                out.append({"id": None if row["id"] == NULL_ID else row["id"], "n_words": n, "n_removed": gone, "kept": digest(kept)})
            yield from _rows(out, FINAL_SCHEMA, 2_000)

    met = back.unionByName(waiting).repartitionById(parts, "home").sortWithinPartitions("home", "kind")
    return done.unionByName(map_arrow(met, cut, FINAL_SCHEMA))
