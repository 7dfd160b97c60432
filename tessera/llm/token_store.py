"""Token-id store: raw id payloads with a minimal perfect hash index for keyed access.

Documents are ordered by key over range partitions, and each task writes one shard file:

    payload   ids of its documents one after another, little-endian, 2 bytes each if the vocabulary allows, else 4
    offsets   first id of each document and the end (8 bytes each), in key order
    keys      distinct keys (8 bytes each) with first document and number of documents (4 bytes each), by slot
    prints    32-bit fingerprint of each slot's key
    levels    sizes of the hash levels, their bit words, and the count of bits before each word
    rest      keys that no level places (usually none), sorted
    footer    sizes of all parts, id width, magic

The hash is a cascade: a key belongs to the first level where it is alone in its place, and its slot is the rank of
that bit, so slots are dense. A look-up costs a few probes whatever the size; the stored fingerprint turns strangers
away. A file is named for its attempt, and only the files of committed attempts are in the manifest (Parquet), so lost
executors and repeated tasks leave nothing behind that counts. The manifest's running sums give each shard's start.

Defined results: null text has no ids but the end id. Rows of one key follow each other (by text) and share an entry in
each shard that has some; rows with a null key come first and have no entry. Shards end anywhere but between rows that
agree in key and first characters, so that a frequent key (or null) is no one's task. No rows give an empty store; other
columns are left out. Keys must be integers, else TypeError.
"""

from __future__ import annotations

import bisect
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunked, keyed, map_arrow, materialize, partition_id, scratch_path

MAGIC = b"TSHARD01"
FOOTER = struct.Struct("<8Q8s")
MANIFEST = "shard long, file string, null_docs long, first_key long, last_key long, n_docs long, n_ids long"
#: Words and bytes in each half of the cache, and bytes of the longest word that is kept there.
CACHE_WORDS, CACHE_BYTES, KEPT_BYTES = 300_000, 64 << 20, 256
#: Payload bytes that are read at once.
READ_BYTES = 4 << 20
LEVELS = 48
#: Characters of a text that help to cut the shards, and text bytes of a shard (about: they are cut by a sample).
RANGE_CHARS, SHARD_BYTES = 64, 256 << 20
#: Words that the library gets as one line, and the mark of a word's last token.
LINE_WORDS, END_OF_WORD = 128, "</w>"
#: What begins special tokens' names, and the combining dot above, which makes I lower-case in its own way; texts with
#: either go to the library whole. ASCII punctuation but for the apostrophe; ASCII letters and digits.
SPECIAL, DOT_ABOVE = b"<|", b"\xcc\x87"
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
ALNUM = frozenset(c for c in range(0x80) if chr(c).isalnum())


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mixing of keys under a seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: dense slots below len(keys) for members, any slot or -1 else."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.words, self.rest = sizes, words, rest
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-len(left) * 2 // 64) * 64
            place = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(words) if words else np.empty(0, np.uint64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = (mix(keys[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (self.before[place >> 6] + below)[found]
            left, base = left[~found], base + size
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == keys[left], self.before[-1] + at, -1)
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class Shard:
    """One shard file, its index in memory and its payload read by range."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        self.n_ids, self.n_docs, self.n_keys, n_levels, n_words, n_rest, self.width, self.null_docs, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        file.seek(self.n_ids * self.width)
        read = lambda kind, n: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        self.offsets = read("<i8", self.n_docs + 1)
        self.keys, self.first, self.count, self.prints = read("<i8", self.n_keys), read("<u4", self.n_keys), read("<u4", self.n_keys), read("<u4", self.n_keys)
        self.hash = PerfectHash(read("<u8", n_levels).tolist(), read("<u8", n_words), read("<u8", n_rest))

    def documents(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document or -1, number of documents) of each key."""
        if not self.n_keys:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        known = (slot >= 0) & (self.prints[slot] == fingerprints(keys))
        return np.where(known, self.first[slot], -1).astype(np.int64), np.where(known, self.count[slot], 0).astype(np.int64)

    def ids(self, document: int, stop: int | None = None) -> np.ndarray:
        """Ids of a document, or of those up to `stop`, in one read."""
        a, b = int(self.offsets[document]), int(self.offsets[document + 1 if stop is None else stop])
        self.file.seek(a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}")


class ShardWriter:
    """Appends documents in key order; close() adds the index."""

    def __init__(self, uri: str, width: int) -> None:
        store, self.path = pafs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.width = store.open_output_stream(self.path), width
        self.keys, self.sizes, self.nulls = array("q"), array("q"), 0

    def append(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        if key is None:
            self.nulls += 1  # they come first
        else:
            self.keys.append(key)
        self.sizes.append(len(ids) // self.width)

    def close(self) -> tuple[int, int | None, int | None, int, int]:
        """(rows without key, first key, last key, documents, ids)."""
        offsets = np.concatenate(([0], np.cumsum(np.frombuffer(self.sizes, np.int64)))).astype("<i8")
        nulls, keyed = self.nulls, np.frombuffer(self.keys, np.int64)
        distinct, first, count = np.unique(keyed, return_index=True, return_counts=True)
        table = PerfectHash.build(distinct)
        slot = table.slots(distinct)
        place = np.empty(len(slot), np.int64)
        place[slot] = np.arange(len(slot))
        distinct, first, count = distinct[place], first[place] + nulls, count[place]
        for part in (offsets, distinct.astype("<i8"), first.astype("<u4"), count.astype("<u4"), fingerprints(distinct), np.array(table.sizes, "<u8"), table.words.astype("<u8"), table.rest.astype("<u8")):
            self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(int(offsets[-1]), len(self.sizes), len(distinct), len(table.sizes), len(table.words), len(table.rest), self.width, nulls, MAGIC))
        self.out.close()
        return nulls, (int(keyed[0]) if len(keyed) else None), (int(keyed[-1]) if len(keyed) else None), len(self.sizes), int(offsets[-1])


def ends_in_letter(word: bytes) -> bool:
    """Whether the last character still ends in a letter once it is composed and in lower case."""
    return unicodedata.normalize("NFC", word.decode("utf-8")[-1]).lower()[-1].isalpha()


class WordEncoder:
    """The tokenizers library over white-space separated words, each distinct word encoded once while it is in use.

    Only for tokenizers that lower-case, drop white space and never let a token reach over it, or from a letter or
    digit into ASCII punctuation (as the tests check): texts are lower-cased (A-Z) first, and a word is the sum of what
    stands before its trailing punctuation and of that."""

    def __init__(self, path: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), f"<u{width}"
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith(END_OF_WORD)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _single(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, those that are one piece each (letters that normalisation leaves alone) in lines of many.

        In a line each word's last token, and no other, carries the end-of-word mark."""
        texts = [w.decode("utf-8") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t)] if self.last.any() else []
        out: list[bytes] = [b""] * len(words)
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for line, found in zip(lines, self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in line) for line in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            cuts = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(cuts) != len(line):
                raise ValueError("a word of letters was cut into several pieces")
            data, width = ids.tobytes(), ids.itemsize
            for i, a, b in zip(line, [0, *cuts], cuts):
                out[i] = data[a * width : b * width]
        done = set(plain)
        rest = [i for i in range(len(words)) if i not in done]
        for i, ids in zip(rest, self._library([words[i] for i in rest])):
            out[i] = ids
        return out

    def encode(self, texts: list[bytes | None], end: bytes) -> Iterator[bytes]:
        whole = [bool(t) and (SPECIAL in t or DOT_ABOVE in t) for t in texts]
        words = [t.lower().split() if t and not w else [] for t, w in zip(texts, whole)]
        met = set(chain.from_iterable(words))
        long = [w for w in met if len(w) > KEPT_BYTES]
        self._learn(met.difference(long))
        self.young.update(zip(long, self._library(long)))  # until this list of texts is done
        get = self.young.__getitem__
        for text, own, w in zip(texts, words, whole):
            yield (self._library([text])[0] if w else b"".join(map(get, own))) + end
        for w in long:
            del self.young[w]
        if len(self.young) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.old, self.young, self.bytes = self.young, {}, 0

    def _again(self, word: bytes) -> bool:
        """Whether the older half of the cache has the word; it then moves to the younger."""
        known = self.old.get(word)
        if known is not None:
            self.young[word] = known
            self.bytes += 200 + len(word) + len(known)
        return known is not None

    def _learn(self, words: set[bytes]) -> None:
        young = self.young
        new = [w for w in words.difference(young) if not self._again(w)]
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in new:
            core = w.rstrip(PUNCTUATION)
            if core and len(core) < len(w) and (core[-1] in ALNUM or (core[-1] >= 0x80 and ends_in_letter(core))):
                parts[w] = core, w[len(core) :]
        wanted = {w for w in new if w not in parts}.union(*parts.values())
        fresh = [w for w in wanted.difference(young) if not self._again(w)]
        young.update(zip(fresh, self._single(fresh)))
        for w, (core, tail) in parts.items():
            young[w] = young[core] + young[tail]
        self.bytes += sum(200 + len(w) + len(young[w]) for w in chain(fresh, parts))


@lru_cache(maxsize=2)
def _encoder(path: str, width: int) -> WordEncoder:
    return WordEncoder(path, width)


def write_store(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, *, vocabulary: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write docs as shards into the shared folder; the manifest, one row for each shard.

    Shards are as many as the text has `shard_bytes`, or the session's partitions if these are more."""
    spark = docs.sparkSession
    folder, width = scratch_path(spark, "tokens"), 2 if vocabulary <= 1 << 16 else 4
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer() if callable(tokenizer) else tokenizer, width)
        out, file = None, ""
        for keys, texts in chunked(batches, 1 << 20):
            if out is None:
                file = f"{folder}/{uuid.uuid4().hex}.shard"
                out = ShardWriter(file, width)
            for k, ids in zip(keys, encoder.encode(texts, end)):
                out.append(k, ids)
        if out is not None:
            nulls, first, last, n_docs, n_ids = out.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((partition_id(), pa.int64()), (file, pa.string()), (nulls, pa.int64()), (first, pa.int64()), (last, pa.int64()), (n_docs, pa.int64()), (n_ids, pa.int64()))], names=["shard", "file", "null_docs", "first_key", "last_key", "n_docs", "n_ids"])

    rows = keyed(docs, key, text).select(F.col("id").alias("key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    ordered = rows.repartitionByRange(shards, F.col("key"), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("key", "text")
    return materialize(map_arrow(ordered, write, MANIFEST), "manifest")


def shard_list(manifest: DataFrame) -> list[tuple]:
    """(shard, start, file, null_docs, first_key, last_key, n_docs, n_ids) in key order: one entry for each range partition."""
    rows = sorted(manifest.collect(), key=lambda r: r.shard)
    starts = accumulate((r.n_ids for r in rows), initial=0)
    return [(i, start, r.file, r.null_docs, r.first_key, r.last_key, r.n_docs, r.n_ids) for i, (r, start) in enumerate(zip(rows, starts))]


def open_shard(uri: str) -> Shard:
    store, path = pafs.FileSystem.from_uri(uri)
    return Shard(store.open_input_file(path))


class TokenStore:
    """Keyed access: the shard by its key range, the document by the shard's hash."""

    def __init__(self, manifest: DataFrame) -> None:
        self.shards = [s for s in shard_list(manifest) if s[4] is not None]
        self.highs = [s[5] for s in self.shards]
        self.open = lru_cache(maxsize=64)(open_shard)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with the key; none if there is no such key."""
        out: list[np.ndarray] = []
        for _, _, file, _, low, *_ in self.shards[bisect.bisect_left(self.highs, key) :]:
            if low > key:
                break
            shard = self.open(file)
            first, count = shard.documents(np.array([key], np.int64))
            out += [shard.ids(int(first[0]) + i) for i in range(int(count[0]))]
        return out


def read_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files through their index."""
    rows = [(start, file) for _, start, file, *_ in shard_list(manifest)]
    columns = "id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, file in zip(*(c.to_pylist() for c in batch.columns)):
                shard = open_shard(file)
                distinct = np.sort(shard.keys)
                first, count = shard.documents(distinct)
                keys = [None] * shard.null_docs + np.repeat(distinct, count).tolist()
                document = np.concatenate((np.arange(shard.null_docs), np.repeat(first, count) + np.concatenate([np.arange(c) for c in count.tolist()] or [np.empty(0, np.int64)]))).astype(np.int64)
                begins, stops = shard.offsets[document], shard.offsets[document + 1]
                i = 0
                while i < len(keys):  # the documents stand in key order: many in one read, or one longer document
                    j = max(i + 1, min(i + 5_000, int(np.searchsorted(stops, begins[i] + READ_BYTES // shard.width, "right"))))
                    block = shard.ids(int(document[i]), int(document[j - 1]) + 1).astype("<u4").tobytes()
                    cuts = zip(((begins[i:j] - begins[i]) * 4).tolist(), ((stops[i:j] - begins[i]) * 4).tolist())
                    yield pa.record_batch([
                        pa.array(keys[i:j], pa.int64()), pa.array(start + begins[i:j]), pa.array(stops[i:j] - begins[i:j]), pa.array([zlib.crc32(block[a:b]) for a, b in cuts], pa.int64()),
                    ], names=["id", "start", "n_tokens", "ids_crc32"])
                    i = j

    shards = spark.sparkContext.parallelize(rows, len(rows)).toDF("start long, file string")
    return map_arrow(shards, read, columns)
