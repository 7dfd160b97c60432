"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against every document's windows.

Words are the runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. A window is `n` consecutive
words of an item; an item of fewer words is one window. Items become numbers over the benchmark's own vocabulary, and
each distinct window a 64-bit rolling hash in a sorted array, with a place of its words and its items. A document's words are looked up in that vocabulary, its windows
of each length hashed in one vectorised pass, and every hash that the set holds is compared word by word before it
counts. Documents never move: there is no shuffle on their side.

The set is broadcast only up to `block_words` words, which take some 200 bytes each at most (all words different; 40 if
they repeat as prose does). A larger benchmark is cut into blocks of that many, a longer item into overlapping pieces, and
the documents pass over the blocks one after another, carrying their hits through the shared folder.

Defined results: null or wordless texts have no words and no hits; null, empty and repeated items add no windows of
their own (a repeated text counts for each of its item ids; null ids are named ''). Hits of overlapping windows are
merged. Repeated documents are judged row by row; ids may be of any type. Extra columns stay, whatever their names and
types, but for those named like an output; what removes documents or spans returns all columns of docs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import extended, map_arrow, materialize, named, others, private
from tessera.llm.rolling import window_hashes
from tessera.sources.scratch import drop

N = 13
#: Benchmark words that one broadcast holds at most.
BLOCK_WORDS = 2_000_000
#: Words of documents that are hashed together.
CHUNK_WORDS = 500_000

#: Every byte that is no word byte becomes a space; capitals become small letters.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
OUTPUTS = ("n_words", "hit_spans", "hit_items")
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WindowSet:
    """The benchmark's windows: a vocabulary, all items' words one after another, and per window length the sorted hashes
    of distinct windows with a place of their words and their items."""

    def __init__(self, items: Iterable[tuple[str, bytes | None, bool]], n: int = N) -> None:
        """items: (name, text, whether it is a piece of a longer item, which then has no shorter windows)."""
        self.names: list[str] = []
        self.vocabulary: dict[bytes, int] = {}
        parts, sizes, pieces = [], [], []
        for name, text, piece in items:
            words = words_of(text)
            self.names.append(name)
            sizes.append(len(words))
            pieces.append(piece)
            number = self.vocabulary.setdefault
            parts.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
        self.words = np.concatenate([*parts, np.empty(0, np.int32)])
        sizes_, starts = np.array(sizes, np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[:-1].astype(np.int64)
        lengths = np.where((sizes_ >= n) | np.array(pieces, bool), n, sizes_)
        self.codes = np.random.default_rng(20240917).integers(1, 1 << 63, size=len(self.vocabulary) + 1, dtype=np.uint64)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for length in np.unique(lengths[sizes_ >= np.maximum(lengths, 1)]).tolist():
            own = np.flatnonzero((lengths == length) & (sizes_ >= length))
            counts = sizes_[own] - length + 1
            item = np.repeat(own, counts).astype(np.int32)
            at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
            self.tables[length] = self._table(at, item, length)

    def _table(self, at: np.ndarray, item: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(hash, place of the words, first owner) of each distinct window, sorted by hash, and the owners' items."""
        hashes = window_hashes(self.codes[self.words], length)[at]
        order = np.lexsort((at, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        windows = np.lib.stride_tricks.sliding_window_view(self.words, length)
        same = hashes[1:] == hashes[:-1]
        alike = same.copy()
        near = np.flatnonzero(same)
        for i in range(0, len(near), CHUNK_WORDS // length + 1):
            own = near[i : i + CHUNK_WORDS // length + 1]
            alike[own] = (windows[at[own]] == windows[at[own + 1]]).all(axis=1)
        if (same & ~alike).any():  # different words of one hash: their windows are put side by side
            group = np.concatenate(([0], np.cumsum(~same)))
            for g in np.unique(group[1:][same & ~alike]).tolist():
                a, b = np.searchsorted(group, (g, g + 1))
                keys = [tuple(windows[x].tolist()) for x in at[a:b].tolist()]
                inner = sorted(range(b - a), key=keys.__getitem__)
                at[a:b], item[a:b] = at[a:b][inner], item[a:b][inner]
                alike[a : b - 1] = [keys[x] == keys[y] for x, y in zip(inner, inner[1:])]
        first = np.flatnonzero(np.concatenate(([True], ~alike)))
        return hashes[first], at[first], np.concatenate((first, [len(item)])), item

    def hits(self, words: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int]], set[int]]]:
        """Merged hit spans [start, end) and the items that occur, for each document's words."""
        get = self.vocabulary.get
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        ids = np.fromiter((get(w, 0) for own in words for w in own), dtype=np.int32, count=int(sizes.sum()))
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[tuple[int, int]]] = {}
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for length, (hashes, places, _, _) in self.tables.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(full):
                continue
            own = window_hashes(self.codes[ids], length)[full]
            first = np.searchsorted(hashes, own, "left")
            alike = first < len(hashes)
            alike[alike] = hashes[first[alike]] == own[alike]
            starts, slots, values = full[alike], first[alike], own[alike]
            docs = np.searchsorted(ends, starts, "right")
            inside = starts + length <= ends[docs]  # others would run into the next document
            for start, slot, value, doc in zip(starts[inside].tolist(), slots[inside].tolist(), values[inside], docs[inside].tolist()):
                while slot < len(hashes) and hashes[slot] == value:
                    if np.array_equal(self.words[places[slot] : places[slot] + length], ids[start : start + length]):
                        at = start - int(ends[doc] - sizes[doc])
                        spans.setdefault(doc, []).append((at, at + length))
                        found.setdefault(doc, set()).add((length, slot))
                    slot += 1
        for doc in range(len(words)):
            items: set[int] = set()
            for length, slot in found.get(doc, ()):
                _, _, owner, item = self.tables[length]
                items.update(item[owner[slot] : owner[slot + 1]].tolist())
            yield merge_spans(spans.get(doc, [])), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def _blocks(benchmark: DataFrame, block_words: int, n: int) -> Iterator[list[tuple[str, bytes | None, bool]]]:
    """Items in lists of block_words words, one list on the driver at a time. A longer item comes in pieces that overlap by
    n - 1 words, so that each of its windows is in one piece."""
    block_words = max(block_words, 2 * n)
    held: list[tuple[str, bytes | None, bool]] = []
    count = 0
    rows = benchmark.select(F.coalesce(named("item_id").cast("string"), F.lit("")).alias("item"), F.encode(named("text"), "utf-8").alias("text")).toLocalIterator()
    for row in rows:
        words = words_of(row.text and bytes(row.text))
        pieces = [words] if len(words) <= block_words else [words[i : i + block_words] for i in range(0, len(words) - n + 1, block_words - n + 1)]
        for piece in pieces:
            if held and count + len(piece) > block_words:
                yield held
                held, count = [], 0
            held.append((row.item, b" ".join(piece), len(pieces) > 1))
            count += len(piece)
    if held:
        yield held


def find_hits(docs: DataFrame, benchmark: DataFrame, *, n: int = N, text: str = "text", block_words: int = BLOCK_WORDS, outputs: tuple[str, str, str] = OUTPUTS) -> DataFrame:
    """docs with n_words, hit_spans (word positions) and hit_items (sorted item ids), or other names for these."""
    docs = docs.select(*map(named, others(docs, *outputs)))
    blocks = 0
    for items in _blocks(benchmark, block_words, n):
        if blocks:
            before = docs
            docs = materialize(docs, "decontaminate")
            drop(before)
        docs = _scan(docs, WindowSet(items, n), text, outputs, carried=blocks > 0)
        blocks += 1
    return docs if blocks else _scan(docs, WindowSet([], n), text, outputs, carried=False)


def _scan(docs: DataFrame, windows: WindowSet, text: str, outputs: tuple[str, str, str], carried: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    kept = others(docs, *outputs)
    at, old = kept.index(text), (len(kept) + 1, len(kept) + 2) if carried else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for whole in batches:
            for batch in _small(whole, at):
                words = [words_of(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
                spans, items = [], []
                before = zip(batch.column(old[0]).to_pylist(), batch.column(old[1]).to_pylist()) if old else ((None, None) for _ in words)
                for (own, names), (was, had) in zip(windows.hits(words), before):
                    if was:
                        own = merge_spans([*own, *((x["start"], x["end"]) for x in was)])
                    spans.append([{"start": a, "end": b} for a, b in own])
                    items.append(sorted({windows.names[k] for k in names} | set(had or ())))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), pa.array([len(w) for w in words], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    names=[*kept, *outputs],
                )

    order = [*kept, *(outputs if carried else [])]
    n_words, spans, items = outputs
    return map_arrow(docs.select(*map(named, order)), scan, extended(docs, kept, f"`{n_words}` long, `{spans}` {SPANS}, `{items}` array<string>"))


def _small(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_WORDS words each."""
    sizes = pc.binary_length(batch.column(at)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + (size or 0) > 6 * CHUNK_WORDS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def _n_hit(spans: str) -> Column:
    return F.aggregate(named(spans), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _contaminated(n_words: str, spans: str) -> Column:
    return (_n_hit(spans) > 0) & (20 * _n_hit(spans) >= named(n_words))


def with_counts(hits: DataFrame) -> DataFrame:
    """n_hit and contaminated (a hit, and hit words at least a twentieth) from find_hits."""
    return hits.withColumn("n_hit", _n_hit("hit_spans")).withColumn("contaminated", _contaminated("n_words", "hit_spans"))


def _private(docs: DataFrame) -> tuple[str, str, str]:
    n_words, spans, items = (private(docs, f"_{x}") for x in OUTPUTS)
    return n_words, spans, items


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    outputs = _private(docs)
    return find_hits(docs, benchmark, outputs=outputs, **options).filter(~_contaminated(*outputs[:2])).select(*map(named, docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs whose hit words are cut out of the text, separators between the words left as they are."""
    outputs = _private(docs)
    hits = find_hits(docs, benchmark, text=text, outputs=outputs, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            spans = batch.column(batch.schema.get_field_index(outputs[1])).to_pylist()
            out = [cut_words(t, s) if s else t for t, s in zip(batch.column(at).cast(pa.binary()).to_pylist(), spans)]
            yield batch.set_column(at, pa.field(text, pa.string()), pa.array(out, pa.binary()).cast(pa.string()))

    return map_arrow(hits, cut, hits.schema).select(*map(named, docs.columns))


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """text without the words (and the gaps inside) of each span of word positions."""
    folded = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], folded, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s in spans:
        out.append(text[at : starts[s["start"]]])
        at = int(ends[s["end"] - 1])
    return b"".join([*out, text[at:]])
