"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Texts become arrays of code points, and a table gives each its class: letter, number, white space or other. With one
or two characters of lookahead (made by shifting the arrays) the pre-tokenisation pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is an automaton of eight states. A character's transition function is an element of the automaton's transition monoid,
so prefixes of functions are composed by table look-up: within columns of blocks, then over the blocks. The state
before each character says whether a piece starts there; no regular expression runs. Pieces are slices between
starts, merged by rank through a cache of bounded bytes, and a document's ids are the concatenation of its pieces' ids.
Offsets stay with the ids: where each piece ends in the text's bytes, and how many ids stand before that, so that any
range of pieces or bytes is decoded without the rest.

Defined results: null counts as empty and has no ids; texts of one kind of character and texts of many megabytes are
single pieces or many, merged with a heap in n log n. Ids outside the vocabulary raise an error when decoded. Repeated
rows and null keys stay row by row; no rows give no rows; other columns are left out. Keys must be integers, else TypeError.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, map_arrow

#: White space in the sense of the pattern: Unicode's White_Space property (fixed values).
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = range(4)

#: Symbols: a character's class with its lookahead. LAST_BLANK: ' ' before a character that is no white space; LAST_WHITE:
#: other such white space; MORE_WHITE: white space before white space or the end. TWO, THREE: ' that opens a contraction
#: of so many characters. END stands between documents; SAME is the identity.
SYM_OTHER, SYM_LETTER, SYM_NUMBER, MORE_WHITE, LAST_BLANK, LAST_WHITE, TWO, THREE, END, SAME = range(10)
#: States: FRESH (the next character starts a piece), inside a run of letters, numbers, others or white space, after a
#: blank that joins what follows, and with two or one characters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, TWO_LEFT, ONE_LEFT = range(8)

#: Pieces and bytes in each half of the cache, characters of the longest piece that is kept there, bytes up to which
#: pairs are searched without a heap, and characters that are cut into pieces at once.
CACHE_PIECES, CACHE_BYTES, KEPT_CHARS = 300_000, 64 << 20, 256
SHORT_PIECE = 64
CHUNK_CHARS = 1 << 19
BLOCK = 128
ENCODED = [pa.field("id", pa.int64()), pa.field("ids", pa.binary()), pa.field("n_pieces", pa.int64()), pa.field("piece_bytes", pa.binary()), pa.field("piece_ids", pa.binary()), pa.field("decoded", pa.binary())]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(state after the symbol, whether a piece starts at it)."""
    if symbol == SAME:
        return state, False
    if symbol == END:
        return FRESH, False
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    for sym, run in ((SYM_LETTER, IN_LETTERS), (SYM_NUMBER, IN_NUMBERS), (SYM_OTHER, IN_OTHERS)):
        if symbol == sym:
            return run, state not in (run, AFTER_BLANK)
    if symbol in (TWO, THREE):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == TWO else TWO_LEFT), True
    if symbol == MORE_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_BLANK if symbol == LAST_BLANK else FRESH), True


class Automaton:
    """The transition monoid as tables: element of each symbol, composition, and state after an element from FRESH."""

    def __init__(self) -> None:
        generators = [tuple(_step(s, sym)[0] for s in range(8)) for sym in range(10)]
        elements = list(dict.fromkeys(generators))
        for f in elements:  # grows while it is read
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in elements:
                    elements.append(h)
        number = {f: i for i, f in enumerate(elements)}
        self.element = np.array([number[g] for g in generators], np.uint16)
        self.compose = np.array([[number[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint16)
        self.identity = self.element[SAME]
        self.state = np.array([f[FRESH] for f in elements], np.uint8)
        self.starts = np.array([[_step(s, sym)[1] for sym in range(10)] for s in range(8)], bool)

    def before(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol, by an associative scan."""
        scanned = self._scan(self.element[symbols])
        return np.concatenate(([FRESH], self.state[scanned[:-1]])).astype(np.uint8)

    def _scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions."""
        n = len(f)
        if n <= BLOCK:
            out, at = np.empty(n, np.uint16), self.identity
            for i in range(n):
                out[i] = at = self.compose[at, f[i]]
            return out
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, self.identity, np.uint16)
        padded[:n] = f
        columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        flat, width = self.compose.reshape(-1), self.compose.shape[1]
        for j in range(1, BLOCK):
            columns[j] = flat[columns[j - 1].astype(np.intp) * width + columns[j]]
        ahead = np.concatenate(([self.identity], self._scan(columns[-1])[:-1])).astype(np.intp)
        return flat[ahead * width + columns].T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return table


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in code points of documents that each end with a separator at `ends`."""
    kind = class_table()[points]
    kind[ends] = 4
    after = np.concatenate((kind[1:], [4]))
    symbols = kind.copy()
    white = kind == SPACE
    last = white & (after != SPACE) & (after != 4)
    symbols[white] = MORE_WHITE
    symbols[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_WHITE)
    quotes = np.flatnonzero((points == 0x27) & (kind == OTHER))
    if len(quotes):
        text = np.concatenate((np.where(kind == 4, 0, points), [0, 0]))
        one, two = text[quotes + 1], text[quotes + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = TWO
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        symbols[quotes[np.any([(one == a) & (two == b) for a, b in pairs], axis=0)]] = THREE
    symbols[ends] = END
    machine = automaton()
    return np.flatnonzero(machine.starts[machine.before(symbols), symbols])


class ByteBpe:
    """Encoder and decoder over a rank file (lines of base64 bytes and rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache = _Cache(self)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) <= SHORT_PIECE:
            return self._merge_short(piece)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        previous = list(range(-1, n - 1))
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, at, stop = heapq.heappop(heap)
            if not alive[at] or end[at] >= n or end[end[at]] != stop:
                continue
            gone = end[at]
            alive[gone] = 0
            end[at] = stop
            if stop < n:
                previous[stop] = at
                if (r := ranks.get(piece[at : end[stop]])) is not None:
                    heapq.heappush(heap, (r, at, end[stop]))
            if (before := previous[at]) >= 0 and (r := ranks.get(piece[before:stop])) is not None:
                heapq.heappush(heap, (r, before, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(whole + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + whole, none)
        return [self.ranks[x] for x in parts]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, list[str]]]:
        """(ids as little-endian unsigned 32-bit integers, pieces) of each text."""
        for ids, pieces, _, _ in self.encode_offsets(texts):
            yield ids, pieces

    def encode_offsets(self, texts: list[str | None]) -> Iterator[tuple[bytes, list[str], bytes, bytes]]:
        """(ids, pieces, bytes of the text up to each piece's end, ids up to there); numbers are little-endian, unsigned, of 32 bits."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if held and size + len(text) > CHUNK_CHARS:
                yield from self._encode(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, list[str], bytes, bytes]]:
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = piece_starts(points, ends)
        stops = np.concatenate((starts[1:], [len(points)]))
        owner = np.searchsorted(starts, ends, "right")  # pieces up to each document's end
        last = owner[np.diff(np.concatenate(([0], owner))) > 0] - 1
        stops[last] = ends[np.diff(np.concatenate(([0], owner))) > 0]
        pieces = list(map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist())))
        found = list(map(self.cache.__getitem__, pieces))
        self.cache.age()
        size = np.ones(len(points) + 1, np.int64)  # UTF-8 bytes of each character
        size[:-1] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        before = np.concatenate(([0], np.cumsum(size)))
        tokens = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)))
        begins = np.concatenate(([0], ends[:-1] + 1))
        at = 0
        for stop, begin in zip(owner.tolist(), begins.tolist()):
            yield b"".join(found[at:stop]), pieces[at:stop], (before[stops[at:stop]] - before[begin]).astype("<u4").tobytes(), (tokens[at + 1 : stop + 1] - tokens[at]).astype("<u4").tobytes()
            at = stop

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))

    def decode_pieces(self, ids: bytes, piece_ids: bytes, first: int, last: int) -> bytes:
        """The text of the pieces first .. last - 1, from their ids alone."""
        ends = memoryview(piece_ids).cast("I")
        return self.decode(memoryview(ids)[4 * (ends[first - 1] if first else 0) : 4 * (ends[last - 1] if last else 0)])

    def decode_bytes(self, ids: bytes, piece_bytes: bytes, piece_ids: bytes, start: int, stop: int) -> bytes:
        """Bytes start .. stop - 1 of the text: only the pieces that they touch are decoded."""
        ends = np.frombuffer(piece_bytes, "<u4")
        first, last = int(np.searchsorted(ends, start, "right")), min(len(ends), int(np.searchsorted(ends, stop, "left")) + 1)
        if first >= last or start >= stop:
            return b""
        base = int(ends[first - 1]) if first else 0
        return self.decode_pieces(ids, piece_ids, first, last)[max(0, start - base) : stop - base]


class _Cache(dict):
    """Piece to its ids as bytes; what was not used for a while is forgotten, long pieces at once."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = np.array(self.bpe.merge(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            self[piece] = out
            self.bytes += 200 + 4 * len(piece) + len(out)
        return out

    def age(self) -> None:
        if len(self) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = 0

    def forget(self) -> None:
        self.clear()
        self.old, self.bytes = {}, 0


@lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBpe:
    return ByteBpe.load(path)


def _encoded(bpe: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of encode(); the cache goes at the end, as the worker that holds it stays."""
    try:
        for batch in batches:
            for keys, texts in _slices(batch):
                rows = [(ids, len(pieces), in_bytes, in_ids, bpe.decode(ids)) for ids, pieces, in_bytes, in_ids in bpe.encode_offsets(texts)]
                yield pa.record_batch([pa.array(keys, pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), ENCODED[1:]))], names=[f.name for f in ENCODED])
    finally:
        bpe.cache.forget()


def encode(docs: DataFrame, path: str | Callable[[], str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_pieces, piece_bytes, piece_ids, decoded): path is the rank file on every worker, or a function that names it there.

    piece_bytes and piece_ids say for each piece where it ends, in bytes of the text and in ids (unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(_loaded(path() if callable(path) else path), batches)

    return map_arrow(keyed(docs, key, text), run, "id long, ids binary, n_pieces long, piece_bytes binary, piece_ids binary, decoded binary")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of about CHUNK_CHARS characters."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    start = held = 0
    for i, size in enumerate([*sizes, None]):
        if i > start and (i == len(sizes) or held + (size or 0) > CHUNK_CHARS):
            part = batch.slice(start, i - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            start, held = i, 0
        held += size or 0


def digests(encoded: DataFrame) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows."""
    return encoded.select("id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
