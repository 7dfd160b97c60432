from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from tessera.llm.byte_bpe import Automaton, ByteBpe, digests, encode, piece_starts
from tessera.llm.queries import bpe_ranks

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "re", "S", "Z1", "9", "½", "é", " ", "　", "!", "$$", "<|endoftext|>", "日本", "́", "\x1c", "\x85", "😀", "​", "'S", "l", "e", "𝟘"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load(bpe_ranks())


def texts():
    random.seed(6)
    made = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 14))) for _ in range(6000)]
    return [*made, "", "a" * 5000, " " * 3000, "'" * 77, "\n\n\n", "x \n", "ab" * 40_000, None]


def test_ids_WHEN_any_text_SHOULD_equal_the_library_and_decode(bpe, library):
    for text, (ids, pieces) in zip(texts(), bpe.encode_batch(texts()), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode() and "".join(pieces) == (text or "")


def test_merge_WHEN_short_or_long_SHOULD_agree(bpe):
    random.seed(8)
    for _ in range(300):
        piece = bytes(random.choice(b"athein oers") for _ in range(random.randint(2, 64)))
        if piece not in bpe.ranks:
            long = bpe.merge(piece + b"")
            assert long == bpe._merge_short(piece) == _heap(bpe, piece)


def _heap(bpe, piece):
    import tessera.llm.byte_bpe as module

    limit, module.SHORT_PIECE = module.SHORT_PIECE, 0
    try:
        return bpe.merge(piece)
    finally:
        module.SHORT_PIECE = limit


def test_cache_WHEN_full_SHOULD_forget_the_old(library, monkeypatch):
    monkeypatch.setattr("tessera.llm.byte_bpe.CACHE_PIECES", 5)
    own = ByteBpe.load(bpe_ranks())
    for _ in range(3):
        for text in ("one two three four five six seven", "eight nine ten eleven twelve one"):
            assert list(memoryview(next(own.encode_batch([text]))[0]).cast("I")) == library.encode_ordinary(text)


def test_scan_WHEN_in_blocks_SHOULD_equal_one_by_one():
    machine, rng = Automaton(), np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000, 40_000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        at, want = machine.identity, []
        for f in machine.element[symbols]:
            at = machine.compose[at, f]
            want.append(at)
        assert machine._scan(machine.element[symbols]).tolist() == want


def test_starts_WHEN_documents_are_joined_SHOULD_not_cross():
    points = np.array([ord(c) for c in "don't \nit's\n"], np.uint32)
    assert piece_starts(points, np.array([6, 11])).tolist() == [0, 3, 5, 7, 9]


def test_query_WHEN_rows_are_odd_SHOULD_have_digests(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "it's", 0), (3, "é" * 20, 0), (3, "é" * 20, 0)], "doc_id long, text string, ids int")
    got = {(r.id, r.n_tokens, r.decoded_sha256) for r in digests(encode(docs, bpe_ranks)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(i, d) for i, _, d in got} == {(1, sha("")), (2, sha("")), (None, sha("it's")), (3, sha("é" * 20))}
    assert encode(docs.limit(0), bpe_ranks).count() == 0


def test_offsets_WHEN_pieces_are_decoded_alone_SHOULD_give_their_text(bpe):
    odd = texts()[:300] + ["é日本😀 don't  x", "", None, "a" * 5000]
    for text, (ids, pieces, in_bytes, in_ids) in zip(odd, bpe.encode_offsets(odd), strict=True):
        whole = (text or "").encode()
        ends = np.frombuffer(in_bytes, "<u4").tolist()
        assert ends == np.cumsum([len(p.encode()) for p in pieces]).tolist() and len(in_ids) == 4 * len(pieces)
        for k in range(len(pieces)):
            assert bpe.decode_pieces(ids, in_ids, k, k + 1) == pieces[k].encode()
        assert bpe.decode_pieces(ids, in_ids, 0, len(pieces)) == whole
        for a, b in ((0, len(whole)), (1, 3), (len(whole) // 2, len(whole)), (3, 3), (len(whole), len(whole) + 5)):
            assert bpe.decode_bytes(ids, in_bytes, in_ids, a, b) == whole[a:b]


def test_cache_WHEN_pieces_are_long_and_distinct_SHOULD_hold_bounded_bytes(monkeypatch):
    monkeypatch.setattr("tessera.llm.byte_bpe.CACHE_BYTES", 50_000)
    monkeypatch.setattr("tessera.llm.byte_bpe.CHUNK_CHARS", 20_000)
    own, rng = ByteBpe.load(bpe_ranks()), random.Random(2)
    for size in (200, 2000):
        made = ["".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(300)]
        for ids, text in zip((x for x, _ in own.encode_batch(made)), made):
            assert own.decode(ids) == text.encode()
        held = sum(200 + 4 * len(k) + len(v) for half in (own.cache, own.cache.old) for k, v in half.items())
        assert held < 4 * 50_000 + 10 * 20_000 and all(len(k) <= 256 for k in own.cache)


def test_worker_WHEN_its_task_ends_SHOULD_hold_no_pieces_and_return_its_memory(monkeypatch):
    import pyarrow as pa

    from tessera.llm import byte_bpe
    from tessera.sources import shipping

    calls = []
    monkeypatch.setattr(shipping, "release", lambda: calls.append(len(bpe.cache)))
    bpe = byte_bpe.ByteBpe({bytes([i]): i for i in range(256)} | {b"ab": 256})
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["ab ab", "b"])], names=["id", "text"])
    out = shipping.releasing(lambda batches: byte_bpe._encoded(bpe, batches))(iter([batch]))
    first = next(out)
    assert first.column("decoded").to_pylist() == [b"ab ab", b"b"] and len(bpe.cache) == 3 and not calls
    assert not list(out) and calls == [0] and not bpe.cache.old and bpe.cache.bytes == 0
