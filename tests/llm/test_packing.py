import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import packing
from tests.llm.fixtures import documents, empty, odd_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_hold_every_id_once(spark, library):
    rows = odd_documents()
    found = [r.asDict() for r in packing.pack(documents(spark, clashing=True), RANKS).collect()]
    expected = {}
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected.setdefault((r[0], len(ids)), []).append(ids)
    got = {}
    for p in found:
        got.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    assert set(got) == set(expected)
    for key, docs in expected.items():
        pieces = sorted((p["start"], p["length"], p["ids_crc32"]) for p in got[key])
        own = []
        for ids in docs:
            for start, length, _ in packing.cut(len(ids)):
                own.append((start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
        assert pieces == sorted(own)
    sequences = {}
    for p in found:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    used = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        used += at
    assert set(sequences) == set(range(len(sequences)))
    # No more windows than whole ones, one for each kind of greedy rest, and a few.
    assert len(sequences) <= used / 2048 + 6


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|>", "  x  \n\n y\t", "I'll don't 'S", "日本語 १२३", "\x1c\x85　 z", "a" * 4000])
def test_ids(library, text):
    tokens = packing.ByteTokens(RANKS)
    for _ in range(2):
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids == tokens.by_words(text)


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "\n" * 1_100_000, "ab" * 200_000])
def test_extreme_texts(library, text):
    tokens = packing.ByteTokens(RANKS)
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.by_words(text)


def test_cut_covers():
    for n in [*range(1, 200), 2047, 2048, 2049, 4096, 10_000]:
        pieces = packing.cut(n)
        assert sum(p[1] for p in pieces) == n and [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]


def test_combinations():
    def plain(total, depth, most):
        if depth == 0 or total <= 0:
            return [()] if total == 0 else []
        return [(x, *rest) for x in range(min(most, total), 0, -1) for rest in ([()] if x == total else plain(total - x, depth - 1, x))]

    assert sorted(packing.combinations_filling(12, 4)) == sorted(c for c in plain(12, 4, 11))


def test_nnls():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a = rng.integers(0, 4, (6, 15)).astype(float)
        b = rng.integers(0, 30, 6).astype(float)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        # The conditions of an optimum.
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 1e-9]).max(initial=0) <= 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_ranks(seed):
    rng = random.Random(seed)
    histogram = {b: rng.randrange(0, 10 ** rng.randrange(1, 6)) for b in rng.sample(range(0, 95), rng.randrange(1, 95))}
    histogram = {b: n for b, n in histogram.items() if n}
    plan = packing.Plan(histogram)
    length = lambda b: 2048 if b == 0 else 64 * b if b < 32 else b - 31
    sequence, offset, size = [], [], []
    for b, n in histogram.items():
        s, o = plan.find(b, np.arange(n))
        sequence.append(s)
        offset.append(o)
        size.append(np.full(n, length(b)))
    if not histogram:
        return
    sequence, offset, size = map(np.concatenate, (sequence, offset, size))
    order = np.lexsort((offset, sequence))
    sequence, offset, size = sequence[order], offset[order], size[order]
    fresh = np.concatenate(([True], np.diff(sequence) > 0))
    ends = offset + size
    assert (offset[fresh] == 0).all() and (offset[1:][~fresh[1:]] == ends[:-1][~fresh[1:]]).all() and ends.max() <= 2048
    assert sequence.max() + 1 == plan.next == len(np.unique(sequence))


def test_little_padding_where_lengths_are_mixed():
    rng = np.random.default_rng(1)
    histogram = {}
    for n in rng.lognormal(6, 1, 20_000).astype(int) + 1:
        for _, _, b in packing.cut(int(n)):
            histogram[b] = histogram.get(b, 0) + 1
    plan = packing.Plan(histogram)
    ids = sum(n * (2048 if b == 0 else 64 * b if b < 32 else b - 31) for b, n in histogram.items())
    assert ids / (2048 * plan.next) > 0.999


def test_empty_table(spark):
    assert packing.pack(empty(spark), RANKS).count() == 0
