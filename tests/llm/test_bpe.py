import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import bpe
from tests.llm.fixtures import documents, empty, key_rows, odd_documents, texts

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text[:80]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(own, library):
    for text in [*texts(), *(r[1] or "" for r in odd_documents())]:
        same(own, library, text)


@pytest.mark.parametrize("text", [
    "", " ", "İstanbul ΣΑΣ", "<|endoftext|>a<|startoftext|>B", "<|endoftext|", "é Å K", "'S 'll can't", "日本語 १२३ ½²",
    "👩‍👩‍👧", "\x00\x01 \x7f", "\x1c\x1d\x1e\x1f\x85x", "ẞ ß ﬁ", " </w> a</w>b", "Ᲊ Ɤ \U00010d50", "a" * 3000, "ab" * 2000, "﻿a",
])
def test_odd_texts(own, library, text):
    same(own, library, text)


def test_random_letters(own, library):
    rng = random.Random(2)
    for _ in range(3000):
        same(own, library, "".join(rng.choice("etaoinshrdlu'") for _ in range(rng.randrange(1, 40))))


def test_every_code_point(own, library):
    every = [chr(c) for c in [*range(0xD800), *range(0xF900, 0x20000, 7)]]
    for at in range(0, len(every), 500):
        same(own, library, " ".join(f"a{c}1" for c in every[at : at + 500]))


def test_marks(own, library):
    """Marks of all classes beside one another, also those that are newer than the library's tables."""
    rng = random.Random(5)
    import unicodedata

    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    for _ in range(1500):
        same(own, library, "".join(rng.choice([rng.choice("aeoAE "), rng.choice(marks)]) for _ in range(12)))


def merged(own, ids, a, b):
    """The plain merge of two tokens' symbols: lowest rank first, leftmost first."""
    def symbols(i):
        return [i] if i not in own.split else symbols(own.split[i][0]) + symbols(own.split[i][1])

    parts = symbols(a) + symbols(b)
    while True:
        found = [(own.merge_rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in own.merge_rank]
        if not found:
            return parts
        rank, _ = min(found)
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and own.merge_rank.get((parts[k], parts[k + 1])) == rank:
                out.append(ids[parts[k], parts[k + 1]])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


def test_compatibility_table(own):
    """A pair is compatible if and only if merging its joined symbols gives back the pair."""
    rng = random.Random(4)
    names = {i: t for t, i in own.ids.items()}
    joined = {pair: own.ids[names[pair[0]] + names[pair[1]]] for pair in own.merge_rank}
    inner = [i for i, t in names.items() if not t.endswith(bpe.MARK)]
    pairs = [(rng.choice(inner), rng.choice(list(names))) for _ in range(3000)] + rng.sample(list(own.merge_rank), 1000)
    pairs += [own.split[i] for i in rng.sample(sorted(own.split), 1000)]
    for a, b in pairs:
        assert own.may_follow(a, b) == (merged(own, joined, a, b) == [a, b]), (names[a], names[b])


def test_report(spark, library):
    rows = odd_documents()
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert key_rows(bpe.round_trip_report(documents(spark, clashing=True), FILE).collect()) == key_rows(expected)
    assert bpe.round_trip_report(empty(spark), FILE).count() == 0


def test_encode_and_decode_frames(spark, library):
    rows = [(i, t, None, None, None) for i, t in enumerate(["Hello there", None, "", "naïve café"])]
    ids = bpe.encode(documents(spark, rows=rows), FILE)
    found = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert found == {i: library.encode(r[1] or "", add_special_tokens=False).ids for i, r in enumerate(rows)}
    decoded = {r.doc_id: r.text for r in bpe.decode(ids, FILE).collect()}
    assert decoded == {i: library.decode(v, skip_special_tokens=False) for i, v in found.items()}
