import random

import numpy as np
import pytest
import xxhash

from lodeworks import storage
from lodeworks.llm import simhash
from tests.llm.fixtures import documents, empty, key_rows, odd_documents


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_groups(prints):
    return roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])


def plain(rows):
    rows = [r for r in rows if r[1] is None or len(r[1]) < 50_000]
    prints = [plain_print(r[1]) for r in rows]
    group = plain_groups(prints)
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group)], group, rows


def test_equals_plain(spark):
    rows = [r for r in odd_documents() if r[1] is None or len(r[1]) < 50_000]
    expected, _, _ = plain(rows)
    assert key_rows(simhash.group_report(documents(spark, rows=rows)).collect()) == key_rows(expected)
    assert len({r[2] for r in expected}) < len(expected)


def test_long_text():
    text = next(r[1] for r in odd_documents() if r[1] and len(r[1]) > 50_000)
    assert simhash.fingerprint(text) == plain_print(text)


def test_one_of_each_group_stays(spark):
    rows = [r for r in odd_documents() if r[1] is None or len(r[1]) < 50_000]
    docs = documents(spark, clashing=True, rows=rows)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    found = out.collect()
    _, group, _ = plain(rows)
    assert len(found) == len(set(group))
    ids = {}
    for r, g in zip(rows, group):
        ids.setdefault(g, []).append(r[0])
    expected = sorted((min((i for i in v if i is not None), default=None) for v in ids.values()), key=repr)
    assert sorted((r.doc_id for r in found), key=repr) == expected


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_near_is_exact():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = np.array([flipped(rng, x, rng.randrange(0, 9)) for x in base for _ in range(9)], np.uint64)
    for radius in (0, 1, 3, 4, 6):
        i, j = simhash.near(prints[:100], simhash.planes_of(prints), len(prints), radius)
        distance = np.bitwise_count(prints[:100, None] ^ prints[None, :])
        assert set(zip(i, j)) == set(zip(*np.nonzero(distance <= radius)))


@pytest.mark.parametrize("tile", [20_000, 16])
def test_links_lose_nothing(spark, monkeypatch, tile):
    """Also where every bucket of a crowded neighbourhood is cut into tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(7)
    crowd = rng.getrandbits(64)
    prints = {flipped(rng, crowd, rng.randrange(0, 5)) for _ in range(300)}
    prints |= {flipped(rng, x, rng.randrange(0, 7)) for x in [rng.getrandbits(64) for _ in range(60)] for _ in range(4)}
    prints = sorted(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    at = {p[0]: i for i, p in enumerate(signed)}
    assert roots(len(prints), [(at[r.a], at[r.b]) for r in found]) == plain_groups(prints)
    assert len(found) <= 15 * len(prints)


def test_empty_table(spark):
    assert simhash.group_report(empty(spark)).count() == 0
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_hot_keys_and_long_texts(spark, monkeypatch):
    """All rows, also the longest, many copies of one text and of near copies, where no table is small enough to broadcast whole."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = odd_documents()
    rows += [(1000 + i, rows[7][1], None, None, None) for i in range(40)]
    prints = [plain_print(t) for t in dict.fromkeys(r[1] for r in rows)]
    print_of = dict(zip(dict.fromkeys(r[1] for r in rows), prints))
    group = plain_groups([print_of[r[1]] for r in rows])
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    expected = [(r[0], f"{print_of[r[1]]:016x}", least.get(g)) for r, g in zip(rows, group)]
    assert key_rows(simhash.group_report(documents(spark, rows=rows)).collect()) == key_rows(expected)
