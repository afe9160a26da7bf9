import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import quality_rules
from tests.llm.fixtures import SF, documents, empty, key_rows, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts(spark):
    found = quality_rules.judge(documents(spark), quality_rules.prior_model()).collect()
    expected = [(r[0], *plain(r[1])) for r in odd_documents()]
    assert key_rows(tuple(r)[:7] for r in found) == key_rows(expected)
    assert all(not r.kept for r in found if r.base_failed)


def every_path(features, state, move):
    """The best label sequence by trying all."""
    n = len(features)
    best = None
    for code in range(2**n):
        labels = [(code >> i) & 1 for i in range(n)]
        score = sum(sum(state[k] for k in f) for f, y in zip(features, labels) if y) + sum(move[a][b] for a, b in zip(labels, labels[1:]))
        if best is None or score > best[0] + 1e-9:
            best = (score, labels)
    return best


def test_viterbi_is_the_best_path():
    rng = random.Random(8)
    for _ in range(60):
        state = [rng.uniform(-2, 2) for _ in quality_rules.FEATURES]
        move = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        features = [rng.sample(range(len(state)), 3) for _ in range(rng.randrange(1, 9))]
        score, _ = every_path(features, state, move)
        labels = quality_rules.viterbi(features, state, move)
        own = sum(sum(state[k] for k in f) for f, y in zip(features, labels) if y) + sum(move[a][b] for a, b in zip(labels, labels[1:]))
        assert own == pytest.approx(score)


def test_held_out_labels(spark):
    """Rows that training left out: good documents stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels)
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0")
    rows = quality_rules.judge(docs, model).join(held, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) == len(good) and sum(bad) <= 0.1 * len(bad)


def test_filter_keeps_rows_whole(spark):
    docs = documents(spark, clashing=True)
    model = quality_rules.prior_model()
    kept = quality_rules.filter_documents(docs, model)
    assert kept.columns == docs.columns
    expected = [r for r in docs.collect() if quality_rules.judge_text(r.text, model, 50, 50, 0.5)[6]]
    assert key_rows(kept.collect()) == key_rows(expected) and expected


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(documents(spark), none) == quality_rules.prior_model()
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.train(documents(spark), odd) == quality_rules.prior_model()


def test_empty_table(spark):
    assert quality_rules.judge(empty(spark), quality_rules.prior_model()).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality_rules.train(empty(spark), labels) == quality_rules.prior_model()


def test_digits_are_counted_over_the_whole_line():
    at = quality_rules.FEATURES.index("digits")
    prose, numbers = ["word"] * 100, ["0123456789"] * 300
    assert at in quality_rules.line_features(prose + numbers, False, False, False)
    assert at not in quality_rules.line_features(numbers[:50] + prose * 20, False, False, False)


def test_training_reads_all_lines(monkeypatch):
    good, bad = "these are words of a plain sentence.\n", "## $$ || ##\n"
    short = [(good * 5, 0), (bad * 5, 1), (good + bad * 4, 1), (good * 70, 0), (bad * 300, 1)]
    one, other = (quality_rules.fit([*short, (good * 200 + tail * 300, 0)]) for tail in (good, bad))
    assert one["state"] != pytest.approx(other["state"], abs=1e-3)
    monkeypatch.setattr(quality_rules, "CELLS", 400)
    split = quality_rules.fit([*short, (good * 200 + good * 300, 0)])
    assert split["state"] == pytest.approx(one["state"], abs=1e-6) and sum(split["move"], []) == pytest.approx(sum(one["move"], []), abs=1e-6)


def test_sample_is_chosen_within_the_bound(spark):
    rows = [(i, "a word " * (1000 if i % 3 else 10), None, None, None) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for most, bound in ((2, 100), (4, 100_000)):
        sample = quality_rules.training_sample(documents(spark, rows=rows), labels, most, bound)
        assert sorted(y for _, y in sample) == [0] * most + [1] * most and all(len(t) <= bound for t, _ in sample)


def chains(seed, documents=6, longest=5):
    rng = random.Random(seed)
    out = []
    for i in range(documents):
        n = rng.randrange(1, longest + 1)
        features = [[0, *rng.sample(range(1, len(quality_rules.FEATURES)), 3)] for _ in range(n)]
        out.append((features, [rng.randrange(2) for _ in range(n)], i % 2))
    return out


def test_objective_equals_enumeration():
    """Log of the labelled path's share of all paths, each document by its weight."""
    rng = np.random.default_rng(3)
    docs = chains(3)
    w = rng.normal(0, 1, len(quality_rules.FEATURES) + 4)
    state, move = w[:-4], w[-4:].reshape(2, 2)

    def score(features, labels):
        return sum(sum(state[k] for k in f) for f, y in zip(features, labels) if y) + sum(move[a][b] for a, b in zip(labels, labels[1:]))

    expected = 0.0
    for features, labels, y in docs:
        n = len(features)
        paths = [score(features, [(code >> i) & 1 for i in range(n)]) for code in range(2**n)]
        share = score(features, labels) - math.log(sum(map(math.exp, paths)))
        expected += share * 0.5 / sum(d[2] == y for d in docs) / n
    x, parts = quality_rules.training_parts([(quality_rules.bits_of(f), np.array(labels), y) for f, labels, y in docs])
    assert quality_rules.objective(w, x, parts)[0] == pytest.approx(expected)


@pytest.mark.parametrize("chain", [3, 256])
def test_gradient_equals_differences(monkeypatch, chain):
    monkeypatch.setattr(quality_rules, "CHAIN", chain)
    x, parts = quality_rules.training_parts([(quality_rules.bits_of(f), np.array(labels), y) for f, labels, y in chains(4, 8, 9)])
    w = np.random.default_rng(5).normal(0, 1, len(quality_rules.FEATURES) + 4)
    grad = quality_rules.objective(w, x, parts)[1]
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert grad[i] == pytest.approx((quality_rules.objective(up, x, parts)[0] - quality_rules.objective(down, x, parts)[0]) / 2e-5, abs=1e-7)


def test_recurring_lines_are_boilerplate_to_learn_from(spark):
    """In texts that differ; copies of one text do not make its lines boilerplate, nor do lines that are most of a text."""
    menu, prose = "Home | About", "these are plain words of a sentence."
    rows = [(i, f"{menu}\n{prose} {i} {prose}\n  HOME | about ", None, None, None) for i in range(12)]
    rows += [(100 + i, "a copied line of words\nand another one", None, None, None) for i in range(20)]
    rows += [(200 + i, f"{menu}\n{menu}\n{i}", None, None, None) for i in range(12)]
    rows += [(300, "## $$\n\n%% ##", None, None, None), (301, None, None, None, None)]
    labels = spark.createDataFrame([(r[0], int(r[0] != 300), 0) for r in rows], "doc_id long, quality int, toxic int")
    fold = {r.doc_id for r in labels.where("crc32(cast(doc_id as string)) % 5 != 0").collect()}
    found = quality_rules.training_lines(documents(spark, rows=rows), labels, 100)
    expected = []
    for i, text, *_ in rows:
        if i in fold and text is not None:
            expected.append([1, 0, 1] if i < 100 else [0, 0] if i < 200 else [0, 0, 0] if i < 300 else [1, 1])
    assert [label.tolist() for _, label, _ in found] == expected
    assert [[f.tolist(), y] for f, _, y in found] == [
        [quality_rules.bits_of(quality_rules.text_lines(t)[2]).tolist(), int(i == 300)] for i, t, *_ in rows if i in fold and t is not None
    ]


def test_menu_lines_around_good_prose(spark):
    """Trained on the test tables, the labeller marks both kinds of lines in one document, and the document stays."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels)
    prose = next(r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("n_chars > 1500 and lang = 'en'").orderBy("doc_id").collect())
    lines = ["Home | About", "Log in | Help", "Menu | Search", *(x for x in prose.split("\n") if len(x.split()) > 30), "Terms | Privacy", "Site | Map", "Top | Back"]
    labels_of = quality_rules.viterbi(quality_rules.text_lines("\n".join(lines))[2], model["state"], model["move"])
    assert labels_of[:3] == [1, 1, 1] == labels_of[-3:] and not any(labels_of[3:-3]) and len(labels_of) > 6
    assert quality_rules.judge_text("\n".join(lines), model, 50, 50, 0.5)[6]


def test_different_texts_of_one_id_are_chosen_from_by_hash(spark):
    rows = [(7, f"text {i}", None, None, None) for i in range(6)]
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    found = {quality_rules.training_sample(documents(spark, rows=order), labels, 5)[0][0] for order in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(found) == 1


def test_judge_takes_clashing_columns(spark):
    model = quality_rules.prior_model()
    assert key_rows(quality_rules.judge(documents(spark, clashing=True), model).collect()) == key_rows(quality_rules.judge(documents(spark), model).collect())
