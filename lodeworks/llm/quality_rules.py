"""Quality rules: a linear-chain CRF labels each line as content or boilerplate; the content share decides retention.

Words are ``[^\\x20\\x09-\\x0D]+``. Hard rules come first (too few words, too many repeated three-word windows).
For the other documents, Viterbi decoding finds the most probable label sequence of the lines that have words; a
document stays if at least ``min_content`` of its words lie in content lines.

The CRF is trained here, by gradient ascent on the regularised conditional log-likelihood (forward-backward), on at
most ``max_documents`` labelled documents of each class (the first by the hash of their id), whole and with all their lines.
Lines get weak labels of their own: in a bad document all are boilerplate; in a good one those whose key (op9's: trimmed, A-Z
lower-cased) at least ``recurs`` different texts of the whole corpus hold, and the others are content. Where such lines have
most of a good document's words, it is a copy among others, and all its lines are content. The driver holds a few numbers for
each line of these documents, and no text. Where a class has no labelled document, the prior weights in ``PRIOR`` decode.

Defined cases: a null text has no words, so the document fails the hard rules; a null doc_id stays null; repeated
rows are judged alike, each by itself; of different texts with one id, that with the smallest hash is learnt from; an empty
table gives an empty result; extra columns are passed by ``filter_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import SPACE, ascii_lower, bounded, remove, stored

SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"[0-9]+")
ENDS = re.compile(r"[.!?] ")
#: Lines, with padding, that training steps at once.
CELLS = 1 << 18
#: Training cuts longer chains here, so that a step's length is bounded; every line counts.
CHAIN = 256
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)
FEATURES = (
    "bias", "few_words", "many_words", "symbols_some", "symbols_many", "shouting", "bangs_some", "bangs_many",
    "digits", "one_word_often", "few_distinct", "separators", "ends_sentence", "seen_before", "first", "last",
    "short", "several_sentences",
)
#: Weights that stand in until labels are at hand: content unless a line is mostly symbols, shouting or repetition.
PRIOR = {
    "state": {"bias": -2.0, "symbols_many": 2.5, "shouting": 1.5, "bangs_many": 2.0, "few_distinct": 2.0,
              "one_word_often": 1.0, "separators": 2.0, "seen_before": 1.0},
    "move": [[0.5, -0.5], [-0.5, 0.5]],
}


def prior_model() -> dict:
    weights = [PRIOR["state"].get(name, 0.0) for name in FEATURES]
    return {"state": weights, "move": PRIOR["move"]}


def word_list(text: str) -> list[str]:
    """Words of text. str.split() knows more white space than the rule does, so bytes are split."""
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").split()] if not text.isascii() else split_ascii(text)


def split_ascii(text: str) -> list[str]:
    """For ASCII texts str.split() differs from the rule by U+001C to U+001F alone."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w.decode() for w in text.encode().split()]
    return text.split()


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if window in often:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_features(words: list[str], seen: bool, first: bool, last: bool) -> list[int]:
    """Indexes into FEATURES that hold for a line."""
    n = len(words)
    line = " ".join(words)
    symbols = len(SYMBOLS.findall(line)) / n
    bangs = line.count("!!") / n
    shouts = line.upper() == line and sum(len(w) > 1 and w.isupper() for w in words) > 0.5 * n
    digits = DIGITS.findall(line)
    counts = Counter(words) if n > 3 else {}
    on = [0]
    if n < 4:
        on.append(1)
    if n > 60:
        on.append(2)
    if symbols > 0.15:
        on.append(3)
    if symbols > 0.8:
        on.append(4)
    if shouts:
        on.append(5)
    if bangs > 0.1:
        on.append(6)
    if bangs > 0.5:
        on.append(7)
    if digits and sum(map(len, digits)) > 0.3 * len(line):
        on.append(8)
    if counts and max(counts.values()) > max(3, 0.2 * n):
        on.append(9)
    if n > 7 and len(counts) < 0.4 * n:
        on.append(10)
    if words.count("|") > 0.2 * n:
        on.append(11)
    if line[-1] in ".?!":
        on.append(12)
    if seen:
        on.append(13)
    if first:
        on.append(14)
    if last:
        on.append(15)
    if 4 <= n < 16:
        on.append(16)
    if ENDS.search(line):
        on.append(17)
    return on


def text_lines(text: str) -> tuple[list[str], list[list[str]], list[list[int]], int]:
    """Words of the text; words and features of each line that has words; lines equal to an earlier one."""
    all_words, lines, seen, repeats, n_dup = [], [], set(), [], 0
    for line in text.split("\n"):
        words = word_list(line)
        if words:
            again = line in seen
            seen.add(line)
            n_dup += again
            lines.append(words)
            repeats.append(again)
            all_words += words
    last = len(lines) - 1
    return all_words, lines, [line_features(w, repeats[i], i == 0, i == last) for i, w in enumerate(lines)], n_dup


def viterbi(features: list[list[int]], state: list[float], move: list[list[float]]) -> list[int]:
    """The best labels (0 content, 1 boilerplate). A line's score for label 1 is the sum of its features' weights; ties go to content."""
    if not features:
        return []
    (m00, m01), (m10, m11) = move
    best0, best1 = 0.0, sum(state[k] for k in features[0])
    back = []
    for on in features[1:]:
        s = 0.0
        for k in on:
            s += state[k]
        stay0, come0 = best0 + m00, best1 + m10
        come1, stay1 = best0 + m01, best1 + m11
        back.append((0 if stay0 >= come0 else 1, 0 if come1 >= stay1 else 1))
        best0, best1 = max(stay0, come0), max(come1, stay1) + s
    label = 0 if best0 >= best1 else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def judge_text(text: str | None, model: dict, min_words: int, max_repeat_percent: int, min_content: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    text = text or ""
    words, lines, features, n_dup = text_lines(text)
    n = len(words)
    repeated = repeated_words(words)
    failed = n < min_words or 100 * repeated > max_repeat_percent * n
    labels = viterbi(features, model["state"], model["move"])
    share = sum(len(w) for w, label in zip(lines, labels) if label == 0) / n if n else 0.0
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), n_dup, repeated, failed, not failed and share >= min_content, share


def judge(docs: DataFrame, model: dict, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5) -> DataFrame:
    """One row per document with its counts, the hard rules' outcome and the verdict. Map-only: no shuffle."""

    def kernel(batches):
        types = [f.type for f in out_schema]
        for batch in batches:
            rows = [judge_text(t.as_py(), model, min_words, max_repeat_percent, min_content) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[] for _ in types[1:]]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    out_schema = pa.schema([
        ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()),
    ])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, SCHEMA)


def filter_documents(docs: DataFrame, model: dict, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns. Map-only: no shuffle."""
    at = docs.columns.index("text")

    def kernel(batches):
        for batch in batches:
            keep = [judge_text(t.as_py(), model, min_words, max_repeat_percent, min_content)[6] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def chosen_documents(docs: DataFrame, labels: DataFrame, max_documents: int, max_chars: int | None = None) -> DataFrame:
    """doc_id, text, y (1: bad) of at most max_documents documents of each class outside the held-out fold; max_chars: among texts of at most so many."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    if max_chars is not None:
        texts = texts.where(F.char_length("text") <= max_chars)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where("y = z and crc32(cast(doc_id as string)) % 5 != 0").select("doc_id", "y")
        .join(texts.select("doc_id"), "doc_id", "left_semi")
    )
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return found.select("doc_id", "one.text", (1 - F.col("y")).alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, max_documents: int, max_chars: int | None = None) -> list[tuple[str, int]]:
    """Texts and labels (1: bad) of chosen_documents, by id."""
    found = chosen_documents(docs, labels, max_documents, max_chars)
    return [(r.text, r.y) for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def line_keys(text: Column) -> Column:
    """A hash for each line that has words."""
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))
    return F.transform(F.filter(keys, lambda key: key != ""), lambda key: F.xxhash64(key))


def bits_of(features: list[list[int]]) -> np.ndarray:
    """A line's features as the bits of one number."""
    return np.array([sum(1 << i for i in on) for on in features], np.int32)


def training_lines(docs: DataFrame, labels: DataFrame, max_documents: int, recurs: int = 10, max_chars: int | None = None) -> list[tuple]:
    """(features, weak labels, y) of each chosen document: one number a line."""

    def kernel(batches):
        for batch in batches:
            made = [text_lines(t.as_py()) for t in batch.column(2)]
            bits, sizes = ([f(m) for m in made] for f in (lambda m: bits_of(m[2]), lambda m: [len(w) for w in m[1]]))
            arrays = [batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, pa.list_(pa.int32())) for c in (bits, sizes))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "y", "keys", "bits", "sizes"])

    rows = chosen_documents(docs, labels, max_documents, max_chars).select("doc_id", "y", "text", line_keys(F.col("text")).alias("keys"))
    lines = stored(rows.mapInArrow(kernel, "doc_id long, y int, keys array<long>, bits array<int>, sizes array<int>"), "lines")
    wanted = stored(lines.where("y = 0").select(F.explode("keys").alias("key")).distinct(), "keys")
    every = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("t"), F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))
    often = every.join(bounded(wanted), "key", "left_semi").groupBy("key").agg(F.count_distinct("t").alias("n")).where(F.col("n") >= recurs)
    common = np.sort(often.select("key").toArrow().column("key").to_numpy())
    out = []
    for r in lines.orderBy("doc_id").select("y", "keys", "bits", "sizes").toArrow().to_pylist():
        size = np.array(r["sizes"], np.int64)
        label = np.full(len(size), r["y"])
        if not r["y"]:
            again = np.isin(np.array(r["keys"], np.int64), common)
            label = again.astype(int) if 2 * size[again].sum() <= size.sum() else label
        out.append((np.array(r["bits"], np.int32), label, r["y"]))
    remove(lines)
    remove(wanted)
    return out


def train(
    docs: DataFrame, labels: DataFrame, max_documents: int = 400, rounds: int = 150, rate: float = 0.5, penalty: float = 1e-3,
    max_chars: int | None = None, recurs: int = 10,
) -> dict:
    """Fits the CRF on the driver, from a bounded sample (max_documents of each class). Corpus counts cover all documents."""
    return fit_lines(training_lines(docs, labels, max_documents, recurs, max_chars), rounds, rate, penalty)


def batches_of(sizes: list[int]) -> list[range]:
    """Places in sorted sizes that are stepped at once: of like length or short, and of at most CELLS lines when padded."""
    out, a = [], 0
    for z in range(1, len(sizes) + 1):
        if z == len(sizes) or sizes[z] > max(64, 2 * sizes[a]) or (z + 1 - a) * sizes[z] > CELLS:
            out.append(range(a, z))
            a = z
    return out


def fit(sample: list[tuple[str, int]], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-3) -> dict:
    """fit_lines on texts all of whose lines have their document's label."""
    data = [(bits_of(text_lines(t)[2]), y) for t, y in sample]
    return fit_lines([(bits, np.full(len(bits), y), y) for bits, y in data], rounds, rate, penalty)


def training_parts(data: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
    """Features of each kind of line, and (size, label, scale, alive, kind) of chains that are stepped at once, padded to the longest.

    data: (features, labels, y) of documents with lines. Both classes weigh the same, and so do a class's documents."""
    kinds, kind_of = np.unique(np.concatenate([bits for bits, _, _ in data]), return_inverse=True)
    x = (kinds[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)
    n_of = Counter(y for _, _, y in data)
    begin, chains = 0, []
    for bits, label, y in data:
        n = len(bits)
        for at in range(0, n, CHAIN):
            z = min(n, at + CHAIN)
            chains.append((z - at, begin + at, 0.5 / n_of[y] / n))
        begin += n
    labels = np.concatenate([label for _, label, _ in data])
    chains.sort()
    sizes, begins, scales = (np.array(c) for c in zip(*chains))
    parts = []
    for part in batches_of(sizes.tolist()):
        size = sizes[part]
        place = np.arange(size.max())[None, :]
        alive = place < size[:, None]
        at = np.where(alive, begins[part][:, None] + place, 0)
        parts.append((size, np.where(alive, labels[at], 0), scales[part], alive, np.where(alive, kind_of[at], 0)))
    return x, parts


def objective(w: np.ndarray, x: np.ndarray, parts: list[tuple]) -> tuple[float, np.ndarray]:
    """Weighted conditional log-likelihood of the labels, and its gradient, by forward-backward."""
    k = x.shape[1]
    state, move = w[:k], w[k:].reshape(2, 2)
    value, grad, of_kind = 0.0, np.zeros_like(w), np.zeros(len(x))
    for size, label, scale, alive, kind in parts:
        n, length = alive.shape
        score = np.zeros((n, length, 2))
        score[:, :, 1] = (x @ state)[kind]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            for b in (0, 1):
                forward[:, t, b] = score[:, t, b] + np.logaddexp(forward[:, t - 1, 0] + move[0, b], forward[:, t - 1, 1] + move[1, b])
        for t in range(length - 2, -1, -1):
            for a in (0, 1):
                ahead = score[:, t + 1] + backward[:, t + 1] + move[a]
                backward[:, t, a] = np.where(t + 1 < size, np.logaddexp(ahead[:, 0], ahead[:, 1]), 0.0)
        rows = np.arange(n)
        total = np.logaddexp(forward[rows, size - 1, 0], forward[rows, size - 1, 1])
        p1 = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - total[:, None])) * alive
        own = (score[:, :, 1] * label * alive).sum(1)
        of_kind += np.bincount(kind.ravel(), ((label * alive - p1) * scale[:, None]).ravel(), len(x))
        if length > 1:
            both = alive[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    joint = forward[:, :-1, a] + move[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                    expected = np.exp(np.minimum(0, joint)) * both
                    seen = (label[:, :-1] == a) & (label[:, 1:] == b) & both
                    own += move[a, b] * seen.sum(1)
                    grad[k + 2 * a + b] += ((seen - expected) * scale[:, None]).sum()
        value += float((scale * (own - total)).sum())
    grad[:k] = of_kind @ x
    return value, grad


def fit_lines(data: list[tuple], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-3) -> dict:
    """Regularised maximum likelihood by Adam steps over all lines. data: (features, labels, y) of each document."""
    data = [d for d in data if len(d[0])]
    if {y for _, _, y in data} != {0, 1}:
        return prior_model()
    x, parts = training_parts(data)
    start = prior_model()
    w = np.concatenate([np.array(start["state"]), np.array(start["move"]).ravel()])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = objective(w, x, parts)[1] - penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) / math.sqrt(step)
    k = len(FEATURES)
    return {"state": [float(z) for z in w[:k]], "move": w[k:].reshape(2, 2).tolist()}
