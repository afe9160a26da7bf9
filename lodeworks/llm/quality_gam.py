"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes ``FEATURES`` numbers. Cyclic boosting goes round the features: for each it fits a shallow tree (at most
three cuts of that one feature's bins) to the current residuals and adds its leaves, times a small rate, to the feature's lookup table.
Then the pairs of features with the strongest remaining interaction get two-way tables the same way (one cut of each feature, four leaves).
A score is the logistic function of an intercept and the sum of table entries; scoring is bin lookup and vectorised addition.

Learning: labels of rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` of them (the first by a hash
of the id). Labels, lang, source and doc_id are no inputs. Texts are read once: features are written to the shared
folder, narrow, and both the join with the labels and the scoring read that table.

Defined cases: a null text is an empty one (all features zero) and is scored; a null doc_id counts as the empty string
for the fold; an id with contradicting labels teaches nothing; of different texts with one id, that with the smallest features
is learnt from; repeated rows are scored alike; where a class has no
label, the score is the share of good labels, or one half with no label at all; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import stored, text_of

FEATURES = (
    "words", "word_length", "long_words", "symbols", "bars", "bangs", "digits", "upper", "shouted", "other_letters",
    "distinct_words", "top_word", "repeated_next", "repeated_triples", "lines", "repeated_lines", "sentence_ends", "words_a_line",
)
SYMBOLS = re.compile(r"[#*$%&|<>@^~=_{}\[\]\\]")
DIGITS = re.compile(r"[0-9]")
UPPER = re.compile(r"[A-Z]")
ENDS = re.compile(r"[.!?](?=\s|$)")


def features_of(text: str | None) -> list[float]:
    """One number for each of FEATURES."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum([len(w) > 20 for w in words]) / n,
        len(SYMBOLS.findall(text)) / n,
        counts.get("|", 0) / n,
        text.count("!!") / n,
        len(DIGITS.findall(text)) / size,
        len(UPPER.findall(text)) / size,
        sum([w.isupper() for w in words]) / n,
        (size - len(text.encode("ascii", "ignore"))) / size,
        len(counts) / n,
        max(counts.values()) / n,
        sum([a == b for a, b in zip(words, words[1:])]) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        len(ENDS.findall(text)) / n,
        float(np.log1p(n / len(lines))),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x (array<float> of FEATURES). Map-only."""

    def kernel(batches):
        for batch in batches:
            x = np.array([features_of(t.as_py()) for t in batch.column(2)], np.float32).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "held_out", "x"])

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    rows = docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), text_of(F.col("text")).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, held_out boolean, x array<float>")


class Gam:
    """Bins, lookup tables and intercept."""

    def __init__(self, rate: float = 0.1, rounds: int = 150, bins: int = 48, pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 60, smooth: float = 5.0):
        self.rate, self.rounds, self.bins, self.pairs = rate, rounds, bins, pairs
        self.pair_bins, self.pair_rounds, self.smooth = pair_bins, pair_rounds, smooth
        self.intercept, self.edges, self.coarse = 0.0, [], []
        self.tables: list[np.ndarray] = []
        self.pair_tables: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    def _steps(self, bin_: np.ndarray, n: int, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """Leaves of a tree of at most three cuts (one, then one in each half), as one value a bin."""
        g, h = np.bincount(bin_, slope, n), np.bincount(bin_, bend, n)
        out = np.zeros(n)

        def best_cut(a, z):
            if z - a < 2:
                return None
            cg, ch = np.cumsum(g[a:z]), np.cumsum(h[a:z])
            left = cg[:-1] ** 2 / (ch[:-1] + self.smooth)
            right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + self.smooth)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + self.smooth)
            at = int(gain.argmax())
            return a + at + 1 if gain[at] > 1e-9 else None

        cut = best_cut(0, n)
        if cut is None:
            return out
        spans = []
        for a, z in ((0, cut), (cut, n)):
            inner = best_cut(a, z)
            spans += [(a, z)] if inner is None else [(a, inner), (inner, z)]
        for a, z in spans:
            out[a:z] = g[a:z].sum() / (h[a:z].sum() + self.smooth)
        return out

    def _corners(self, a: np.ndarray, b: np.ndarray, shape: tuple[int, int], slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, float]:
        """Four leaves of the best cross of one cut of each feature, and its gain."""
        cell = a * shape[1] + b
        g = np.bincount(cell, slope, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)
        h = np.bincount(cell, bend, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)

        def quarters(t):
            whole, low, left = t[-1, -1], t[:-1, -1:], t[-1:, :-1]
            both = t[:-1, :-1]
            return both, low - both, left - both, whole - low - left + both

        out = np.zeros(shape)
        if min(shape) < 2:
            return out, 0.0
        gq, hq = quarters(g), quarters(h)
        gain = sum(x * x / (y + self.smooth) for x, y in zip(gq, hq)) - g[-1, -1] ** 2 / (h[-1, -1] + self.smooth)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        leaf = [x[i, j] / (y[i, j] + self.smooth) for x, y in zip(gq, hq)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
        return out, float(gain[i, j])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        m = x.shape[1]
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
            self.intercept = float(np.log(share / (1 - share)))
            self.edges = [np.empty(0)] * m
            self.tables = [np.zeros(1)] * m
            return self
        self.intercept = float(np.log(y.mean() / (1 - y.mean())))
        self.edges = [self._edges(x[:, f], self.bins) for f in range(m)]
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        raw = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for f in range(m):
                p = 1 / (1 + np.exp(-raw))
                step = self.rate * self._steps(bins[f], len(self.tables[f]), y - p, p * (1 - p))
                self.tables[f] += step
                raw += step[bins[f]]
        self.coarse = [self._edges(x[:, f], self.pair_bins) for f in range(m)]
        small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-raw))
        ranked = []
        for a in range(m):
            for b in range(a + 1, m):
                shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
                ranked.append((-self._corners(small[a], small[b], shape, y - p, p * (1 - p))[1], a, b, shape))
        chosen = [(a, b, np.zeros(shape)) for _, a, b, shape in sorted(ranked, key=lambda r: r[:3])[: self.pairs]]
        for _ in range(self.pair_rounds):
            for a, b, table in chosen:
                p = 1 / (1 + np.exp(-raw))
                step = self.rate * self._corners(small[a], small[b], table.shape, y - p, p * (1 - p))[0]
                table += step
                raw += step[small[a], small[b]]
        self.pair_tables = chosen
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        raw = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            raw += table[np.searchsorted(edges, x[:, f], "right")]
        for a, b, table in self.pair_tables:
            raw += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-raw))


def train(features: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Gam:
    """Fits on the driver, on at most max_rows labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where((F.col("y") == F.col("z")) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")
    )
    rows = features.where(~F.col("held_out")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
    return Gam().fit(x, rows.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    features = stored(with_features(docs), "features")
    model = train(features, labels, max_rows)

    def kernel(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            s = model.score(x)
            made = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "score", "predicted"])

    return features.select("doc_id", "held_out", "x").mapInArrow(kernel, "doc_id long, held_out boolean, score double, predicted int")
