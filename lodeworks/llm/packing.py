"""Packing of token sequences into fixed windows by non-negative least squares.

A document's ids (byte-level BPE, then an end id) are cut into whole windows, then a piece of whole units (64 ids) and a
rest of under a unit. The lengths' histogram, of under a hundred bins, is all that the driver sees. Shallow combinations
(up to four lengths) that fill a window of units, or a unit with rests, are enumerated; non-negative least squares
(Lawson-Hanson) finds how often each is to be used so that the histogram is met; counts are rounded down; what is left is
packed greedily, by kinds of windows and not by pieces. A filled unit of rests takes the place of one unit.

A piece finds its place from its rank among pieces of its length: the rank in its task plus the earlier tasks' counts.
Texts are read once, map-only; no id is shuffled, and the plan that tasks get has a bounded size.

Defined cases: a null or empty text has the end id alone; repeated rows and null ids are documents of their own; texts of
any length are cut whole; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.llm.common import bounded, stored, worker_cache

WINDOW = 2048
UNIT = 64
DEPTH = 4
END_ID = 1
#: Fixed values of the vocabulary: how text is split before merges, and the special token.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part int, rank long"


class ByteTokens:
    """Ids of texts as little-endian 32-bit bytes. Special tokens in a text count as such."""

    def __init__(self, rank_file: str):
        import base64

        import regex
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = len(ranks)
        self.words_of = regex.compile(SPLIT).findall
        self.encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special})

    def encode(self, text: str) -> bytes:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # runs of white space that are too long for the encoder's own split
            return np.array(self.by_words(text), "<u4").tobytes()

    def by_words(self, text: str) -> list[int]:
        """The same ids, split here and merged word by word."""
        out: list[int] = []
        for i, segment in enumerate(text.split(SPECIAL)):
            if i:
                out.append(self.special)
            for word in self.words_of(segment):
                out += self.encoding._encode_single_piece(word)
        return out


def cut(n: int, window: int = WINDOW, unit: int = UNIT) -> list[tuple[int, int, int]]:
    """(start, length, bin) of a document of n ids. Bin 0: whole window; 1 .. window/unit - 1: whole units; then rests."""
    units = window // unit
    out = [(at, window, 0) for at in range(0, n - window + 1, window)]
    at = len(out) * window
    whole = (n - at) // unit
    if whole:
        out.append((at, whole * unit, whole))
        at += whole * unit
    if at < n:
        out.append((at, n - at, units - 1 + n - at))
    return out


def pieces(docs: DataFrame, rank_file: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their bin, the task that cut them, and their rank in task and bin."""

    def kernel(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens, ranks = worker_cache(("bytes", rank_file), lambda: ByteTokens(rank_file)), {}
        end = np.array([end_id], "<u4").tobytes()
        fields = pa.schema([(n, pa.int32() if n in ("bin", "part") else pa.int64()) for n in
                            ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "rank")])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(tokens.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for start, length, bin_ in cut(n, window, unit):
                    rank = ranks.get(bin_, 0)
                    ranks[bin_] = rank + 1
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, bin_, part, rank))
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, PIECES)


def combinations_filling(total: int, depth: int) -> list[tuple[int, ...]]:
    """Descending lengths, two to ``depth`` of them, that add up to total."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(most, left), 0, -1):
                if x * (depth - len(head)) < left:
                    break
                extend((*head, x), left - x, x)

    extend((), total, total - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b|, x >= 0: active sets after Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * a.shape[0] + 50):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= limit:
            break
        passive[best] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (trial <= 1e-12)
            if not bad.any():
                x = trial
                break
            back = x[bad] - trial[bad]
            step = float(np.min(np.where(back > 0, x[bad] / np.where(back > 0, back, 1), 0)))
            x = x + step * (trial - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def solve(histogram: dict[int, int], total: int, depth: int = DEPTH) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations with repeat counts that the histogram covers, and what it has left."""
    left = {k: v for k, v in histogram.items() if v}
    used: list[tuple[tuple[int, ...], int]] = []
    choices = [c for c in combinations_filling(total, depth) if all(left.get(x, 0) for x in c)]
    if choices:
        bins = sorted(left)
        at = {x: i for i, x in enumerate(bins)}
        a = np.zeros((len(bins), len(choices)))
        for j, c in enumerate(choices):
            for x in c:
                a[at[x], j] += 1
        scale = float(max(left.values()))
        x = nnls(a, np.array([left[k] for k in bins], float) / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            times = min([int(x[j] + 1e-6), *(left[v] // choices[j].count(v) for v in set(choices[j]))])
            if times > 0:
                used.append((choices[j], times))
                for v in choices[j]:
                    left[v] -= times
    return used, {k: v for k, v in left.items() if v > 0}


def greedy(left: dict[int, int], total: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest length first, then the largest that still fits; a kind of window is repeated while its lengths last."""
    left, out = dict(left), []
    while left:
        room, kind = total, []
        for v in sorted(left, reverse=True):
            n = min(left[v], room // v)
            kind += [v] * n
            room -= n * v
        times = min(left[v] // kind.count(v) for v in set(kind))
        out.append((tuple(kind), times))
        for v in set(kind):
            left[v] -= times * kind.count(v)
            if not left[v]:
                del left[v]
    return out


class Plan:
    """For each bin, runs of ranks with their first sequence (or filled unit) and offset."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT):
        self.units = window // unit
        self.runs: dict[int, list[tuple[int, int, int, bool]]] = {}
        rests = {b - self.units + 1: n for b, n in histogram.items() if b >= self.units}
        wholes = {b: n for b, n in histogram.items() if 0 < b < self.units}
        taken: dict[int, int] = {}
        self.next = histogram.get(0, 0)
        self.runs[0] = [(0, 0, 0, False)]

        def place(bin_of, length_of, uses, first, inner):
            for lengths, times in uses:
                offset = 0
                for v in lengths:
                    b = bin_of(v)
                    rank = taken.get(b, 0)
                    taken[b] = rank + times
                    self.runs.setdefault(b, []).append((rank, first, offset, inner))
                    offset += length_of(v)
                first += times
            return first

        used, rest = solve(rests, unit)
        filled = place(lambda v: self.units - 1 + v, lambda v: v, used, 0, True)
        self.first_filled = wholes.get(1, 0)  # filled units come after the pieces of one unit
        if filled:
            wholes[1] = self.first_filled + filled
        used, rest_units = solve(wholes, self.units)
        self.next = place(lambda v: v, lambda v: v * unit, used, self.next, False)
        self.next = place(lambda v: v, lambda v: v * unit, greedy(rest_units, self.units), self.next, False)
        self.next = place(lambda v: self.units - 1 + v, lambda v: v, greedy(rest, window), self.next, False)
        self.table = {b: tuple(np.array(c) for c in zip(*sorted(r))) for b, r in self.runs.items()}

    def find(self, bin_: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of ranks of one bin."""
        begin, first, offset, inner = self.table[bin_]
        at = np.searchsorted(begin, rank, "right") - 1
        sequence, place = first[at] + rank - begin[at], offset[at].copy()
        nested = inner[at]
        if nested.any():
            outer, ahead = self.find(1, self.first_filled + sequence[nested])
            sequence[nested], place[nested] = outer, place[nested] + ahead
        return sequence, place


def pack(docs: DataFrame, rank_file: str, window: int = WINDOW, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    if window % unit or unit < 2:
        raise ValueError("a window is a number of whole units")
    made = stored(pieces(docs, rank_file, window, unit, end_id), "pieces")
    counts = stored(made.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # one row a bin
    plan = Plan(histogram, window, unit)
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("part", "bin", F.coalesce(before, F.lit(0)).alias("ahead"))
    ranked = made.join(bounded(stored(ahead, "ahead")), ["part", "bin"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("rank") + F.col("ahead")).alias("rank")
    )

    def kernel(batches):
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                mine = bins == b
                sequence[mine], offset[mine] = plan.find(int(b), ranks[mine])
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=batch.schema.names[:5] + ["sequence_id", "offset"])

    return ranked.mapInArrow(kernel, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
