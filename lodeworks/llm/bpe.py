"""BPE encoding and decoding: a backtracking encoder over longest token matches, and an offset-table decoder.

Text goes the way of the vocabulary file: special tokens are split off, the rest is brought to NFC and lower-cased, and
words are found by its pattern. A word's bytes, as the vocabulary's symbols, end in a marker. An Aho-Corasick automaton
over all tokens finds the longest token at each position in one pass. The encoder takes the longest token that may
follow the last one and steps back to a shorter one where none may; whether two tokens may stand side by side (that no merge would
have crossed their border) is looked up in a pair-compatibility table, filled as pairs are met. A position that was
shown to lead nowhere is not tried again, so time is linear in the word.

Decoding joins slices of one byte string by a table of offsets. Words recur, so a bounded cache keeps their ids.

Defined cases: a null text counts as empty (no ids, empty decoded text); a null doc_id stays null; repeated rows are
encoded each by itself; texts of any length are encoded whole; an empty table gives an empty result; other columns play
no part. Map-only: no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Remembered, worker_cache

SUFFIX = "</w>"
#: Stands for the suffix inside the encoder; the vocabulary's symbols are all below U+0144.
MARK = "࿿"
#: Code points that the regex module counts as letters or digits and the vocabulary's library does not.
LATE = """
0x558-0x558 0x58B-0x58C 0x88F-0x88F 0xC5C-0xC5C 0xCDC-0xCDC 0x1C89-0x1C89 0x208F-0x208F 0x209D-0x209F
0xA7CB-0xA7CC 0xA7CE-0xA7CF 0xA7D2-0xA7D2 0xA7D4-0xA7D4 0xA7DA-0xA7DA 0xA7DC-0xA7DD 0xA7E2-0xA7E2
0xA7F1-0xA7F1 0xAB6C-0xAB6D 0x107BB-0x107BF 0x10940-0x10959 0x10D50-0x10D65 0x10EC5-0x10EC7 0x10ED9-0x10EEE
0x11B0A-0x11B0A 0x11DB0-0x11DDB 0x11DE0-0x11DE9 0x11DF1-0x11DF1 0x1246F-0x1246F 0x12475-0x1247F
0x12550-0x12686 0x16EA0-0x16EB8 0x16EBB-0x16ED3 0x16FF2-0x16FF6 0x187F8-0x187FF 0x18CD6-0x18CDA
0x18D09-0x18D20 0x18D80-0x18DF2 0x18E00-0x19191 0x191A0-0x191D2 0x1B123-0x1B128 0x1B168-0x1B168
0x1D6A6-0x1D6A6 0x1DF1F-0x1DF24 0x1DF2B-0x1DF81 0x1DF90-0x1DF96 0x1DFCD-0x1DFFF 0x1E6C0-0x1E6DE
0x1E6E0-0x1E6E2 0x1E6E4-0x1E6E5 0x1E6E7-0x1E6ED 0x1E6F0-0x1E6F4 0x1E6FE-0x1E6FF 0x2B73A-0x2B73F
0x2B81E-0x2B81E 0x2CEA2-0x2CEAD 0x323B0-0x33479 0x3D000-0x3FC3F
"""
#: Marks that the library's normal form neither moves nor joins, as its tables are older.
LATE_MARKS = """
0x7FD-0x7FD 0x898-0x89F 0x8CA-0x8D3 0x9FE-0x9FE 0xC3C-0xC3C 0xD3B-0xD3C 0xEBA-0xEBA 0x1715-0x1715
0x1ABF-0x1ACE 0x1DF6-0x1DFA 0xA82C-0xA82C 0x10D24-0x10D27 0x10EAB-0x10EAC 0x10EFD-0x10EFF 0x10F46-0x10F50
0x10F82-0x10F85 0x11070-0x11070 0x1133B-0x1133B 0x1145E-0x1145E 0x11839-0x1183A 0x11930-0x11930
0x1193D-0x1193E 0x11943-0x11943 0x119E0-0x119E0 0x11A34-0x11A34 0x11A47-0x11A47 0x11A99-0x11A99
0x11D42-0x11D42 0x11D44-0x11D45 0x11D97-0x11D97 0x11F41-0x11F42 0x16FF0-0x16FF1 0x1E08F-0x1E08F
0x1E130-0x1E136 0x1E2AE-0x1E2AE 0x1E2EC-0x1E2EF 0x1E4EC-0x1E4EF
"""
#: Capital letters that Python's tables lack, with their small letters (runs of one shift each).
LATE_LOWER = """
0x1C89-0x1C89:0x1C8A 0xA7CB-0xA7CB:0x264 0xA7CC-0xA7CC:0xA7CD 0xA7CE-0xA7CE:0xA7CF 0xA7D2-0xA7D2:0xA7D3
0xA7D4-0xA7D4:0xA7D5 0xA7DA-0xA7DA:0xA7DB 0xA7DC-0xA7DC:0x19B 0x10D50-0x10D65:0x10D70 0x16EA0-0x16EB8:0x16EBB
"""
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable Latin-1, else the next symbol from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def character_class(runs: str) -> str:
    """The inside of a character class of runs of code points."""
    return "".join("\\U{:08x}-\\U{:08x}".format(*(int(x, 16) for x in run.split("-"))) for run in runs.split())


def settled(pattern: str) -> str:
    """The split pattern with LATE counted as neither letters nor digits; slower, so for texts with such letters alone."""
    span = character_class(LATE)
    for old, new in ((r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{span}]]"), (r"[\p{L}]", rf"[\p{{L}}--[{span}]]"), (r"[\p{N}]", rf"[\p{{N}}--[{span}]]")):
        pattern = pattern.replace(old, new)
    return pattern


def late_lower() -> dict[int, int]:
    """For str.translate."""
    out = {}
    for run in LATE_LOWER.split():
        span, to = run.split(":")
        first, last = (int(x, 16) for x in span.split("-"))
        out |= {c: int(to, 16) + c - first for c in range(first, last + 1)}
    return out


def of_worker(vocabulary_file: str) -> WordBpe:
    return worker_cache(("bpe", vocabulary_file), lambda: WordBpe(vocabulary_file))


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary file."""

    CACHE = 250_000

    def __init__(self, vocabulary_file: str):
        import ahocorasick
        import regex

        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["end_of_word_suffix"] != SUFFIX or model["continuing_subword_prefix"] or model["byte_fallback"]:
            raise ValueError("not a word-level vocabulary with end-of-word suffix")
        self.special = {t["content"]: t["id"] for t in added}
        vocab: dict[str, int] = model["vocab"]
        marked = {token: (token[: -len(SUFFIX)] + MARK if token.endswith(SUFFIX) and len(token) > len(SUFFIX) else token) for token in vocab}
        self.ids = {marked[token]: i for token, i in vocab.items()}
        self.length = {i: len(t) for t, i in self.ids.items()}
        rank_of = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            rank_of[left, right] = rank
            # Of several merges that make a token, only that which its own symbols go through counts.
            self.split.setdefault(whole, (left, right))
            self.rank.setdefault(whole, rank)
        self.merge_rank = rank_of
        self.compatible: dict[tuple[int, int], bool] = {}
        # Tokens that their own symbols do not merge to can never appear, so the automaton leaves them out.
        self.automaton = ahocorasick.Automaton()
        self.reachable = {i for t, i in self.ids.items() if i not in self.split or self._plain(t) == [i]}
        for token, i in self.ids.items():
            if i in self.reachable:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.prefix: dict[int, int] = {}
        for token, i in self.ids.items():
            for k in range(len(token) - 1, 0, -1):
                j = self.ids.get(token[:k])
                if j is not None and j in self.reachable:
                    self.prefix[i] = j
                    break
        # The offset table: token i is blob[offsets[i]:offsets[i + 1]].
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        offsets, parts = [0], []
        for i in range(max(names) + 1):
            parts.append(names.get(i, "").encode("utf-8"))
            offsets.append(offsets[-1] + len(parts[-1]))
        self.blob, self.offsets = b"".join(parts), offsets
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(pattern).findall
        self.words_of_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.words_of_rare = regex.compile(settled(pattern), regex.V1).findall
        self.late_lower = late_lower()
        self.marks = re.compile(f"([{character_class(LATE_MARKS)}])")
        self.rare = re.compile("[\u0558-\U0010ffff]").search
        self.parts_of = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.symbols = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self.cache = Remembered(self.entry, self.CACHE)

    def _plain(self, token: str) -> list[int]:
        """The token's symbols, merged by rank one pair at a time."""
        end = token.endswith(MARK)
        body = token[:-1] if end else token
        ids = [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + MARK if end else body[-1]]]
        while len(ids) > 1:
            rank, at = min((self.merge_rank.get(pair, 1 << 30), k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            ids[at : at + 2] = [self.ids[token_of] for token_of in [self._joined(ids[at], ids[at + 1])]]
        return ids

    def _joined(self, a: int, b: int) -> str:
        if not hasattr(self, "_names"):
            self._names = {i: t for t, i in self.ids.items()}
        return self._names[a] + self._names[b]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of two tokens' joined symbols is just these two tokens."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 500_000:
                self.compatible.clear()
            known = self.compatible[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undoes the merges of both tokens, latest first, and looks for a merge over the border that would have come sooner.

        Merges of the left token come first among equal ranks, as the merge of the leftmost pair does."""
        limit = 1 << 30
        while True:
            crossing = self.merge_rank.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                # a is there from rank_a on; before, its right part stood at the border.
                limit, a = rank_a, self.split[a][1]
            else:
                # A crossing merge of the same rank stands further left, so it would come before b's.
                limit, b = rank_b + 1, self.split[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (of the split text)."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols) + MARK
        whole = self.ids.get(text)
        if whole is not None and whole in self.reachable:
            return [whole]
        n = len(text)
        found = [-1] * n
        for end, (size, token) in self.automaton.iter(text):
            found[end + 1 - size] = token  # ends ascend, so the longest token of a position comes last
        alive = bytearray(b"\x01") * (n + 1)
        alive[n - 1] = 0  # the marker belongs to the last symbol
        length, prefix, compatible = self.length, self.prefix, self.compatible
        out: list[int] = []
        at, token, last = 0, found[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if last < 0:
                        break
                    fits = compatible.get((last, token))
                    if fits or (fits is None and self.may_follow(last, token)):
                        break
                token = prefix.get(token, -1)
            if token >= 0:
                out.append(token)
                last = token
                at += length[token]
                token = found[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the vocabulary file has no decoder."""
        blob, offsets = self.blob, self.offsets
        return b" ".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode("utf-8")

    def words(self, text: str) -> list[str]:
        """Words of the text in turn; special tokens as they are."""
        if "<|" not in text:
            return self._split(text)
        out: list[str] = []
        for k, part in enumerate(self.parts_of(text)):
            if k % 2:
                out.append(part)
            else:
                out += self._split(part)
        return out

    def _split(self, part: str) -> list[str]:
        if part.isascii():
            return self.words_of_ascii(part.lower())
        part = "".join([unicodedata.normalize("NFC", x) for x in self.marks.split(part)]) if self.marks.search(part) else unicodedata.normalize("NFC", part)
        # Letter by letter: str.lower() has a rule of its own for a final sigma.
        part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
        return self.words_of_rare(part.translate(self.late_lower)) if self.rare(part) else self.words_of(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words(text):
            special = self.special.get(word)
            out += self.encode_word(word) if special is None else [special]
        return out

    def entry(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word as text, and its decoded tokens."""
        special = self.special.get(word)
        ids = self.encode_word(word) if special is None else [special]
        return b" ".join([b"%d" % i for i in ids]), self.decode(ids).encode("utf-8")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        words = self.words(text)
        ids, decoded = map(b" ".join, zip(*map(self.cache.__getitem__, words))) if words else (b"", b"")
        return ids.count(b" ") + 1 if words else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""

    def kernel(batches):
        bpe = of_worker(vocabulary_file)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, text (the decoded tokens) of every array of ids."""

    def kernel(batches):
        bpe = of_worker(vocabulary_file)
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(kernel, "doc_id long, text string")


def round_trip_report(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""

    def kernel(batches):
        bpe = of_worker(vocabulary_file)
        for batch in batches:
            rows = [bpe.digest(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, SCHEMA)
