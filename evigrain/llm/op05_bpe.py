"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes a token of the vocabulary. So two neighbouring symbols
that stand side by side in no token are never joined: there a cut is certain.
Words are cut at all such places, the fragments are encoded one by one (each
distinct one once, as long as the worker's cache holds it), and their ids are
concatenated. White space and the pre-tokenizer's own boundaries are cuts of
the same kind.

The vocabulary is that of a ``tokenizers`` JSON file with NFC, white space and
lower-case normalising, a pattern of pre-tokens, byte-level symbols and a word
end. Results are those of the library with ``add_special_tokens=False``;
special strings inside a text are special tokens, as they are there.

Defined cases: null is the empty text, with no ids; texts of any length are
encoded whole; every input row gives one row; an empty table gives an empty
result; input columns other than those kept are dropped, and one named as an
output column gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, text_or_empty

#: Python's split() also cuts at these, which are no white space in the pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters whose case, composition and class no Unicode version has changed
#: of late; texts with others are normalised and split by the library itself.
UNUSUAL = re.compile("[^\x00-\u052f\u2010-\u2027\u2030-\u205e\u20ac]")
#: Longer pieces are rare, and are not kept.
LONGEST_CACHED = 40
#: Fragments up to these lengths are merged side by side in one matrix.
WIDTHS = (4, 8, 16, 32, 64)
NEVER = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairTable:
    """A fixed map from symbol pairs to integers, looked up for whole arrays."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(4, (len(entries) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        keys, values = np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        self.probes, at = 0, self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, absent: int) -> np.ndarray:
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], absent)
        rest = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class WordBpe:
    """Encoder and decoder of one vocabulary, with its forced boundaries."""

    def __init__(self, spec: bytes, cache_size: int = 400_000):
        import regex
        import tokenizers

        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        symbols = byte_symbols()
        self.as_byte = {s: i for i, s in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], np.int64)
        ranks, made = {}, []
        for pair in model["merges"]:
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            ranks.setdefault(vocab[a] << 20 | vocab[b], len(made))
            made.append(vocab[a + b])
        self.ranks, self.made = PairTable(ranks), np.array(made, np.int64)
        self.rank_of = ranks
        joined: dict[int, int] = {}
        for t in vocab:
            ends = bool(self.end) and t.endswith(self.end)
            body = [self.as_byte[c] for c in (t[: -len(self.end)] if ends else t)]
            ids = [int(self.inner[b]) for b in body]
            if ends and ids:
                ids[-1] = int(self.last[body[-1]])
            joined.update((a << 20 | b, 1) for a, b in zip(ids, ids[1:], strict=False))
        self.joined = PairTable(joined)
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        library = tokenizers.Tokenizer.from_buffer(spec)
        self.normalise, self.split_rare = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache_size = cache_size
        self.chunks: dict[str, bytes] = {}

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """The merges of many fragments at once, a row each, -1 after its symbols.

        Each round joins, in every row, its pair of lowest rank (the leftmost of
        equals); a row without a pair that the vocabulary joins is done.
        """
        out = rows.copy()
        width = rows.shape[1]
        at = np.arange(len(rows))
        cols = np.arange(width)
        ranks = np.full((len(rows), width), NEVER, np.int32)
        real = rows[:, 1:] >= 0
        ranks[:, :-1][real] = self.ranks.get((rows[:, :-1] << 20 | rows[:, 1:])[real], NEVER)
        rows = rows.copy()
        while len(at):
            j = ranks.argmin(1)
            here = np.arange(len(at))
            low = ranks[here, j]
            more = low != NEVER
            if not more.all():
                out[at[~more]] = rows[~more]
                at, rows, ranks, j, low = at[more], rows[more], ranks[more], j[more], low[more]
                here = np.arange(len(at))
                if not len(at):
                    break
            after = cols[None, :-1] > j[:, None]
            rows[here, j] = self.made[low]
            rows[:, :-1] = np.where(after, rows[:, 1:], rows[:, :-1])
            rows[:, -1] = -1
            after = cols[None, :-1] >= j[:, None]
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            for i in (j - 1, j):
                ok = (i >= 0) & (i + 1 < width)
                ok[ok] = rows[here[ok], i[ok] + 1] >= 0
                a, b = rows[here[ok], i[ok]], rows[here[ok], i[ok] + 1]
                ranks[here[ok], i[ok]] = self.ranks.get(a << 20 | b, NEVER)
                if i is j:
                    ranks[here[~ok], j[~ok]] = NEVER
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and a linked list, for one fragment of any length."""
        out, n = list(ids), len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (rank := self.rank_of.get(out[i] << 20 | out[j])) is not None:
                heapq.heappush(heap, (rank, i, out[i], out[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if out[i] != a or j < 0 or out[j] != b:
                continue
            out[i], out[j], right[i] = int(self.made[rank]), -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return out

    def new_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of pieces without white space."""
        words: list[bytes] = []
        ends: list[int] = []
        for c in chunks:
            if UNUSUAL.search(c):
                words += [bytes(self.as_byte[s] for s in w) for w, _ in self.split_rare(c)]
            else:
                words += [w.encode() for w in self.words(c)]
            ends.append(len(words))
        if not words:
            return [b""] * len(chunks)
        raw = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self.inner[raw]
        symbols[stops - 1] = self.last[raw[stops - 1]]
        cut = self.joined.get(symbols[:-1] << 20 | symbols[1:], 0) == 0
        cut[stops[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lengths = np.diff(np.append(starts, len(symbols)))
        low = 1
        for width in WIDTHS:
            pick = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if not len(pick):
                continue
            cols = np.arange(width)
            inside = cols[None, :] < lengths[pick, None]
            where = starts[pick, None] + cols[None, :]
            rows = np.full((len(pick), width), -1, np.int64)
            rows[inside] = symbols[where[inside]]
            symbols[where[inside]] = self.merge(rows)[inside]
        for k in np.flatnonzero(lengths > WIDTHS[-1]):
            s = slice(starts[k], starts[k] + lengths[k])
            symbols[s] = self.merge_long(symbols[s].tolist())
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.concatenate([[0], stops])
        at = (4 * upto[bounds[np.array([0, *ends])]]).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def cut(self, text: str) -> list[str | int]:
        """A text as pieces without white space and, between them, ids of special tokens."""
        if self.specials and self.specials.search(text):
            return [x for part in self.specials.split(text) for x in ([self.special[part]] if part in self.special else self.cut_plain(part))]
        return self.cut_plain(text)

    def cut_plain(self, text: str) -> list[str | int]:
        if not text.isascii():
            if UNUSUAL.search(text):
                text = self.normalise(text)
            else:
                # lower() looks at what surrounds a capital sigma, the library doesn't
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [text] if ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.cut(t) for t in texts]
        known = self.chunks
        new = [c for c in set().union(*split) if c not in known]
        if len(known) + len(new) > self.cache_size:
            known.clear()
            new = list(set().union(*split))
        strings = [c for c in new if isinstance(c, str)]
        known.update(zip(strings, self.new_chunks(strings), strict=True))
        known.update((c, struct.pack("<I", c)) for c in new if not isinstance(c, str))
        out = [b"".join(map(known.__getitem__, found)) for found in split]
        for c in strings:
            if len(c) > LONGEST_CACHED:
                del known[c]
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens with spaces between, as the library does for a file that names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict = {}


def _encoder(key, spec: bytes) -> WordBpe:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordBpe(spec)
    return _ENCODERS[key]


def bpe_encode(docs: DataFrame, spec: bytes, *, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids") -> DataFrame:
    """``keep`` columns and the ids of each text as a binary column of little-endian 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = hash(spec)

    def make():
        encoder = _encoder(key, shared.value)
        return lambda texts: [encoder.encode(texts)]

    kept = [c for c in keep if c != out]
    rows = docs.select(*kept, text_or_empty(F.col(text)).alias("__text"))
    return add_columns(rows, "__text", [(out, T.BinaryType())], make, keep=kept)


def bpe_decode(encoded: DataFrame, spec: bytes, *, ids: str = "ids", keep: Sequence[str] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """``keep`` columns and the decoded text of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    key = hash(spec)

    def make():
        encoder = _encoder(key, shared.value)
        return lambda rows: [[encoder.decode(x or b"") for x in rows]]

    return add_columns(encoded, ids, [(out, T.StringType())], make, keep=keep)


def bpe_digests(docs: DataFrame, spec: bytes, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row, encoded and decoded in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = hash(spec)

    def make():
        encoder = _encoder(key, shared.value)

        def work(texts: list[str]) -> list[list]:
            ids = encoder.encode(texts)
            return [
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids],
            ]

        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    kept = [c for c in keep if c not in {n for n, _ in fields}]
    rows = docs.select(*kept, text_or_empty(F.col(text)).alias("__text"))
    return add_columns(rows, "__text", fields, make, keep=kept)
