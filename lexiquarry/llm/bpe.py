"""BPE encoding and decoding of whole texts with a public vocabulary file.

A text is cut at special tokens, normalised (NFC, lower case), split into words by the file's pattern, and each word
is merged by a priority queue of merge ranks over a doubly linked list of symbols; entries that a later merge made
stale are skipped when they surface. Decoding concatenates the ids' vocabulary strings. The result is that of the
tokenizers library on the same file, without its added special tokens.

Cases: a null text is an empty one and gives no ids; an empty table gives an empty result; repeated rows and extra
columns pass; an input column named as an output column gives way. Texts of any length are encoded whole: a word of
n bytes costs n log n. Words, and what stands between
white space, are cached per worker in tables of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexiquarry.llm.common import append_by_text
from lexiquarry.llm.hashing import BLANKS

#: White space as Unicode has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: The word pattern of the vocabulary file that is understood here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Strings in a worker's cache, and letters in the longest of them.
CACHE_WORDS, CACHE_LETTERS = 200_000, 64
#: Letters of text that are encoded at a time, and bytes of text in a batch: of each worker, what an encoding holds besides
#: the text is many times its size.
PART = 1 << 19
BLANK_BYTES = bytes(np.flatnonzero(BLANKS).tolist())


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable in Latin-1, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.cache
def letter_class(first: str, last: int = sys.maxunicode) -> str:
    """The code points of a general category (L or N) up to last, as ranges for a character class."""
    out, start = [], None
    for c in range(last + 2):
        if c <= last and unicodedata.category(chr(c))[0] == first:
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class WordSplitter:
    """The normaliser and word pattern of a vocabulary file; special tokens come out as ids."""

    def __init__(self, spec: dict):
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the vocabulary file has another normaliser or word pattern than the one understood here")
        self.ascii, self.low, self.all = (self.finder(last) for last in (0x7F, 0xFFFF, sys.maxunicode))
        self.high = re.compile("[\U00010000-\U0010ffff]").search
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]
        self.letters = byte_letters()

    @staticmethod
    def finder(last: int):
        """Finds the words of texts with code points up to last; smaller classes are faster to test."""
        letters, numbers = letter_class("L", last), letter_class("N", last)
        return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{letters}{numbers}]+").findall

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (a final sigma is like any other)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """The words of a normalised text without special tokens."""
        return (self.ascii if text.isascii() else self.all if self.high(text) else self.low)(text)

    def spelled(self, word: str) -> str:
        """A word as the vocabulary spells it."""
        return "".join([self.letters[b] for b in word.encode()])


class Merger:
    """Merges the symbols of one word. A pair of ids and a queue entry are single integers, which compare fastest."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = vocab = model["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]

    def ids(self, spelled: str) -> list[int]:
        """The ids of a spelled word."""
        vocab, rank_of, made = self.vocab, self.ranks.get, self.made
        n = len(spelled)
        symbol = [vocab[c] for c in spelled[:-1]]
        symbol.append(vocab[spelled[-1] + self.end])
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbol[i] << 32 | symbol[i + 1])) is not None]
        if not queue:
            return symbol
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbol[i] < 0 or rank_of(symbol[i] << 32 | symbol[j]) != entry >> 32:
                continue  # stale: one of the two symbols has been merged meanwhile
            symbol[i] = new = made[entry >> 32]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | symbol[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 32 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [x for x in symbol if x >= 0]


class Cache(dict):
    """Computed values of short strings; it is emptied when full."""

    def __init__(self, compute, entries: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_LETTERS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes texts to ids and back; word_ids gives the ids of a spelled word."""

    def __init__(self, spec: dict, word_ids, entries: int = CACHE_WORDS, part: int = PART):
        self.part = part
        self.splitter = WordSplitter(spec)
        self.words = Cache(lambda word: struct.pack(f"<{len(ids := word_ids(self.splitter.spelled(word)))}I", *ids), entries)
        self.chunks = Cache(lambda chunk: b"".join(map(self.words.__getitem__, self.splitter.words(chunk.decode()))), entries)
        self.strings = [""] * (1 + max([*spec["model"]["vocab"].values(), *self.splitter.special.values()]))
        for s, i in [*spec["model"]["vocab"].items(), *self.splitter.special.items()]:
            self.strings[i] = s

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Words never cross white space, so what stands between blanks is encoded once for all texts of a part.
        """
        out: list[bytes] = []
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= self.part:
                out += self._part(held)
                held, size = [], 0
        return out + self._part(held)

    def _part(self, texts: list[str]) -> list[bytes]:
        special = self.splitter.special
        pieces = [self.splitter.cut(t) if "<|" in t else [t] for t in texts]
        plain = [self.splitter.normal(p).encode() for ps in pieces for p in ps[::2]]
        data = b"\n".join(plain)
        blank = BLANKS[np.frombuffer(data, np.uint8)]
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if data else np.zeros(0, np.int64)
        # each chunk with the blanks behind it; equal ones are found by their bytes
        edges = np.append(starts, len(data)).astype(np.int64)
        distinct = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        which = distinct.indices.to_numpy()
        words, chunks = self.words, self.chunks
        bare = (x.rstrip(BLANK_BYTES) for k in range(0, len(distinct.dictionary), 10_000) for x in distinct.dictionary[k : k + 10_000].to_pylist())
        encoded = [words[x.decode()] if x.isalpha() else chunks[x] for x in bare]  # ASCII letters alone are one word
        counts = np.array([len(x) // 4 for x in encoded], np.int64)
        flat, froms = np.frombuffer(b"".join(encoded), "<u4"), np.cumsum(counts) - counts
        own = counts[which]
        upto = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(froms[which] - upto[:-1], own) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p in plain])]))].tolist()
        out, k = [], 0
        for ps in pieces:
            parts = []
            for j, p in enumerate(ps):
                if j % 2:
                    parts.append(np.array([special[p]], "<u4").tobytes())
                else:
                    parts.append(ids[edges[k] : edges[k + 1]].tobytes())
                    k += 1
            out.append(b"".join(parts))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The ids' vocabulary strings, one blank between two, as a file without a decoder has it."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def load(path: str) -> Codec:
    """The codec of a vocabulary file; a worker reads a file once."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Codec(spec, Merger(spec["model"]).ids)


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """df and token_ids (binary: little-endian unsigned 32-bit ids), n_tokens and decoded, which is read from token_ids."""
    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]

    def make():
        codec = load(vocabulary)

        def work(texts):
            ids = codec.encode_batch(texts)
            return ids, [len(x) // 4 for x in ids], [codec.decode(x) for x in ids]

        return work

    return append_by_text(df, text_col, fields, make, most=PART)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """df and token_ids and n_tokens."""
    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]

    def make():
        codec = load(vocabulary)

        def work(texts):
            ids = codec.encode_batch(texts)
            return ids, [len(x) // 4 for x in ids]

        return work

    return append_by_text(df, text_col, fields, make, most=PART)
