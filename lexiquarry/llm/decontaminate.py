"""Benchmark decontamination by suffix arrays over the training texts.

The training corpus is cut into shards of documents. In each shard, words become ids of the test vocabulary, and all
suffixes that begin with a word of it (no other can match) are sorted by prefix doubling: the shard's suffix array. A
suffix ends at the first word that no item has. Every test suffix (of each position of each item) is searched by
bisection, word by word, until no suffix of the shard goes on with it: that gives its longest verbatim match and, as a
range of the array, all its locations. Where a whole window matches, the range at that depth holds the window's
occurrences; documents with one are contaminated.

A word: what `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` matches after A-Z became lower case. A window: `window` consecutive
words of an item; an item of fewer words, but not none, is one window.

Test items go to the executors in blocks of at most BLOCK_BYTES; each block is searched in all documents and the blocks'
findings are merged by document, so any number of items can be searched.

Cases: a null or empty text has no words; a null or wordless item has no windows; repeated items count once per item
id (scan leaves a null id out, remove searches its text too); repeated rows each get their findings; empty tables give no findings.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.llm.common import append_by_text, fresh, quoted

#: Bytes of test items that executors hold at a time.
BLOCK_BYTES = 8 << 20
#: Every byte: A-Z in lower case, letters, digits and what is not ASCII as they are, the rest blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


#: Pairs of an occurrence and an item that are followed at a time.
PAIRS = 1 << 20


class TestSuffixes:
    """The suffixes of a block of items, ready to be searched. Ids from 1; 0 stands for any other word and for ends."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.ids, self.names = {}, [i for i, _ in items]
        seqs = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words(t)] for _, t in items]
        sizes = np.array([len(s) + 1 for s in seqs], np.int64)
        self.text = np.array([x for s in seqs for x in [*s, 0]] + [0], np.int64)
        self.item_at = np.repeat(np.arange(len(seqs)), sizes)
        # the window that begins at each place: its words, 0 if none does
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum()) - 1
        whole = np.repeat(sizes - 1, sizes)
        self.window = np.where(left >= window, window, np.where((whole < window) & (left == whole), left, 0))

    def search(self, ids: np.ndarray, order: np.ndarray):
        """(longest match of each test suffix, its range in order; windows that occur: place in the items, words, range)."""
        at = np.flatnonzero(self.text)
        longest = np.zeros(len(self.text), np.int64)
        ranges = np.zeros((len(self.text), 2), np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        hits, depth = [], 0
        while len(at) and len(order):
            word = self.text[at + depth]
            first = bisect(ids, order, lo, hi, depth, word, False)
            last = bisect(ids, order, first, hi, depth, word, True)
            go = (first < last) & (word > 0)
            at, lo, hi = at[go], first[go], last[go]
            depth += 1
            longest[at] = depth
            ranges[at, 0], ranges[at, 1] = lo, hi
            whole = self.window[at] == depth
            hits.append((at[whole], np.full(int(whole.sum()), depth), lo[whole], hi[whole]))
        none = np.zeros(0, np.int64)
        return longest, ranges, tuple(np.concatenate(x) for x in zip(*hits)) if hits else (none, none, none, none)


def bisect(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, behind: bool) -> np.ndarray:
    """In each range of suffixes that are equal up to depth, the first one whose next word is not below (or is above) word."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        next_ = ids[order[mid] + depth]
        low = next_ <= word[live] if behind else next_ < word[live]
        lo[live] = np.where(low, mid + 1, lo[live])
        hi[live] = np.where(low, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The places of ids that aren't 0, in the order of their suffixes up to the first 0 (equal ones in any order)."""
    zeros = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    left = zeros[np.searchsorted(zeros, at)] - at  # words up to the first 0; ids end with one
    rank = ids.astype(np.int64)
    most, depth, longest = int(rank.max()), 1, int(left.max())
    order = at[np.argsort(rank[at])]
    while depth < longest:
        beyond = np.zeros(len(at), np.int64)
        far = left > depth
        beyond[far] = rank[at[far] + depth]
        key = rank[at] * (most + 1) + beyond
        by_key = np.argsort(key)
        new = np.concatenate([[1], (np.diff(key[by_key]) > 0).astype(np.int64)]).cumsum()
        order, rank[at[by_key]] = at[by_key], new
        if new[-1] == len(at):
            break
        most, depth = int(new[-1]), depth * 2
    return order


def reached(ids: np.ndarray, text: np.ndarray, place: np.ndarray, test: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How far each occurrence goes on, word by word."""
    reach, live = length.copy(), np.arange(len(place))
    while len(live):
        a, b = ids[place[live] + reach[live]], text[test[live] + reach[live]]
        live = live[(a == b) & (a != 0)]
        reach[live] += 1
    return reach


def located(suffixes: TestSuffixes, texts: list[str | None]):
    """Per text: its words, the hit spans, and the longest match of each item, over one shard."""
    get = suffixes.ids.get
    parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in map(words, texts)]
    sizes = np.array([len(p) for p in parts], np.int64)
    gap = np.zeros(1, np.int32)
    ids = np.concatenate([*chain.from_iterable((p, gap) for p in parts), gap])
    starts = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(ids)
    _, _, (test, length, lo, hi) = suffixes.search(ids, order)
    spans: list[list] = [[] for _ in texts]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if len(test):
        edge = np.zeros(len(ids) + 1, np.int64)
        # a window that several items have is one range: its places are marked once
        _, once = np.unique(np.stack([lo, hi, length]), axis=1, return_index=True)
        for k in once.tolist():
            place = order[lo[k] : hi[k]]
            edge[place] += 1
            edge[place + length[k]] -= 1
        flips = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        a, b = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
        doc = np.searchsorted(starts, a, "right") - 1
        for d, x, y in zip(doc.tolist(), (a - starts[doc]).tolist(), (b - starts[doc]).tolist()):
            spans[d].append({"start": x, "end": y})
        # per document and item the longest match: pairs of windows and places are followed in parts of bounded size
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        for first in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(first, min(first + PAIRS, int(upto[-1])))
            own = np.searchsorted(upto, pair, "right") - 1
            place = order[lo[own] + pair - upto[own]]
            reach = reached(ids, suffixes.text, place, test[own], length[own])
            doc, item = np.searchsorted(starts, place, "right") - 1, suffixes.item_at[test[own]]
            by = np.lexsort((place, -reach, item, doc))
            doc, item, place, reach = doc[by], item[by], place[by], reach[by]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
            for d, i, p, r in zip(doc[new].tolist(), item[new].tolist(), (place - starts[doc])[new].tolist(), reach[new].tolist()):
                best[d, i] = min(best.get((d, i), (0, 0)), (-r, p))
    matches: list[list] = [[] for _ in texts]
    for (d, i), (r, p) in sorted(best.items()):
        matches[d].append({"item": suffixes.names[i], "start": p, "length": -r})
    return sizes, spans, matches


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (item id, text) of at most BLOCK_BYTES each (or one item), in turn; the driver holds one at a time."""
    held, size = [], 0
    for r in benchmark.select(quoted(id_col).cast("string").alias("i"), quoted(text_col).cast("string").alias("t")).where("i is not null").toLocalIterator():
        n = len((r["t"] or "").encode()) + len(r["i"])
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    yield held


def scan(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """df and n_words, hit_spans (word positions, merged, ends exclusive), matches (per item: the longest match's place in the document and words)."""
    new = ["n_words", "hit_spans", "matches"]
    for k, items in enumerate(blocks(benchmark, item_col, item_text_col)):
        if k:  # a further block: its findings are merged into those of the rows so far
            spans, found = fresh(df, "__s"), fresh(df, "__m")
            df = df.withColumnsRenamed({"hit_spans": spans, "matches": found}).drop("n_words")
        df = _scan_block(df, items, window, text_col)
        if k:
            df = df.withColumns({"hit_spans": merged(F.concat("hit_spans", spans)), "matches": F.concat(found, "matches")}).drop(spans, found)
    kept = [f.name for f in df.schema.fields if f.name not in new]
    return df.select(*map(quoted, kept + new))


def _scan_block(df: DataFrame, items: list, window: int, text_col: str) -> DataFrame:
    block = df.sparkSession.sparkContext.broadcast(items)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("matches", MATCH)]

    def make():
        suffixes = TestSuffixes(block.value, window)
        return lambda texts: located(suffixes, texts)

    return append_by_text(df, text_col, fields, make)


def merged(spans):
    """Spans of several blocks as disjoint ones."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["start"] <= F.when(F.size(acc) > 0, last["end"]))
        longer = F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(joins, longer).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), none, step)


def remove(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """df without the rows whose text holds a window of an item, with an id or without; its columns stay as they are."""
    names = df.columns
    benchmark = benchmark.select(F.coalesce(quoted("item_id").cast("string"), F.lit("")).alias("item_id"), quoted("text"))
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])  # no input column gives way to a finding
    out = scan(safe, benchmark, window, f"c{names.index(text_col)}").where(F.size("hit_spans") == 0)
    return out.drop("n_words", "hit_spans", "matches").toDF(*names)
