"""Word shingles as sets of 64-bit hashes, and their segment signatures for the Jaccard join (numpy, by batches)."""

from __future__ import annotations

import functools

import numpy as np

from lexiquarry.llm.hashing import M1, M2, mix, words

#: Ratio of a size band's ends; share of shingles that unrelated texts have in common, where nothing was measured.
BAND, COMMON = 1.5, 0.25
#: Expected elements of the segments whose frequencies are measured, and cells that count them.
LEVELS, CELLS = (1, 2, 4, 8, 16), 1024
#: What a chance meeting costs, in index entries: its pair and two sketches are moved.
MEETING = 16
#: Bytes of text that are hashed at a time.
PART = 2 << 20


class Shingler:
    """Sets of hashed shingles of k words; a text of fewer words, but not none, is one shingle."""

    def __init__(self, k: int):
        self.k = k

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All sets in one array, each sorted, and their sizes. Words: `[^\\x20\\x09-\\x0D]+`, A-Z in lower case."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        held, first, size = [], 0, 0
        for i, t in enumerate(texts):
            held.append((t or "").encode())
            size += len(held[-1])
            if size >= PART or i == len(texts) - 1:
                out += self._sets(held, sizes[first : i + 1])
                held, first, size = [], i + 1, 0
        return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes

    def _sets(self, texts: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        out, k = [], self.k
        starts, _, h = words(b"\n".join(texts).lower())
        lengths = np.array([len(t) + 1 for t in texts])
        edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        whole = h.copy()
        for j in range(1, min(k, len(h))):
            whole[: len(h) - j] = mix(whole[: len(h) - j]) + h[j:]
        whole = mix(whole + np.uint64(k))
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a == b:
                continue
            if b - a < k:
                s = h[a : a + 1].copy()
                for j in range(a + 1, b):
                    s = mix(s) + h[j]
                s = mix(s + np.uint64(b - a))
            else:
                s = np.sort(whole[a : b - k + 1])
                if len(s) > 1:
                    new = s[1:] != s[:-1]
                    if not new.all():
                        s = s[np.concatenate([[True], new])]
            out.append(s)
            sizes[i] = len(s)
        return out


class Scheme:
    """How sets are cut and indexed so that every pair with den * |both| >= num * |either| meets in a bucket.

    Such a pair of sizes a and b differs in at most h(a + b) elements. Each size band cuts the universe of hashes into
    segments; a set takes the band's segments in order until its strong ones count for more than h, so one of them
    differs from the partner's by less than it counts for: by nothing (weight 1: the segment itself is indexed) or by
    at most one element (weight 2: it is indexed with each one-element deletion). A set also takes part in the bands
    that hold its larger partners. Segments too small to tell sets apart weigh 0; a set that runs out of segments
    indexes them all. The weights and the number of segments are those of least cost for the band: entries made, and
    chance meetings expected from the frequencies that segments of several sizes have among all sets of the band.
    """

    def __init__(self, num: int, den: int, sets: int, measured: dict[int, tuple[int, list[float]]] | None = None):
        """measured: by band, its sets and for each of LEVELS the chance that the segments of two sets are equal."""
        self.num, self.den, self.sets, self.measured = num, den, sets, measured or {}
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))
        self.starts = np.array(self.low)
        self.band = functools.cache(self._band)

    def differ(self, s):
        """Elements in which two sets of s elements together differ at most."""
        return s * (self.den - self.num) // (self.den + self.num)

    def _band(self, k: int) -> tuple[int, int, int]:
        """(segments, how many of the first weigh 2, least strong size) of a band."""
        top, mid = self.low[k + 1] - 1, (self.low[k] + self.low[k + 1] - 1) / 2
        need = int(self.differ(2 * top)) + 1
        if need == 1:
            return 1, 0, 1
        best = None
        for two in sorted({*range(5), *[x for e in range(3, 20) for x in (1 << e, 3 << e - 1)]}):
            one = need - 2 * two
            if one < 0:
                break
            # spare segments stand in for those too small to tell sets apart
            for spare in sorted({(two + one + 4) // 8 * (one > 0), (two + one + 2) // 4 * (one > 0)}):
                segments = two + one + spare
                each = mid / segments
                cost = one * (1 + MEETING * self.meetings(k, each)) + two * (1 + each) * (1 + MEETING * self.meetings(k, max(each - 1, 0)))
                if best is None or cost < best[0]:
                    best = (cost, segments, two)
        _, segments, two = best
        # a quarter of spare segments leaves a hair less than 3 elements each at a similarity of 0.8: single elements are
        # too often in common to count there
        return segments, two, 3 if mid / segments >= 8 else 2 if mid / segments >= 2.9 else 1

    def meetings(self, k: int, each: float) -> float:
        """Other sets that are expected by chance in the bucket of a segment of so many elements.

        What the largest segments measured have in common are copies, which meet however sets are cut: it isn't counted.
        """
        if k not in self.measured:
            return self.sets / 20 * COMMON**each / MEETING
        n, chances = self.measured[k]
        # a chance is measured on one segment of each size: one that seems to fall in smaller segments is counted as it is
        # in larger ones, else an element that happens to be frequent decides
        own = [max(0.0, max(chances[j:]) - chances[-1]) for j in range(len(chances))]
        if each <= LEVELS[0]:
            return n * (own[0] + (1 - own[0]) * max(0.0, 1 - each))
        return n * float(np.interp(each, LEVELS, own))

    def tally(self, sets: np.ndarray, sizes: np.ndarray, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """Adds to counts, by band and level, in how many sets the first segment of the level's size has which cell."""
        first = np.searchsorted(self.starts, sizes, "right") - 1
        ends = np.cumsum(sizes)
        for k in np.unique(first[sizes > 0]).tolist():
            rows = np.flatnonzero((sizes > 0) & (first == k))
            n = sizes[rows]
            own = np.repeat(np.arange(len(rows)), n)
            s = sets[np.repeat(ends[rows] - n, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
            place = mix(s + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            value, mid = mix(place ^ M2), (self.low[k] + self.low[k + 1] - 1) / 2
            for j, each in enumerate(LEVELS):
                inside = place < np.uint64(min((1 << 64) - 1, int((1 << 64) * min(1.0, each / mid))))
                total = np.zeros(len(rows), np.uint64)
                np.add.at(total, own[inside], value[inside])
                cell = (mix(total[np.bincount(own[inside], minlength=len(rows)) > 0]) % np.uint64(CELLS)).astype(np.int64)
                if (k, j) not in counts:
                    counts[k, j] = np.zeros(CELLS, np.int64)
                counts[k, j] += np.bincount(cell, minlength=CELLS)

    def signatures(self, sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, index of the set) of every index entry."""
        keys, owners = [], []
        for k, rows in self._takers(sizes):
            a, b = self._cut(k, sets, sizes, rows)
            keys.append(a)
            owners.append(b)
        none = np.zeros(0, np.int64)
        return (np.concatenate(keys), np.concatenate(owners)) if keys else (none.astype(np.uint64), none)

    def _takers(self, sizes: np.ndarray):
        """(band, sets that take part in it)."""
        first = np.searchsorted(self.starts, sizes, "right") - 1
        last = np.searchsorted(self.starts, sizes * self.den // self.num, "right") - 1
        full = sizes > 0
        if full.any():
            for k in range(int(first[full].min()), int(last.max()) + 1):
                rows = np.flatnonzero(full & (first <= k) & (k <= last))
                if len(rows):
                    yield k, rows

    def _cut(self, k: int, sets: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        segments, two, strong_from = self.band(k)
        n = sizes[rows]
        ends = np.cumsum(sizes)[rows]
        own = np.repeat(np.arange(len(rows)), n)
        s = sets[np.repeat(ends - n, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
        place = mix(s + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        cell = own * segments + ((place >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        value = mix(place ^ M2)
        total = np.zeros(len(rows) * segments, np.uint64)
        np.add.at(total, cell, value)
        count = np.bincount(cell, minlength=len(total))
        segment = np.tile(np.arange(segments), len(rows))
        top = self.low[k + 1] - 1
        need = self.differ(n + np.minimum(n * self.den // self.num, top)) + 1
        weight = np.where(segment < two, 2, 1) * (count >= strong_from)
        so_far = np.cumsum(weight.reshape(-1, segments), axis=1)
        before = (so_far - weight.reshape(-1, segments)).ravel()
        short = np.repeat(so_far[:, -1] < need, segments)
        take = (before < np.repeat(need, segments)) & ((weight > 0) | (segment < two) & (count >= strong_from - 1)) | short
        salt = mix((segment + 1).astype(np.uint64) * M1 + np.uint64(k))
        key = lambda total, count, cell: mix(total + count.astype(np.uint64) * M2 + salt[cell])
        at = np.flatnonzero(take)
        keys, owner = [key(total[at], count[at], at)], [at // segments]
        if two:
            less = np.flatnonzero(take[cell] & (segment[cell] < two))
            c = cell[less]
            keys.append(key(total[c] - value[less], count[c] - 1, c))
            owner.append(c // segments)
        return np.concatenate(keys), rows[np.concatenate(owner)]
