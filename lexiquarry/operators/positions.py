"""Positional algebra: spans and minimal intervals over the positions of terms in one document.

A source is a tree of operators over terms. `spans` evaluates span operators, which give half-open [start, end) spans;
`intervals` evaluates interval operators, which give minimal closed intervals [start, end]. Both take the positions of
each term in a document as sorted lists, and are run in Arrow batches over documents that hold the needed terms.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

Positions = dict[str, list[int]]
Span = tuple[int, int]


@dataclass(frozen=True)
class Node:
    """An operator, its sources and its numbers or words."""

    op: str
    of: tuple = ()
    args: tuple = ()

    def terms(self) -> set[str]:
        own = set(self.args) if self.op == "term" else set()
        return own.union(*[x.terms() for x in self.of]) if self.of else own

    def multis(self) -> list[Node]:
        """The multi-term leaves, each once."""
        return [self] if self.op == "multi" else list(dict.fromkeys(m for x in self.of for m in x.multis()))

    def leaves(self) -> set[Node]:
        """Leaves (terms and multi-terms) without which nothing can match."""
        if self.op in ("term", "multi"):
            return {self}
        if self.op in ("or", "at_least", "none"):
            return set()
        if self.op in ("not", "not_containing", "not_contained_by", "non_overlapping", "not_within"):
            return self.of[0].leaves()
        return set().union(*[x.leaves() for x in self.of])

    def needed(self) -> set[str]:
        """Terms without which nothing can match."""
        return {x.args[0] for x in self.leaves() if x.op == "term"}


def expanded(n: Node, terms_of: Callable, keep: bool = False) -> Node:
    """The tree with its multi-term leaves ("multi": a test and how many terms at most, None: any number) as alternatives of terms_of(test, limit).

    keep: leaves without a bound stay, for operators that are given their places as one list.
    """
    if n.op != "multi":
        of = tuple(expanded(x, terms_of, keep) for x in n.of)
        return n if of == n.of else Node(n.op, of, n.args)
    test, most = n.args
    if keep and most is None:
        return n
    found = terms_of(test, None if most is None else most + 1)
    if most is not None and len(found) > most:
        raise ValueError(f"more than {most} terms for a position")
    return Node("or", tuple(term(t) for t in found)) if found else Node("none")


def named(n: Node, names: dict[Node, object]) -> Node:
    """The tree with its multi-term leaves as terms of these names."""
    if n.op == "multi":
        return Node("term", (), (names[n],))
    of = tuple(named(x, names) for x in n.of)
    return n if of == n.of else Node(n.op, of, n.args)


def multi(test: Callable, most: int | None = None) -> Node:
    """All terms of the corpus that pass a test of the term column; more than `most` are an error."""
    return Node("multi", (), (test, most))


def term(t: str) -> Node:
    return Node("term", (), (t,))


def node(op: str, *of: Node, args: tuple = ()) -> Node:
    return Node(op, of, args)


class Lookup:
    """Tests of one range against all of a list, each by a search among the starts."""

    def __init__(self, ranges: list):
        ranges = sorted(ranges)
        self.starts = [x[0] for x in ranges]
        self.furthest = list(accumulate((x[1] for x in ranges), max))
        self.nearest = list(accumulate((x[1] for x in reversed(ranges)), min))[::-1]

    def any_inside(self, start, end) -> bool:
        """Whether one lies within start to end."""
        k = bisect_left(self.starts, start)
        return k < len(self.starts) and self.nearest[k] <= end

    def any_around(self, start, end) -> bool:
        """Whether one starts no later than start and ends no earlier than end."""
        k = bisect_right(self.starts, start)
        return k > 0 and self.furthest[k - 1] >= end


# ---- spans


def spans(n: Node, at: Positions) -> list[Span]:
    """The spans of a tree, sorted."""
    return sorted(set(SPANS[n.op](n, at)))


def collected(n: Node, at: Positions) -> list[tuple[Span, list[tuple[str, int]]]]:
    """Each span with the leaves (term, place) that lie in it, by place: what a collector of spans is given."""
    leaves = sorted({(p, t) for t in n.terms() for p in at.get(t, [])})
    return [(s, [(t, p) for p, t in leaves if s[0] <= p < s[1]]) for s in spans(n, at)]


def _near(n: Node, at: Positions) -> list[Span]:
    """Spans of all sources, one of each, whose total length is within slop of what they cover."""
    slop, ordered = n.args
    parts = [spans(x, at) for x in n.of]
    if not all(parts):
        return []
    out = []
    if ordered:
        for first in parts[0]:
            start, end, gaps, ok = first[0], first[1], 0, True
            for part in parts[1:]:
                k = bisect_left(part, (end, -1))
                if k == len(part):
                    ok = False
                    break
                gaps += part[k][0] - end
                end = part[k][1]
            if ok and gaps <= slop:
                out.append((start, end))
        return out
    heads = [0] * len(parts)
    while True:
        now = [p[h] for p, h in zip(parts, heads)]
        low, high = min(now), max(e for _, e in now)
        if high - low[0] - sum(e - s for s, e in now) <= slop:
            out.append((low[0], high))
        k = now.index(low)
        heads[k] += 1
        if heads[k] == len(parts[k]):
            return out


def _without(n: Node, at: Positions) -> list[Span]:
    before, after = n.args or (0, 0)
    no = Lookup(spans(n.of[1], at))
    return [(s, e) for s, e in spans(n.of[0], at) if not no.any_around(e + after - 1, s - before + 1)]


def _containing(n: Node, at: Positions) -> list[Span]:
    inner = Lookup(spans(n.of[1], at))
    return [b for b in spans(n.of[0], at) if inner.any_inside(*b)]


def _within(n: Node, at: Positions) -> list[Span]:
    outer = Lookup(spans(n.of[0], at))
    return [x for x in spans(n.of[1], at) if outer.any_around(*x)]


SPANS: dict[str, Callable] = {
    "term": lambda n, at: [(p, p + 1) for p in at.get(n.args[0], [])],
    "near": _near,
    "or": lambda n, at: [s for x in n.of for s in spans(x, at)],
    "not": _without,
    "first": lambda n, at: [s for s in spans(n.of[0], at) if s[1] <= n.args[0]],
    "position_range": lambda n, at: [s for s in spans(n.of[0], at) if s[0] >= n.args[0] and s[1] <= n.args[1]],
    "containing": _containing,
    "within": _within,
    "check": lambda n, at: [s for s in spans(n.of[0], at) if n.args[0](*s)],
    "none": lambda n, at: [],
}


def span_freq(found: list[Span]) -> float:
    return sum(1.0 / (1.0 + (e - s)) for s, e in found)


# ---- intervals


class Interval(tuple):
    """(start, end, gaps): gaps are the places between the parts that no part covers."""

    def __new__(cls, start: int, end: int, gaps: int = 0):
        return super().__new__(cls, (start, end, gaps))


def over(parts: list) -> Interval:
    """The interval over its parts."""
    start, end = min(p[0] for p in parts), max(p[1] for p in parts)
    return Interval(start, end, end - start + 1 - sum(p[1] - p[0] + 1 for p in parts))


def minimal(found: list) -> list:
    """Those that contain no other, sorted."""
    out: list = []
    for s in sorted(found, key=lambda x: (x[1], -x[0])):
        if not out or s[0] > out[-1][0]:
            out.append(s)
    return out


def gapped(n: Node, at: Positions) -> list[Interval]:
    """The minimal intervals of a tree with their gaps, sorted."""
    found = INTERVALS[n.op](n, at)
    return sorted(found) if n.op in ("extend", "before", "after") else minimal(found) if n.op in ("or", "ordered", "unordered", "at_least", "unordered_no_overlaps", "phrase") else found


def intervals(n: Node, at: Positions) -> list[Span]:
    """The minimal intervals of a tree, sorted."""
    return [(x[0], x[1]) for x in gapped(n, at)]


def _ordered(n: Node, at: Positions) -> list[Interval]:
    parts = [gapped(x, at) for x in n.of]
    out = []
    for first in parts[0] if all(parts) else []:
        chosen = [first]
        for part in parts[1:]:
            k = bisect_left(part, (chosen[-1][1] + 1, -1))
            if k == len(part):
                break
            chosen.append(part[k])
        else:
            out.append(over(chosen))
    return out


def _phrase(n: Node, at: Positions) -> list[Interval]:
    return [Interval(x[0], x[1]) for x in _ordered(n, at) if x[2] == 0]


def _windows(parts: list[list[Interval]], least: int) -> list[Interval]:
    """Minimal windows that hold an interval of at least `least` of the parts."""
    marks = sorted((x[0], x[1], k) for k, p in enumerate(parts) for x in p)
    out = []
    best: dict[int, tuple[int, int]] = {}  # of each part the first end from here on, and its start
    first: dict[int, int] = {}  # where the part comes first from here on
    for i in range(len(marks) - 1, -1, -1):
        start, e, k = marks[i]
        first[k] = i
        if k not in best or e <= best[k][0]:
            best[k] = (e, start)
        if len(best) >= least:
            held = sorted((end, first[j], s) for j, (end, s) in best.items())[:least]
            out.append(Interval(start, held[-1][0], held[-1][0] - start + 1 - sum(end - s + 1 for end, _, s in held)))
    return out[::-1]


def repeated(x: list[Interval], n: int) -> list[Interval]:
    """Runs of n intervals of a source."""
    return [over(x[i : i + n]) for i in range(len(x) - n + 1)]


def _unordered(n: Node, at: Positions) -> list[Interval]:
    """Equal sources need as many different intervals."""
    parts = [repeated(gapped(x, at), n.of.count(x)) for x in dict.fromkeys(n.of)]
    if not all(parts):
        return []
    return parts[0] if len(parts) == 1 else _windows(parts, len(parts))


def _apart(n: Node, at: Positions) -> list[Interval]:
    """Two sources in any order that don't overlap."""
    a, b = n.of
    return _ordered(Node("ordered", (a, b)), at) + _ordered(Node("ordered", (b, a)), at)


def _where(test: Callable[[Lookup, Interval, tuple], bool], any_: bool) -> Callable:
    def run(n: Node, at: Positions) -> list[Interval]:
        other = Lookup(gapped(n.of[1], at))
        return [a for a in gapped(n.of[0], at) if test(other, a, n.args) == any_]

    return run


contains = lambda other, a, args: other.any_inside(a[0], a[1])
contained = lambda other, a, args: other.any_around(a[0], a[1])
overlap = lambda other, a, args: other.any_around(a[1], a[0])
near = lambda other, a, args: other.any_around(a[1] + args[0], a[0] - args[0])
INTERVALS: dict[str, Callable] = {
    "term": lambda n, at: [Interval(p, p) for p in at.get(n.args[0], [])],
    "phrase": _phrase,
    "ordered": _ordered,
    "unordered": _unordered,
    "unordered_no_overlaps": _apart,
    "or": lambda n, at: [s for x in n.of for s in gapped(x, at)],
    "at_least": lambda n, at: _windows([gapped(x, at) for x in n.of], n.args[0]),
    "containing": _where(contains, True),
    "contained_by": _where(contained, True),
    "not_containing": _where(contains, False),
    "not_contained_by": _where(contained, False),
    "overlapping": _where(overlap, True),
    "non_overlapping": _where(overlap, False),
    "within": _where(near, True),
    "not_within": _where(near, False),
    "before": lambda n, at: (lambda r: [a for a in gapped(n.of[0], at) if r and a[1] < r[-1][0]])(gapped(n.of[1], at)),
    "after": lambda n, at: (lambda r: [a for a in gapped(n.of[0], at) if r and a[0] > r[0][1]])(gapped(n.of[1], at)),
    "extend": lambda n, at: [Interval(max(0, s - n.args[0]), e + n.args[1], g) for s, e, g in gapped(n.of[0], at)],
    "max_width": lambda n, at: [x for x in gapped(n.of[0], at) if x[1] - x[0] + 1 <= n.args[0]],
    "max_gaps": lambda n, at: [x for x in gapped(n.of[0], at) if x[2] <= n.args[0]],
    "repeating": lambda n, at: repeated(gapped(n.of[0], at), n.args[0]),
    "check": lambda n, at: [x for x in gapped(n.of[0], at) if n.args[0](x[0], x[1])],
    "none": lambda n, at: [],
}


def interval_freq(found: list[Span], extent: int) -> float:
    return sum(1.0 / max(e - s + 1 - extent + 1, 1) for s, e in found)


def extent(n: Node) -> int:
    """The least number of places that an interval of the tree covers."""
    if n.op in ("term", "multi"):
        return 1
    if n.op in ("ordered", "unordered", "phrase", "unordered_no_overlaps"):
        return sum(extent(x) for x in n.of)
    if n.op == "or":
        return min((extent(x) for x in n.of), default=0)
    if n.op == "at_least":
        return sum(sorted(extent(x) for x in n.of)[: n.args[0]])
    if n.op == "repeating":
        return n.args[0] * extent(n.of[0])
    return extent(n.of[0]) + (sum(n.args) if n.op == "extend" else 0) if n.of else 0


# ---- sloppy phrases


def sloppy_freq(parts: list[list[int]], slop: int, places: list[int] | None = None, groups: list[int] | None = None) -> float:
    """Sum of 1 / (1 + distance) of the alignments within slop; parts are positions less their place in the phrase, sorted.

    Of an alignment, the earliest part moves on until it is not the earliest any more; the closest state on the way counts.
    Parts of one group share terms, and never stand on the same occurrence: of two that do, the earlier one moves on.
    """
    if not all(parts):
        return 0.0
    n = len(parts)
    places, groups = places or list(range(n)), groups or list(range(n))
    heads = [0] * n
    now = [p[0] for p in parts]
    mates = [[j for j in range(n) if j != i and groups[j] == groups[i]] for i in range(n)]

    def move(i: int) -> bool:
        heads[i] += 1
        if heads[i] == len(parts[i]):
            return False
        now[i] = parts[i][heads[i]]
        return True

    def settle(i: int) -> bool:
        while True:
            j = next((j for j in mates[i] if now[j] + places[j] == now[i] + places[i]), None)
            if j is None:
                return True
            i = min(i, j, key=lambda x: (now[x], places[x]))
            if not move(i):
                return False

    if not all(settle(i) for i in range(n)):
        return 0.0
    total, high = 0.0, max(now)
    while True:
        k = min(range(n), key=lambda x: (now[x], places[x]))
        rest = min((now[j] for j in range(n) if j != k), default=now[k])
        best = high - now[k]
        while move(k) and settle(k):
            high = max(high, *now) if n > 1 else now[k]
            if now[k] > rest or n == 1:
                break
            best = min(best, high - now[k])
        else:
            return total + (1.0 / (1.0 + best) if best <= slop else 0.0)
        if best <= slop:
            total += 1.0 / (1.0 + best)
