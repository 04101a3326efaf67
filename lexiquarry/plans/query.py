"""Queries as trees that compile to one column of matches and one of scores over the slots of a corpus (see corpus.py)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiquarry.operators import positions as pos
from lexiquarry.plans.corpus import Corpus, Stats

ZERO = lambda: F.lit(0.0)
#: Multi-term queries of at most so many terms are scored as clauses.
FEW = 16


@dataclass(frozen=True)
class Query:
    """The base: what a query needs of the corpus, whether a row matches, and its score there."""

    def needs(self) -> list[tuple[str, object]]:
        """(field, term or test of terms): what the score is made of."""
        return []

    def match(self, c: Corpus) -> Column:
        raise NotImplementedError

    def score(self, c: Corpus, s: Stats) -> Column:
        return F.lit(1.0)

    def rewritten(self, c: Corpus) -> Query:
        return self

    def walk(self) -> Iterable[Query]:
        """The query and all below it."""
        yield self
        for f in fields(self):
            x = getattr(self, f.name)
            for y in x if isinstance(x, tuple) else (x,):
                for z in y if isinstance(y, tuple) else (y,):
                    if isinstance(z, Query):
                        yield from z.walk()

    def on(self, c: Corpus, s: Stats) -> Column:
        """The score where the query matches, else null."""
        return F.when(self.match(c), self.score(c, s))

    def required(self, c: Corpus) -> Column | None:
        """A condition on slots without which the query can't match, if it has a cheap one."""
        return None

    def tree(self, depth: int = 0) -> Iterable[tuple[int, Query]]:
        """The query and all below it with their depths, parents first."""
        yield depth, self
        for f in fields(self):
            x = getattr(self, f.name)
            for y in x if isinstance(x, tuple) else (x,):
                for z in y if isinstance(y, tuple) else (y,):
                    if isinstance(z, Query):
                        yield from z.tree(depth + 1)

    def named(self) -> str:
        """A line that describes this clause."""
        simple = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if isinstance(getattr(self, f.name), (str, int, float, bool))]
        return f"{type(self).__name__}({', '.join(simple)})"

    def term_sets(self) -> list[tuple[str, list[str]]]:
        """The terms that scoring needs, by field."""
        needs = sorted(set(self.needs()), key=str)
        return [(f, [t for g, t in needs if g == f and isinstance(t, str)]) for f in dict.fromkeys(f for f, _ in needs)]

    def tests_of(self, f: str) -> list[Callable[[Column], Column]]:
        """The tests of terms of a field that scoring needs."""
        return [t for g, t in dict.fromkeys(self.needs()) if g == f and not isinstance(t, str)]


@dataclass(frozen=True)
class MatchAll(Query):
    def match(self, c):
        c.every()
        return F.lit(True)


@dataclass(frozen=True)
class MatchNone(Query):
    reason: str = ""

    def match(self, c):
        return F.lit(False)


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str

    def needs(self):
        return [(self.field, self.term)]

    def match(self, c):
        return c.tf(self.field, self.term) > 0

    def score(self, c, s):
        return c.model(self.field).score(c.tf(self.field, self.term), c.length(self.field), s.df(self.field, self.term), s.ttf(self.field, self.term), s.docs(self.field), s.tokens(self.field))


@dataclass(frozen=True)
class Where(Query):
    """A predicate on columns, score 1: ranges, sets, geometry and the like compile to it."""

    predicate: Callable[[], Column]

    def match(self, c):
        c.every()
        c.reads_docs()
        return F.coalesce(self.predicate(), F.lit(False))


def exists(column: str) -> Query:
    """Rows with a value in the column."""
    return Where(lambda: F.col(column).isNotNull())


@dataclass(frozen=True)
class TermInSet(Query):
    field: str
    terms: tuple[str, ...]

    def match(self, c):
        return c.holds(self.field, self.terms)


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    by: float

    def needs(self):
        return self.query.needs()

    def match(self, c):
        return self.query.match(c)

    def required(self, c):
        return self.query.required(c)

    def score(self, c, s):
        return self.query.score(c, s) * float(self.by)

    def rewritten(self, c):
        q = self.query.rewritten(c)
        if isinstance(q, Boost):
            return Boost(q.query, q.by * self.by).rewritten(c)
        return q if self.by == 1 else Boost(Constant(q.query if isinstance(q, Constant) else q), 0.0) if self.by == 0 and not isinstance(q, Constant) else Boost(q, self.by)


@dataclass(frozen=True)
class Constant(Query):
    query: Query
    value: float = 1.0

    def match(self, c):
        return self.query.match(c)

    def required(self, c):
        return self.query.required(c)

    def score(self, c, s):
        return F.lit(float(self.value))

    def rewritten(self, c):
        q = self.query.rewritten(c)
        while isinstance(q, (Boost, Constant)):
            q = q.query
        return replace(self, query=q)


@dataclass(frozen=True)
class Bool(Query):
    """must and should score, filter and must_not don't; at_least counts should clauses; only must_not matches nothing."""

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    at_least: int | None = None

    def clauses(self):
        return [*self.must, *self.should, *self.must_not, *self.filter]

    def needs(self):
        return [n for q in (*self.must, *self.should) for n in q.needs()]

    def match(self, c):
        need = self.at_least if self.at_least is not None else 0 if self.must or self.filter else 1
        if not self.must and not self.should and not self.filter:
            return F.lit(False)
        out = F.lit(True)
        for q in (*self.must, *self.filter):
            out = out & q.match(c)
        if need > len(self.should):
            return F.lit(False)
        if need == 1:
            some = self.should[0].match(c)
            for q in self.should[1:]:
                some = some | q.match(c)
            out = out & some
        elif need:
            total = F.lit(0)
            for q in self.should:
                total = total + q.match(c).cast("int")
            out = out & (total >= need)
        for q in self.must_not:
            out = out & ~q.match(c)
        return out

    def required(self, c):
        out = None
        for q in (*self.must, *self.filter):
            own = q.match(c) if isinstance(q, Term) else q.required(c)
            out = own if out is None else out if own is None else out & own
        return out

    def score(self, c, s):
        total = ZERO()
        for q in self.must:
            total = total + q.score(c, s)
        for q in self.should:
            total = total + F.coalesce(q.on(c, s), ZERO())
        return total

    def rewritten(self, c):
        new = {k: tuple(q.rewritten(c) for q in getattr(self, k)) for k in ("must", "should", "must_not", "filter")}
        out = replace(self, **new)
        if len(out.clauses()) == 1 and not out.must_not and not out.filter and (out.at_least or 0) <= 1:
            return out.clauses()[0]
        return out


@dataclass(frozen=True)
class DisMax(Query):
    """The best score, and a share of the others'."""

    queries: tuple[Query, ...]
    tie: float = 0.0

    def needs(self):
        return [n for q in self.queries for n in q.needs()]

    def match(self, c):
        return Bool(should=self.queries).match(c)

    def score(self, c, s):
        own = [q.on(c, s) for q in self.queries]
        best = F.greatest(*own) if len(own) > 1 else own[0]
        if not self.tie:
            return best
        total = ZERO()
        for x in own:
            total = total + F.coalesce(x, ZERO())
        return best + self.tie * (total - best)

    def rewritten(self, c):
        own = tuple(q for q in (q.rewritten(c) for q in self.queries) if not isinstance(q, MatchNone))
        if not own:
            return MatchNone("no disjunct")
        return own[0] if len(own) == 1 else Bool(should=own) if self.tie == 1 else replace(self, queries=own)


@dataclass(frozen=True)
class Synonym(Query):
    """Several terms scored as one: their weighted occurrences add up, the most frequent gives the document count."""

    field: str
    terms: tuple[tuple[str, float], ...]

    def needs(self):
        return [(self.field, t) for t, _ in self.terms]

    def match(self, c):
        return TermInSet(self.field, tuple(t for t, _ in self.terms)).match(c)

    def score(self, c, s):
        tf, ttf = ZERO(), ZERO()
        for t, w in self.terms:
            tf, ttf = tf + float(w) * c.tf(self.field, t), ttf + s.ttf(self.field, t)
        dfs = [s.df(self.field, t) for t, _ in self.terms]
        return c.model(self.field).score(tf, c.length(self.field), F.greatest(*dfs) if len(dfs) > 1 else dfs[0], ttf, s.docs(self.field), s.tokens(self.field))


@dataclass(frozen=True)
class Blended(Query):
    """Terms (field, term, boost) that share the greatest document count and the sum of occurrences; the best or the sum counts."""

    terms: tuple[tuple[str, str, float], ...]
    best: bool = True
    tie: float = 0.01

    def needs(self):
        return [(f, t) for f, t, _ in self.terms]

    def match(self, c):
        return Bool(should=tuple(Term(f, t) for f, t, _ in self.terms)).match(c)

    def score(self, c, s):
        df = F.greatest(*[s.df(f, t) for f, t, _ in self.terms], ZERO())
        ttf = ZERO()
        for f, t, _ in self.terms:
            ttf = ttf + s.ttf(f, t)
        own = [F.when(Term(f, t).match(c), c.model(f).score(c.tf(f, t), c.length(f), df, ttf, s.docs(f), s.tokens(f), w)) for f, t, w in self.terms]
        total = ZERO()
        for x in own:
            total = total + F.coalesce(x, ZERO())
        if not self.best:
            return total
        top = F.greatest(*own) if len(own) > 1 else own[0]
        return top + self.tie * (total - top)


@dataclass(frozen=True)
class CombinedFields(Query):
    """A term over weighted fields as one field: occurrences and lengths are weighted sums."""

    fields: tuple[tuple[str, float], ...]
    term: str

    def needs(self):
        return [(f, self.term) for f, _ in self.fields]

    def match(self, c):
        return Bool(should=tuple(Term(f, self.term) for f, _ in self.fields)).match(c)

    def score(self, c, s):
        tf, length, tokens, ttf = ZERO(), ZERO(), ZERO(), ZERO()
        for f, w in self.fields:
            tf, length = tf + float(w) * c.tf(f, self.term), length + float(w) * c.length(f)
            tokens, ttf = tokens + float(w) * s.tokens(f), ttf + float(w) * s.ttf(f, self.term)
        most = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
        return c.model(self.fields[0][0]).score(tf, length, most([s.df(f, self.term) for f, _ in self.fields]), ttf, most([s.docs(f) for f, _ in self.fields]), tokens)


@dataclass(frozen=True)
class CommonTerms(Query):
    """Terms above a share of the documents only add to the score, unless all are that common."""

    field: str
    terms: tuple[str, ...]
    most: float = 0.1
    low_all: bool = False

    def rewritten(self, c):
        total, df = c.doc_freqs(self.field, list(self.terms))
        limit = self.most * total if self.most < 1 else self.most
        low = tuple(Term(self.field, t) for t in self.terms if df[t] <= limit)
        high = tuple(Term(self.field, t) for t in self.terms if df[t] > limit)
        if not low:
            return Bool(must=high) if high else MatchNone("no terms")
        need = Bool(must=low) if self.low_all else Bool(should=low)
        return Bool(must=(need,), should=high) if high else need


# ---- multi-term queries: a test of terms


@dataclass(frozen=True)
class MultiTerm(Query):
    """Documents with any term that passes a test, score 1.

    scoring=True scores the terms as they are: the `limit` best by rank, or all; without a rank more than `limit` are an error.
    """

    field: str
    test: Callable[[Column], Column]
    scoring: bool = False
    rank: Callable[[Column], Column] | None = None
    limit: int | None = None
    boosts: Callable[[str], float] | None = None

    def match(self, c):
        return c.has(self.field, self.test)

    def rewritten(self, c):
        if not self.scoring:
            return self
        whole = self.rank is None and self.limit is None and self.boosts is None
        most = FEW + 1 if whole else self.limit if self.rank is not None or self.limit is None else self.limit + 1
        found = c.expanded(self.field, self.test, self.rank, most)
        if self.rank is None and self.limit is not None and len(found) > self.limit:
            raise ValueError(f"more than {self.limit} terms of {self.field} to score")
        if whole and len(found) > FEW:
            return EachTerm(self.field, self.test)
        return scored_terms(self.field, [(t, self.boosts(t) if self.boosts else 1.0) for t in found]).rewritten(c)


@dataclass(frozen=True)
class EachTerm(Query):
    """Documents with any term that passes a test; each of these terms scores, times its weight where there are weights.

    The scores are summed up posting by posting, so the plan doesn't grow with the number of terms.
    """

    field: str
    test: Callable[[Column], Column]
    weights: tuple[tuple[str, float], ...] = ()

    def needs(self):
        return [(self.field, t) for t, _ in self.weights] or [(self.field, self.test)]

    def match(self, c):
        return c.has(self.field, self.test)

    def score(self, c, s):
        def one(term, tf, length, df, ttf):
            x = c.model(self.field).score(tf, length, df, ttf, c.whole_now(self.field, "doc_count"), c.whole_now(self.field, "sum_ttf"))
            return x * F.element_at(F.create_map(*[F.lit(y) for pair in self.weights for y in pair]), term) if self.weights else x

        return c.sum_of(self, self.field, self.test, one)


def scored_terms(f: str, weights: list[tuple[str, float]]) -> Query:
    """Terms with weights, each scored: clauses if they are few."""
    if not weights:
        return MatchNone("no term")
    if len(weights) <= FEW:
        return Bool(should=tuple(Boost(Term(f, t), w) for t, w in weights))
    return EachTerm(f, lambda x: x.isin([t for t, _ in weights]), tuple((t, float(w)) for t, w in weights))


def prefix(f: str, p: str, **kw) -> MultiTerm:
    return MultiTerm(f, lambda t: t.startswith(p), **kw)


def wildcard_regex(pattern: str) -> str:
    """`*` any run, `?` one character, a backslash takes the next one as it is."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if ch == "*" else "." if ch == "?" else re.escape(ch)
        i += 1
    return f"^(?s:{out})$"


def wildcard(f: str, pattern: str, **kw) -> MultiTerm:
    return MultiTerm(f, lambda t: t.rlike(wildcard_regex(pattern)), **kw)


def numbers(low: int, high: int) -> str:
    """A pattern of the decimal numbers low to high: at most two alternatives for each digit and length."""
    parts, low = [], max(low, 0)
    while low <= high:
        zeros = 0  # how many trailing digits can run freely from low on
        while low % 10 ** (zeros + 1) == 0 and low + 10 ** (zeros + 1) - 1 <= high and low:
            zeros += 1
        step = 10**zeros
        last = min((high - low + 1) // step - 1, 9 - low // step % 10)
        head, digit = str(low // step)[:-1], low // step % 10
        parts.append(f"{head}[{digit}-{digit + last}]" + (f"[0-9]{{{zeros}}}" if zeros else ""))
        low += (last + 1) * step
    return "|".join(parts) or "(?!)"


def regexp_java(pattern: str) -> str:
    """The term dialect in Java's: `@` is any string, `#` none, `<a-b>` a number, `~x` all but x, `x&y` both; whole terms match."""
    def both(p: str) -> str:
        parts, depth, last, i = [], 0, 0, 0
        while i < len(p):
            if p[i] == "\\":
                i += 2
                continue
            depth += (p[i] in "([") - (p[i] in ")]")
            if p[i] == "&" and depth == 0:
                parts.append(p[last:i])
                last = i + 1
            i += 1
        parts.append(p[last:])
        return "".join(f"(?={one(x)}$)" for x in parts[:-1]) + one(parts[-1])

    def one(p: str) -> str:
        if p.startswith("~"):
            return f"(?!(?:{one(p[1:])})$).*"
        p = re.sub(r"<(\d+)-(\d+)>", lambda m: "0*(?:" + numbers(int(m[1]), int(m[2])) + ")", p)
        return re.sub(r"(?<!\\)@", ".*", re.sub(r"(?<!\\)#", "(?!)", p))

    return f"^(?s:{both(pattern)})$"


def regexp(f: str, pattern: str, ignore_case: bool = False, **kw) -> MultiTerm:
    java = ("(?i)" if ignore_case else "") + regexp_java(pattern)
    return MultiTerm(f, lambda t: t.rlike(java), **kw)


def term_range(f: str, low: str | None, high: str | None, low_in: bool = True, high_in: bool = True, **kw) -> MultiTerm:
    def test(t):
        out = F.lit(True)
        if low is not None:
            out = out & (t >= low if low_in else t > low)
        if high is not None:
            out = out & (t <= high if high_in else t < high)
        return out

    return MultiTerm(f, test, **kw)


def edits(a: str, b: str, transpose: bool = True) -> int:
    """Edit distance; a swap of neighbours counts as one edit where transpose is set."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if transpose and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def fuzzy(f: str, term: str, most: int = 2, prefix_length: int = 0, expansions: int = 50, transpose: bool = True) -> MultiTerm:
    """Terms within `most` edits; the closest `expansions` are scored, less the farther they are.

    Twice the edits of the built-in distance bound those with swaps, so the exact test runs on few terms.
    """
    bound = most * (2 if transpose else 1)
    near = lambda t: t.startswith(term[:prefix_length]) & (F.levenshtein(t, F.lit(term), bound) >= 0) if prefix_length else F.levenshtein(t, F.lit(term), bound) >= 0
    worth = lambda t: 1.0 if t == term else max(0.0, 1 - edits(term, t, transpose) / min(len(t), len(term)))
    return Fuzzy(f, near, True, None, expansions, worth, term, most, transpose)


@dataclass(frozen=True)
class Fuzzy(MultiTerm):
    term: str = ""
    most: int = 2
    transpose: bool = True

    def rewritten(self, c):
        words = c.dictionary(self.field).where(self.test(F.col("term"))).select("term")
        wanted, transpose = self.term, self.transpose
        d = F.udf(lambda t: edits(wanted, t, transpose), "int", useArrow=True)(F.col("term"))
        worth = F.when(F.col("term") == self.term, 1.0).otherwise(1 - F.col("d") / F.least(F.char_length("term"), F.lit(len(self.term))))
        best = words.withColumn("d", d).where(F.col("d") <= self.most).orderBy(worth.desc(), "term").limit(self.limit).collect()
        return scored_terms(self.field, [(r["term"], self.boosts(r["term"])) for r in best]).rewritten(c)


# ---- phrases, spans, intervals


@dataclass(frozen=True)
class Phrase(Query):
    """Terms at given places; a place may have several terms. With slop, nearer alignments count more."""

    field: str
    terms: tuple[tuple[str, ...], ...]
    slop: int = 0
    places: tuple[int, ...] | None = None

    def needs(self):
        return [(self.field, t) for ts in self.terms for t in ts]

    def at(self) -> list[int]:
        return list(self.places or range(len(self.terms)))

    def lists(self, c: Corpus) -> list[Column]:
        """Per place, positions less the place."""
        def one(ts, p):
            own = [c.places(self.field, t) for t in ts]
            return F.transform(F.concat(*own) if len(own) > 1 else own[0], lambda x: x - p)

        return [one(ts, p) for ts, p in zip(self.terms, self.at())]

    def freq(self, c: Corpus) -> Column:
        parts = self.lists(c)
        if self.slop:
            slop, at, groups = self.slop, self.at(), self.sharing()
            return c.count_of(self, self.candidates(c), parts, lambda xs: pos.sloppy_freq(xs, slop, at, groups))
        both = parts[0]
        for p in parts[1:]:
            both = F.array_intersect(both, p)
        return F.when(self.candidates(c), F.size(both).cast("double")).otherwise(0.0)

    def sharing(self) -> list[int]:
        """The place of the phrase whose terms each one shares (its own if none): one occurrence can't serve both."""
        return [next(j for j in range(i + 1) if set(self.terms[j]) & set(self.terms[i])) for i in range(len(self.terms))]

    def candidates(self, c: Corpus) -> Column:
        out = F.lit(True)
        for ts in self.terms:
            out = out & c.holds(self.field, ts)
        return out

    def required(self, c):
        return self.candidates(c)

    def match(self, c):
        return self.freq(c) > 0

    def score(self, c, s):
        total = ZERO()
        for _, t in dict.fromkeys(self.needs()):
            total = total + c.model(self.field).score(self.freq(c), c.length(self.field), s.df(self.field, t), s.ttf(self.field, t), s.docs(self.field), s.tokens(self.field))
        return total


def phrase(f: str, *terms: str, slop: int = 0) -> Phrase:
    return Phrase(f, tuple((t,) for t in terms), slop)


def ngram_phrase(f: str, n: int, *terms: str) -> Phrase:
    """A phrase of overlapping n-grams needs every n-th and the last only."""
    keep = [i for i in range(len(terms)) if i % n == 0 or i == len(terms) - 1]
    return Phrase(f, tuple((terms[i],) for i in keep), 0, tuple(keep))


@dataclass(frozen=True)
class Positional(Query):
    """A span or interval tree. Spans are scored by the model at their sloppy frequency, intervals by saturation or a sigmoid."""

    field: str
    source: pos.Node
    kind: str = "span"
    pivot: float = 1.0
    power: float = 0.0

    def needs(self):
        return [(self.field, t) for t in sorted(self.source.terms())] if self.kind == "span" else []

    def freq(self, c: Corpus) -> Column:
        words, multis, span = sorted(self.source.terms()), self.source.multis(), self.kind == "span"
        names = [*words, *[(i,) for i in range(len(multis))]]
        wide, source = pos.extent(self.source), pos.named(self.source, dict(zip(multis, names[len(words) :])))

        def run(lists):
            at = dict(zip(names, lists))
            return pos.span_freq(pos.spans(source, at)) if span else pos.interval_freq(pos.intervals(source, at), wide)

        lists = [c.places(self.field, w) for w in words] + [c.places_where(self.field, m.args[0]) for m in multis]
        return c.count_of(self, self.candidates(c), lists, run)

    def rewritten(self, c):
        """Terms under a test become the terms of the corpus that pass it: spans score each of them, intervals need their places only."""
        expand = lambda test, most: c.expanded(self.field, test, None, most)
        return replace(self, source=pos.expanded(self.source, expand, self.kind != "span"))

    def candidates(self, c: Corpus) -> Column:
        out = c.holds(self.field, sorted(self.source.terms()))
        for m in self.source.multis():
            out = out | c.has(self.field, m.args[0])
        for x in sorted(self.source.leaves(), key=lambda x: str(x.args[0])):
            out = out & (c.tf(self.field, x.args[0]) > 0 if x.op == "term" else c.has(self.field, x.args[0]))
        return out

    def required(self, c):
        return self.candidates(c)

    def match(self, c):
        return self.freq(c) > 0

    def score(self, c, s):
        f = self.freq(c)
        if self.kind != "span":
            if not self.power:
                return 1 - self.pivot / (self.pivot + f)
            k = self.pivot**self.power
            return 1 - k / (F.pow(f, F.lit(float(self.power))) + k)
        total = ZERO()
        for _, t in self.needs():
            total = total + c.model(self.field).score(f, c.length(self.field), s.df(self.field, t), s.ttf(self.field, t), s.docs(self.field), s.tokens(self.field))
        return total


# ---- scores made of scores and columns


@dataclass(frozen=True)
class FunctionScore(Query):
    """A query's score changed by a column: combine(score, value)."""

    query: Query
    value: Callable[[], Column]
    combine: Callable[[Column, Column], Column] = field(default=lambda score, value: score * value)

    def needs(self):
        return self.query.needs()

    def match(self, c):
        return self.query.match(c)

    def score(self, c, s):
        c.reads_docs()
        return self.combine(self.query.score(c, s), F.coalesce(self.value().cast("double"), ZERO()))

    def rewritten(self, c):
        return replace(self, query=self.query.rewritten(c))


def function_query(value: Callable[[], Column]) -> Query:
    """All documents, scored by a column."""
    return FunctionScore(MatchAll(), value, lambda _, v: v)


def boosted_by(query: Query, other: Query, by: float) -> Query:
    """query, its score times `by` where other matches."""
    return BoostedBy(query, other, by)


@dataclass(frozen=True)
class BoostedBy(Query):
    query: Query
    other: Query
    by: float

    def needs(self):
        return self.query.needs()

    def match(self, c):
        return self.query.match(c)

    def score(self, c, s):
        return self.query.score(c, s) * F.when(self.other.match(c), float(self.by)).otherwise(1.0)


@dataclass(frozen=True)
class Bayesian(Query):
    """A score as a probability: sigmoid(alpha * (score - beta) [+ logit of the base rate])."""

    query: Query
    alpha: float
    beta: float
    base_rate: float = 0.0

    def needs(self):
        return self.query.needs()

    def match(self, c):
        return self.query.match(c)

    def score(self, c, s):
        prior = math.log(self.base_rate / (1 - self.base_rate)) if self.base_rate else 0.0
        return 1 / (1 + F.exp(-(self.alpha * (self.query.score(c, s) - self.beta) + prior)))


@dataclass(frozen=True)
class LogOdds(Query):
    """Probabilities of clauses fused: softplus of their log odds, mean over all clauses or weighted sum, times clauses ** alpha, as a probability."""

    queries: tuple[Query, ...]
    alpha: float = 0.5
    weights: tuple[float, ...] | None = None

    def needs(self):
        return [n for q in self.queries for n in q.needs()]

    def match(self, c):
        return Bool(should=self.queries).match(c)

    def score(self, c, s):
        total = ZERO()
        for i, q in enumerate(self.queries):
            p = F.least(F.greatest(q.score(c, s), F.lit(1e-7)), F.lit(1 - 1e-7))
            gate = F.log1p(F.exp(F.log(p / (1 - p))))
            total = total + F.when(q.match(c), gate * float(self.weights[i] if self.weights else 1 / len(self.queries))).otherwise(0.0)
        return 1 / (1 + F.exp(-total * float(len(self.queries) ** self.alpha)))


@dataclass(frozen=True)
class IndriAnd(Query):
    """The weighted mean of the clauses' scores; a clause without a match gives its term's score at no occurrence."""

    clauses: tuple[tuple[Term, float], ...]

    def needs(self):
        return [n for q, _ in self.clauses for n in q.needs()]

    def match(self, c):
        return Bool(should=tuple(q for q, _ in self.clauses)).match(c)

    def score(self, c, s):
        total, weight = ZERO(), sum(w for _, w in self.clauses)
        for q, w in self.clauses:
            total = total + float(w) * q.score(c, s)
        return total / float(weight) if weight else ZERO()


def more_like_this(c: Corpus, f: str, text: str, most: int = 5, min_tf: int = 1, min_df: int = 1, max_df: float = 1.0, min_len: int = 0, stop: tuple[str, ...] = (), share: float = 0.3) -> Query:
    """The most telling words of a text (by occurrences times idf) as a query of which a share must match."""
    spark = c.docs.sparkSession
    own = spark.createDataFrame([(text,)], "x string").select(F.explode(c.analyzers[f](F.col("x"))).alias("t")).groupBy("t.term").agg(F.count("*").alias("tf"))
    words = [r for r in own.where((F.col("tf") >= min_tf) & (F.char_length("term") >= min_len)).collect() if r["term"] not in stop]
    if not words:
        return MatchNone("no word")
    n, df = c.doc_freqs(f, [w["term"] for w in words])
    ranked = sorted((-(w["tf"] * (math.log((n + 1) / (df[w["term"]] + 1)) + 1)), w["term"]) for w in words if min_df <= df[w["term"]] <= max_df * n)[:most]
    return Bool(should=tuple(Term(f, t) for _, t in ranked), at_least=max(1, int(share * len(ranked)))) if ranked else MatchNone("no word is in range")


@dataclass(frozen=True)
class LikeThis(Query):
    """more_like_this as a clause: the words are chosen when the query meets its corpus."""

    field: str
    text: str
    most: int = 5
    min_tf: int = 1
    min_df: int = 1
    stop: tuple[str, ...] = ()
    share: float = 0.3

    def rewritten(self, c):
        return more_like_this(c, self.field, self.text, self.most, self.min_tf, self.min_df, stop=self.stop, share=self.share).rewritten(c)


@dataclass(frozen=True)
class DocScores(Query):
    """Given documents with given scores (key, score): a small result taken up as a clause."""

    hits: tuple[tuple[object, float], ...]

    def match(self, c):
        c.every()
        return F.coalesce(F.col(c.key).isin([k for k, _ in self.hits]), F.lit(False)) if self.hits else F.lit(False)

    def score(self, c, s):
        if not self.hits:
            return ZERO()
        kind = c.docs.schema[c.key].dataType
        table = F.create_map(*[x for k, v in self.hits for x in (F.lit(k).cast(kind), F.lit(float(v)))])
        return F.coalesce(F.try_element_at(table, F.col(c.key)), ZERO())


@dataclass(frozen=True)
class IndexOrColumns(Query):
    """The same condition as a query over postings and as a test of columns; the postings are used, unless the query reads documents anyway."""

    indexed: Query
    columns: Query

    def needs(self):
        return self.indexed.needs()

    def match(self, c):
        return (self.columns if ("docs",) in c.slots else self.indexed).match(c)

    def score(self, c, s):
        return F.lit(1.0)
