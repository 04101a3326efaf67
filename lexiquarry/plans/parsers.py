"""Query languages that give query trees: classic, simple, surround and XML, and structured requests.

All turn text into terms with the field's analyzer (a function from text to words on the driver: query texts are short).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from lexiquarry.operators import positions as pos
from lexiquarry.operators import ranges
from lexiquarry.plans import query as q

Words = Callable[[str], list[str]]


def plain_words(text: str) -> list[str]:
    """The words of the plain ASCII analysis."""
    return re.findall(r"[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


class QueryBuilder:
    """Text to a query by analysis: all words, any word, a share of them, or a phrase."""

    def __init__(self, words: Words = plain_words):
        self.words = words

    def boolean(self, f: str, text: str, every: bool = False) -> q.Query:
        found = tuple(q.Term(f, w) for w in self.words(text))
        return q.MatchNone("no word") if not found else found[0] if len(found) == 1 else q.Bool(must=found) if every else q.Bool(should=found)

    def phrase(self, f: str, text: str, slop: int = 0) -> q.Query:
        found = self.words(text)
        return q.MatchNone("no word") if not found else q.Term(f, found[0]) if len(found) == 1 else q.phrase(f, *found, slop=slop)

    def share(self, f: str, text: str, part: float) -> q.Query:
        found = tuple(q.Term(f, w) for w in self.words(text))
        return q.Bool(should=found, at_least=max(1, int(part * len(found)))) if found else q.MatchNone("no word")


class ParseError(ValueError):
    pass


TOKEN = re.compile(
    r"""\s*(?:(?P<quoted>"(?:\\.|[^"\\])*")|(?P<regex>/(?:\\.|[^/\\])+/)|(?P<range>[\[{][^\]}]*[\]}])|(?P<cmp><=|>=|<|>|=)(?=\S)
    |(?P<op>\(|\)|:|\^\d+(?:\.\d+)?|~\d*(?:\.\d+)?|@\d+|\+|-|!|&&|\|\|)|(?P<word>(?:\\.|[^\s()\[\]{}"^~:+\-!&|/<>=\\@])(?:\\.|[^\s()\[\]{}"^~:\\])*))""",
    re.X,
)


class ClassicParser:
    """field:term, "phrases"~slop, term~edits, prefix*, wild?card, /regex/, [a TO b], {a TO b}, <=, +, -, AND, OR, NOT, ^boost, (groups)@least, *:*.

    `numeric` fields are columns; ranges on them compare numbers. `extensions` maps field names to functions that make
    a query of the text after the colon.
    """

    def __init__(self, default: str = "text", words: Words = plain_words, every: bool = False, numeric: tuple[str, ...] = (), fields: dict[str, float] | None = None, extensions: dict[str, Callable[[str], q.Query]] | None = None):
        self.default, self.build, self.every = default, QueryBuilder(words), every
        self.numeric, self.fields, self.extensions = set(numeric), fields, extensions or {}

    def parse(self, text: str) -> q.Query:
        self.items, at = [], 0
        while at < len(text) and text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"cannot read {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        out = self.clauses(self.default)
        if self.at < len(self.items):
            raise ParseError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def peek(self, value: str | None = None):
        item = self.items[self.at] if self.at < len(self.items) else (None, None)
        return item if value is None else item[1] == value

    def take(self):
        self.at += 1
        return self.items[self.at - 1]

    def clauses(self, f: str) -> q.Query:
        """Clauses up to a closing bracket. AND makes both neighbours required, OR optional, NOT and - forbid."""
        parts: list[list] = []
        conj = None
        while self.at < len(self.items) and not self.peek(")"):
            kind, value = self.peek()
            if kind == "word" and value in ("AND", "OR") or value in ("&&", "||"):
                conj = "AND" if value in ("AND", "&&") else "OR"
                self.take()
                continue
            mod = ""
            if value in ("+", "-", "!") or (kind == "word" and value == "NOT"):
                self.take()
                mod = "+" if value == "+" else "-"
            clause = self.clause(f)
            if conj == "AND" and parts and parts[-1][0] == "":
                parts[-1][0] = "+"
            if conj == "OR" and self.every and parts and parts[-1][0] == "*":
                parts[-1][0] = ""
            if not mod:
                mod = "+" if conj == "AND" else "" if conj == "OR" or not self.every else "*"
            parts.append([mod, clause])
            conj = None
        of = lambda *m: tuple(c for k, c in parts if k in m)
        if len(parts) == 1 and parts[0][0] != "-":
            return parts[0][1]
        return q.Bool(must=of("+", "*"), should=of(""), must_not=of("-")) if parts else q.MatchNone("empty")

    def clause(self, f: str) -> q.Query:
        kind, value = self.peek()
        if kind == "word" and self.at + 1 < len(self.items) and self.items[self.at + 1][1] == ":":
            self.take()
            self.take()
            if value == "*" and self.peek("*"):
                self.take()
                return self.boosted(q.MatchAll())
            f = re.sub(r"\\(.)", r"\1", value)
            if f in self.extensions:
                return self.boosted(self.extensions[f](self.take()[1].strip('"')))
            return self.clause(f)
        if value == "(":
            self.take()
            inner = self.clauses(f)
            if not self.peek(")"):
                raise ParseError("a bracket isn't closed")
            self.take()
            if (self.peek()[1] or "").startswith("@"):
                inner = q.Bool(should=inner.should if isinstance(inner, q.Bool) else (inner,), at_least=int(self.take()[1][1:]))
            return self.boosted(inner)
        if kind is None or kind == "op":
            raise ParseError(f"unexpected {value!r}")
        self.take()
        if self.fields and f == self.default:
            here = self.at
            made = []
            for name, w in self.fields.items():
                self.at = here
                one = self.leaf(name, kind, value)
                made.append(q.Boost(one, w) if w != 1 else one)
            return self.boosted(q.Bool(should=tuple(made)))
        return self.boosted(self.leaf(f, kind, value))

    def boosted(self, query: q.Query) -> q.Query:
        if (self.peek()[1] or "").startswith("^") and self.peek()[0] == "op":
            return q.Boost(query, float(self.take()[1][1:]))
        return query

    def leaf(self, f: str, kind: str, value: str) -> q.Query:
        tilde = self.take()[1][1:] if self.peek()[0] == "op" and (self.peek()[1] or "").startswith("~") else None
        if kind == "quoted":
            return self.build.phrase(f, re.sub(r"\\(.)", r"\1", value[1:-1]), int(float(tilde or 0)))
        if kind == "regex":
            return q.regexp(f, value[1:-1])
        if kind == "range":
            m = re.fullmatch(r"\s*(\S+)\s+TO\s+(\S+)\s*", value[1:-1])
            if not m:
                raise ParseError(f"not a range: {value}")
            low, high = (None if x == "*" else x.strip('"') for x in m.groups())
            return self.range(f, low, high, value[0] == "[", value[-1] == "]")
        if kind == "cmp":
            other = self.take()[1]
            return self.range(f, other if value[0] in ">=" else None, other if value[0] in "<=" else None, value != ">", value != "<")
        if tilde is not None:
            return q.fuzzy(f, "".join(self.build.words(value)), int(float(tilde)) if tilde and float(tilde) >= 1 else 2)
        if re.search(r"(?<!\\)[*?]", value):
            low = value.lower()
            if low == "*":
                return q.exists(f) if f in self.numeric else q.MultiTerm(f, lambda t: t.isNotNull())
            return q.prefix(f, low[:-1]) if re.fullmatch(r"[^*?\\]+\*", low) else q.wildcard(f, low)
        if f in self.numeric:
            return self.range(f, value, value, True, True)
        return self.build.boolean(f, re.sub(r"\\(.)", r"\1", value), every=True)

    def range(self, f: str, low, high, low_in: bool, high_in: bool) -> q.Query:
        if f in self.numeric:
            number = lambda x: None if x is None else float(x)
            return q.Where(lambda: ranges.between(F.col(f), number(low), number(high), low_in, high_in))
        return q.term_range(f, low, high, low_in, high_in)


class SimpleParser:
    """A forgiving language that never fails: + and, | or, - not, "phrase"~slop, prefix*, word~edits, (groups)."""

    def __init__(self, fields: dict[str, float], words: Words = plain_words, every: bool = False):
        self.fields, self.build, self.every = fields, QueryBuilder(words), every

    def parse(self, text: str) -> q.Query:
        if text.strip() == "*":
            return q.MatchAll()
        self.items = re.findall(r'"[^"]*"(?:~\d+)?|[()|+]|-(?=\S)|[^\s()|+"]+', text)
        self.at = 0
        out = self.group()
        while self.at < len(self.items):  # a closing bracket too many
            self.at += 1
            out = q.Bool(should=(out, self.group()))
        return out

    def group(self) -> q.Query:
        must: list[q.Query] = []
        should: list[q.Query] = []
        conj, negative = None, False
        while self.at < len(self.items):
            item = self.items[self.at]
            self.at += 1
            if item == ")":
                break
            if item in ("+", "|"):
                conj = item
                continue
            if item == "-":
                negative = not negative
                continue
            if item == "(":
                one = self.group()
            else:
                one = self.leaf(item)
            if negative:
                one, negative = q.Bool(must=(q.MatchAll(),), must_not=(one,)), False
            if conj == "+" or (conj is None and self.every):
                if should:
                    must.append(should.pop())
                must.append(one)
            else:
                should.append(one)
            conj = None
        if not must and not should:
            return q.MatchNone("empty")
        return (must + should)[0] if len(must + should) == 1 else q.Bool(must=tuple(must), should=tuple(should))

    def leaf(self, item: str) -> q.Query:
        made = []
        for f, w in self.fields.items():
            if item.startswith('"'):
                text, _, slop = item[1:].rpartition('"')
                one = self.build.phrase(f, text, int(slop[1:] or 0) if slop.startswith("~") else 0)
            elif item.endswith("*") and len(item) > 1:
                one = q.prefix(f, item[:-1].lower())
            elif m := re.fullmatch(r"(.+)~(\d*)", item):
                one = q.fuzzy(f, "".join(self.build.words(m[1])), min(2, int(m[2] or 2)))
            else:
                one = self.build.boolean(f, item, every=True)
            made.append(q.Boost(one, w) if w != 1 else one)
        return made[0] if len(made) == 1 else q.Bool(should=tuple(made))


class SurroundParser:
    """a OR b, a AND b, a NOT b, a 3W b (in order), a 3N b (any order), OR(a, b), 3N(a, b), word*, w?rd, field:query."""

    WORD = re.compile(r'\s*("[^"]*"|[(),:]|\d*[wWnN](?=[\s(])|[^\s(),:]+)')

    def __init__(self, default: str = "text"):
        self.default = default

    def parse(self, text: str) -> q.Query:
        self.items = self.WORD.findall(text)
        self.at = 0
        out = self.either(self.default)
        if self.at < len(self.items):
            raise ParseError(f"unexpected {self.items[self.at]!r}")
        return out

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def binary(self, f: str, names: tuple[str, ...], below: Callable, make: Callable) -> q.Query:
        parts = [below(f)]
        while self.peek().upper() in names:
            self.at += 1
            parts.append(below(f))
        return parts[0] if len(parts) == 1 else make(parts)

    def either(self, f: str) -> q.Query:
        return self.binary(f, ("OR",), self.both, lambda p: q.Bool(should=tuple(p)))

    def both(self, f: str) -> q.Query:
        return self.binary(f, ("AND",), self.without, lambda p: q.Bool(must=tuple(p)))

    def without(self, f: str) -> q.Query:
        return self.binary(f, ("NOT",), self.near, lambda p: q.Bool(must=(p[0],), must_not=tuple(p[1:])))

    def near(self, f: str) -> q.Query:
        left = self.primary(f)
        while m := re.fullmatch(r"(\d*)([wWnN])", self.peek()):
            self.at += 1
            left = self.distance(f, [left, self.primary(f)], m)
        return left

    def distance(self, f: str, parts: list[q.Query], m: re.Match) -> q.Query:
        slop = int(m[1] or 1) - 1
        return q.Positional(f, pos.node("near", *[self.source(p) for p in parts], args=(slop, m[2] in "wW")))

    def source(self, query: q.Query) -> pos.Node:
        """A query as spans."""
        if isinstance(query, q.Term):
            return pos.term(query.term)
        if isinstance(query, q.Positional):
            return query.source
        if isinstance(query, q.Bool) and query.should and not query.must:
            return pos.node("or", *[self.source(x) for x in query.should])
        raise ParseError("only words, their alternatives and distances can stand in a distance")

    def primary(self, f: str) -> q.Query:
        if self.at >= len(self.items):
            raise ParseError("a word is missing")
        item = self.items[self.at]
        self.at += 1
        if self.peek() == ":":
            self.at += 1
            return self.primary(item)
        m = re.fullmatch(r"(\d*)([wWnN])", item)
        if self.peek() == "(" and (m or item.upper() in ("OR", "AND")):
            self.at += 1
            parts = [self.either(f)]
            while self.peek() == ",":
                self.at += 1
                parts.append(self.either(f))
            self.at += 1
            return self.distance(f, parts, m) if m else q.Bool(should=tuple(parts)) if item.upper() == "OR" else q.Bool(must=tuple(parts))
        if item == "(":
            out = self.either(f)
            if self.peek() != ")":
                raise ParseError("a bracket isn't closed")
            self.at += 1
            return out
        word = item.strip('"').lower()
        if "*" in word or "?" in word:
            return q.prefix(f, word[:-1]) if re.fullmatch(r"[^*?]+\*", word) else q.wildcard(f, word)
        return q.Term(f, word)


# interval functions of the standard language: fn:name(sources and numbers)
INTERVAL_FUNCTIONS = {
    "ordered": "ordered", "unordered": "unordered", "unorderedNoOverlaps": "unordered_no_overlaps", "or": "or", "phrase": "phrase",
    "containing": "containing", "containedBy": "contained_by", "notContaining": "not_containing", "notContainedBy": "not_contained_by",
    "overlapping": "overlapping", "nonOverlapping": "non_overlapping", "before": "before", "after": "after",
}


def parse_interval(text: str, words: Words = plain_words) -> pos.Node:
    """fn:maxgaps(2 fn:ordered(a b)) and the like as an interval tree; bare and quoted text is analyzed."""
    items = re.findall(r'fn:\w+|\(|\)|"[^"]*"|[^\s()]+', text)
    at = 0

    def analyzed(t: str) -> pos.Node:
        found = [pos.term(w) for w in words(t)]
        return pos.node("none") if not found else found[0] if len(found) == 1 else pos.node("phrase", *found)

    def one() -> pos.Node:
        nonlocal at
        item = items[at]
        at += 1
        if not item.startswith("fn:"):
            return analyzed(item.strip('"'))
        name = item[3:]
        if at >= len(items) or items[at] != "(":
            raise ParseError(f"{item} needs brackets")
        at += 1
        if name in ("wildcard", "fuzzyTerm"):  # a pattern or term as it is, then numbers
            given = []
            while at < len(items) and items[at] != ")":
                given.append(items[at].strip('"'))
                at += 1
            if at >= len(items) or not given:
                raise ParseError(f"{item} needs a term and a closing bracket")
            at += 1
            if name == "wildcard":
                pattern = q.wildcard_regex(given[0])
                return pos.multi(lambda t: t.rlike(pattern), *[int(x) for x in given[1:2]])
            most = int(given[1]) if len(given) > 1 else 2
            return pos.multi(lambda t: F.levenshtein(t, F.lit(given[0]), most) >= 0, *[int(x) for x in given[2:3]])
        numbers: list[int] = []
        sources: list[pos.Node] = []
        while at < len(items) and items[at] != ")":
            if re.fullmatch(r"\d+", items[at]) and name in ("maxgaps", "maxwidth", "atLeast", "extend", "within", "notWithin"):
                numbers.append(int(items[at]))
                at += 1
            else:
                sources.append(one())
        if at >= len(items):
            raise ParseError("a bracket isn't closed")
        at += 1
        special = {"maxgaps": "max_gaps", "maxwidth": "max_width", "atLeast": "at_least", "extend": "extend", "within": "within", "notWithin": "not_within"}
        if name in special:
            return pos.node(special[name], *sources, args=tuple(numbers))
        if name not in INTERVAL_FUNCTIONS:
            raise ParseError(f"no interval function {name}")
        return pos.node(INTERVAL_FUNCTIONS[name], *sources)

    out = one()
    if at < len(items):
        raise ParseError(f"unexpected {items[at]!r}")
    return out


class PrecedenceParser:
    """The classic language with precedence: NOT binds before AND, AND before OR; clauses side by side are alternatives."""

    #: A quoted text or range with what stands at its ends, a bracket, or a run without blanks.
    ITEM = re.compile(r'[^\s()"\[{]*(?:"[^"]*"|[\[{][^\]}]*[\]}])[^\s()]*|[()]|[^\s()]+')

    def __init__(self, leaf: ClassicParser | None = None):
        self.leaf = leaf or ClassicParser()

    def parse(self, text: str) -> q.Query:
        self.items, self.at = self.ITEM.findall(text), 0
        found, negated = self.either()
        if self.at < len(self.items):
            raise ParseError(f"unexpected {self.items[self.at]!r}")
        return q.Bool(must_not=(found,)) if negated else found

    def now(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def either(self) -> tuple[q.Query, bool]:
        parts = [self.all()]
        while self.now() not in (None, ")"):
            self.at += self.now() in ("OR", "||")
            parts.append(self.all())
        return self.joined(parts, "should")

    def all(self) -> tuple[q.Query, bool]:
        parts = [self.one()]
        while self.now() in ("AND", "&&"):
            self.at += 1
            parts.append(self.one())
        return self.joined(parts, "must")

    @staticmethod
    def joined(parts: list[tuple[q.Query, bool]], kind: str) -> tuple[q.Query, bool]:
        if len(parts) == 1:
            return parts[0]
        return q.Bool(**{kind: tuple(x for x, no in parts if not no), "must_not": tuple(x for x, no in parts if no)}), False

    def one(self) -> tuple[q.Query, bool]:
        item = self.now()
        if item is None or item in (")", "AND", "OR", "&&", "||"):
            raise ParseError("a clause is missing")
        self.at += 1
        if item in ("NOT", "!"):
            found, negated = self.one()
            return found, not negated
        if item != "(":
            return (self.leaf.parse(item[1:]), True) if len(item) > 1 and item[0] in "-!" else (self.leaf.parse(item.removeprefix("+")), False)
        found = self.either()
        if self.now() != ")":
            raise ParseError("a bracket isn't closed")
        self.at += 1
        return found


class XmlParser:
    """Query trees written as XML elements."""

    def __init__(self, default: str = "text", words: Words = plain_words):
        self.default, self.words = default, words

    def parse(self, text: str) -> q.Query:
        return self.query(ET.fromstring(text))

    def query(self, e: ET.Element) -> q.Query:
        f = e.get("fieldName", self.default)
        build = QueryBuilder(self.words)
        text = (e.text or "").strip()
        if e.tag == "TermQuery":
            out = q.Term(f, text)
        elif e.tag == "TermsQuery":
            out = build.boolean(f, text)
        elif e.tag == "MatchAllDocsQuery":
            out = q.MatchAll()
        elif e.tag == "UserQuery":
            out = ClassicParser(f, self.words).parse(text)
        elif e.tag == "ConstantScoreQuery":
            out = q.Constant(self.query(e[0]))
        elif e.tag == "DisjunctionMaxQuery":
            out = q.DisMax(tuple(self.query(x) for x in e), float(e.get("tieBreakerMultiplier", 0)))
        elif e.tag == "BooleanQuery":
            kinds: dict[str, list] = {"must": [], "should": [], "mustNot": [], "filter": []}
            for c in e.findall("Clause"):
                kinds[c.get("occurs", "should")].append(self.query(c[0]))
            need = e.get("minimumNumberShouldMatch")
            out = q.Bool(tuple(kinds["must"]), tuple(kinds["should"]), tuple(kinds["mustNot"]), tuple(kinds["filter"]), int(need) if need else None)
        elif e.tag == "LikeThisQuery":
            share = e.get("percentTermsToMatch")
            out = q.LikeThis(e.get("fieldNames", f).split(",")[0].strip(), text, int(e.get("maxQueryTerms", 20)), int(e.get("minTermFrequency", 1)), int(e.get("minDocFreq", 1)), tuple(self.words(e.get("stopWords", ""))), float(share) / 100 if share else 0.3)
        elif e.tag == "RangeQuery":
            out = q.term_range(f, e.get("lowerTerm"), e.get("upperTerm"), e.get("includeLower", "true") == "true", e.get("includeUpper", "true") == "true")
        elif e.tag == "PointRangeQuery":
            low, high = e.get("lowerTerm"), e.get("upperTerm")
            out = q.Where(lambda: ranges.between(F.col(f), float(low) if low else None, float(high) if high else None))
        elif e.tag.startswith("Span"):
            out = q.Positional(f, self.span(e))
        else:
            raise ParseError(f"no element {e.tag}")
        return q.Boost(out, float(e.get("boost"))) if e.get("boost") else out

    def span(self, e: ET.Element) -> pos.Node:
        text = (e.text or "").strip()
        inner = [self.span(x if x.tag.startswith("Span") else x[0]) for x in e]
        if e.tag == "SpanTerm":
            return pos.term(text)
        if e.tag == "SpanOrTerms":
            return pos.node("or", *map(pos.term, self.words(text)))
        if e.tag == "SpanOr":
            return pos.node("or", *inner)
        if e.tag == "SpanNear":
            return pos.node("near", *inner, args=(int(e.get("slop", 0)), e.get("inOrder", "false") == "true"))
        if e.tag == "SpanFirst":
            return pos.node("first", *inner, args=(int(e.get("end", 1)),))
        if e.tag == "SpanNot":
            return pos.node("not", *inner, args=(0, 0))
        if e.tag == "SpanPositionRange":
            return pos.node("position_range", *inner, args=(int(e.get("start", 0)), int(e.get("end", 1))))
        raise ParseError(f"no element {e.tag}")


@dataclass(frozen=True)
class SearchRequest:
    """Criteria by kind, each (occur, values): text, phrase, term, terms, range, box, distance, id; and how hits are returned."""

    criteria: tuple[tuple[str, str, dict], ...] = ()
    default_fields: tuple[str, ...] = ("text",)
    sort: tuple = ()
    limit: int = 10
    fields: tuple[str, ...] = field(default=())

    def query(self, words: Words = plain_words, key: str = "doc_id") -> q.Query:
        build = QueryBuilder(words)

        def one(kind: str, a: dict) -> q.Query:
            f = a.get("field", self.default_fields[0])
            if kind == "text":  # every word in at least one field
                fields = (a["field"],) if "field" in a else self.default_fields
                return q.Bool(must=tuple(q.Bool(should=tuple(q.Term(x, w) for x in fields)) for w in words(a["text"])))
            if kind == "phrase":
                return build.phrase(f, a["text"], a.get("slop", 0))
            if kind == "term":
                return q.Where(lambda: F.col(f) == a["value"])
            if kind == "terms":
                return q.Where(lambda: F.col(f).isin(list(a["values"])))
            if kind == "id":
                return q.Where(lambda: F.col(key).isin(list(a["values"])))
            if kind == "range":
                return q.Where(lambda: ranges.between(F.col(f), a.get("low"), a.get("high"), a.get("low_in", True), a.get("high_in", True)))
            if kind == "box":
                return q.Where(lambda: ranges.geo_box(F.col(f)["lat"], F.col(f)["lon"], a["south"], a["north"], a["west"], a["east"]))
            if kind == "distance":
                return q.Where(lambda: ranges.geo_within(F.col(f)["lat"], F.col(f)["lon"], a["lat"], a["lon"], a["metres"]))
            raise ParseError(f"no criterion {kind}")

        of = lambda occur: tuple(one(k, a) for o, k, a in self.criteria if o == occur)
        must, should, no = of("must"), of("should"), of("must_not")
        if not must and not should:
            must = (q.MatchAll(),)
        return q.Bool(must, should, no)
