"""Text analysis as column functions: character filters, tokenizers and token filters, and named analyzers.

A token is struct<term string, pos int>: positions start at 0, and a removed token leaves a gap. Tokenizers make an
array of tokens from a text column, filters map such arrays; everything here stays inside the JVM but what is named
*_python, which needs rules that SQL functions can't express and runs in Arrow batches.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiquarry.functions.stemming import STEMMERS, stem

Step = Callable[[Column], Column]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The English stop words of the standard analysis.
ENGLISH_STOP = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
# Articles that elision strips.
FRENCH_ARTICLES = ["l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu"]
ITALIAN_ARTICLES = ["c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d"]
CATALAN_ARTICLES = ["d", "l", "m", "n", "s", "t"]
IRISH_ARTICLES = ["d", "m", "b"]


def tokens(words: Column) -> Column:
    """An array of strings as tokens at positions 0, 1, ..."""
    return F.transform(words, lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("pos")))


def terms(toks: Column) -> Column:
    return F.transform(toks, lambda t: t["term"])


def also_plain(step: Step, plain: Step) -> Step:
    """A step with a second form, over arrays of strings: what it does to the terms where nobody asks for positions."""

    def run(x: Column) -> Column:
        return step(x)

    run.plain = plain
    return run


def each(fn: Callable[[Column], Column]) -> Step:
    """A filter that maps every term."""
    return also_plain(lambda toks: F.transform(toks, lambda t: F.struct(fn(t["term"]).alias("term"), t["pos"].alias("pos"))), lambda words: F.transform(words, lambda w: fn(w)))


def keep(fn: Callable[[Column], Column]) -> Step:
    """A filter that keeps terms and leaves gaps."""
    return also_plain(lambda toks: F.filter(toks, lambda t: fn(t["term"])), lambda words: F.filter(words, lambda w: fn(w)))


def once(fn: Callable[[Column], Column]) -> Step:
    """fn of an array that is evaluated once, however often fn names it."""
    return lambda x: F.get(F.transform(F.array(x), fn), F.lit(0))


# ---- character filters


def html_strip(text: Column) -> Column:
    """Comments, scripts, styles and tags go; block tags become line ends; common entities are decoded."""
    out = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def mapping(pairs: dict[str, str]) -> Step:
    """Replaces strings, longer ones first."""

    def run(text: Column) -> Column:
        for a in sorted(pairs, key=len, reverse=True):
            text = F.replace(text, F.lit(a), F.lit(pairs[a]))
        return text

    return run


def pattern_replace(pattern: str, by: str, every: bool = True) -> Step:
    if every:
        return lambda text: F.regexp_replace(text, pattern, by)
    return lambda text: F.when(text.rlike(pattern), F.concat(F.split(text, pattern, 2)[0], F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, by), F.split(text, pattern, 2)[1])).otherwise(text)


def cjk_width(text: Column) -> Column:
    """Full-width ASCII becomes ASCII."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, full, "".join(chr(ord(c) - 0xFEE0) for c in full))


def persian_chars(text: Column) -> Column:
    """Zero-width non-joiners become blanks."""
    return F.translate(text, "‌", " ")


# ---- tokenizers


def pattern_group(pattern: str, group: int = 0) -> Step:
    words = lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return also_plain(lambda text: tokens(words(text)), words)


def pattern_split(pattern: str) -> Step:
    words = lambda text: F.filter(F.split(text, pattern, -1), lambda w: w != "")
    return also_plain(lambda text: tokens(words(text)), words)


letter = pattern_group(r"\p{L}+")
whitespace = pattern_split(r"\s+")
ascii_words = pattern_group(r"[a-z0-9]+")
#: Letters, digits and their marks; dots, apostrophes and underscores join what stands between letters or digits.
standard = pattern_group(r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*(?:['’.:·][\p{L}_][\p{L}\p{N}\p{M}_]*|[.,][\p{N}][\p{L}\p{N}\p{M}_]*)*")
#: As standard, with addresses as one token.
url_email = pattern_group(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>\"]+|[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}|[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*")
#: Letters and digits, possessives, acronyms with dots, company names with & or @, host names and numbers.
classic_words = pattern_group(r"\p{L}+(?:\.\p{L}+)+\.?|[\p{L}\p{N}]+(?:[@&][\p{L}\p{N}]+)+|\p{L}+(?:'\p{L}+)+|[\p{L}\p{N}]+(?:[-.,/_][\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*)*")


def keyword(text: Column) -> Column:
    return tokens(F.array(text))


def path_hierarchy(delimiter: str = "/", reverse: bool = False) -> Step:
    def run(parts: Column) -> Column:
        cut = lambda i: F.slice(parts, i, F.size(parts)) if reverse else F.slice(parts, F.lit(1), i)
        paths = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(cut(i), delimiter)), lambda p: p != "")
        return F.transform(paths, lambda p: F.struct(p.alias("term"), F.lit(0).alias("pos")))

    return lambda text: once(run)(F.split(text, "\\Q" + delimiter + "\\E", -1))


def grams_of(word: Column, low: int, high: int) -> Column:
    """All substrings of low to high letters, by start, then length."""
    n = F.char_length(word)
    starts = F.when(n >= low, F.sequence(F.lit(1), n - low + 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n - s + 1)), lambda k: F.substr(word, s, k))))


def edges_of(word: Column, low: int, high: int) -> Column:
    n = F.least(F.char_length(word), F.lit(high))
    return F.when(n >= low, F.transform(F.sequence(F.lit(low), n), lambda k: F.substr(word, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def ngram(low: int, high: int) -> Step:
    return lambda text: tokens(grams_of(text, low, high))


def edge_ngram(low: int, high: int) -> Step:
    return lambda text: tokens(edges_of(text, low, high))


# ---- token filters

lowercase, uppercase, trim, reverse = each(F.lower), each(F.upper), each(F.trim), each(F.reverse)
english_possessive = each(lambda t: F.regexp_replace(t, "['’＇][sS]$", ""))
apostrophe = each(lambda t: F.regexp_replace(t, "['’].*$", ""))
classic_filter = each(lambda t: F.when(t.rlike(r"^\p{L}(\.\p{L})+\.?$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.regexp_replace(t, "'[sS]$", "")))
cjk_width_filter = each(cjk_width)
turkish_lowercase = each(lambda t: F.lower(F.translate(F.replace(t, F.lit("İ"), F.lit("i")), "I", "ı")))
greek_lowercase = each(lambda t: F.translate(F.lower(t), "ςάέήίόύώϊϋΐΰ", "σαεηιουωιυιυ"))


def stop(words: list[str]) -> Step:
    return keep(lambda t: ~t.isin(words))


def keep_words(words: list[str]) -> Step:
    return keep(lambda t: t.isin(words))


def length(low: int, high: int) -> Step:
    return keep(lambda t: F.char_length(t).between(low, high))


def truncate(n: int) -> Step:
    return each(lambda t: F.substring(t, 1, n))


def replace_all(pattern: str, by: str) -> Step:
    return each(lambda t: F.regexp_replace(t, pattern, by))


def elision(articles: list[str]) -> Step:
    return each(lambda t: F.regexp_replace(t, "(?i)^(" + "|".join(articles) + ")['’]", ""))


def capitalization(only_first: bool = True, keep_words_: tuple[str, ...] = ()) -> Step:
    return each(lambda t: F.when(t.isin(list(keep_words_)), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2), F.char_length(t))))))


def stem_override(table: dict[str, str]) -> Step:
    return each(lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t), t))


def conditional(predicate: Callable[[Column], Column], step: Callable[[Column], Column]) -> Step:
    return each(lambda t: F.when(predicate(t), step(t)).otherwise(t))


def protected(words: list[str], step: Callable[[Column], Column]) -> Step:
    return conditional(lambda t: ~t.isin(words), step)


def limit_count(n: int) -> Step:
    return lambda toks: F.slice(toks, 1, n)


def limit_position(n: int) -> Step:
    return lambda toks: F.filter(toks, lambda t: t["pos"] < n)


def remove_duplicates(toks: Column) -> Column:
    """Equal terms of one position once."""
    return F.array_distinct(toks)


def keyword_repeat(toks: Column) -> Column:
    return F.flatten(F.transform(toks, lambda t: F.array(t, t)))


def fingerprint(toks: Column) -> Column:
    return tokens(F.array(F.array_join(F.array_sort(F.array_distinct(terms(toks))), " ")))


def grams_filter(low: int, high: int) -> Step:
    return lambda toks: F.flatten(F.transform(toks, lambda t: F.transform(grams_of(t["term"], low, high), lambda g: F.struct(g.alias("term"), t["pos"].alias("pos")))))


def edge_filter(low: int, high: int) -> Step:
    def listed(w: Column) -> Column:
        return F.slice(F.array(*[F.left(w, F.lit(k)) for k in range(low, high + 1)]), F.lit(1), F.greatest(F.char_length(w) - (low - 1), F.lit(0)))

    edges = listed if 0 < low <= high < low + 8 else lambda w: edges_of(w, low, high)
    return also_plain(lambda toks: F.flatten(F.transform(toks, lambda t: F.transform(edges_of(t["term"], low, high), lambda g: F.struct(g.alias("term"), t["pos"].alias("pos"))))), lambda words: F.flatten(F.transform(words, lambda w: edges(w))))


def shingles(low: int = 2, high: int = 2, unigrams: bool = True, joiner: str = " ") -> Step:
    """Runs of low to high tokens at the position of the first."""
    sizes = ([1] if unigrams else []) + list(range(low, high + 1))

    def one_size(toks: Column) -> Column:
        others = lambda i: [F.get(toks, i + k)["term"] for k in range(1, low)]
        starts = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - (low - 1), F.lit(0)))
        return F.transform(starts, lambda t, i: F.struct(F.concat_ws(joiner, t["term"], *others(i)).alias("term"), t["pos"].alias("pos")))

    def one_size_plain(words: Column) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (low - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(joiner, w, *[F.get(words, i + k) for k in range(1, low)]))

    if sizes == [low] and low <= 16:
        return also_plain(once(one_size), once(one_size_plain))

    def run(toks: Column) -> Column:
        n = F.size(toks)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda k: i + k - 1 <= n), lambda k: F.struct(F.array_join(terms(F.slice(toks, i, k)), joiner).alias("term"), F.element_at(toks, i)["pos"].alias("pos")))
        return F.flatten(F.transform(starts, at))

    return once(run)


def common_grams(words: list[str], query: bool = False) -> Step:
    """Adds pairs with a common word (joined by _); for queries, words that a pair covers go."""

    def run(toks: Column) -> Column:
        n = F.size(toks)
        common = lambda i: F.get(toks, i)["term"].isin(words)
        pair = lambda i: (i + 1 < n) & (i >= 0) & (common(i) | common(i + 1))
        gram = lambda i: F.struct(F.concat_ws("_", F.get(toks, i)["term"], F.get(toks, i + 1)["term"]).alias("term"), F.get(toks, i)["pos"].alias("pos"))
        one = lambda i: F.get(toks, i)
        none = F.array().cast("array<struct<term:string,pos:int>>")
        at = (lambda t, i: F.when(pair(i), F.array(gram(i))).when(pair(i - 1), none).otherwise(F.array(one(i)))) if query else (lambda t, i: F.when(pair(i), F.array(one(i), gram(i))).otherwise(F.array(one(i))))
        return F.flatten(F.transform(toks, at))

    return once(run)


def synonyms(groups: dict[str, list[str]]) -> Step:
    """Adds single-word synonyms at the position of their word."""
    table = lambda: F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = lambda t: F.transform(F.try_element_at(table(), t["term"]), lambda s: F.struct(s.alias("term"), t["pos"].alias("pos")))
    own = lambda w: F.when(w.isin(list(groups)), F.concat(F.array(w), F.try_element_at(table(), w))).otherwise(F.array(w))
    return also_plain(lambda toks: F.flatten(F.transform(toks, lambda t: F.when(t["term"].isin(list(groups)), F.concat(F.array(t), more(t))).otherwise(F.array(t)))), lambda words: F.flatten(F.transform(words, own)))


def capture_groups(pattern: str, groups: int) -> Step:
    """Each group's matches, and the term itself."""
    return lambda toks: F.flatten(F.transform(toks, lambda t: F.transform(F.concat(F.array(t["term"]), *[F.regexp_extract_all(t["term"], F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]), lambda g: F.struct(g.alias("term"), t["pos"].alias("pos")))))


def min_hash(k: int = 1, seeds: int = 4) -> Step:
    """The k least hashes of the terms under each of several hash functions, as hexadecimal terms."""
    hashed = lambda s: lambda t: F.hex(F.xxhash64(F.lit(s), t))
    return lambda toks: tokens(F.flatten(F.array(*[F.slice(F.array_sort(F.transform(F.array_distinct(terms(toks)), hashed(s))), 1, k) for s in range(seeds)])))


def folded(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Letters whose decomposition starts with an ASCII letter, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(first, last + 1)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_folding(t: Column) -> Column:
    """Latin letters without their marks; ligatures and letters that don't decompose by their usual spelling."""
    a, b = folded()
    out = F.translate(t, a + "øØđĐłŁıħĦ", b + "oOdDlLihH")
    for x, y in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return out


ascii_folding_filter = each(ascii_folding)


def digits(t: Column) -> Column:
    """Decimal digits of other scripts as 0 to 9."""
    other = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return F.translate(t, "".join(map(chr, other)), "".join(str(unicodedata.digit(chr(c))) for c in other))


decimal_digit = each(digits)
#: Orthographic normalisations by language: letters that are written alike become one, marks go.
NORMALIZE: dict[str, Step] = {
    "arabic": each(lambda t: F.translate(t, "آأإىةـًٌٍَُِّْ", "اااي" + "ه")),
    "persian": each(lambda t: F.translate(t, "یےكۀةٔ", "ييکهه")),
    "german": each(lambda t: F.regexp_replace(F.regexp_replace(F.translate(F.replace(t, F.lit("ß"), F.lit("ss")), "äöü", "aou"), "(?<![aeq])ue", "u"), "(a|o)e", "$1")),
    "scandinavian": each(lambda t: F.translate(F.regexp_replace(F.regexp_replace(t, "aa", "å"), "ae", "æ"), "äÄöÖ", "æÆøØ")),
    "scandinavian_folding": each(lambda t: F.regexp_replace(F.regexp_replace(F.translate(t, "åäæøöÅÄÆØÖ", "aaaooAAAOO"), "(?i)(a)[ae]", "$1"), "(?i)(o)[eo]", "$1")),
    "romanian": each(lambda t: F.translate(t, "şţŞŢ", "șțȘȚ")),
    "serbian": each(lambda t: F.replace(F.translate(t, "абвгдежзијклмнопрстћуфхцчшčćšžђ", "abvgdežzijklmnoprstcufhcčšccsz"), F.lit("đ"), F.lit("dj"))),
    "sorani": each(lambda t: F.translate(t, "يىكھ", "یییک"[:2] + "که")),
}


# ---- stemmers by suffix rules

def alternatives(pattern: str) -> list[str] | None:
    """The strings that a pattern of letters, classes of letters and | stands for, longest first; None for other patterns."""
    out = []
    for one in pattern.split("|"):
        if not re.fullmatch(r"(?:[^\W\d_]|\[[^\W\d_]+\])*", one):
            return None
        out += ["".join(x) for x in itertools.product(*[x.strip("[]") for x in re.findall(r"\[[^]]+\]|.", one)])]
    return sorted(dict.fromkeys(out), key=len, reverse=True)


def ending_cases(t: Column, cases: list[tuple[str, str, Column | None]]) -> Column:
    """Of (ending, what replaces it, condition) the first that fits holds; plain endings are compared, others are patterns."""
    out = None
    when = lambda hit, new: F.when(hit, new) if out is None else out.when(hit, new)
    for end, by, also in cases:
        plain = alternatives(end) if "$" not in by and "\\" not in by else None
        if plain is None:
            hit = t.rlike(f"(?:{end})$")
            out = when(hit if also is None else also & hit, F.regexp_replace(t, f"(?:{end})$", by))
            continue
        for n in dict.fromkeys(map(len, plain)):
            hit = None
            for x in plain:
                if len(x) == n:
                    hit = t.endswith(x) if hit is None else hit | t.endswith(x)
            rest = F.left(t, F.char_length(t) - n)
            out = when(hit if also is None else also & hit, F.concat(rest, F.lit(by)) if by else rest)
    return out.otherwise(t)


def suffix_rules(rules: list[tuple[str, str]], least: int) -> Callable[[Column], Column]:
    """The first rule whose suffix fits replaces it; words shorter than least stay."""
    return lambda t: F.when(F.char_length(t) >= least, ending_cases(t, [(end, by, None) for end, by in rules])).otherwise(t)


def endings(*rules: tuple[str, int]) -> Callable[[Column], Column]:
    """Drops the first of several endings (a pattern, for words longer than so many letters) that fits."""
    return lambda t: ending_cases(t, [(end, "", F.char_length(t) > longer) for end, longer in rules])


def rules(*cases: tuple[str, str, int]) -> Step:
    """A filter: of (ending, what replaces it, letters that the word must exceed) the first that fits holds."""
    return each(lambda t: ending_cases(t, [(end, by, F.char_length(t) > longer) for end, by, longer in cases]))


def from_length(n: int, step: Callable[[Column], Column], needs: str = "") -> Step:
    """A filter for words of n letters and more that match a pattern."""
    fits = lambda t: (F.char_length(t) >= n) & t.rlike(needs) if needs else F.char_length(t) >= n
    return each(lambda t: F.when(fits(t), step(t)).otherwise(t))


def steps(*filters: Step) -> Step:
    """Filters one after the other."""

    def run(toks: Column, form=lambda f: f) -> Column:
        for f in filters:
            toks = form(f)(toks)
        return toks

    return also_plain(run, lambda words: run(words, lambda f: f.plain)) if all(hasattr(f, "plain") for f in filters) else run


def unmarked(t: Column) -> Column:
    """Vowels without their marks."""
    return F.translate(t, "àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii")


# Published minimal and light stemmers as endings, and the least lengths of words that lose them.
STEM: dict[str, Step] = {
    "english_minimal": from_length(3, lambda t: F.when(t.rlike("[us]s$"), t).when(t.rlike("[^ae]ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("[iaoe]es$"), t).otherwise(F.regexp_replace(t, "s$", "")), "s$"),
    "french_minimal": from_length(6, lambda t: F.when(t.endswith("x"), F.regexp_replace(F.regexp_replace(t, "aux$", "alx"), "x$", "")).otherwise(F.regexp_replace(F.regexp_replace(t, "é?e?r?s?$", ""), r"(\p{L})\1$", "$1"))),
    "german_minimal": from_length(5, lambda t: endings(("nen", 6), ("en|se|es|er", 5), ("[nesr]", 4))(F.translate(t, "äöü", "aou"))),
    "spanish_minimal": from_length(4, lambda t: endings(("(?<=z)es", 3), ("(?<=[ao])s", 3), ("es", 3), ("s", 3))(F.regexp_replace(F.translate(unmarked(t), "ñ", "n"), "ces$", "zes")), "s$"),
    "portuguese_minimal": each(suffix_rules([("ões|ães", "ão"), ("ais", "al"), ("éis|eis", "el"), ("óis", "ol"), ("res", "r"), ("s", "")], 4)),
    "italian_light": from_length(6, lambda t: endings(("ie|he|hi|ii|ia|io", 5), ("[eiao]", 5))(unmarked(t))),
    "swedish_minimal": steps(each(endings(("s", 4))), each(endings(("arne|erna|arna|orna|aren", 6), ("are", 5), ("ar|at|er|et|or|en", 4), ("[aen]", 3)))),
    "norwegian_minimal": steps(each(endings(("s", 4))), each(endings(("ene", 5), ("er|en|et", 4), ("[ae]", 3)))),
    "galician_minimal": each(suffix_rules([("ns", "n"), ("res", "r"), ("is", "l"), ("s", "")], 4)),
    "hungarian_light": each(suffix_rules([("ban|ben|hoz|hez|höz|nak|nek|val|vel|tól|től|ról|ről|ból|ből|ért", ""), ("ok|ek|ök|ak", ""), ("k", "")], 6)),
}
#: Stands behind a word that a step has finished, so that no further ending fits.
DONE = "\u0001"
# Light stemmers of several steps; in each the first ending that fits holds.
STEM |= {
    "bulgarian": steps(
        rules(("ища", DONE, 5)),
        rules(("ият", "", 6), ("ът|то|те|та|ия", "", 5), ("ят", "", 4)),
        rules(("(?<=о)вци", "", 6), ("ове", "", 6), ("еве", "й", 6), ("ища", "", 5), ("та", "", 5), ("ци", "к", 5), ("зи", "г", 5), ("е(.)и", "я$1", 5), ("си", "х", 4), ("и", "", 4)),
        rules(("[аое]я|[аоея]", "", 3)),
        rules(("ен", "н", 4)),
        rules((f"ъ([^{DONE}])", "$1", 5)),
        each(lambda t: F.replace(t, F.lit(DONE), F.lit(""))),
    ),
    "czech": steps(
        rules(("atech", "", 7), ("ětem|etem|atům", "", 6), ("ech|ich|ích|ého|ěmi|emi|ému|ěte|ete|ěti|eti|ího|iho|ími|ímu|imu|ách|ata|aty|ých|ama|ami|ové|ovi|ými", "", 5), ("em|es|ém|ím|ům|at|ám|os|us|ým|mi|ou", "", 4), ("[aeiouůyáéíýě]", "", 3)),
        rules(("ov|in|ův", "", 5)),
        rules(("čt", "ck", 0), ("št", "sk", 0), ("[cč]", "k", 0), ("[zž]", "h", 0), ("e(.)", "$1", 1), ("ů(.)", "o$1", 2)),
    ),
    "sorani": steps(
        rules(("دا", "", 5), ("(?<=ن)ا", "", 4), ("ەوە", "", 6)),
        rules(("مان|یان|تان", "", 6)),
        rules(("ێکی", "", 6), ("یەکی", "", 7), ("ێک", "", 5), ("یەک", "", 6), ("ەکە", "", 6), ("کە", "", 5), ("ەکان", "", 7), ("کان", "", 6), ("یانی", "", 7), ("انی", "", 6), ("یان", "", 6), ("ان", "", 5), ("یانە", "", 7), ("انە", "", 6), ("(?<=[اە])یە", "", 5), ("[ەی]", "", 4)),
    ),
    "telugu": rules(("ళ్ళు|డ్లు", "", 5), ("డు|ము|వు|లు|ని|ను|చే|కై|లో|ది|కి|సు|వై|పై", "", 3), ("[ిీుూెేొోా]", "", 2)),
}
#: Of these only the commonest endings are covered, so far.
PARTIAL_STEM = ("portuguese_minimal", "galician_minimal", "hungarian_light")


@dataclass(frozen=True)
class Analyzer:
    """A named chain: character filters, one tokenizer, token filters."""

    tokenizer: Step
    filters: tuple[Step, ...] = ()
    char_filters: tuple[Step, ...] = field(default=())

    def __call__(self, text: Column) -> Column:
        toks = self.tokenizer(self._filtered(text))
        for f in self.filters:
            toks = f(toks)
        return toks

    def _filtered(self, text: Column) -> Column:
        text = F.coalesce(text.cast("string"), F.lit(""))
        for f in self.char_filters:
            text = f(text)
        return text

    def terms(self, text: Column) -> Column:
        """The terms without their positions; no tokens are made as far as the steps have a plain form."""
        steps = (self.tokenizer, *self.filters)
        if not all(hasattr(f, "plain") for f in steps):
            return terms(self(text))
        words = self._filtered(text)
        for f in steps:
            words = f.plain(words)
        return words


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


ANALYZERS: dict[str, Analyzer] = {
    "simple_ascii": Analyzer(ascii_words, (), (ascii_lower,)),
    "standard": Analyzer(standard, (lowercase,)),
    "simple": Analyzer(letter, (lowercase,)),
    "whitespace": Analyzer(whitespace),
    "keyword": Analyzer(keyword),
    "stop": Analyzer(letter, (lowercase, stop(ENGLISH_STOP))),
    "classic": Analyzer(classic_words, (classic_filter, lowercase, stop(ENGLISH_STOP))),
    "english": Analyzer(standard, (english_possessive, lowercase, stop(ENGLISH_STOP), stem(STEMMERS["porter"]))),
    "french": Analyzer(standard, (elision(FRENCH_ARTICLES), lowercase, STEM["french_minimal"])),
    "german": Analyzer(standard, (lowercase, NORMALIZE["german"], stem(STEMMERS["german_light"]))),
    "spanish": Analyzer(standard, (lowercase, stem(STEMMERS["spanish_light"]))),
    "portuguese": Analyzer(standard, (lowercase, STEM["portuguese_minimal"])),
    "italian": Analyzer(standard, (elision(ITALIAN_ARTICLES), lowercase, STEM["italian_light"])),
    "catalan": Analyzer(standard, (elision(CATALAN_ARTICLES), lowercase)),
    "irish": Analyzer(standard, (elision(IRISH_ARTICLES), lowercase)),
    "swedish": Analyzer(standard, (lowercase, stem(STEMMERS["swedish"]))),
    "norwegian": Analyzer(standard, (lowercase, stem(STEMMERS["norwegian"]))),
    "danish": Analyzer(standard, (lowercase, stem(STEMMERS["danish"]))),
    "russian": Analyzer(standard, (lowercase, stem(STEMMERS["russian"]))),
    "hindi": Analyzer(standard, (lowercase, decimal_digit, stem(STEMMERS["hindi"]))),
    "galician": Analyzer(standard, (lowercase, STEM["galician_minimal"])),
    "hungarian": Analyzer(standard, (lowercase, STEM["hungarian_light"])),
    "arabic": Analyzer(standard, (lowercase, decimal_digit, NORMALIZE["arabic"], stem(STEMMERS["arabic"]))),
    "persian": Analyzer(standard, (lowercase, decimal_digit, NORMALIZE["arabic"], NORMALIZE["persian"]), (persian_chars,)),
    "romanian": Analyzer(standard, (lowercase, NORMALIZE["romanian"])),
    "serbian": Analyzer(standard, (lowercase, NORMALIZE["serbian"])),
    "sorani": Analyzer(standard, (NORMALIZE["sorani"], lowercase, decimal_digit, STEM["sorani"])),
    "turkish": Analyzer(standard, (apostrophe, turkish_lowercase)),
    "greek": Analyzer(standard, (greek_lowercase,)),
    "bulgarian": Analyzer(standard, (lowercase, STEM["bulgarian"])),
    "czech": Analyzer(standard, (lowercase, STEM["czech"])),
    "unicode_whitespace": Analyzer(pattern_split(r"(?U)\s+")),
    "url_email": Analyzer(url_email, (lowercase, stop(ENGLISH_STOP))),
    "html": Analyzer(standard, (lowercase,), (html_strip,)),
}
