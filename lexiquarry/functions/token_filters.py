"""Token filters that split, join, type or annotate tokens; column expressions over arrays of struct<term, pos>.

Where a filter makes several tokens of one, later positions move on by as many; gaps that removed tokens left stay.
Null tokens don't occur: analyzers read a null text as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiquarry.functions.analysis import ANALYZERS, ENGLISH_STOP, Analyzer, Step, also_plain, cjk_width_filter, keep, lowercase, once, shingles, standard, stop

#: Letters of the scripts that are cut into bigrams.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: A word part: capitals and what follows them up to the next capital.
LOWER_PART = r"[\p{L}&&[^\p{Lu}]]"


def spread(parts) -> Step:
    """A filter from a function that gives each term's parts, which take a position each; a term without parts leaves its gap."""

    def run(toks: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            gap = t["pos"] - i
            filled = once(lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string"))))
            return F.transform(filled(parts(t["term"])), lambda p: F.struct(p.alias("term"), gap.alias("gap")))

        moved = F.transform(F.flatten(F.transform(toks, one)), lambda x, k: F.struct(x["term"].alias("term"), (k + x["gap"]).cast("int").alias("pos")))
        return F.filter(moved, lambda t: t["term"].isNotNull())

    return also_plain(run, lambda words: F.flatten(F.transform(words, lambda w: parts(w))))


def word_delimiter(split_on_case: bool = True, split_on_numerics: bool = True, words: bool = True, numbers: bool = True, possessive: bool = True) -> Step:
    """Parts of terms: cut at other signs, before capitals that follow small letters, and between letters and digits."""
    word = rf"\p{{Lu}}+{LOWER_PART}*|{LOWER_PART}+" if split_on_case else r"\p{L}+"
    if split_on_numerics:
        pattern = "|".join(([word] if words else []) + ([r"\p{N}+"] if numbers else []))
    else:
        pattern = rf"\p{{Lu}}+[\p{{L}}\p{{N}}&&[^\p{{Lu}}]]*|[\p{{L}}\p{{N}}&&[^\p{{Lu}}]]+" if split_on_case else r"[\p{L}\p{N}]+"
    bare = (lambda t: F.when(F.contains(t, F.lit("'")), F.regexp_replace(t, r"'[sS](?=$|[^\p{L}\p{N}])", "")).otherwise(t)) if possessive else (lambda t: t)
    cut = lambda t: F.regexp_extract_all(bare(t), F.lit(pattern), F.lit(0))
    return spread(lambda t: F.when(t.rlike(r"^[a-z]+\z"), F.array(t)).otherwise(cut(t)) if words else cut(t))


def word_delimiter_all(toks: Column) -> Column:
    """Terms with all other signs taken out (the parts as one)."""
    return F.filter(F.transform(toks, lambda t: F.struct(F.regexp_replace(t["term"], r"[^\p{L}\p{N}]+", "").alias("term"), t["pos"].alias("pos"))), lambda t: t["term"] != "")


def cjk_bigrams(unigrams: bool = False) -> Step:
    """Runs of Chinese, Japanese and Korean letters as overlapping pairs (a single letter as itself); other runs stay.

    With unigrams, each letter comes too, at the position of the pair that it begins.
    """

    def cut(run: Column) -> Column:
        n = F.char_length(run)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(n < 2, F.array(run)).otherwise(F.concat(pairs, F.array(F.right(run, F.lit(1)))) if unigrams else pairs)

    def parts(term: Column) -> Column:
        runs = F.regexp_extract_all(term, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))
        return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), cut(r)).otherwise(F.array(r))))

    def with_first(t: Column) -> Column:
        first = F.struct(F.left(t["term"], F.lit(1)).alias("term"), t["pos"].alias("pos"))
        return F.when(t["term"].rlike(f"^[{CJK}]{{2}}$"), F.array(first, t)).otherwise(F.array(t))

    paired = spread(parts)
    return (lambda toks: F.flatten(F.transform(paired(toks), with_first))) if unigrams else paired


def hyphenated_words(toks: Column) -> Column:
    """A term that ends in a hyphen is joined with the next one; positions are counted anew."""
    joined = F.array_join(F.transform(toks, lambda t: t["term"]), "\n")
    words = F.filter(F.split(F.regexp_replace(joined, "-\n", ""), "\n", -1), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("pos")))


def date_recognizer(pattern: str = "yyyy-MM-dd") -> Step:
    """Keeps the terms that are dates in this pattern."""
    return keep(lambda t: F.try_to_timestamp(t, F.lit(pattern)).isNotNull())


def compound_words(dictionary: list[str], least_word: int = 5, least: int = 2, most: int = 15, longest: bool = False) -> Step:
    """Adds the dictionary's words that stand in a term, at its position, by start, then length (longest: one per start)."""

    def inside(term: Column) -> Column:
        n = F.char_length(term)
        starts = F.when(n >= F.greatest(F.lit(least_word), F.lit(least)), F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))

        def at(s: Column) -> Column:
            found = F.filter(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), n - s + 1)), lambda k: F.substr(term, s, k)), lambda w: F.lower(w).isin(dictionary))
            return F.slice(found, -1, 1) if longest else found

        one = F.transform(starts, at)
        return F.flatten(F.transform(one, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array().cast("array<string>"))))

    return lambda toks: F.flatten(F.transform(toks, lambda t: F.concat(F.array(t), F.transform(inside(t["term"]), lambda w: F.struct(w.alias("term"), t["pos"].alias("pos"))))))


def fixed_shingle(size: int = 2, joiner: str = " ") -> Step:
    """Runs of exactly this many tokens."""
    return shingles(size, size, False, joiner)


# ---- annotations: these end a chain, for they add a field to each token


def delimited(name: str, kind: str, default, delimiter: str = "|") -> Step:
    """Splits term|value at the last delimiter; the value is cast to kind, and default stands in for a missing or malformed one."""

    def one(t: Column) -> Column:
        held = F.contains(t["term"], F.lit(delimiter))
        value = F.when(held, F.substring_index(t["term"], delimiter, -1))
        bare = F.when(held, F.left(t["term"], F.char_length(t["term"]) - F.char_length(value) - len(delimiter))).otherwise(t["term"])
        return F.struct(bare.alias("term"), t["pos"].alias("pos"), F.coalesce(value.try_cast(kind), F.lit(default).cast(kind)).alias(name))

    return lambda toks: F.transform(toks, one)


def delimited_boost(delimiter: str = "|") -> Step:
    return delimited("boost", "double", 1.0, delimiter)


def delimited_frequency(delimiter: str = "|") -> Step:
    return delimited("freq", "int", 1, delimiter)


def delimited_payload(kind: str = "float", delimiter: str = "|") -> Step:
    """kind: float, int or string (the bytes as they are)."""
    return delimited("payload", kind, None, delimiter)


def typed(rules: list[tuple[str, str]], default: str = "word") -> Step:
    """Adds a type to each token: that of the first pattern that the whole term matches."""

    def one(t: Column) -> Column:
        out = F.lit(default)
        for pattern, name in reversed(rules):
            out = F.when(t["term"].rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return F.struct(t["term"].alias("term"), t["pos"].alias("pos"), out.alias("type"))

    return lambda toks: F.transform(toks, one)


def of_types(types: list[str], keep_them: bool = True) -> Step:
    """Keeps or drops typed tokens by type."""
    return lambda toks: F.filter(toks, lambda t: t["type"].isin(types) if keep_them else ~t["type"].isin(types))


def type_as_synonym(prefix: str = "", ignore: tuple[str, ...] = ("word",)) -> Step:
    """Adds each typed token's type as a token at its position; types in ignore add none."""

    def one(t: Column) -> Column:
        own = F.struct(t["term"].alias("term"), t["pos"].alias("pos"))
        return F.when(t["type"].isin(list(ignore)), F.array(own)).otherwise(F.array(own, F.struct(F.concat(F.lit(prefix), t["type"]).alias("term"), t["pos"].alias("pos"))))

    return lambda toks: F.flatten(F.transform(toks, one))


ANALYZERS["cjk"] = Analyzer(standard, (cjk_width_filter, lowercase, cjk_bigrams(), stop(ENGLISH_STOP)))
