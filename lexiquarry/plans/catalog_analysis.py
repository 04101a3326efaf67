"""Registered queries over stemmers and the filters that split, join and type tokens."""

from __future__ import annotations

from lexiquarry.functions import analysis as an
from lexiquarry.functions import stemming as st
from lexiquarry.functions import token_filters as tf
from lexiquarry.plans.catalog_fields import ORACLES, QUERIES, analyzed, chain

#: The blank-separated strings of a text.
_WHITE = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_SMALL = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
_PARTS = ["that", "with", "ness", "tion"]
_IN_PARTS = "(" + ", ".join(f"'{w}'" for w in _PARTS) + ")"


def white(*filters) -> an.Analyzer:
    return an.Analyzer(an.whitespace, filters)


for _name, _rules in st.STEMMERS.items():
    analyzed(f"{_name}_stem", chain(st.stem(_rules)), st.stem_sql(_rules, "toks"))
analyzed("word_delimiter", white(tf.word_delimiter()), rf"flatten(list_transform({_WHITE}, lambda x: regexp_extract_all(regexp_replace(x, '''[sS]($|[^\p{{L}}\p{{N}}])', '\1', 'g'), '\p{{Lu}}+{_SMALL}*|{_SMALL}+|\p{{N}}+')))")
analyzed("word_delimiter_all", white(tf.word_delimiter_all), rf"list_filter(list_transform({_WHITE}, lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda x: x <> '')")
analyzed("hyphenated_words", white(tf.hyphenated_words), f"list_filter(string_split(replace(array_to_string({_WHITE}, chr(10)), '-' || chr(10), ''), chr(10)), lambda x: x <> '')")
analyzed("cjk_bigram", chain(tf.cjk_bigrams()), "toks")
analyzed("fixed_shingle", chain(tf.fixed_shingle(3)), "list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])")
analyzed("date_recognizer", white(tf.date_recognizer()), f"list_filter({_WHITE}, lambda x: regexp_full_match(x, '\\d{{4}}-\\d\\d-\\d\\d') AND try_strptime(x, '%Y-%m-%d') IS NOT NULL)")
analyzed("compound_words", chain(tf.compound_words(_PARTS, 5, 4, 6)), f"flatten(list_transform(toks, lambda x: list_concat([x], CASE WHEN length(x) < 5 THEN CAST([] AS VARCHAR[]) ELSE flatten(list_transform(range(1, length(x) - 2), lambda s: list_filter(list_transform(range(4, least(6, length(x) - s + 1) + 1), lambda k: x[s:s + k - 1]), lambda w: w IN {_IN_PARTS}))) END)))")
analyzed("type_as_synonym", chain(tf.typed([("[0-9]+", "number")]), tf.type_as_synonym("_type_")), "flatten(list_transform(toks, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN [x, '_type_number'] ELSE [x] END))")
analyzed("type", chain(tf.typed([("[0-9]+", "number")]), tf.of_types(["number"])), "list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+'))")
__all__ = ["ORACLES", "QUERIES"]
