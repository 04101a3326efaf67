"""Registered queries against DuckDB on the smallest tables, and the entry point."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "term", "bool_min_should_match", "dis_max", "synonym", "indri_and", "phrase", "multi_phrase", "regexp_complement", "interval_ordered", "interval_repeating", "span_near_ordered", "span_not", "interval_unordered", "interval_gaps_of_phrase", "interval_wildcard_ordered", "span_near_unordered", "span_within", "combined_fields", "fuzzy", "common_terms", "explain", "total_hits", "bool_mixed_with_columns", "date_terms", "parser_fn_at_least", "parser_xml_span_or_terms", "analysis_czech_stem", "analysis_swedish_minimal_stem",
    "similarity_dfr_g_b_none", "similarity_ib_spl_ttf_h2", "similarity_axiomatic_f3log", "range_crosses", "ip_range", "geo_box_dateline", "value_scale", "value_selector_middle", "term_statistics",
    "collection_statistics", "knn_cosine", "max_sim", "search_after", "rank_fusion", "analysis_common_grams", "analysis_ngram", "analysis_porter_stem", "analysis_russian_stem", "analysis_word_delimiter", "analysis_compound_words", "analysis_type", "parser_classic_at_least", "parser_surround_near", "parser_search_request",
]


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6))
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is not None, str(round(x, 3)) if isinstance(x, float) else str(x)) for x in r)
    rows = sorted([tuple(r[c] for c in columns) for r in got.collect()], key=key)
    wanted = sorted([tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()], key=key)
    assert len(rows) == len(wanted)
    assert all(same(x, y) for a, b in zip(rows, wanted) for x, y in zip(a, b))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
