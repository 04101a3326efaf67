"""Registered queries over positions, several fields, fused and near terms, explanations, totals and columns, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import analysis as an
from lexiquarry.functions import similarity as sim
from lexiquarry.functions import values as val
from lexiquarry.operators import collect as col_
from lexiquarry.operators import positions as pos
from lexiquarry.plans import parsers as ps
from lexiquarry.plans import query as q
from lexiquarry.plans.catalog import _OF_TO, _PAIRS, ORACLES, TOKENS, bm, corpus, formula_sql, interval, register, search_sql, searched, span, table
from lexiquarry.plans.catalog_analysis import QUERIES
from lexiquarry.plans.catalog_fields import analyzed, chain, top_sql

OF, TO, THE = pos.term("of"), pos.term("to"), pos.term("the")
ORDERED = lambda: pos.node("ordered", OF, TO)
T = lambda t: q.Term("text", t)


def next_other(words: str) -> str:
    """Neighbouring occurrences of different words."""
    return f"(SELECT doc_id, pos AS s, npos AS e FROM (SELECT *, lead(pos) OVER w AS npos, lead(t) OVER w AS nt FROM p WHERE t IN ({words}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE nt <> t)"


_THE_IN = "SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND t = 'the' AND pos BETWEEN s AND e"
interval("interval_unordered", lambda: pos.node("unordered", *_OF_TO), next_other("'of', 'to'"), 2)
interval("interval_unordered_same", lambda: pos.node("unordered", OF, OF), "(SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM a QUALIFY e IS NOT NULL)", 2)
interval("interval_at_least", lambda: pos.node("at_least", OF, TO, THE, args=(2,)), next_other("'of', 'to', 'the'"), 2)
interval("interval_no_overlaps", lambda: pos.node("unordered_no_overlaps", OF, TO), next_other("'of', 'to'"), 2)
interval("interval_overlapping", lambda: pos.node("overlapping", ORDERED(), THE), f"(SELECT * FROM m WHERE EXISTS ({_THE_IN}))", 2)
interval("interval_non_overlapping", lambda: pos.node("non_overlapping", ORDERED(), THE), f"(SELECT * FROM m WHERE NOT EXISTS ({_THE_IN}))", 2)
interval("interval_not_contained_by", lambda: pos.node("not_contained_by", THE, ORDERED()), "(SELECT doc_id, pos AS s, pos AS e FROM p WHERE t = 'the' AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND p.pos BETWEEN m.s AND m.e))", 1)
interval("interval_gaps_of_phrase", lambda: pos.node("max_gaps", pos.node("ordered", pos.node("phrase", OF, THE), TO), args=(6,)), "(SELECT doc_id, max(s) AS s, e FROM (SELECT f.doc_id, f.pos AS s, min(b.pos) AS e FROM a AS f JOIN p AS g ON g.doc_id = f.doc_id AND g.pos = f.pos + 1 AND g.t = 'the' JOIN b ON b.doc_id = f.doc_id AND b.pos > g.pos GROUP BY f.doc_id, f.pos) GROUP BY doc_id, e HAVING e - max(s) - 2 <= 6)", 3)
interval("interval_prefix", lambda: pos.multi(lambda t: t.startswith("thatn")), "(SELECT doc_id, pos AS s, pos AS e FROM p WHERE starts_with(t, 'thatn'))", 1)
interval("interval_wildcard_ordered", lambda: pos.node("ordered", OF, pos.multi(lambda t: t.rlike("^t.$"))), "(SELECT doc_id, max(s) AS s, e FROM (SELECT a.doc_id, a.pos AS s, min(w.pos) AS e FROM a JOIN p AS w ON w.doc_id = a.doc_id AND regexp_full_match(w.t, 't.') AND w.pos > a.pos GROUP BY a.doc_id, a.pos) GROUP BY doc_id, e)", 2)
interval("interval_predicate", lambda: pos.Node("check", (ORDERED(),), (lambda s, e: (e - s) % 2 == 1,)), "(SELECT * FROM m WHERE (e - s) % 2 = 1)", 2)

_NEAR = "SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.doc_id, a.pos HAVING min(b.pos) - a.pos - 1 <= {}"
_NEAR_BACK = _NEAR.replace("FROM a JOIN b", "FROM b AS a JOIN a AS b")
span("span_near_unordered", lambda: pos.node("near", *_OF_TO, args=(2, False)), ["of", "to"], f"({_NEAR.format(2)} UNION ALL {_NEAR_BACK.format(2)})")
span("span_containing", lambda: pos.node("containing", pos.node("near", *_OF_TO, args=(3, True)), THE), ["of", "the", "to"], f"(SELECT * FROM ({_NEAR.format(3)}) AS m WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND t = 'the' AND pos >= s AND pos < e))")
span("span_within", lambda: pos.node("within", pos.node("near", *_OF_TO, args=(3, True)), THE), ["of", "the", "to"], f"(SELECT DISTINCT p.doc_id, pos AS s, pos + 1 AS e FROM p JOIN ({_NEAR.format(3)}) AS m ON p.doc_id = m.doc_id WHERE t = 'the' AND pos >= m.s AND pos < m.e)")
span("span_check", lambda: pos.Node("check", (OF,), (lambda s, e: s % 2 == 0,)), ["of"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM a WHERE (pos - 1) % 2 = 0)")

# ---- near terms, common terms, fused scores
_N = "(SELECT count(*) FROM documents)"
ORACLES["common_terms"] = search_sql(["that", "rely", "of"], " OR ".join(f"(df{i} <= 0.2 * {_N} AND tf{i} > 0)" for i in range(3)), " + ".join(f"if(tf{i} > 0, {bm(i)}, 0)" for i in range(3)))
_P = lambda i: f"least(greatest(1 / (1 + exp(-({bm(i)} - 1.0::DOUBLE))), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"
_GATE = lambda i: f"if(tf{i} > 0, ln(1 + exp(ln({_P(i)} / (1 - {_P(i)})))) * 0.5::DOUBLE, 0)"
ORACLES["log_odds_fusion"] = search_sql(["that", "with"], "tf0 > 0 OR tf1 > 0", f"1 / (1 + exp(-({_GATE(0)} + {_GATE(1)}) * sqrt(2.0::DOUBLE)))")
_WORDS = f"WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), w AS (SELECT doc_id, unnest(toks) AS term FROM d), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL), st AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ttf FROM tf GROUP BY term), n AS (SELECT count(*) FILTER (WHERE len(toks) > 0)::DOUBLE AS docs, sum(len(toks))::DOUBLE AS tokens FROM d)"
ORACLES["fuzzy"] = f"""{_WORDS}, near AS (SELECT term, df, ttf, CASE WHEN term = 'thatn' THEN 1.0 ELSE greatest(0, 1 - damerau_levenshtein(term, 'thatn')::DOUBLE / least(length(term), 5)) END AS worth FROM st WHERE damerau_levenshtein(term, 'thatn') <= 1)
SELECT doc_id, round(sum(worth * {formula_sql(sim.bm25().formula, "tf", "df", "ttf")}), 6) AS score FROM (SELECT tf.doc_id, tf.tf, near.df, near.ttf, near.worth, len(d.toks)::DOUBLE AS length, n.docs, n.tokens FROM tf JOIN near USING (term) JOIN d USING (doc_id), n) GROUP BY doc_id"""


def both_fields(spark, sf_dir):
    return corpus(spark, sf_dir, text=("text", "lang")).search(q.CombinedFields((("text", 1.0), ("lang", 2.0)), "de")).withColumn("score", F.round("score", 6))


register("combined_fields", both_fields, f"""WITH d AS (SELECT doc_id, {TOKENS} AS a, {TOKENS.replace("coalesce(text", "coalesce(lang")} AS b FROM documents),
e AS (SELECT doc_id, len(list_filter(a, lambda x: x = 'de'))::DOUBLE AS ta, len(list_filter(b, lambda x: x = 'de'))::DOUBLE AS tb, len(a)::DOUBLE AS la, len(b)::DOUBLE AS lb FROM d),
s AS (SELECT greatest(count(*) FILTER (WHERE ta > 0), count(*) FILTER (WHERE tb > 0))::DOUBLE AS df, (sum(ta) + 2 * sum(tb))::DOUBLE AS ttf, greatest(count(*) FILTER (WHERE la > 0), count(*) FILTER (WHERE lb > 0))::DOUBLE AS docs, (sum(la) + 2 * sum(lb))::DOUBLE AS tokens FROM e)
SELECT doc_id, round({formula_sql(sim.bm25().formula, "tf", "df", "ttf")}, 6) AS score FROM (SELECT doc_id, ta + 2 * tb AS tf, la + 2 * lb AS length FROM e) AS f, s WHERE tf > 0""")
register("multi_similarity", searched(lambda: T("que"), sim.MultiSimilarity(sim.bm25(), sim.lm_dirichlet())), search_sql(["que"], "tf0 > 0", f"{bm(0)} + {formula_sql(sim.lm_dirichlet().formula, 'tf0', 'df0', 'ttf0')}"))
register("per_field_similarity", searched(lambda: T("que"), sim.PerField(sim.bm25(), text=sim.classic())), search_sql(["que"], "tf0 > 0", formula_sql(sim.classic().formula, "tf0", "df0", "ttf0")))
register("prefix_scored", searched(lambda: q.prefix("text", "thatn", scoring=True)), f"""{_WORDS} SELECT doc_id, round(sum({formula_sql(sim.bm25().formula, "tf", "df", "ttf")}), 6) AS score FROM (SELECT tf.doc_id, tf.tf, st.df, st.ttf, len(d.toks)::DOUBLE AS length, n.docs, n.tokens FROM tf JOIN st USING (term) JOIN d USING (doc_id), n WHERE starts_with(tf.term, 'thatn')) GROUP BY doc_id""")
register("bool_mixed_with_columns", searched(lambda: q.Bool(must=(T("that"),), should=(q.Where(lambda: F.col("n_chars") > 900),), must_not=(q.prefix("text", "zu"),))), search_sql(["that"], "tf0 > 0 AND len(list_filter(toks, lambda x: starts_with(x, 'zu'))) = 0", f"{bm(0)} + if(coalesce(n_chars > 900, false), 1.0::DOUBLE, 0)"))
register("regexp_numbers", searched(lambda: q.regexp("text", "<7-1234>")), search_sql([], "len(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+') AND length(ltrim(x, '0')) < 9 AND coalesce(try_cast(x AS BIGINT), -1) BETWEEN 7 AND 1234)) > 0", "1.0::DOUBLE"))

# ---- explanations, places of matches, totals, rescoring
_BOTH = lambda: q.Bool(must=(T("that"), T("with")))
_E = search_sql(["that", "with"], "tf0 > 0 AND tf1 > 0", bm(0)).rsplit("\nSELECT", 1)[0]
register("explain", lambda s, d: corpus(s, d).explain(_BOTH()).select("doc_id", "node", "depth", "matches", F.round("value", 6).alias("value")), _E + "".join(f" {'' if i == 0 else 'UNION ALL '}SELECT doc_id, {i} AS node, {depth} AS depth, true AS matches, round({score}, 6) AS value FROM e, s WHERE tf0 > 0 AND tf1 > 0" for i, (depth, score) in enumerate(((0, f"{bm(0)} + {bm(1)}"), (1, bm(0)), (1, bm(1))))))
register("matches", lambda s, d: corpus(s, d).matches(_BOTH()), f"WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), p AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS start, unnest(toks) AS term FROM d WHERE list_contains(toks, 'that') AND list_contains(toks, 'with')) SELECT doc_id, 'text' AS field, term, start FROM p WHERE term IN ('that', 'with')")
register("total_hits", lambda s, d: corpus(s, d).top_with_total(T("that"), 10).withColumn("score", F.round("score", 6)), f"WITH a AS ({top_sql('that', 10)}), b AS ({top_sql('that', 1000000000)}) SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM b) AS total, '=' AS relation FROM a")
register("total_hits_bounded", lambda s, d: corpus(s, d).top_with_total(T("that"), 10, 25).withColumn("score", F.round("score", 6)), f"WITH a AS ({top_sql('that', 10)}), b AS ({top_sql('that', 1000000000)}) SELECT doc_id, round(score, 6) AS score, least((SELECT count(*) FROM b), 25) AS total, CASE WHEN (SELECT count(*) FROM b) > 25 THEN '>=' ELSE '=' END AS relation FROM a")
register("sort_rescorer", lambda s, d: (lambda c: col_.sort_rescored(c.search(T("that")), c.docs, "doc_id", 40, col_.SortKey(F.col("n_chars"), True)).select("doc_id", F.col("rank").cast("long").alias("rank")))(corpus(s, d)), f"WITH a AS ({top_sql('that', 40)}) SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM a JOIN documents USING (doc_id)")
register("value_rescorer", lambda s, d: (lambda c: col_.rescored_by(c.search(T("that")), c.docs, "doc_id", 40, F.round(F.col("score") + F.log(F.col("n_chars") + 1), 6)))(corpus(s, d)), f"WITH a AS ({top_sql('that', 40)}) SELECT doc_id, round(score + ln(n_chars + 1), 6) AS score FROM a JOIN documents USING (doc_id)")
register("positive_scores", lambda s, d: col_.positive(corpus(s, d).search(q.FunctionScore(T("that"), lambda: F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.0)))).withColumn("score", F.round("score", 6)), search_sql(["that"], "tf0 > 0 AND doc_id % 2 = 0", bm(0)))
register("value_query", lambda s, d: corpus(s, d).project(lambda c: [F.col("doc_id"), F.round(F.coalesce(T("that").on(c, q.Stats(c)), F.lit(-1.0)), 6).alias("v")]), search_sql(["that"], "true", f"if(tf0 > 0, {bm(0)}, -1.0::DOUBLE)").replace("AS score", "AS v"))

_AND_OR = search_sql(["that", "with", "que"], "(tf0 > 0 AND tf1 > 0) OR tf2 > 0", f"if(tf0 > 0 AND tf1 > 0, {bm(0)} + {bm(1)}, 0) + if(tf2 > 0, {bm(2)}, 0)")
register("parser_precedence", searched(lambda: ps.PrecedenceParser().parse("que OR that AND with")), _AND_OR)
register("parser_precedence_not", searched(lambda: ps.PrecedenceParser().parse("NOT with AND (that OR que)")), search_sql(["that", "with", "que"], "tf1 = 0 AND (tf0 > 0 OR tf2 > 0)", f"if(tf0 > 0, {bm(0)}, 0) + if(tf2 > 0, {bm(2)}, 0)"))
register("doc_scores", searched(lambda: q.Bool(must=(T("that"),), should=(q.DocScores(((1, 2.5), (2, 1.5), (3, 0.5), (40, 9.0))),))), search_sql(["that"], "tf0 > 0", f"{bm(0)} + CASE doc_id WHEN 1 THEN 2.5::DOUBLE WHEN 2 THEN 1.5 WHEN 3 THEN 0.5 WHEN 40 THEN 9 ELSE 0 END"))
register("index_or_columns", searched(lambda: q.Bool(must=(T("that"),), filter=(q.IndexOrColumns(q.Constant(T("with")), q.Where(lambda: F.col("text").rlike("(?i)with"))),))), search_sql(["that", "with"], "tf0 > 0 AND tf1 > 0", bm(0)))

# ---- dates as terms, field statistics
register("date_terms", lambda s, d: table(s, d, "orders").select("o_orderkey", val.date_term(F.col("o_orderdate"), "month").alias("month"), val.date_term(F.col("o_orderdate"), "second").alias("second"), val.date_of_term(val.date_term(F.col("o_orderdate"), "day"), "day").alias("day"), val.date_round(F.col("o_orderdate"), "month").alias("first")), "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS month, strftime(o_orderdate, '%Y%m%d%H%M%S') AS second, date_trunc('day', o_orderdate)::TIMESTAMP AS day, date_trunc('month', o_orderdate)::TIMESTAMP AS first FROM orders")
register("field_stats", lambda s, d: col_.field_stats(table(s, d, "lineitem"), "l_quantity", "l_tax"), " UNION ALL ".join(f"SELECT '{c}' AS field, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count({c}) AS n FROM lineitem" for c in ("l_quantity", "l_tax")))
analyzed("czech_stem", chain(an.STEM["czech"]), "list_transform(list_transform(list_transform(toks, lambda x: CASE WHEN length(x) > 7 AND x[-5:] = 'atech' THEN x[:-6] WHEN length(x) > 6 AND x[-4:] = 'etem' THEN x[:-5] WHEN length(x) > 5 AND x[-3:] IN ('ech', 'ich', 'emi', 'ete', 'eti', 'iho', 'imu', 'ata', 'aty', 'ama', 'ami', 'ovi') THEN x[:-4] WHEN length(x) > 4 AND x[-2:] IN ('em', 'es', 'at', 'os', 'us', 'mi', 'ou') THEN x[:-3] WHEN length(x) > 3 AND x[-1] IN ('a', 'e', 'i', 'o', 'u', 'y') THEN x[:-2] ELSE x END), lambda x: CASE WHEN length(x) > 5 AND x[-2:] IN ('ov', 'in') THEN x[:-3] ELSE x END), lambda x: CASE WHEN x[-1] = 'c' THEN x[:-2] || 'k' WHEN x[-1] = 'z' THEN x[:-2] || 'h' WHEN length(x) > 1 AND x[-2] = 'e' THEN x[:-3] || x[-1] ELSE x END)")

# ---- parsers: the same rows as the trees that they stand for
for _name, _text, _like in (
    ("ordered", "fn:ordered(of to)", "interval_ordered"), ("unordered", "fn:unordered(of to)", "interval_unordered"), ("unordered_same", "fn:unordered(of of)", "interval_unordered_same"),
    ("phrase", "fn:phrase(of to)", "interval_phrase"), ("or", "fn:or(of to)", "interval_or"), ("maxwidth", "fn:maxwidth(3 fn:ordered(of to))", "interval_max_width"),
    ("at_least", "fn:atLeast(2 of to the)", "interval_at_least"), ("no_overlaps", "fn:unorderedNoOverlaps(of to)", "interval_no_overlaps"),
    ("containing", "fn:containing(fn:ordered(of to) the)", "interval_containing"), ("not_containing", "fn:notContaining(fn:ordered(of to) the)", "interval_not_containing"),
    ("contained_by", "fn:containedBy(the fn:ordered(of to))", "interval_contained_by"), ("not_contained_by", "fn:notContainedBy(the fn:ordered(of to))", "interval_not_contained_by"),
    ("overlapping", "fn:overlapping(fn:ordered(of to) the)", "interval_overlapping"), ("non_overlapping", "fn:nonOverlapping(fn:ordered(of to) the)", "interval_non_overlapping"),
    ("before", "fn:before(of to)", "interval_before"), ("after", "fn:after(of to)", "interval_after"), ("extend", "fn:extend(of 0 2)", "interval_extend"),
    ("within", "fn:within(of 2 to)", "interval_within"), ("not_within", "fn:notWithin(of 2 to)", "interval_not_within"),
    ("maxgaps_phrase", 'fn:maxgaps(6 fn:ordered("of the" to))', "interval_gaps_of_phrase"), ("wildcard", "fn:wildcard(thatn*)", "interval_prefix"),
):
    register(f"parser_fn_{_name}", searched(lambda t=_text: q.Positional("text", ps.parse_interval(t), "interval")), ORACLES[_like])
_NEAR_XML = '<SpanNear slop="3" inOrder="true"><SpanTerm>of</SpanTerm><SpanTerm>to</SpanTerm></SpanNear>'
for _name, _text, _like in (
    ("span_near", _NEAR_XML, "span_near_ordered"), ("span_or", "<SpanOr><SpanTerm>of</SpanTerm><SpanTerm>to</SpanTerm></SpanOr>", "span_or"), ("span_or_terms", "<SpanOrTerms>of to</SpanOrTerms>", "span_or"),
    ("span_position_range", '<SpanPositionRange start="5" end="20"><SpanTerm>of</SpanTerm></SpanPositionRange>', "span_position_range"), ("terms", "<TermsQuery>que und</TermsQuery>", "bool_should"),
    ("match_all", "<MatchAllDocsQuery/>", "match_all"), ("user", "<UserQuery>that AND with</UserQuery>", "bool_must"), ("constant", '<ConstantScoreQuery boost="2.5"><TermQuery>that</TermQuery></ConstantScoreQuery>', "constant_score"),
    ("dis_max", '<DisjunctionMaxQuery tieBreakerMultiplier="0.1"><TermQuery>that</TermQuery><TermQuery>with</TermQuery></DisjunctionMaxQuery>', "dis_max"),
    ("range", '<RangeQuery lowerTerm="zu" upperTerm="zw" includeUpper="false"/>', "term_range"), ("point_range", '<PointRangeQuery fieldName="n_chars" lowerTerm="500" upperTerm="1500"/>', "numeric_range"),
):
    register(f"parser_xml_{_name}", searched(lambda t=_text: ps.XmlParser().parse(t)), ORACLES[_like])
for _name, _text, _like in (("or", "que OR und", "bool_should"), ("not", "that NOT with", "bool_must_not"), ("wildcard", "th?t*on", "wildcard")):
    register(f"parser_surround_{_name}", searched(lambda t=_text: ps.SurroundParser().parse(t)), ORACLES[_like])
__all__ = ["ORACLES", "QUERIES"]
