"""The registered queries of the search engine, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiquarry.functions import similarity as sim
from lexiquarry.operators import positions as pos
from lexiquarry.plans import query as q
from lexiquarry.sources.shared import fingerprint, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}
_OPEN: dict[tuple[str, str], q.Corpus] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def corpus(spark: SparkSession, sf_dir: str, similarity=None, text: tuple[str, ...] = ("text",)) -> q.Corpus:
    """The documents over their stored index, which the first query of a table and its text fields builds in the shared folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    c, key = q.Corpus(docs, "doc_id", dict.fromkeys(text, "simple_ascii"), similarity), (spark.sparkContext.applicationId, fingerprint(docs, f"simple_ascii 2 {' '.join(text)}"))
    if key not in _OPEN:
        _OPEN[key] = c.indexed(f"{shared_dir(spark)}/index-{key[1]}")
    return c.like(path=_OPEN[key].path, meta=_OPEN[key].meta)


TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


def formula_sql(formula: str, tf: str, df: str, ttf: str, boost: float = 1.0) -> str:
    """A model's formula in DuckDB's words."""
    names = {"tf": tf, "df": df, "ttf": ttf, "boost": f"{float(boost)}::DOUBLE", "length": "length", "docs": "docs", "tokens": "tokens", "avg": "(tokens / greatest(docs, 1.0::DOUBLE))", "case": "if"}
    out = re.sub(r"\b(tf|df|ttf|boost|avg|case)\b", lambda m: names[m[1]], formula)
    return re.sub(r"(?<![\w.])(\d+\.?\d*)(?![\w.])", r"\1::DOUBLE", out)


def search_sql(terms: list[str], match: str, score: str, rows: str = "documents") -> str:
    """Documents with tfN, dfN, ttfN of terms N and length, docs, tokens; match and score are over these."""
    tfs = "".join(f", len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    stats = "".join(f", count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}, sum(tf{i})::DOUBLE AS ttf{i}" for i in range(len(terms)))
    return f"""WITH d AS (SELECT *, {TOKENS} AS toks FROM {rows}),
e AS (SELECT *, len(toks)::DOUBLE AS length{tfs} FROM d),
s AS (SELECT count(*) FILTER (WHERE length > 0)::DOUBLE AS docs, sum(length)::DOUBLE AS tokens{stats} FROM e)
SELECT doc_id, round({score}, 6) AS score FROM e, s WHERE {match}"""


def bm(i: int, boost: float = 1.0) -> str:
    return formula_sql(sim.bm25().formula, f"tf{i}", f"df{i}", f"ttf{i}", boost)


def searched(query: Callable[[], q.Query], similarity=None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: corpus(spark, sf_dir, similarity).search(query()).withColumn("score", F.round("score", 6))


def search(name: str, query: Callable[[], q.Query], terms: list[str], match: str, score: str, similarity=None) -> None:
    register(name, searched(query, similarity), search_sql(terms, match, score))


T = lambda t: q.Term("text", t)
search("term", lambda: T("that"), ["that"], "tf0 > 0", bm(0))
search("match_all", lambda: q.MatchAll(), [], "true", "1.0::DOUBLE")
search("match_none", lambda: q.MatchNone(), [], "false", "1.0::DOUBLE")
search("bool_must", lambda: q.Bool(must=(T("that"), T("with"))), ["that", "with"], "tf0 > 0 AND tf1 > 0", f"{bm(0)} + {bm(1)}")
search("bool_should", lambda: q.Bool(should=(T("que"), T("und"))), ["que", "und"], "tf0 > 0 OR tf1 > 0", f"if(tf0 > 0, {bm(0)}, 0) + if(tf1 > 0, {bm(1)}, 0)")
search("bool_must_not", lambda: q.Bool(must=(T("that"),), must_not=(T("with"),)), ["that", "with"], "tf0 > 0 AND tf1 = 0", bm(0))
search("bool_filter", lambda: q.Bool(must=(T("that"),), filter=(T("from"),)), ["that", "from"], "tf0 > 0 AND tf1 > 0", bm(0))
search("bool_min_should_match", lambda: q.Bool(should=(T("that"), T("with"), T("from")), at_least=2), ["that", "with", "from"], "(tf0 > 0)::INT + (tf1 > 0)::INT + (tf2 > 0)::INT >= 2", " + ".join(f"if(tf{i} > 0, {bm(i)}, 0)" for i in range(3)))
search("bool_only_not", lambda: q.Bool(must_not=(T("that"),)), [], "false", "1.0::DOUBLE")
search("dis_max", lambda: q.DisMax((T("that"), T("with")), 0.1), ["that", "with"], "tf0 > 0 OR tf1 > 0", f"greatest(if(tf0 > 0, {bm(0)}, 0), if(tf1 > 0, {bm(1)}, 0)) + 0.1::DOUBLE * least(if(tf0 > 0, {bm(0)}, 0), if(tf1 > 0, {bm(1)}, 0))")
search("boost", lambda: q.Boost(q.Boost(T("that"), 2.0), 1.5), ["that"], "tf0 > 0", f"3.0::DOUBLE * {bm(0)}")
search("constant_score", lambda: q.Constant(q.Boost(T("that"), 4.0), 2.5), ["that"], "tf0 > 0", "2.5::DOUBLE")
search("term_in_set", lambda: q.TermInSet("text", ("pour", "oder", "sich")), ["pour", "oder", "sich"], "tf0 + tf1 + tf2 > 0", "1.0::DOUBLE")
search("field_exists", lambda: q.exists("lang"), [], "lang IS NOT NULL", "1.0::DOUBLE")
search("synonym", lambda: q.Synonym("text", (("that", 1.0), ("this", 0.5))), ["that", "this"], "tf0 + tf1 > 0", formula_sql(sim.bm25().formula, "(tf0 + 0.5 * tf1)", "greatest(df0, df1)", "(ttf0 + ttf1)"))
search("blended", lambda: q.Blended((("text", "that", 1.0), ("text", "this", 2.0)), True, 0.25), ["that", "this"], "tf0 + tf1 > 0", (lambda a, b: f"greatest({a}, {b}) + 0.25::DOUBLE * least({a}, {b})")(*[f"if(tf{i} > 0, {formula_sql(sim.bm25().formula, f'tf{i}', 'greatest(df0, df1)', '(ttf0 + ttf1)', w)}, 0)" for i, w in ((0, 1.0), (1, 2.0))]))
search("indri_and", lambda: q.IndriAnd(((T("that"), 1.0), (T("with"), 3.0))), ["that", "with"], "tf0 + tf1 > 0", "({} + 3.0::DOUBLE * {}) / 4.0::DOUBLE".format(*[formula_sql(sim.indri_dirichlet().formula, f"tf{i}", f"df{i}", f"ttf{i}") for i in (0, 1)]), sim.indri_dirichlet())
search("bayesian", lambda: q.Bayesian(T("that"), 1.5, 0.8, 0.1), ["that"], "tf0 > 0", f"1 / (1 + exp(-(1.5::DOUBLE * ({bm(0)} - 0.8::DOUBLE) + ln(0.1::DOUBLE / 0.9::DOUBLE))))")
search("function_score", lambda: q.FunctionScore(T("that"), lambda: F.log10(F.col("n_chars") + 10)), ["that"], "tf0 > 0", f"{bm(0)} * log10(n_chars + 10)")
search("function_query", lambda: q.function_query(lambda: F.sqrt(F.col("n_chars"))), [], "true", "sqrt(n_chars::DOUBLE)")
search("boosted_by_query", lambda: q.boosted_by(T("that"), T("with"), 0.5), ["that", "with"], "tf0 > 0", f"{bm(0)} * if(tf1 > 0, 0.5::DOUBLE, 1.0::DOUBLE)")
search("numeric_range", lambda: q.Where(lambda: F.col("n_chars").between(500, 1500)), [], "n_chars BETWEEN 500 AND 1500", "1.0::DOUBLE")
search("prefix", lambda: q.prefix("text", "tha"), [], "len(list_filter(toks, lambda x: starts_with(x, 'tha'))) > 0", "1.0::DOUBLE")
search("wildcard", lambda: q.wildcard("text", "th?t*on"), [], "len(list_filter(toks, lambda x: regexp_full_match(x, 'th.t.*on'))) > 0", "1.0::DOUBLE")
search("regexp", lambda: q.regexp("text", "(un|re)[a-m]{2,3}ing"), [], "len(list_filter(toks, lambda x: regexp_full_match(x, '(un|re)[a-m]{2,3}ing'))) > 0", "1.0::DOUBLE")
search("regexp_complement", lambda: q.regexp("text", "the.*&~.*e"), [], "len(list_filter(toks, lambda x: starts_with(x, 'the') AND NOT ends_with(x, 'e'))) > 0", "1.0::DOUBLE")
search("term_range", lambda: q.term_range("text", "zu", "zw", True, False), [], "len(list_filter(toks, lambda x: x >= 'zu' AND x < 'zw')) > 0", "1.0::DOUBLE")
search("phrase", lambda: q.phrase("text", "of", "the"), ["of", "the"], "freq > 0", "0")
_ALIGNED = "len(list_filter(range(1, len(toks)), lambda i: toks[i] = '{}' AND toks[i + {}] = '{}'))::DOUBLE"


def phrase_sql(a: str, b: str, gap: int) -> str:
    freq = _ALIGNED.format(a, gap, b)
    both = " + ".join(formula_sql(sim.bm25().formula, "freq", f"df{i}", f"ttf{i}") for i in (0, 1))
    return search_sql([a, b], "freq > 0", both).replace("e AS (SELECT *,", f"e AS (SELECT *, {freq} AS freq,")


ORACLES["phrase"] = phrase_sql("of", "the", 1)
register("phrase_with_gap", searched(lambda: q.Phrase("text", (("of",), ("that",)), 0, (0, 2))), phrase_sql("of", "that", 2))
register("ngram_phrase", searched(lambda: q.ngram_phrase("text", 2, "of", "to", "that")), phrase_sql("of", "that", 2))
search("multi_phrase", lambda: q.Phrase("text", (("of",), ("the", "that"))), ["of", "the", "that"], "freq > 0", " + ".join(formula_sql(sim.bm25().formula, "freq", f"df{i}", f"ttf{i}") for i in range(3)))
ORACLES["multi_phrase"] = ORACLES["multi_phrase"].replace("e AS (SELECT *,", "e AS (SELECT *, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] IN ('the', 'that')))::DOUBLE AS freq,")
for _s in [sim.classic(), sim.boolean(), sim.raw_tf(), sim.lm_dirichlet(), sim.lm_jelinek_mercer(), *[sim.dfr(m, "l", "h2") for m in sim.BASIC_MODELS], sim.dfr("in", "b", "h1"), sim.dfr("in", "l", "h3"), sim.dfr("if", "l", "z"), sim.dfr("g", "b", "none"), sim.ib("ll", "df"), sim.ib("spl", "ttf"), *[sim.dfi(m) for m in sim.INDEPENDENCE], *[sim.axiomatic(k) for k in ("f1exp", "f1log", "f2exp", "f2log", "f3exp", "f3log")]]:
    search(f"similarity_{_s.name}", lambda: T("que"), ["que"], "tf0 > 0", formula_sql(_s.formula, "tf0", "df0", "ttf0"), _s)


# intervals: minimal ordered pairs have no nearer partner on either side
_PAIRS = f"""WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
p AS (SELECT doc_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS t FROM d),
a AS (SELECT doc_id, pos FROM p WHERE t = 'of'), b AS (SELECT doc_id, pos FROM p WHERE t = 'to'),
o AS (SELECT a.doc_id, max(a.pos) AS s, b.pos AS e FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.doc_id, b.pos),
m AS (SELECT doc_id, s, min(e) AS e FROM o GROUP BY doc_id, s)"""
_OF_TO = (pos.term("of"), pos.term("to"))


def interval(name: str, node: Callable[[], pos.Node], rows: str, wide: int) -> None:
    register(name, searched(lambda: q.Positional("text", node(), "interval")), f"{_PAIRS} SELECT doc_id, round(1 - 1 / (1 + sum(1.0::DOUBLE / greatest(e - s + 1 - {wide} + 1, 1))), 6) AS score FROM {rows} GROUP BY doc_id")


interval("interval_ordered", lambda: pos.node("ordered", *_OF_TO), "m", 2)
interval("interval_max_gaps", lambda: pos.node("max_gaps", pos.node("ordered", *_OF_TO), args=(2,)), "(SELECT * FROM m WHERE e - s - 1 <= 2)", 2)
interval("interval_max_width", lambda: pos.node("max_width", pos.node("ordered", *_OF_TO), args=(3,)), "(SELECT * FROM m WHERE e - s + 1 <= 3)", 2)
interval("interval_phrase", lambda: pos.node("phrase", *_OF_TO), "(SELECT * FROM m WHERE e = s + 1)", 2)
interval("interval_or", lambda: pos.node("or", *_OF_TO), "(SELECT doc_id, pos AS s, pos AS e FROM p WHERE t IN ('of', 'to'))", 1)
interval("interval_within", lambda: pos.node("within", *_OF_TO, args=(2,)), "(SELECT DISTINCT a.doc_id, a.pos AS s, a.pos AS e FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 2)", 1)
interval("interval_not_within", lambda: pos.node("not_within", *_OF_TO, args=(2,)), "(SELECT doc_id, pos AS s, pos AS e FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND abs(a.pos - b.pos) <= 2))", 1)
interval("interval_before", lambda: pos.node("before", *_OF_TO), "(SELECT DISTINCT a.doc_id, a.pos AS s, a.pos AS e FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos)", 1)
interval("interval_after", lambda: pos.node("after", *_OF_TO), "(SELECT DISTINCT a.doc_id, a.pos AS s, a.pos AS e FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos > b.pos)", 1)
interval("interval_repeating", lambda: pos.node("repeating", pos.term("of"), args=(2,)), "(SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM a QUALIFY e IS NOT NULL)", 2)
interval("interval_containing", lambda: pos.node("containing", pos.node("ordered", *_OF_TO), pos.term("the")), "(SELECT * FROM m WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND t = 'the' AND pos BETWEEN s AND e))", 2)
interval("interval_not_containing", lambda: pos.node("not_containing", pos.node("ordered", *_OF_TO), pos.term("the")), "(SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND t = 'the' AND pos BETWEEN s AND e))", 2)
interval("interval_contained_by", lambda: pos.node("contained_by", pos.term("the"), pos.node("ordered", *_OF_TO)), "(SELECT DISTINCT p.doc_id, pos AS s, pos AS e FROM p JOIN m ON p.doc_id = m.doc_id WHERE t = 'the' AND pos BETWEEN m.s AND m.e)", 1)
interval("interval_extend", lambda: pos.node("extend", pos.term("of"), args=(0, 2)), "(SELECT doc_id, pos AS s, pos + 2 AS e FROM a)", 3)


def span(name: str, node: Callable[[], pos.Node], terms: list[str], rows: str) -> None:
    """Spans are rows (doc_id, s, e); every term's statistics score the sloppy frequency."""
    base = search_sql(terms, "true", " + ".join(formula_sql(sim.bm25().formula, "freq", f"df{i}", f"ttf{i}") for i in range(len(terms))))
    head, tail = base.rsplit("SELECT doc_id", 1)
    pairs = _PAIRS.split("FROM documents),", 1)[1].strip()
    sql = f"{head.rstrip()},\n{pairs},\nf AS (SELECT doc_id, sum(1.0::DOUBLE / (1 + e - s)) AS freq FROM {rows} GROUP BY doc_id)\nSELECT doc_id{tail.replace('FROM e, s', 'FROM e JOIN f USING (doc_id), s')}"
    register(name, searched(lambda: q.Positional("text", node(), "span")), sql)


span("span_term", lambda: pos.term("of"), ["of"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM a)")
span("span_first", lambda: pos.node("first", pos.term("of"), args=(10,)), ["of"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM a WHERE pos <= 10)")
span("span_position_range", lambda: pos.node("position_range", pos.term("of"), args=(5, 20)), ["of"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM a WHERE pos - 1 >= 5 AND pos <= 20)")
span("span_or", lambda: pos.node("or", *_OF_TO), ["of", "to"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM p WHERE t IN ('of', 'to'))")
span("span_not", lambda: pos.node("not", pos.term("of"), pos.term("to"), args=(1, 1)), ["of", "to"], "(SELECT doc_id, pos AS s, pos + 1 AS e FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND abs(a.pos - b.pos) <= 1))")
span("span_near_ordered", lambda: pos.node("near", *_OF_TO, args=(3, True)), ["of", "to"], "(SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM a JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.doc_id, a.pos HAVING min(b.pos) - a.pos - 1 <= 3)")
