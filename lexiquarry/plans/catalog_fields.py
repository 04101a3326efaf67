"""Registered queries over columns: ranges, sets, addresses, places, vectors, value functions, sorting, fusion, analysis, parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import analysis as an
from lexiquarry.functions import similarity as sim
from lexiquarry.functions import values as val
from lexiquarry.operators import collect as col_
from lexiquarry.operators import ranges as rg
from lexiquarry.operators import vectors as vec
from lexiquarry.plans import parsers as ps
from lexiquarry.plans import query as q
from lexiquarry.sources.shared import spread
from lexiquarry.plans.catalog import ORACLES, QUERIES, TOKENS, bm, corpus, register, search_sql, table

C = F.col


def select(name: str, source: str, columns, sql_columns: str, where=None, sql_where: str = "true") -> None:
    """A projection of one table with an optional filter."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return (df.where(where()) if where else df).select(*columns())

    register(name, run, f"SELECT {sql_columns} FROM {source} WHERE {sql_where}")


# ---- ranges and sets
KEYS = lambda: ["l_orderkey", "l_linenumber"]
select("point_range", "lineitem", KEYS, "l_orderkey, l_linenumber", lambda: rg.between(C("l_quantity"), 10, 20), "l_quantity BETWEEN 10 AND 20")
select("point_range_open", "lineitem", KEYS, "l_orderkey, l_linenumber", lambda: rg.between(C("l_discount"), 0.02, 0.05, False, False), "l_discount > 0.02 AND l_discount < 0.05")
select("point_in_set", "lineitem", KEYS, "l_orderkey, l_linenumber", lambda: rg.in_set(C("l_linenumber"), [1, 5]), "l_linenumber IN (1, 5)")
select("multi_valued_range", "part", lambda: ["p_partkey"], "p_partkey", lambda: rg.any_between(F.array(C("p_size"), C("p_size") * 2), 40, 45), "p_size BETWEEN 40 AND 45 OR p_size * 2 BETWEEN 40 AND 45")
select("date_range", "orders", lambda: ["o_orderkey"], "o_orderkey", lambda: rg.between(C("o_orderdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1995-06-30").cast("timestamp")), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
select("keyword_range", "orders", lambda: ["o_orderkey"], "o_orderkey", lambda: rg.between(C("o_orderpriority"), "2", "4"), "o_orderpriority >= '2' AND o_orderpriority <= '4'")
_RANGE = lambda: F.struct(F.array(C("l_discount"), C("l_quantity")).alias("min"), F.array(C("l_discount") + 0.03, C("l_quantity") + 10).alias("max"))
for _name, _fn, _sql in (
    ("intersects", rg.range_intersects, "l_discount <= 0.05 AND l_discount + 0.03 >= 0.02 AND l_quantity <= 25 AND l_quantity + 10 >= 15"),
    ("contains", rg.range_contains, "l_discount <= 0.02 AND l_discount + 0.03 >= 0.05 AND l_quantity <= 15 AND l_quantity + 10 >= 25"),
    ("within", rg.range_within, "l_discount >= 0.02 AND l_discount + 0.03 <= 0.05 AND l_quantity >= 15 AND l_quantity + 10 <= 25"),
    ("crosses", rg.range_crosses, "l_discount <= 0.05 AND l_discount + 0.03 >= 0.02 AND l_quantity <= 25 AND l_quantity + 10 >= 15 AND NOT (l_discount >= 0.02 AND l_discount + 0.03 <= 0.05 AND l_quantity >= 15 AND l_quantity + 10 <= 25)"),
):
    select(f"range_{_name}", "lineitem", KEYS, "l_orderkey, l_linenumber", lambda fn=_fn: fn(_RANGE(), [0.02, 15], [0.05, 25]), _sql)
_IP = lambda: rg.ipv4_column(F.concat_ws(".", F.lit("10"), (C("o_orderkey") % 4).cast("string"), (C("o_custkey") % 256).cast("string"), (C("o_orderkey") % 256).cast("string")))
select("ip_prefix", "orders", lambda: ["o_orderkey"], "o_orderkey", lambda: rg.ip_prefix(_IP(), "10.2.0.0/16"), "o_orderkey % 4 = 2")
select("ip_range", "orders", lambda: ["o_orderkey"], "o_orderkey", lambda: rg.ip_between(_IP(), "10.1.0.0", "10.2.127.255"), "o_orderkey % 4 = 1 OR (o_orderkey % 4 = 2 AND o_custkey % 256 < 128)")

# ---- places: coordinates from keys
_LAT, _LON = lambda: (C("c_custkey") * 37 % 180 - 90).cast("double"), lambda: (C("c_custkey") * 91 % 360 - 180).cast("double")
_SLAT, _SLON = "(c_custkey * 37 % 180 - 90)::DOUBLE", "(c_custkey * 91 % 360 - 180)::DOUBLE"
_HAV = f"2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin(radians({_SLAT} - 48.0) / 2), 2) + cos(radians({_SLAT})) * cos(radians(48.0)) * pow(sin(radians({_SLON} - 11.0) / 2), 2))))"
select("geo_box", "customer", lambda: ["c_custkey"], "c_custkey", lambda: rg.geo_box(_LAT(), _LON(), -10, 50, 0, 90), f"{_SLAT} BETWEEN -10 AND 50 AND {_SLON} BETWEEN 0 AND 90")
select("geo_box_dateline", "customer", lambda: ["c_custkey"], "c_custkey", lambda: rg.geo_box(_LAT(), _LON(), -10, 50, 170, -170), f"{_SLAT} BETWEEN -10 AND 50 AND ({_SLON} >= 170 OR {_SLON} <= -170)")
select("geo_distance", "customer", lambda: ["c_custkey"], "c_custkey", lambda: rg.geo_within(_LAT(), _LON(), 48.0, 11.0, 2_000_000.0), f"{_HAV} <= 2000000")
register("geo_nearest", lambda s, d: table(s, d, "customer").select("c_custkey", F.round(rg.haversine(_LAT(), _LON(), 48.0, 11.0), 3).alias("metres")).orderBy("metres", "c_custkey").limit(20), f"SELECT c_custkey, round({_HAV}, 3) AS metres FROM customer ORDER BY metres, c_custkey LIMIT 20")
select("geo_polygon", "customer", lambda: ["c_custkey"], "c_custkey", lambda: rg.in_polygon(_LON(), _LAT(), rg.wkt_polygon("POLYGON((-100.5 -40.5, 100.5 -40.5, 0.5 80.5, -100.5 -40.5))")[0]), f"{_SLAT} >= -40.5 AND {_SLON} > -100.5 + 101 * ({_SLAT} + 40.5) / 121 AND {_SLON} < 100.5 - 100 * ({_SLAT} + 40.5) / 121")

# ---- value functions
X, Y = lambda: C("l_quantity"), lambda: C("l_discount")


def value(name: str, fn, sql: str) -> None:
    select(f"value_{name}", "lineitem", lambda: [*KEYS(), F.round(fn(), 6).alias("v")], f"l_orderkey, l_linenumber, round({sql}, 6) AS v")


value("const", lambda: F.lit(2.5), "2.5::DOUBLE")
value("sum", lambda: X() + Y() + C("l_tax"), "l_quantity + l_discount + l_tax")
value("product", lambda: X() * C("l_extendedprice"), "l_quantity * l_extendedprice")
value("max", lambda: val.most(Y(), C("l_tax")), "greatest(l_discount, l_tax)")
value("min", lambda: val.fewest(Y(), C("l_tax")), "least(l_discount, l_tax)")
value("div", lambda: val.div(X(), C("l_tax") + 1), "l_quantity / (l_tax + 1)")
value("pow", lambda: F.pow(X(), F.lit(1.5)), "pow(l_quantity, 1.5)")
value("linear", lambda: val.linear(X(), 3, 2), "l_quantity * 3 + 2")
value("recip", lambda: val.recip(X(), 1, 10, 5), "10 / (l_quantity + 5)")
value("map", lambda: val.range_map(X(), 10, 20, F.lit(1.0), F.lit(0.0)), "CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1.0::DOUBLE ELSE 0 END")
value("if", lambda: F.when(X() > 25, Y()).otherwise(C("l_tax")), "CASE WHEN l_quantity > 25 THEN l_discount ELSE l_tax END")
value("def", lambda: val.default(F.when(X() > 25, X()), Y()), "coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END, l_discount)")
value("compare", lambda: val.compare(F.when(X() > 5, X()) < 30).cast("double"), "coalesce(CASE WHEN l_quantity > 5 THEN l_quantity END < 30, false)::INT::DOUBLE")
value("logic", lambda: ((X() > 10) & ~(Y() > 0.05) | (C("l_tax") > 0.07)).cast("double"), "((l_quantity > 10 AND NOT l_discount > 0.05) OR l_tax > 0.07)::INT::DOUBLE")
value("selector_middle", lambda: val.selector(F.array(X(), Y(), C("l_tax")), "middle_max"), "list_sort([l_quantity, l_discount, l_tax])[2]")
value("selector_min", lambda: val.selector(F.array(X(), Y()), "min"), "least(l_quantity, l_discount)")
value("saturation", lambda: val.saturation(X(), 12.0, 2.0), "2.0 * l_quantity / (l_quantity + 12.0)")
value("log_feature", lambda: val.log_feature(X(), 3.0), "ln(l_quantity + 3.0)")
value("sigmoid", lambda: val.sigmoid(X(), 12.0, 0.6), "pow(l_quantity, 0.6) / (pow(l_quantity, 0.6) + pow(12.0, 0.6))")
value("distance_feature", lambda: val.distance_feature(X(), 20.0, 5.0), "5.0 / (5.0 + abs(l_quantity - 20.0))")
register("value_scale", lambda s, d: val.scaled(table(s, d, "lineitem"), X(), 0.0, 10.0, "v").select(*KEYS(), F.round("v", 6).alias("v")), "SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) * (10.0::DOUBLE / ((SELECT max(l_quantity) FROM lineitem) - (SELECT min(l_quantity) FROM lineitem))), 6) AS v FROM lineitem")
select("value_enum", "lineitem", lambda: [*KEYS(), val.enum(C("l_linenumber"), {1: "one", 2: "two"}).alias("v")], "l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS v")
select("function_range", "lineitem", KEYS, "l_orderkey, l_linenumber", lambda: rg.between(C("l_quantity") * C("l_discount"), 0.5, 1.0, True, False), "l_quantity * l_discount >= 0.5 AND l_quantity * l_discount < 1.0")


def counts(name: str, fn, sql: str) -> None:
    register(name, lambda s, d: fn(corpus(s, d)), sql)


_P = f"WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), p AS (SELECT doc_id, unnest(toks) AS term FROM d)"
counts("term_statistics", lambda c: c.term_stats("text"), f"{_P} SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df, count(*) AS ttf FROM p GROUP BY term")
counts("collection_statistics", lambda c: c.collection_stats("text"), f"{_P} SELECT 'text' AS field, (SELECT count(*) FROM d) AS max_doc, count(DISTINCT doc_id) AS doc_count, count(*) AS sum_ttf, count(DISTINCT (doc_id, term)) AS sum_df FROM p")
counts("postings", lambda c: c.postings("text").where("term = 'that'"), f"WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), p AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS term FROM d) SELECT 'text' AS field, term, doc_id, pos FROM p WHERE term = 'that'")
counts("count_query", lambda c: c.count(q.Bool(should=(q.Term("text", "that"), q.Term("text", "que")))), f"WITH d AS (SELECT {TOKENS} AS toks FROM documents) SELECT count(*) AS n FROM d WHERE list_contains(toks, 'that') OR list_contains(toks, 'que')")
counts("term_freq", lambda c: c.project(lambda c: [F.col("doc_id"), c.tf("text", "that").alias("tf"), F.round(F.sqrt(c.tf("text", "that")), 6).alias("root"), c.length("text").alias("length")]), f"WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), e AS (SELECT doc_id, len(list_filter(toks, lambda x: x = 'that'))::DOUBLE AS tf, len(toks)::DOUBLE AS length FROM d) SELECT doc_id, tf, round(sqrt(tf), 6) AS root, length FROM e")
counts("norm_coded_length", lambda c: c.project(lambda c: [F.col("doc_id"), sim.coded_length(c.length("text").cast("int")).cast("long").alias("coded")]), f"WITH d AS (SELECT doc_id, len({TOKENS}) - 24 AS x FROM documents), e AS (SELECT doc_id, x, greatest(length(bin(greatest(x, 1))) - 4, 0) AS sh FROM d) SELECT doc_id, CASE WHEN x < 16 THEN x + 24 ELSE ((x >> sh) << sh) + 24 END AS coded FROM e")

# ---- vectors
DIMENSION = 64
_V = [round(0.1 * ((7 * i) % 11) - 0.5, 1) for i in range(64)]


def vectors(name: str, run, sql) -> None:
    def go(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings")
        return run(df, [_V[i % 64] for i in range(DIMENSION)])

    register(name, go, sql)


_Q = f"(SELECT list_transform(range(len(embedding)), lambda i: [{', '.join(map(str, _V))}][i % 64 + 1]::DOUBLE) FROM embeddings LIMIT 1)"
_DOT = "list_sum(list_transform(list_zip(embedding, qv), lambda z: z[1]::DOUBLE * z[2]))"
_SQ = "list_sum(list_transform(list_zip(embedding, qv), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
_NORMS = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qv, lambda x: x * x)))"
_KINDS = {"euclidean": f"1 / (1 + {_SQ})", "dot": f"greatest((1 + {_DOT}) / 2, 0)", "cosine": f"greatest((1 + {_DOT} / ({_NORMS})) / 2, 0)", "max_inner_product": f"CASE WHEN {_DOT} < 0 THEN 1 / (1 - {_DOT}) ELSE {_DOT} + 1 END"}
for _kind, _sql in _KINDS.items():
    vectors(f"knn_{_kind}", lambda df, v, kind=_kind: vec.nearest(df, "vec_id", "embedding", v, 20, kind).withColumn("score", F.round("score", 6)), f"WITH e AS (SELECT vec_id, embedding, {_Q} AS qv FROM embeddings), f AS (SELECT vec_id, {_sql} AS score FROM e ORDER BY score DESC, vec_id LIMIT 20) SELECT vec_id, round(score, 6) AS score FROM f")
vectors("knn_filtered", lambda df, v: vec.nearest(df, "vec_id", "embedding", v, 20, "euclidean", C("label") == 1).withColumn("score", F.round("score", 6)), f"WITH e AS (SELECT vec_id, embedding, {_Q} AS qv FROM embeddings WHERE label = 1), f AS (SELECT vec_id, {_KINDS['euclidean']} AS score FROM e ORDER BY score DESC, vec_id LIMIT 20) SELECT vec_id, round(score, 6) AS score FROM f")
vectors("vector_threshold", lambda df, v: vec.at_least(df, "vec_id", "embedding", v, 0.5, "cosine").withColumn("score", F.round("score", 6)), f"WITH e AS (SELECT vec_id, embedding, {_Q} AS qv FROM embeddings), f AS (SELECT vec_id, {_KINDS['cosine']} AS score FROM e) SELECT vec_id, round(score, 6) AS score FROM f WHERE score >= 0.5")
vectors("max_sim", lambda df, v: df.select("vec_id", F.round(vec.max_sim(F.array(vec.literal(v), F.reverse(vec.literal(v))), F.array(C("embedding"), F.reverse("embedding"))), 6).alias("score")), f"WITH e AS (SELECT vec_id, embedding, {_Q} AS qv FROM embeddings), f AS (SELECT vec_id, {_DOT} AS a, {_DOT.replace('embedding', 'list_reverse(embedding)')} AS b FROM e) SELECT vec_id, round(2 * greatest(greatest((1 + a) / 2, 0), greatest((1 + b) / 2, 0)), 6) AS score FROM f")

# ---- sorting, paging, fusion
register("sort_multi_key", lambda s, d: col_.top(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 50, col_.SortKey(C("o_orderpriority")), col_.SortKey(C("o_totalprice"), True)), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
register("sort_missing", lambda s, d: col_.top(table(s, d, "orders").select("o_orderkey", F.when(C("o_orderkey") % 3 != 0, C("o_totalprice")).alias("v")), "o_orderkey", 400, col_.SortKey(C("v"), False, True)), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v FROM orders ORDER BY v NULLS FIRST, o_orderkey LIMIT 400")
register("search_after", lambda s, d: col_.top(col_.after(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", ["3-MEDIUM", 100000.0, 0], col_.SortKey(C("o_orderpriority")), col_.SortKey(C("o_totalprice"), True)), "o_orderkey", 30, col_.SortKey(C("o_orderpriority")), col_.SortKey(C("o_totalprice"), True)), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority > '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND (o_totalprice < 100000.0 OR (o_totalprice = 100000.0 AND o_orderkey > 0))) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")


def top_sql(t: str, k: int) -> str:
    return search_sql([t], "tf0 > 0", bm(0)).replace("round(", "(").replace(", 6) AS score", ") AS score") + f" ORDER BY score DESC, doc_id LIMIT {k}"


_A, _B = q.Term("text", "that"), q.Term("text", "with")
register("top_k", lambda s, d: corpus(s, d).top(_A, 20).withColumn("score", F.round("score", 6)), f"WITH a AS ({top_sql('that', 20)}) SELECT doc_id, round(score, 6) AS score FROM a")
register("rank_fusion", lambda s, d: (lambda c: col_.rank_fusion([c.top(_A, 50), c.top(_B, 50)], "doc_id").withColumn("score", F.round("score", 6)))(corpus(s, d)), f"WITH a AS ({top_sql('that', 50)}), b AS ({top_sql('with', 50)}), r AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM a UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM b) SELECT doc_id, round(sum(p), 6) AS score FROM r GROUP BY doc_id")
register("query_rescorer", lambda s, d: (lambda c: col_.rescored(c.search(_A), c.search(_B), "doc_id", 50, 0.5).withColumn("score", F.round("score", 6)))(corpus(s, d)), f"WITH a AS ({top_sql('that', 50)}), b AS ({search_sql(['with'], 'tf0 > 0', bm(0)).replace('round(', '(').replace(', 6) AS score', ') AS score')}) SELECT a.doc_id, round(a.score + 0.5::DOUBLE * coalesce(b.score, 0), 6) AS score FROM a LEFT JOIN b USING (doc_id)")
register("merge_shards", lambda s, d: (lambda c: col_.merged([c.search(_A).where("doc_id % 2 = 0"), c.search(_A).where("doc_id % 2 = 1")], "doc_id", 20).select("doc_id", "shard", F.round("score", 6).alias("score")))(corpus(s, d)), f"WITH a AS ({top_sql('that', 1000000)}) SELECT doc_id, (doc_id % 2)::INT AS shard, round(score, 6) AS score FROM a ORDER BY a.score DESC, shard, doc_id LIMIT 20")

# ---- analysis


def analyzed(name: str, analyzer, sql: str) -> None:
    """The terms of every document, blank-joined."""
    register(f"analysis_{name}", lambda s, d: spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(analyzer.terms(C("text")), " ").alias("terms")), f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {TOKENS} AS toks FROM d) SELECT doc_id, array_to_string({sql}, ' ') AS terms FROM w")


def chain(*filters):
    return an.Analyzer(an.ascii_words, filters, (an.ascii_lower,))


_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
analyzed("simple_ascii", chain(), "toks")
analyzed("letter", an.Analyzer(an.letter), "regexp_extract_all(text, '\\p{L}+')")
analyzed("whitespace", an.Analyzer(an.whitespace), "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')")
analyzed("keyword", an.Analyzer(an.keyword), "[text]")
analyzed("stop", chain(an.stop(an.ENGLISH_STOP)), f"list_filter(toks, lambda x: x NOT IN {_IN(an.ENGLISH_STOP)})")
analyzed("keep_word", chain(an.keep_words(["that", "with", "que"])), "list_filter(toks, lambda x: x IN ('that', 'with', 'que'))")
analyzed("length", chain(an.length(4, 6)), "list_filter(toks, lambda x: length(x) BETWEEN 4 AND 6)")
analyzed("truncate", chain(an.truncate(4)), "list_transform(toks, lambda x: x[1:4])")
analyzed("uppercase", chain(an.uppercase), "list_transform(toks, lambda x: upper(x))")
analyzed("reverse", chain(an.reverse), "list_transform(toks, lambda x: reverse(x))")
analyzed("limit_count", chain(an.limit_count(12)), "toks[1:12]")
analyzed("pattern_replace", chain(an.replace_all("[aeiou]+", "_")), "list_transform(toks, lambda x: regexp_replace(x, '[aeiou]+', '_', 'g'))")
analyzed("shingle", chain(an.shingles(2, 2, False)), "list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])")
analyzed("keyword_repeat", chain(an.keyword_repeat), "flatten(list_transform(toks, lambda x: [x, x]))")
analyzed("fingerprint", chain(an.fingerprint), "[array_to_string(list_sort(list_distinct(toks)), ' ')]")
analyzed("edge_ngram", chain(an.edge_filter(2, 3)), "flatten(list_transform(toks, lambda x: list_transform(range(2, least(3, length(x)) + 1), lambda k: x[1:k])))")
analyzed("ngram", chain(an.grams_filter(3, 3)), "flatten(list_transform(toks, lambda x: list_transform(range(1, length(x) - 1), lambda k: x[k:k + 2])))")
analyzed("stem_override", chain(an.stem_override({"that": "this", "with": "by"})), "list_transform(toks, lambda x: CASE x WHEN 'that' THEN 'this' WHEN 'with' THEN 'by' ELSE x END)")
analyzed("synonym", chain(an.synonyms({"that": ["this", "those"]})), "flatten(list_transform(toks, lambda x: CASE WHEN x = 'that' THEN [x, 'this', 'those'] ELSE [x] END))")
analyzed("common_grams", chain(an.common_grams(["of"])), "flatten(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN i < len(toks) AND (toks[i] = 'of' OR toks[i + 1] = 'of') THEN [toks[i], toks[i] || '_' || toks[i + 1]] ELSE [toks[i]] END))")
analyzed("capitalization", chain(an.capitalization()), "list_transform(toks, lambda x: upper(x[1:1]) || x[2:])")
analyzed("english_minimal_stem", chain(an.STEM["english_minimal"]), "list_transform(toks, lambda x: CASE WHEN length(x) < 3 OR NOT ends_with(x, 's') OR x[-2] IN ('u', 's') THEN x WHEN x[-2] = 'e' AND x[-3] = 'i' AND length(x) > 3 AND x[-4] NOT IN ('a', 'e') THEN x[:-4] || 'y' WHEN x[-2] = 'e' AND x[-3] IN ('i', 'a', 'o', 'e') THEN x ELSE x[:-2] END)")
analyzed("german_minimal_stem", chain(an.STEM["german_minimal"]), "list_transform(toks, lambda x: CASE WHEN length(x) > 6 AND x[-3:] = 'nen' THEN x[:-4] WHEN length(x) > 5 AND x[-2:] IN ('en', 'se', 'es', 'er') THEN x[:-3] WHEN length(x) > 4 AND x[-1] IN ('n', 'e', 's', 'r') THEN x[:-2] ELSE x END)")
analyzed("spanish_minimal_stem", chain(an.STEM["spanish_minimal"]), "list_transform(toks, lambda x: CASE WHEN length(x) < 4 OR x[-1] <> 's' THEN x WHEN x[-3:] = 'ces' THEN x[:-4] || 'z' WHEN x[-2] = 'e' THEN x[:-3] ELSE x[:-2] END)")
analyzed("italian_light_stem", chain(an.STEM["italian_light"]), "list_transform(toks, lambda x: CASE WHEN length(x) < 6 OR x[-1] NOT IN ('a', 'e', 'i', 'o') THEN x WHEN x[-2] = 'i' OR (x[-2] = 'h' AND x[-1] IN ('e', 'i')) THEN x[:-3] ELSE x[:-2] END)")
analyzed("norwegian_minimal_stem", chain(an.STEM["norwegian_minimal"]), "list_transform(list_transform(toks, lambda x: CASE WHEN length(x) > 4 AND x[-1] = 's' THEN x[:-2] ELSE x END), lambda x: CASE WHEN length(x) > 5 AND x[-3:] = 'ene' THEN x[:-4] WHEN length(x) > 4 AND x[-2:] IN ('er', 'en', 'et') THEN x[:-3] WHEN length(x) > 3 AND x[-1] IN ('a', 'e') THEN x[:-2] ELSE x END)")
analyzed("swedish_minimal_stem", chain(an.STEM["swedish_minimal"]), "list_transform(list_transform(toks, lambda x: CASE WHEN length(x) > 4 AND x[-1] = 's' THEN x[:-2] ELSE x END), lambda x: CASE WHEN length(x) > 6 AND x[-4:] IN ('arne', 'erna', 'arna', 'orna', 'aren') THEN x[:-5] WHEN length(x) > 5 AND x[-3:] = 'are' THEN x[:-4] WHEN length(x) > 4 AND x[-2:] IN ('ar', 'at', 'er', 'et', 'or', 'en') THEN x[:-3] WHEN length(x) > 3 AND x[-1] IN ('a', 'e', 'n') THEN x[:-2] ELSE x END)")
register("html_strip", lambda s, d: table(s, d, "pages").select("page_id", F.size(an.ANALYZERS["html"](C("html"))).alias("n_tokens")))
register("more_like_this", lambda s, d: (lambda c: c.search(q.more_like_this(c, "text", "the thing that was with the rest of the nation", 5)).withColumn("score", F.round("score", 6)))(corpus(s, d)))
register("fuzzy", lambda s, d: corpus(s, d).search(q.fuzzy("text", "thatn", 1)).withColumn("score", F.round("score", 6)))
register("common_terms", lambda s, d: corpus(s, d).search(q.CommonTerms("text", ("that", "rely", "of"), 0.2)).withColumn("score", F.round("score", 6)))
register("sloppy_phrase", lambda s, d: corpus(s, d).search(q.phrase("text", "of", "to", slop=2)).withColumn("score", F.round("score", 6)))
register("log_odds_fusion", lambda s, d: corpus(s, d).search(q.LogOdds((q.Bayesian(_A, 1.0, 1.0), q.Bayesian(_B, 1.0, 1.0)))).withColumn("score", F.round("score", 6)))

# ---- parsers: the same rows as the trees that they stand for
for _name, _parse, _like in (
    ("classic_and", lambda: ps.ClassicParser().parse("that AND with"), "bool_must"),
    ("classic_or", lambda: ps.ClassicParser().parse("que und"), "bool_should"),
    ("classic_not", lambda: ps.ClassicParser().parse("+that -with"), "bool_must_not"),
    ("classic_phrase", lambda: ps.ClassicParser().parse('"of the"'), "phrase"),
    ("classic_range", lambda: ps.ClassicParser(numeric=("n_chars",)).parse("n_chars:[500 TO 1500]"), "numeric_range"),
    ("classic_wildcard", lambda: ps.ClassicParser().parse("th?t*on"), "wildcard"),
    ("classic_at_least", lambda: ps.ClassicParser().parse("(that with from)@2"), "bool_min_should_match"),
    ("simple", lambda: ps.SimpleParser({"text": 1.0}).parse("that + with"), "bool_must"),
    ("surround_and", lambda: ps.SurroundParser().parse("that AND with"), "bool_must"),
    ("surround_near", lambda: ps.SurroundParser().parse("of 4W to"), "span_near_ordered"),
    ("xml_bool", lambda: ps.XmlParser().parse('<BooleanQuery><Clause occurs="must"><TermQuery>that</TermQuery></Clause><Clause occurs="mustNot"><TermQuery>with</TermQuery></Clause></BooleanQuery>'), "bool_must_not"),
    ("xml_span_first", lambda: ps.XmlParser().parse('<SpanFirst end="10"><SpanTerm>of</SpanTerm></SpanFirst>'), "span_first"),
    ("interval_function", lambda: q.Positional("text", ps.parse_interval("fn:maxgaps(2 fn:ordered(of to))"), "interval"), "interval_max_gaps"),
    ("search_request", lambda: ps.SearchRequest((("must", "term", {"field": "lang", "value": "en"}), ("must", "range", {"field": "n_chars", "low": 500, "high": 1500}))).query(), "numeric_range"),
):
    register(f"parser_{_name}", lambda s, d, p=_parse: corpus(s, d).search(p()).withColumn("score", F.round("score", 6)), ORACLES[_like])
ORACLES["parser_search_request"] = "SELECT doc_id, 2.0::DOUBLE AS score FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 1500"
__all__ = ["ORACLES", "QUERIES"]
