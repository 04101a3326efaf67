"""Hand-computed cases and properties of the engine."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions import analysis as an
from lexiquarry.functions import similarity as sim
from lexiquarry.functions import values as val
from lexiquarry.operators import collect, vectors
from lexiquarry.operators import positions as pos
from lexiquarry.operators import ranges as rg
from lexiquarry.plans import parsers as ps
from lexiquarry.plans import query as q
from lexiquarry.sources import files
from lexiquarry.sources.store import Searcher, Store
from lexiquarry.streaming.refresh import apply_changes, latest_by_key

TEXTS = ["red thing number one", "blue thing number two", "red red thing", "", None, "thing thing one red"]


@pytest.fixture(scope="module")
def corpus(spark):
    return q.Corpus(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_bm25_by_hand(corpus):
    got = {r["doc_id"]: r["score"] for r in corpus.search(q.Term("text", "red")).collect()}
    lengths, n, df = {0: 4, 2: 3, 5: 4}, 4, 3
    avg = (4 + 4 + 3 + 4) / 4
    for i, tf in ((0, 1), (2, 2), (5, 1)):
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        assert math.isclose(got[i], idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * lengths[i] / avg)))
    assert set(got) == set(lengths)


def test_conjunction_is_a_subset(corpus):
    a, b = q.Term("text", "red"), q.Term("text", "one")
    both = ids(corpus.search(q.Bool(must=(a, b))))
    assert both == [0, 5] and set(both) <= set(ids(corpus.search(a)))
    assert ids(corpus.search(q.Bool(must_not=(a,)))) == []


def test_rewrites(corpus):
    t = q.Term("text", "red")
    assert q.Boost(t, 1).rewritten(corpus) == t
    assert q.Boost(q.Boost(t, 2), 3).rewritten(corpus) == q.Boost(t, 6)
    assert q.DisMax((q.MatchNone(), t)).rewritten(corpus) == t
    assert q.Constant(q.Boost(t, 5)).rewritten(corpus) == q.Constant(t)


def test_fuzzy_counts_a_swap_once(corpus):
    assert q.edits("ab", "ba") == 1 and q.edits("ab", "ba", False) == 2
    assert ids(corpus.search(q.fuzzy("text", "rde", 1))) == [0, 2, 5]
    assert ids(corpus.search(q.fuzzy("text", "zzzzzz", 1))) == []


def test_phrases(corpus):
    assert ids(corpus.search(q.phrase("text", "thing", "number"))) == [0, 1]
    assert ids(corpus.search(q.phrase("text", "red", "number"))) == []
    assert ids(corpus.search(q.phrase("text", "red", "number", slop=1))) == [0]


def test_paging(corpus):
    first = corpus.top(q.Term("text", "thing"), 2).collect()
    rest = corpus.top(q.Term("text", "thing"), 10, (first[-1]["score"], first[-1]["doc_id"])).collect()
    every = corpus.top(q.Term("text", "thing"), 10).collect()
    assert first + rest == every


def test_stored_tokens_give_the_same(corpus, tmp_path):
    again = corpus.stored(str(tmp_path / "tokens"))
    assert sorted(corpus.search(q.Term("text", "red")).collect()) == sorted(again.search(q.Term("text", "red")).collect())


def test_intervals_are_minimal():
    at = {"a": [0, 4, 5], "b": [6], "c": [8]}
    assert pos.intervals(pos.node("ordered", pos.term("a"), pos.term("b")), at) == [(5, 6)]
    assert pos.intervals(pos.node("unordered", pos.term("b"), pos.term("a")), at) == [(5, 6)]
    assert pos.intervals(pos.node("at_least", pos.term("a"), pos.term("b"), pos.term("c"), args=(2,)), at) == [(5, 6), (6, 8)]
    assert pos.spans(pos.node("near", pos.term("c"), pos.term("b"), args=(1, False)), at) == [(6, 9)]
    assert pos.sloppy_freq([[1], [1]], 0) == 1.0


def test_repeated_sources_and_gaps():
    a, b, c = map(pos.term, "abc")
    assert pos.sloppy_freq([[0], [-1]], 2, [0, 1], [0, 0]) == 0  # one occurrence can't serve both places
    assert pos.sloppy_freq([[0, 5], [-1, 4]], 5, [0, 1], [0, 0]) == 1 / 5
    assert pos.intervals(pos.node("unordered", a, a), {"a": [0, 5]}) == [(0, 5)]
    phrase = pos.node("ordered", pos.node("phrase", a, b), c)
    assert pos.intervals(pos.node("max_gaps", phrase, args=(0,)), {"a": [0], "b": [1], "c": [2]}) == [(0, 2)]
    assert pos.intervals(pos.node("max_gaps", phrase, args=(1,)), {"a": [0], "b": [1], "c": [4]}) == []
    assert pos.collected(pos.node("near", a, b, args=(1, True)), {"a": [0, 9], "b": [2]}) == [((0, 3), [("a", 0), ("b", 2)])]


def test_index_gives_the_same_as_texts(corpus, tmp_path):
    stored = corpus.indexed(str(tmp_path / "index"))
    for query in (q.phrase("text", "thing", "number"), q.phrase("text", "red", "red"), q.prefix("text", "num"), q.Bool(must=(q.MatchAll(),), must_not=(q.Term("text", "red"),)), q.Positional("text", pos.node("near", pos.term("thing"), pos.term("one"), args=(2, True))), q.fuzzy("text", "rde", 1)):
        assert sorted(map(tuple, stored.search(query).collect())) == sorted(map(tuple, corpus.search(query).collect()))
    plan = stored.search(q.Term("text", "red"))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "PushedFilters" in plan
    assert [r["total"] for r in stored.top_with_total(q.Term("text", "red"), 1).collect()] == [3]


def test_scored_expansion_is_bounded(corpus):
    with pytest.raises(ValueError):
        corpus.search(q.prefix("text", "", scoring=True, limit=3))


def test_precedence():
    t = lambda x: q.Term("text", x)
    parse = ps.PrecedenceParser().parse
    assert parse("a OR b AND c") == q.Bool(should=(t("a"), q.Bool(must=(t("b"), t("c")))))
    assert parse("(a OR b) AND NOT c") == q.Bool(must=(q.Bool(should=(t("a"), t("b"))),), must_not=(t("c"),))
    assert parse('"a b" c') == q.Bool(should=(q.phrase("text", "a", "b"), t("c")))
    for bad in ("", "a AND", "(a", "a )", "OR a"):
        with pytest.raises(ps.ParseError):
            parse(bad)


def test_store_conflicts_pins_and_merges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), T.StructType.fromDDL("id long, v string"), "id", merge_after=3)
    store.create()
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, v string, gone boolean, t long")
    store.append(make((1, "a", None, 0)))
    reader = Searcher(store)
    token = reader.record()
    store.change(make((1, "b", False, 1), (1, None, True, 2), (2, None, True, 1), (2, "x", False, 2)), F.col("gone"), F.col("t"))
    assert sorted(map(tuple, store.read().collect())) == [(2, "x")]
    for k in range(4):
        store.append(make((10 + k, "n", None, 0)))
    assert len(store._steps(store.versions()[-1])) <= 4 and store.read().count() == 5
    reader.maybe_refresh()
    store.prune(1)
    assert [tuple(r) for r in reader.rows(token).collect()] == [(1, "a")]
    reader.prune(-1)
    assert token in store.prune(1)
    with pytest.raises(ValueError):
        store.upsert(make((5, "a", None, 0), (5, "b", None, 0)))


def test_analysis(spark):
    df = spark.createDataFrame([("L'été des Wölfe’s ÆON",), (None,)], "x string")
    made = lambda a: [r[0] for r in df.select(an.terms(a(F.col("x")))).collect()]
    assert made(an.Analyzer(an.standard, (an.elision(an.FRENCH_ARTICLES), an.lowercase, an.ascii_folding_filter))) == [["ete", "des", "wolfe’s", "aeon"], []]
    stop = an.Analyzer(an.whitespace, (an.stop(["b"]),))
    assert spark.createDataFrame([("a b c",)], "x string").select(stop(F.col("x"))).first()[0] == [("a", 0), ("c", 2)]
    assert spark.createDataFrame([("/a/b",)], "x string").select(an.terms(an.path_hierarchy("/")(F.col("x")))).first()[0] == ["/a", "/a/b"]
    one = spark.createDataFrame([("<p>A&amp;B<script>x()</script></p>",)], "x string").select(an.html_strip(F.col("x"))).first()[0]
    assert one.split() == ["A&B"]


def test_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(val.div(F.lit(1.0), F.lit(0.0))) == math.inf and math.isnan(one(val.div(F.lit(0.0), F.lit(0.0))))
    assert one(val.most(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.0
    assert one(val.compare(F.lit(None).cast("int") > 1)) is False
    assert one(sim.coded_length(F.lit(39))) == 39 and one(sim.coded_length(F.lit(1000))) == 984


def test_places_and_addresses(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(rg.ip_prefix(rg.ipv4_column(F.lit("10.1.2.3")), "10.1.0.0/16")) and not one(rg.ip_prefix(rg.ipv4_column(F.lit("10.2.2.3")), "10.1.0.0/16"))
    assert abs(one(rg.haversine(F.lit(0.0), F.lit(1.0), 0.0, 0.0)) - 111195) < 1
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert one(rg.in_polygon(F.lit(0.5), F.lit(0.5), square, [hole])) and not one(rg.in_polygon(F.lit(2.0), F.lit(2.0), square, [hole]))


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, v array<double>")
    assert [r["vec_id"] for r in vectors.nearest(df, "vec_id", "v", [1.0, 0.1], 5, "cosine").collect()] == [1, 2]
    assert [r["vec_id"] for r in vectors.at_least(df, "vec_id", "v", [1.0, 0.0], 0.9).collect()] == [1]


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "doc_id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "doc_id long, score double")
    assert [(r["doc_id"], round(r["score"], 9)) for r in collect.rank_fusion([a, b], "doc_id").collect()] == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_parsers(spark):
    c = ps.ClassicParser(numeric=("n",))
    T_ = lambda t: q.Term("text", t)
    assert c.parse("a AND b") == q.Bool(must=(T_("a"), T_("b")))
    assert c.parse("+a -b c^2") == q.Bool(must=(T_("a"),), should=(q.Boost(T_("c"), 2.0),), must_not=(T_("b"),))
    assert c.parse('"x y"~3') == q.phrase("text", "x", "y", slop=3)
    for bad in ("(a", "[1 2]", ":a"):
        with pytest.raises(ps.ParseError):
            c.parse(bad)
    for odd in ("(", ")a(", '"x', "-", "", "a | + b"):
        ps.SimpleParser({"text": 1.0}).parse(odd)
    assert ps.SurroundParser().parse("a 3n b").source.args == (2, False)
    assert ps.parse_interval('fn:extend("a b" 1 2)') == pos.node("extend", pos.node("phrase", pos.term("a"), pos.term("b")), args=(1, 2))


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), T.StructType.fromDDL("id long, v string"), "id")
    store.create()
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    store.append(make((1, "a"), (2, "b")))
    searcher = Searcher(store)
    store.upsert(make((2, "B"), (3, "c")))
    store.delete(make((1, None), (9, None)))
    now = lambda: sorted(map(tuple, store.read().collect()))
    assert now() == [(2, "B"), (3, "c")]
    assert searcher.rows().count() == 2 and searcher.maybe_refresh() and sorted(r["id"] for r in searcher.rows().collect()) == [2, 3]
    assert [tuple(r) for r in store.get(make((3, None), (7, None))).orderBy("id").collect()] == [(3, "c", True), (7, None, False)]
    store.check()
    source = str(tmp_path / "changes")
    spark.createDataFrame([(3, "C", False), (2, None, True), (4, "d", False)], "id long, v string, gone boolean").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, v string, gone boolean").parquet(source)
    apply_changes(stream, store, str(tmp_path / "ck"), "gone", once=True).awaitTermination()
    assert now() == [(3, "C"), (4, "d")]
    assert latest_by_key(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id long, t long, v string"), "id", "t").select("v").collect() == [("y",)]
    assert len(store.prune(2)) > 0 and len(store.versions()) == 2


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,mag,place\n1,2.5,"a ""b"", c"\n2,,"x\ny"\n')
    schema = T.StructType.fromDDL("id string, mag double, place string, depth double")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 2.5, 'a "b", c'), ("2", None, "x\ny")]
    (tmp_path / "b.csv").write_text("id,mag\n1,no\n")
    with pytest.raises(Exception, match="cannot read"):
        files.read_csv(spark, str(tmp_path / "b.csv"), schema).collect()


def test_models_are_finite(corpus):
    for s in (sim.classic(), sim.lm_dirichlet(), sim.dfr("ine", "b", "h3"), sim.ib(), sim.dfi(), sim.axiomatic("f1log"), sim.MultiSimilarity(sim.bm25(), sim.boolean())):
        c = q.Corpus(corpus.docs, similarity=s)
        assert all(r["score"] is not None and math.isfinite(r["score"]) for r in c.search(q.Term("text", "red")).collect())


def test_positions_of_many_terms(spark, tmp_path):
    """More than 128 terms under one test: 200 words that start alike, as an index and without one."""
    docs = spark.createDataFrame([(i, f"of wo{i:03} x wo{(i + 1) % 200:03} to") for i in range(200)] + [(900, "of to")], "doc_id long, text string")
    plain = q.Corpus(docs)
    for c in (plain, plain.indexed(str(tmp_path / "many"))):
        score = lambda source: {r["doc_id"]: round(r["score"], 9) for r in c.search(q.Positional("text", source, "interval")).collect()}  # noqa: E731, B023
        assert score(pos.multi(lambda t: t.startswith("wo"))) == {i: round(1 - 1 / 3, 9) for i in range(200)}
        assert score(pos.node("ordered", pos.term("of"), pos.multi(lambda t: t.rlike("^wo[0-9]")), pos.term("to"))) == {i: round(1 - 1 / (1 + 1 / 3), 9) for i in range(200)}
        assert score(ps.parse_interval("fn:or(nowhere fn:wildcard(nix*))")) == {}
        with pytest.raises(ValueError):
            c.search(q.Positional("text", ps.parse_interval("fn:wildcard(wo* 128)"), "interval"))


def test_many_scored_terms(spark, tmp_path):
    """A sum over postings equals the clauses, for any number of terms and with weights, and its plan stays small."""
    docs = spark.createDataFrame([(i, f"wo{i:04} wo{(i * 7) % 1500:04} wo{i % 5:04} y") for i in range(1500)], "doc_id long, text string")
    plain = q.Corpus(docs)
    stored = plain.indexed(str(tmp_path / "scored"))
    scores = lambda c, x: {r["doc_id"]: round(r["score"], 9) for r in c.search(x).collect()}
    got = scores(stored, q.prefix("text", "wo", scoring=True))
    assert len(got) == 1500 and got == scores(plain, q.prefix("text", "wo", scoring=True))
    few = [f"wo{i:04}" for i in range(20)]
    clauses = q.Bool(should=tuple(q.Boost(q.Term("text", t), 1 + i / 10) for i, t in enumerate(few)))
    weighted = q.MultiTerm("text", lambda t: t.isin(few), True, boosts=lambda t: 1 + few.index(t) / 10)
    assert isinstance(weighted.rewritten(stored), q.EachTerm) and scores(stored, weighted) == scores(stored, clauses)
    plan = stored.search(q.prefix("text", "wo", scoring=True))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000
    assert stored.matches(q.prefix("text", "wo", scoring=True)).count() == sum(r["ttf"] for r in stored.dictionary("text").where("term like 'wo%'").collect())


def test_positions_against_pairwise_tests():
    """The searches among sorted ranges give what comparing all pairs gives, and a long document takes no time with its square."""
    import random
    import time

    rnd = random.Random(5)
    a, b, c = map(pos.term, "abc")
    inside = lambda x, y: x[0] <= y[0] and y[1] <= x[1]
    meet = lambda x, y, n=0: x[0] - n <= y[1] and y[0] <= x[1] + n
    for _ in range(300):
        at = {k: sorted(rnd.sample(range(30), rnd.randrange(9))) for k in "abc"}
        pair, lone = pos.node("ordered", a, b), pos.node("or", c, pos.node("ordered", c, a))
        for x, y in ((pair, lone), (lone, pair), (pos.node("extend", a, args=(1, 3)), pair)):
            xs, ys = pos.intervals(x, at), pos.intervals(y, at)
            for op, test in (("containing", lambda p, q_: inside(p, q_)), ("contained_by", lambda p, q_: inside(q_, p)), ("overlapping", meet)):
                assert pos.intervals(pos.node(op, x, y), at) == [p for p in xs if any(test(p, q_) for q_ in ys)]
            assert pos.intervals(pos.node("not_within", x, y, args=(2,)), at) == [p for p in xs if not any(meet(p, q_, 2) for q_ in ys)]
        near, near2 = pos.node("near", a, b, args=(4, False)), pos.node("near", c, b, args=(9, True))
        xs, ys = pos.spans(near, at), pos.spans(near2, at)
        assert pos.spans(pos.node("containing", near, near2), at) == [p for p in xs if any(inside(p, q_) for q_ in ys)]
        assert pos.spans(pos.node("within", near, near2), at) == [q_ for q_ in ys if any(inside(p, q_) for p in xs)]
        assert pos.spans(pos.node("not", near, near2, args=(1, 2)), at) == [p for p in xs if not any(s < p[1] + 2 and e > p[0] - 1 for s, e in ys)]
        marks = sorted((p, k) for k in "abc" for p in at[k])
        best = [(p, min((r for r, k2 in marks if r >= p and k2 != k), default=None)) for p, k in marks]
        want = [(s, e) for s, e in best if e is not None and not any(s <= s2 and e2 is not None and e2 <= e and (s2, e2) != (s, e) for s2, e2 in best)]
        assert pos.intervals(pos.node("at_least", a, b, c, args=(2,)), at) == sorted(set(want))
    long = {k: list(range(i, 120_000, 3)) for i, k in enumerate("abc")}
    began = time.process_time()
    assert len(pos.intervals(pos.node("at_least", a, b, c, args=(2,)), long)) == 119_999
    assert len(pos.spans(pos.node("within", pos.node("near", a, b, args=(3, True)), c), long)) == 0
    assert len(pos.intervals(pos.node("within", a, b, args=(2,)), long)) == 40_000
    assert time.process_time() - began < 20


def test_postings_in_bounded_blocks(spark, tmp_path, monkeypatch):
    """Blocks of few tokens give the postings and lengths of all texts; positions may repeat and go back."""
    import pyarrow as pa

    from lexiquarry.plans import corpus as cp

    texts = ["a b a", "", None, "b " * 30, "c a b", "a"]
    token = pa.struct([("term", pa.string()), ("pos", pa.int32())])
    toks = [[{"term": w, "pos": i} for i, w in enumerate((t or "").split())] for t in texts] + [[{"term": "z", "pos": 5}, {"term": "y", "pos": 1}, {"term": "z", "pos": 1}], None]
    batch = pa.record_batch([pa.array([f"k{i}" for i in range(8)]), pa.array(toks, pa.list_(token))], names=["k", "t"])
    monkeypatch.setattr(cp, "BLOCK_TOKENS", 4)
    parts = list(cp.sliced(batch, 1))
    assert [len(p) for p in parts] == [3, 1, 2, 2] and all(len(p) == 1 or len(p.column(1).flatten()) <= 4 for p in parts)
    rows, lengths = [], {}
    for p in parts:
        made = cp.blocks(p, ["t"])
        for term, df, ttf, keys, tfs, places, lens in zip(*[c.to_pylist() for c in made["t"]]):
            assert df == len(keys) and ttf == sum(tfs)
            rows += [(term, k, tf, tuple(at), n) for k, tf, at, n in zip(keys, tfs, places, lens)]
        lengths |= dict(zip(made[cp.LENGTHS][3].to_pylist()[0], made[cp.LENGTHS][6].to_pylist()[0]))
    want = {}
    for i, ts in enumerate(toks):
        for t in ts or []:
            want.setdefault((t["term"], f"k{i}"), []).append(t["pos"])
    assert lengths == {f"k{i}": len({t["pos"] for t in ts or []}) for i, ts in enumerate(toks)}
    assert sorted(rows) == sorted((t, k, len(at), tuple(sorted(at)), lengths[k]) for (t, k), at in want.items())
    docs = spark.createDataFrame(list(enumerate(texts)), "_df long, text string").withColumnRenamed("_df", "n")
    c = q.Corpus(docs, "n").indexed(str(tmp_path / "blocks"))
    assert sorted(map(tuple, c.lengths().collect())) == [(0, 3), (1, 0), (2, 0), (3, 30), (4, 3), (5, 1)]
    assert sorted((r["term"], r["n"], r["tf"], r["pos"]) for r in c.posted("text", ["a", "c"]).collect()) == [("a", 0, 2, [0, 2]), ("a", 4, 1, [1]), ("a", 5, 1, [0]), ("c", 4, 1, [0])]


def test_inputs_are_dealt_if_tasks_are_few(spark, tmp_path, monkeypatch):
    """An input read in too few tasks for the cores is dealt; one that gives enough of them isn't shuffled."""
    from lexiquarry.sources import shared

    spark.range(2000).write.parquet(str(tmp_path / "t"))
    df, name = spark.read.parquet(str(tmp_path / "t")), "spark.sql.files.maxPartitionBytes"
    plan = lambda: shared.spread(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan()
    monkeypatch.setattr(shared, "SMALL_INPUT", 0)
    assert "Repartition 8" in plan()
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1k")
        assert "Repartition" not in plan()
    finally:
        spark.conf.set(name, before)
