"""Stemmers against word pairs (well-known examples, or worked out from the rules), and token filters on small inputs."""

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import analysis as an
from lexiquarry.functions import stemming as st
from lexiquarry.functions import token_filters as tf

WORDS = {
    "porter": "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil is:is",
    "danish": "indtager:indtag indtages:indtag undersøgelse:undersøg huset:hus bilerne:bil venlighed:ven",
    "norwegian": "havnedistriktene:havnedistrikt havnedistrikter:havnedistrikt opning:opning havnene:havn",
    "swedish": "jaktkarlarne:jaktkarl jaktkarlens:jaktkarl klokt:klokt klostergården:klostergård friskt:frisk",
    "german": "aufeinanderfolgende:aufeinanderfolg kategorischen:kategor häuser:haus katers:kat aufgenommen:aufgenomm verständlichkeit:verstand kuß:kuss",
    "russian": "вагоны:вагон важнейшие:важн важности:важност пароходами:пароход падение:паден падаешь:пада волновался:волнова",
    "german_light": "häuser:haus kindern:kind schönsten:schon ärzte:arzt rad:rad bits:bit bahns:bahn",
    "spanish_light": "chicas:chic libros:libr leones:leon luces:luz franceses:frances mamá:mamá canción:cancion",
    "swedish_light": "jaktkarlarne:jaktkarl jaktkarlens:jaktkarl klockorna:klock hus:hus frihetens:fri",
    "hindi": "किताबें:किताब घर:घर",
    "arabic": "الحسن:حسن والحسن:حسن ساهدهات:ساهد ول:ول",
}


def go(spark, step, words):
    df = spark.createDataFrame([(words,)], "w array<string>")
    return [tuple(r) for r in df.select(step(an.tokens(F.col("w"))).alias("r")).first()["r"]]


@pytest.mark.parametrize("name", WORDS)
def test_stems(spark, name):
    pairs = [x.split(":") for x in WORDS[name].split()]
    assert go(spark, st.stem(st.STEMMERS[name]), [a for a, _ in pairs]) == [(b, i) for i, (_, b) in enumerate(pairs)]
    assert go(spark, st.stem(st.STEMMERS[name]), []) == []


def test_splitting_filters(spark):
    parts = [("Power", 0), ("Shot", 1), ("XMLHttp", 2), ("2", 3), ("go", 4), ("O", 6), ("Neil", 7), ("a", 8), ("BC", 9)]
    assert go(spark, tf.word_delimiter(), ["Power-Shot", "XMLHttp2go", "--", "O'Neil's", "aBC"]) == parts
    assert go(spark, tf.word_delimiter(split_on_case=False, split_on_numerics=False), ["aB2-c"]) == [("aB2", 0), ("c", 1)]
    assert go(spark, tf.word_delimiter_all, ["wi-fi", "--", "x_1"]) == [("wifi", 0), ("x1", 2)]
    assert go(spark, tf.cjk_bigrams(), ["abc東京都x", "京", "ひと"]) == [("abc", 0), ("東京", 1), ("京都", 2), ("x", 3), ("京", 4), ("ひと", 5)]
    assert go(spark, tf.cjk_bigrams(True), ["東京都", "a"]) == [("東", 0), ("東京", 0), ("京", 1), ("京都", 1), ("都", 2), ("a", 3)]
    assert go(spark, tf.compound_words(["schiff", "fahrt", "schifffahrt"], longest=True), ["dampfschifffahrt", "ab"]) == [("dampfschifffahrt", 0), ("schifffahrt", 0), ("fahrt", 0), ("ab", 1)]
    for step in (tf.word_delimiter(), tf.cjk_bigrams(), tf.hyphenated_words, tf.compound_words(["ab"]), tf.fixed_shingle(2)):
        assert go(spark, step, []) == []


def test_joining_and_typing_filters(spark):
    assert go(spark, tf.hyphenated_words, ["eco-", "nomic", "x", "a-"]) == [("economic", 0), ("x", 1), ("a-", 2)]
    assert go(spark, tf.date_recognizer(), ["2020-01-02", "x", "2020-13-02"]) == [("2020-01-02", 0)]
    assert go(spark, tf.fixed_shingle(2), ["a", "b", "c"]) == [("a b", 0), ("b c", 1)]
    assert go(spark, tf.delimited_boost(), ["a|2.5", "b", "c|x", "d|e|3", "|1"]) == [("a", 0, 2.5), ("b", 1, 1.0), ("c", 2, 1.0), ("d|e", 3, 3.0), ("", 4, 1.0)]
    assert go(spark, tf.delimited_frequency(), ["a|3", "b"]) == [("a", 0, 3), ("b", 1, 1)]
    assert go(spark, tf.delimited_payload("string"), ["a|q", "b"]) == [("a", 0, "q"), ("b", 1, None)]
    number = tf.typed([(r"\d+", "num")])
    assert go(spark, lambda t: tf.type_as_synonym("_t_")(number(t)), ["12", "ab"]) == [("12", 0), ("_t_num", 0), ("ab", 1)]
    assert go(spark, lambda t: tf.of_types(["num"], False)(number(t)), ["12", "ab"]) == [("ab", 1, "word")]


@pytest.mark.parametrize("name, pairs", [
    ("english_minimal", "shoes>shoes trees>trees movaies>movaies ponies>pony bus>bus glass>glass cats>cat ies>ies times>time s>s"),
    ("french_minimal", "chevaux>cheval chantées>chant barons>baron bijoux>bijou écoles>écol mots>mots nettes>net"),
    ("german_minimal", "häuser>haus katzen>katz bildern>bilder freundinnen>freundin haus>haus äste>äste hund>hund"),
    ("spanish_minimal", "luces>luz casas>casa árboles>arbol reses>res mes>mes niños>nino"),
    ("italian_light", "ragazzi>ragazz amiche>amic città>città oche>oche famiglia>famigl"),
    ("swedish_minimal", "flickorna>flick hundar>hund husets>hus bilarna>bil ett>ett"),
    ("bulgarian", "градове>град жените>жени училища>учил момичето>момич езици>езиц"),
    ("czech", "hradech>hrad ženami>žn otcova>otcov muž>muh"),
    ("telugu", "పుస్తకాలు>పుస్తకా"),
    ("norwegian_minimal", "husene>hus gutter>gutt bilens>bil jenta>jent"),
])
def test_minimal_stemmers(spark, name, pairs):
    pairs = [x.split(">") for x in pairs.split()]
    got = [t for t, _ in go(spark, an.STEM[name], [a for a, _ in pairs])]
    assert got == [b for _, b in pairs]


def test_terms_without_tokens(spark):
    """The plain form of a chain gives the terms of its tokens, makes no structs, and endings are compared as their patterns would match."""
    texts = ["Husene stoler Bilene' s's O'Neil's WiFi-2Go a1 b", "that with that", None, "", "-- ''", "x", "lakes ponies atech kočkami městech किताबें лошадей"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    chains = [an.Analyzer(t, f) for t in (an.whitespace, an.standard, an.ascii_words) for f in ((), (an.edge_filter(2, 3),), (an.edge_filter(1, 20),), (an.shingles(3, 3, False),), (an.shingles(2, 2, False, "_"), an.uppercase), (an.synonyms({"that": ["this", "those"]}),), (an.stop(["that"]), an.shingles(2, 2, False)), (tf.word_delimiter(),), (tf.word_delimiter(False, False),), (tf.word_delimiter(words=False),), (tf.cjk_bigrams(),), (an.STEM["norwegian_minimal"],), (an.STEM["czech"],), (an.STEM["hungarian_light"],), (an.stem(an.STEMMERS["hindi"]),), (an.stem(an.STEMMERS["porter"]),))]
    row = df.select(*[F.collect_list(F.to_json(F.struct((an.terms(a(F.col("x"))) if k else a.terms(F.col("x"))).alias("t")))).alias(f"c{i}_{k}") for i, a in enumerate(chains) for k in (0, 1)]).first()
    for i in range(len(chains)):
        assert row[f"c{i}_0"] == row[f"c{i}_1"]
    plan = df.select(an.Analyzer(an.ascii_words, (an.STEM["norwegian_minimal"], an.edge_filter(2, 3))).terms(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "RLIKE" not in plan
    assert an.alternatives("er|[ae]n|x") == ["er", "an", "en", "x"] and an.alternatives("(?<=z)es") is None and an.alternatives("[^a]") is None
