import math
import random

from pyspark.sql import functions as F

from textloom.operators import salience

TOPICS = "topic_id string, n_sources long, keyword string"


def test_typing_errors_after_the_first_cluster(spark):
    words = ["strzelec", "uchwtow", "plain words", "schrift", "abcdfgo", ""]
    rows = spark.createDataFrame([(w,) for w in words], "p string")
    assert [r[0] for r in rows.select(salience.looks_mistyped(F.col("p"))).collect()] == [False, True, False, False, True, False]


def test_concepts_are_shown_as_mostly_written(spark):
    rows = [("t", "a", "red cars")] * 2 + [("t", "b", "red cars"), ("t", "b", "cars red"), ("t", "a", "lone thing"), ("t", "a", "the of"), (None, "a", "red cars")]
    got = salience.topical_entities(spark.createDataFrame(rows, "topic_id string, src_idx string, phrase string"), spark.createDataFrame([("t", 4, "fast red boat")], TOPICS), ["the", "of"]).collect()
    assert [(r.key, r.display, r.variants, r.etype, r.freq, r.sources) for r in got] == [("cars red", "red cars", "cars red, red cars", "CONCEPT", 4, 2)]
    assert got[0].importance == round(0.35 * 2 / 4 + 0.06 * math.log(5) + 0.2 + 0.2 / 3, 6)


def test_salience_by_place_headings_and_keyword(spark):
    concepts = spark.createDataFrame([("t", "red cars", 2), ("t", "absent", 1)], "topic_id string, display string, sources long")
    sources = spark.createDataFrame([("t", "a", "Red cars first" + " pad" * 30), ("t", "a", "red cars"), ("t", "b", "x" * 2000 + " red cars"), ("t", "b", None)], "topic_id string, src_idx string, content string")
    heads = spark.createDataFrame([("t", 1, "Red Cars"), ("t", 2, "buy red cars"), ("u", 1, "red cars")], "topic_id string, level int, heading string")
    got = {r.display: r for r in salience.salience_topical(concepts, sources, heads, spark.createDataFrame([("t", 2, "red")], TOPICS)).collect()}
    place = round(((1 + 0) / 2 + 2001 / 2009) / 2, 6)
    assert (got["red cars"].position, got["red cars"].early, got["red cars"].in_h1, got["red cars"].in_h2) == (place, 1, 1, 1)
    assert abs(got["red cars"].salience - (0.25 + 0.2 * (1 - place) + 3 * 0.075 + 0.1)) < 1e-5
    assert got["absent"].position == 1.0 and got["absent"].salience == 0.125
    odd = spark.createDataFrame([("t", d, 2) for d in ("red cars", "ab", "menu home", "menu cars", "x .cars", "1.cars")], "topic_id string, display string, sources long")
    left = salience.salience_topical(odd, sources, heads, spark.createDataFrame([("t", 2, "red")], TOPICS), nav=["menu", "home"])
    assert {r.display for r in left.collect()} == {"red cars", "menu cars", "1.cars"}


def test_running_position_equals_a_plain_fold(spark):
    rng = random.Random(1)
    weights = [("t", "a", 1), ("t", "b", 3), ("t", "c", 50), ("t", "d", 0), ("u", "a", 7)]
    places, want = [], {}
    for topic, display, n in weights:
        mean = 1.0
        for k in sorted(rng.sample(range(1000), 40)):
            first = rng.random()
            places.append((topic, display, f"s{k:04}", first, k % 2))
            w = max(n - 1, 0)
            mean = (mean * w + first) / (w + 1)
        want[topic, display] = mean
    rng.shuffle(places)
    frame = spark.createDataFrame(places, "topic_id string, display string, src_idx string, first double, early long")
    got = {(r.topic_id, r.display): r.position for r in salience.running_position(frame.repartition(5), spark.createDataFrame(weights, "topic_id string, display string, sources long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_subjects_stand_in_the_first_words(spark):
    sents = spark.createDataFrame([("t", "a", 0, 2, "Cars are fast machines on roads"), ("t", "a", 1, 2, "we all know that the fast cars win")], "topic_id string, src_idx string, pos int, n int, sentence string")
    got = {(r.phrase, r.pos): (r.place, r.subject) for r in salience.roles_in_sentences(sents, ["cars", "win"]).collect()}
    assert got == {("cars", 0): (0.0, True), ("cars", 1): (0.5, False), ("win", 1): (0.5, False)}


def test_main_entity_gives_way_to_the_keyword(spark):
    rows = lambda *p: spark.createDataFrame(list(p), "topic_id string, phrase string, rank int")
    topics = spark.createDataFrame([("a", 1, "boat"), ("b", 1, "red boat"), ("c", 1, "boat"), ("d", 1, "boat")], TOPICS)
    heads = spark.createDataFrame([("a", "All about cars"), ("b", "boat")], "topic_id string, heading string")
    bad = F.when(F.col("phrase") == "bad", "reason")
    got = {r.topic_id: (r.entity, r.origin) for r in salience.main_entity(rows(("a", "bad", 1), ("b", "boat", 1), ("c", "cars", 1)), rows(("a", "cars", 1)), heads, topics, bad).collect()}
    assert got == {"a": ("cars", "phrase"), "b": ("red boat", "keyword holds it"), "c": ("boat", "in no heading"), "d": ("boat", "keyword only")}


def test_relations_need_an_entity_or_a_frequent_word(spark):
    docs = spark.createDataFrame([("t", "engine oil is thick stuff here. engine engine"), ("t", "rare one is odd two"), ("t", None)], "topic_id string, text string")
    got = salience.extract_relations(docs, [("is", r"(\w+ \w+) is (\w+ \w+)")], ["odd tw"], frequent=1).collect()
    assert [(r.relation, r.subject, r.object, r.n) for r in got] == [("is", "engine oil", "thick stuff", 1), ("is", "rare one", "odd two", 1)]


def test_early_entities_and_brands(spark):
    rows = spark.createDataFrame([("t", "a", 0.1, 0, 0.5, 0.9, 1), ("t", "b", 0.5, 3, 0.0, 0.8, 2), ("t", "c", 0.5, 2, 0.0, 0.7, 3)], "topic_id string, phrase string, position double, early long, subject_ratio double, salience double, rank int")
    assert [(r.phrase, r.subject_pct) for r in salience.early_entities(rows).collect()] == [("a", 50), ("b", 70)]
    queries = spark.createDataFrame([("t", "Acme shoes"), ("t", "acme"), ("u", None)], "topic_id string, text string")
    assert [tuple(r) for r in salience.match_brands(queries, ["ACME", "other"]).collect()] == [("t", "acme")]


def test_texts_are_not_shuffled_by_few_topics(spark):
    concepts = spark.createDataFrame([("t", "red fox", 2), ("t", "menu", 1)], "topic_id string, display string, sources int")
    sources = spark.createDataFrame([("t", "a", "a red fox " + "x" * 100), ("t", "b", "y" * 100 + " red fox")], "topic_id string, src_idx string, content string")
    heads = spark.createDataFrame([("t", 1, "The red fox")], "topic_id string, level int, heading string")
    topics = spark.createDataFrame([("t", 2, "red")], TOPICS)
    small = salience.salience_topical(concepts, sources, heads, topics, small=True)
    assert sorted(small.collect()) == sorted(salience.salience_topical(concepts, sources, heads, topics).collect())
    assert small._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2  # texts and headings
