from pyspark.sql import functions as F

from textloom.operators import articles as A
from textloom.plans.articles import j29_audit_report

TEXT = "# The license guide\nThis License is short. It holds.\n## License terms\nA license is given. Software Foundation gave it.\n## Other license\n**bold** TODO later."


def rows(spark, *texts):
    return A.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def test_salience_of_headings_and_place(spark):
    got = A.with_salience(rows(spark, TEXT, None), "license", ["license"]).orderBy("doc_id").collect()
    assert (got[0].first_char, got[0].first_word, got[0].h1_status, got[0].h2_status, got[0].salience_points) == (6, 2, "pass", "pass", 5)
    assert (got[1].first_char, got[1].position_status, got[1].salience_points) == (-1, "fail", 0)


def test_triples_need_one_paragraph(spark):
    frame = rows(spark, "cats chase mice", "cats run\nwe chase\nmice hide", "cats only", "cats eat mice")
    got = A.with_triples(frame, [("cats", "chase", "mice")]).orderBy("doc_id").collect()
    assert [(r.triples_pass, r.triples_warn, r.triples_fail) for r in got] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]


def test_facts_without_thousand_marks(spark):
    got = A.with_facts(rows(spark, "pays 1.000 euro", "1000"), ["1 000"]).orderBy("doc_id").collect()
    assert [r.facts_pass for r in got] == [True, True]


def test_rewrites_keep_length_and_headings(spark):
    frame = spark.createDataFrame([("a b c d", "a b c"), ("a b c d", "a b"), ("## a b c", "a b c d"), (None, None)], "x string, y string")
    assert [r[0] for r in frame.select(A.accept_rewrite(F.col("x"), F.col("y"))).collect()] == [True, False, False, True]


def test_remarks_go_with_their_sentence(spark):
    frame = rows(spark, "One. TODO fix this. Two.\nIn summary  three.")
    got = frame.select(A.clean_generated(F.col("body"), ["in summary"], [], ["TODO"])).first()[0]
    assert got == "One. Two.\n three."


def test_heading_echo_and_paragraphs(spark):
    frame = rows(spark, "# t\nsome intro. now license terms apply.\n## License terms\nbody", TEXT)
    got = {(r.doc_id, r.issue) for r in A.structure_issues(frame, "license", ["some"]).collect()}
    assert (0, "heading_repeated") in got and (1, "heading_repeated") not in got
    places = {r.fragment: (r["mode"], r.pos) for r in A.locate_paragraph(frame.filter("doc_id = 1"), ["License terms", "SOFTWARE", "absent"]).collect()}
    assert places == {"License terms": ("exact", 2), "SOFTWARE": ("any case", 3)}


def test_brands_inside_sentences(spark):
    got = A.brand_candidates(rows(spark, TEXT), ["license"]).collect()
    assert [tuple(r) for r in got if r.brand == "Foundation"] == [(0, "Foundation", 1)]


def test_density_counts_sections_between_headings(spark):
    text = "car car\n# Car one\ncar car car\n## two\ncar"
    assert [tuple(r) for r in A.keyword_density(rows(spark, text, None), "car").collect()] == [(0, 1, 4)]


def test_half_of_the_words_by_their_stems(spark):
    frame = spark.createDataFrame([("the software foundation",), ("soft words",), ("an apache",), ("of it",)], "t string")
    holds = lambda p: [r[0] for r in frame.select(A.fuzzy_share(F.col("t"), p)).collect()]
    assert holds("Software licenses") == [True, True, False, False]
    assert holds("apache software license terms") == [False, False, False, False] and holds("apache software found") == [True, False, False, False]
    assert holds("of it") == [False, False, False, True]
    found = A.fuzzy_hits(rows(spark, "first apache line\nsecond\nthe apache", "none"), ["apache license", "zebra"]).collect()
    assert [(r.doc_id, r.phrase, r.whole, r.paragraphs) for r in found] == [(0, "apache license", True, 2)]


def test_findings_have_a_row_for_each_triple_link_and_form(spark):
    frame = rows(spark, "Cats chase mice.\nRain falls because clouds burst. It floods.", "cats run\nmice chase", "Rain. Floods", "cats eat mice")
    triples = {(r.doc_id, r.subject): (r.found, r.clear, r.status) for r in A.triple_findings(frame, [("cats", "chase", "mice"), ("zebra", "is", "here")]).collect()}
    assert triples == {(0, "cats"): (True, True, "pass"), (1, "cats"): (True, False, "warn"), (2, "cats"): (False, False, "fail"), (3, "cats"): (True, True, "pass"), **{(k, "zebra"): (False, False, "fail") for k in range(4)}}
    links = {r.doc_id: (r.covered, r.explained, r.status) for r in A.causal_findings(frame, [("rain", "floods")], ["because"]).collect()}
    assert links == {0: (True, True, "pass"), 1: (False, False, "fail"), 2: (True, False, "warn"), 3: (False, False, "fail")}
    forms = A.naming_findings(rows(spark, "License licenses LICENSE licensed anana ananana", "nothing"), "license", ["license", "anana", "absent"]).collect()
    assert {(r.form, r.n, r.known) for r in forms} == {("anana", 3, True), ("license", 4, True), ("licensed", 1, False), ("licenses", 1, False)}


def test_grams_against_which_a_reason_speaks_do_not_count(spark):
    frame = rows(spark, "one two two three")
    for c in ("named_pct", "nominal_pct", "facts_pct"):
        frame = frame.withColumn(c, F.lit(0.0))
    for c in ("salience_points", "triples_pass", "triples_warn", "causal_covered", "causal_explained", "pairs_found", "opening_points"):
        frame = frame.withColumn(c, F.lit(0))
    budgets = [("one", 1, 1), ("two", 1, 1), ("bad", 1, 2), ("three", 1, 2)]
    of = lambda reason: A.compliance_score(frame, {"grams": 1}, budgets, 1, 1, 1, reason).first().grams
    assert of(None) == 40.0
    assert of(lambda p: F.when(p == "bad", "x")) == round(200 / 3 - 10, 2)
    assert of(lambda p: F.when(p != "", "x")) == 0.0


def test_only_texts_with_a_remark_are_searched_for_its_context(spark):
    long = "a" * 1_000_000  # 31 places for each character before
    rows = spark.createDataFrame([(1, long), (2, "x\nsome TODO here\ny"), (3, None)], "doc_id long, text string")
    found = A.meta_comments(A.prepared(rows), ["todo", "worth noting"])
    assert [tuple(r) for r in found.collect()] == [(2, "some TODO here")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(") == 2


def test_the_report_is_one_pass_and_keeps_what_a_join_by_key_gives(spark):
    plan = j29_audit_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    rows = [(1, (5,), 50.0, 2), (2, (6,), 60.0, 0), (2, (7,), 70.0, 3), (None, (8,), 80.0, 1)]
    got = A.audit_report(spark.createDataFrame(rows, "doc_id long, article struct<n_words:long>, score double, n_gaps long")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 50.0, 2), (2, 6, 60.0, 3), (2, 6, 70.0, 3), (2, 7, 60.0, 3), (2, 7, 70.0, 3)]
