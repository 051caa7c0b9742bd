import random

from pyspark.sql import functions as F

from textloom.operators import sections

ARTICLE = "# Title\nIntro one.\n\nIntro two.\n## First\nBody a.\n\nBody b.\n### Sub\n## Second\n"


def test_parts_of_an_article(spark):
    frame = spark.createDataFrame([(1, ARTICLE), (2, "no headings\nat all"), (3, None), (4, "")], "doc_id int, text string")
    got = {}
    for r in sections.split_articles(frame).collect():
        got.setdefault(r.doc_id, []).append((r.part, r.pos, r.heading, r.body))
    assert [x for x in got[1] if x[0] != "paragraph"] == [("title", 0, "Title", ""), ("intro", 0, "", "\nIntro one.\n\nIntro two."), ("section", 0, "First", "\nBody a.\n\nBody b.\n### Sub"), ("section", 1, "Second", "\n")]
    assert [x[3] for x in got[1] if x[0] == "paragraph"][1:] == ["Intro two.\n## First\nBody a.", "Body b.\n### Sub\n## Second\n"]
    assert got[2] == [("paragraph", 0, "", "no headings\nat all")] and 3 not in got and 4 not in got


def test_sources_are_made_only_where_there_are_none(spark):
    signals = spark.createDataFrame([("a", "title", 0, "t" * 30), ("a", "snippet", 0, "s" * 30), ("a", "title", 1, "short"), ("b", "title", 0, "t" * 60), ("b", "other", 0, "x")], "topic_id string, kind string, pos int, text string")
    got = sections.synthesize_sources(signals, spark.createDataFrame([("b",)], "topic_id string")).collect()
    assert [(r.topic_id, r.pos, r.content) for r in got] == [("a", 0, "t" * 30 + ". " + "s" * 30)]


def test_heading_scores_pools_and_fallback(spark):
    rows = [("t", 1, 1, "Red cars", 6), ("t", 2, 1, "red cars", 0), ("t", 2, 2, "why buy", 0), ("t", 2, 9, "too late", 0), ("t", 3, 1, "Boats now", 0), ("t", 4, 1, "thin", 0), ("t", 1, 2, "many", 20)]
    schema = "topic_id string, pool int, k int, heading string, n long"
    lists = spark.createDataFrame([("t", ["red"], ["cars", "buy"], ["boats now"])], "topic_id string, grams array<string>, entities array<string>, related array<string>")
    scored = sections.score_headings(spark.createDataFrame(rows, schema), lists)
    assert [(r.heading, r.pool, r["score"], r["class"]) for r in scored.collect()] == [("Red cars", 1, 0.88, "must"), ("many", 1, 0.88, "must"), ("why buy?", 2, 0.6, "high"), ("Boats now", 3, 0.43, "high"), ("thin", 4, 0.25, "optional")]
    raw = sections.score_headings(spark.createDataFrame([("t", 1, 1, "raw", 1), ("u", 1, 1, "raw", 1)], schema), lists)
    assert sorted(r.topic_id for r in sections.raw_fallback(scored, raw).collect()) == ["t"] * 5 + ["u"]


def test_facts_go_to_their_first_section_only(spark):
    plan = spark.createDataFrame([("t", 1, "red cars"), ("t", 2, "fast cars")], "topic_id string, section int, heading string")
    items = spark.createDataFrame([("t", "fact", 0, "cars cost 5"), ("t", "pair", 0, "Cars + roads"), ("t", "fact", 1, "nothing"), ("t", "fact", 2, "fast one")], "topic_id string, kind string, k int, item string")
    got = sections.assign_to_sections(plan, items, {"fact": 6, "pair": 3}).collect()
    assert sorted((r.section, r.kind, r.item) for r in got) == [(1, "fact", "cars cost 5"), (1, "pair", "Cars + roads"), (2, "fact", "fast one"), (2, "pair", "Cars + roads")]


def test_short_sections_of_shared_headings_are_found_in_texts(spark):
    words = lambda n: " ".join(["word"] * n)
    texts = [
        ("t", "a", 1, f"intro text\n# How to CARE for boats!\n{words(30)}\n\n{words(20)}\nand more\n\nNext part\n{words(500)}"),
        ("t", "b", 2, f"{words(40)} how care boats line of over one hundred characters {words(20)}\nCare of boats how\n{words(60)}"),
        ("t", "c", 3, f"care boats for how\nshort\n\n{words(5)}"),
        ("t", "d", 4, "how care\n" + "\n".join([words(2)] * 80)),
        ("u", "a", 5, f"how to care for boats\n{words(40)}"),
    ]
    heads = [("t", s, h) for s, h in [("a", "How to care for boats"), ("b", "how to care for BOATS?"), ("c", "How to care for boats"), ("a", "rare one")]]
    texts, heads = spark.createDataFrame(texts, "topic_id string, src string, doc_id int, text string"), spark.createDataFrame(heads, "topic_id string, src string, heading string")
    norms = heads.select("topic_id", sections.heading_norm(heads["heading"]).alias("norm")).distinct()
    got = {(r.doc_id, r.norm): r.words for r in sections.find_sections(texts, norms).collect()}
    assert got == {(1, "how to care for boats"): 52, (3, "how to care for boats"): 1}
    norms = spark.createDataFrame([("t", "how care boats")], "topic_id string, norm string")
    got = {(r.doc_id, r.norm): r.words for r in sections.find_sections(texts, norms).collect()}
    assert got == {(1, "how care boats"): 52, (2, "how care boats"): 60, (3, "how care boats"): 1, (4, "how care boats"): 98}
    heads = heads.withColumn("heading", F.regexp_replace("heading", "(?i) to | for ", " "))
    row = sections.gap_depth(heads, texts).first()
    assert (row.sources, row.sections, row.mean_words, row.priority) == (3, 3, 70.0, "high")


def test_open_and_standard_questions(spark):
    rows = [("t", i, "what about wooden boats", "a long enough answer here" if i % 2 else None) for i in range(30)]
    got = sections.split_questions(spark.createDataFrame(rows, "topic_id string, id int, question string, answer string"), spark.createDataFrame([("t", 1)], "topic_id string, id int"), []).collect()
    kinds = {k: sorted(r.id for r in got if r.kind == k) for k in ("open", "standard")}
    assert kinds == {"open": [0, 1, 2, 4, 6, 8, 10, 12], "standard": [3, 5, 7, 9, 11, 13, 15, 17, 19, 21]}
    assert sum(r.faq for r in got) == 6


def test_a_fact_is_placed_by_its_snippet(spark):
    plan = spark.createDataFrame([("t", 1, "Costs of repair"), ("t", 2, "Fines and points")], "topic_id string, section int, heading string")
    items = spark.createDataFrame([("t", "fact", 0, "1500 zl", "The fines rise to 1500"), ("t", "fact", 0, "12", None), ("t", "causal", 0, "rust leads to repair", None)], "topic_id string, kind string, k int, item string, snippet string")
    got = sections.assign_to_sections(plan, items, {"fact": 6, "causal": 4}).collect()
    assert sorted((r.section, r.kind, r.item) for r in got) == [(1, "causal", "rust leads to repair"), (2, "fact", "1500 zl")]


def test_lines_stay_in_their_texts_and_meet_headings_alike_by_a_join(spark):
    rng, words = random.Random(4), ["the", "of", "care", "boat", "été", "ab", "part2", "wood", "long", "river", "\u00c9t\u00c9"]
    line = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    texts = [("t" if i % 3 else "u", "s", i, "\n".join(line(rng.choice([3, 8, 30])) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [("t", "s", None, "the boat"), ("t", None, 90, None), (None, "s", 91, "the boat")]
    heads = sorted({(t, " ".join(line(6).lower().split())) for t in "tuv" for _ in range(80)})
    texts, heads = spark.createDataFrame(texts, "topic_id string, src string, doc_id int, text string"), spark.createDataFrame(heads, "topic_id string, norm string")
    found = sections.find_sections(texts, heads)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(map(tuple, found.collect()))
    assert len(got) > 200 and got == sorted(map(tuple, sections.find_sections(texts, heads, whole_table=0).collect()))
