import random
from collections import Counter

from pyspark.sql import functions as F

from textloom.functions.lists import STOP
from textloom.operators import terms
from textloom.plans.terms import by_ending, d11_gram_quality


def test_first_reason_wins(spark):
    phrases = ["ab", "big big", "red fox red", "5 kg sack", "font size", "add to cart now", "fooBar test", "menu", "the of", "solid oak"]
    rows = spark.createDataFrame([(p,) for p in phrases], "g string")
    reason = terms.quality_reason(F.col("g"), ["the", "of"], ["font"], ["add to cart"], ["menu"])
    want = ["too_short", "repeated_word", "repeated_content_word", "unit", "css_prefix", "shop", "camel_case", "navigation", "stop_words", None]
    assert [r[0] for r in rows.select(reason).collect()] == want


def test_garbage_levels(spark):
    phrases = ["menu", "a{b}", "top menu bar", "12:30", "fooBarBaz", "arial, sans-serif", "deadbeef", "cut off...", "one one", "clean phrase"]
    rows = spark.createDataFrame([(p,) for p in phrases], "g string")
    assert [r[0] for r in rows.select(terms.web_garbage_level(F.col("g"), ["menu"], [])).collect()] == [1, 2, 4, 3, 6, 3, 9, 3, 11, None]


def plain_runs(words, lexicon):
    """Maximal runs of listed kinds, read from left to right."""
    out, run = [], []
    for w in [*words, None]:
        tag = lexicon.get(w)
        if tag and tag[1] in ("ADJ", "NOUN", "PROPN") and not tag[2]:
            run.append(w)
            continue
        if 2 <= len(run) <= 5 and lexicon[run[-1]][1] != "ADJ":
            out.append((" ".join(run), " ".join(lexicon[x][0] for x in run)))
        run = []
    return out


def test_noun_phrases_follow_the_lexicon(spark):
    rng = random.Random(4)
    lexicon = {"red": ("red", "ADJ", False), "cars": ("car", "NOUN", False), "Bob": ("bob", "PROPN", False), "such": ("such", "ADJ", True), "run": ("run", "VERB", False), "old": ("old", "ADJ", False)}
    texts = [("t", "a", i, rng.choices([*lexicon, "unlisted"], k=rng.randrange(30))) for i in range(80)] + [("t", None, 900, ["red", "cars"]), ("t", "a", 901, None)]
    listed = spark.createDataFrame([(w, *x) for w, x in lexicon.items()] + [("red", "rot", "ADJ", False)][:0], "surface string, lemma string, pos string, is_stop boolean")
    toks = spark.createDataFrame(texts, "topic_id string, src_idx string, doc_id int, words array<string>")
    got = {(r.phrase, r.key): r.n for r in terms.noun_phrases(toks, listed).collect()}
    assert got == dict(Counter(run for *_, words in texts for run in plain_runs(words or [], lexicon)))
    assert {r.pos for r in terms.lexicon_runs(toks, listed).filter("doc_id = 900").collect()} == {0}


def test_noun_phrases_of_a_rule_join_nothing(spark):
    rng = random.Random(6)
    known = {"nation": ("nation", "NOUN", False), "licensed": ("license", "ADJ", False), "moving": ("moving", "ADJ", False), "den": ("den", "ADJ", "den" in STOP), "payment": ("payment", "NOUN", False)}
    texts = [("t", "a", i, rng.choices([*known, "tree", "é"], k=rng.randrange(30))) for i in range(120)] + [("t", None, 900, ["moving", "nation"]), ("t", "a", 901, None), ("t", "a", 902, [])]
    toks = spark.createDataFrame(texts, "topic_id string, src_idx string, doc_id int, words array<string>")
    found = terms.noun_phrases(toks, by_ending)
    assert {(r.phrase, r.key): r.n for r in found.collect()} == dict(Counter(run for *_, words in texts for run in plain_runs(words or [], known)))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    runs = terms.lexicon_runs(toks, by_ending)
    assert {r.pos for r in runs.filter("doc_id = 900").collect()} == {0}
    assert runs.filter("doc_id = 900").first().key == "moving nation"


def test_moderation_counts_in_the_same_pass(spark):
    tables = {
        "gram": spark.createDataFrame([("t", "a b"), ("t", "A B"), ("t", "c d")], "topic_id string, item string"),
        "triplet": spark.createDataFrame([("t", 0, "x"), ("t", 1, "y"), ("u", 2, None)], "topic_id string, index int, item string"),
        "entity": spark.createDataFrame([], "topic_id string, item string"),
    }
    flagged = spark.createDataFrame([("gram", "A b"), ("triplet", "1"), ("entity", "c d"), ("triplet", "9")], "kind string, flag string")
    kept, counts = terms.moderated(tables, flagged, {"gram": "item", "triplet": "index", "entity": "item"})
    rows = {kind: df.collect() for kind, df in kept.items()}
    assert [r.item for r in rows["gram"]] == ["c d"] and sorted(r["index"] for r in rows["triplet"]) == [0, 2] and rows["entity"] == []
    assert {k: (terms.observed_count(b), terms.observed_count(a)) for k, (b, a) in counts.items()} == {"gram": (3, 1), "triplet": (3, 2), "entity": (0, 0)}


def test_lists_are_trimmed_for_a_consumer(spark):
    long = spark.createDataFrame([("t", k, f"g{k}", 1, k, 0.5) for k in range(1, 40)], "topic_id string, rank int, gram string, freq_min int, freq_max int, weight double")
    got = terms.trim_lists({"grams": long, "other": long}, {"grams": ["gram", "range"], "other": ["gram"]})
    rows = sorted(got["grams"].collect(), key=lambda r: r.rank)
    assert len(rows) == 25 and rows[-1].asDict() == {"topic_id": "t", "rank": 25, "gram": "g25", "range": "1-25"} and got["other"].count() == 39


def test_placement_holds_pairs_concepts_and_relations(spark):
    entities = spark.createDataFrame([("t", f"e{k:02}", 1 - k / 100, k) for k in range(1, 13)], "topic_id string, phrase string, importance double, rank int")
    pairs = spark.createDataFrame([("t", "a", f"b{k}", 0.1 * k, k) for k in range(1, 9)], "topic_id string, a string, b string, strength double, rank int")
    concepts = spark.createDataFrame([("t", k, f"c{k}", k % 3) for k in range(1, 12)], "topic_id string, rank int, display string, sources int")
    relations = spark.createDataFrame([("t", k, "s", "r", f"o{k}") for k in range(1, 9)], "topic_id string, rank int, subject string, relation string, object string")
    got = {}
    for r in terms.placement_plan(entities, pairs, concepts, relations).orderBy("rank").collect():
        got.setdefault(r.kind, []).append(r.item)
    assert got == {
        "primary": ["e01"], "secondary": ["e02", "e03", "e04"], "supporting": [f"e{k:02}" for k in range(5, 11)],
        "pair": [f"a + b{k}" for k in (8, 7, 6, 5, 4)], "concept": ["c2", "c5", "c8"], "relation": [f"s r o{k}" for k in range(1, 6)],
    }
def test_budgets_without_counts(spark):
    rows = spark.createDataFrame([("a", 0.5, 0, 0), ("b", 0.01, 0, 0), ("c", 0.9, 2, 7)], "gram string, weight double, freq_min int, freq_max int")
    got = {r.gram: (r.low, r.high, r.per_section) for r in terms.section_budget(rows, 3).collect()}
    assert got == {"a": (2, 5, 2), "b": (1, 1, 1), "c": (2, 7, 3)}


def test_signals_stop_after_the_cap(spark):
    rows = spark.createDataFrame([("t", 1, "aaaa"), ("t", 0, "bb"), ("t", 2, "c"), ("t", 3, None)], "topic_id string, pos int, text string")
    assert terms.signal_sources(rows, cap=5).first()["content"] == "bb . aaaa"


def test_phrase_keys(spark):
    rows = spark.createDataFrame([("Best red Cars!",), ("the car",), ("1234 56",), ("",), (None,)], "g string")
    assert [r[0] for r in rows.select(terms.phrase_key(F.col("g"), ["the"])).collect()] == ["best cars red", None, None, None, None]


def test_flagged_phrases_are_split_once_and_have_the_reasons(spark):
    phrases = ["", "the of", "a b", "go go", "boat red boat", "5 kg of nuts", "font red nuts", "add to cart now", "x{y} nuts", "camelCase nuts", "a_b_c nuts", "123 456", "menu", "red nuts", None]
    lists = ["the", "of"], ["font"], ["add to cart"], ["menu"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(phrases)], "id int, g string")
    found = terms.flagged_phrases(rows, "g", *lists)
    want = rows.select("id", "g", terms.quality_reason(F.col("g"), *lists).alias("reason")).filter("reason IS NOT NULL")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() > 9
    plan = d11_gram_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(gram") == 1
