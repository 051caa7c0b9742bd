import random
import re

from pyspark.sql import functions as F

from textloom.functions.lists import FACTS, SCRIPTS
from textloom.operators import checks, facts, gaps, grams, headings, text


def test_markup_and_domain(spark):
    frame = spark.createDataFrame([("## Head\n**bold** and *it* [link](http://x)\n---\n\n\n\nend",)], "t string")
    assert frame.select(text.strip_markup(F.col("t"))).first()[0] == "Head\nbold and it link\n\nend"
    urls = spark.createDataFrame([("https://www.a.org/x",), ("not a url",)], "u string")
    assert [r[0] for r in urls.select(text.domain_of(F.col("u"))).collect()] == ["a.org", "not a url"]


def test_admission_stops_after_the_cap_is_reached(spark):
    rows = [("t", i, i, "x" * 600) for i in range(5)] + [("t", 9, 9, "short")]
    got = text.admit_sources(spark.createDataFrame(rows, "topic_id string, src_idx int, doc_id int, content string"), cap=1200)
    assert sorted(r.src_idx for r in got.collect()) == [0, 1]


def test_navigation_lines_start_a_skip(spark):
    long = "this line is long enough to end the skip, as it has over fifty characters"
    lines = ["keep", "menu here", "a", "b", "c", long, "after"]
    frame = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    assert text.clean_lines(frame, "(?i)menu").first()["text"].split("\n") == ["keep", long, "after"]
    short = ["menu"] + [str(k) for k in range(12)]
    frame = spark.createDataFrame([(1, "\n".join(short))], "doc_id int, text string")
    assert text.clean_lines(frame, "(?i)menu").first()["text"].split("\n") == ["8", "9", "10", "11"]


def test_floor_median_and_boilerplate_filter(spark):
    rows = [("t", "g", s) for s, n in ((0, 1), (1, 2), (2, 5), (3, 8)) for _ in range(n)]
    stats = grams.gram_stats(spark.createDataFrame(rows, "topic_id string, gram string, src_idx int")).first()
    assert (stats.freq, stats.sources, stats.freq_min, stats.freq_median, stats.freq_max) == (16, 4, 1, 3, 8)


def test_lexicon_gives_lemmas(spark):
    sources = spark.createDataFrame([("t", 0, 1, "Cats run")], "topic_id string, src_idx int, doc_id int, content string")
    lexicon = spark.createDataFrame([("cats", "cat")], "surface string, lemma string")
    got = grams.tokens(sources, lexicon=lexicon).orderBy("pos").collect()
    assert [r.lemma for r in got] == ["cat", "run"]


def test_corrections_apply_only_to_a_single_place(spark):
    articles = spark.createDataFrame([(1, "one two two three"), (2, "untouched")], "doc_id int, text string")
    todo = spark.createDataFrame([(1, 2, "two", "2"), (1, 1, "one", "two"), (1, 3, "three", "3"), (1, 4, "absent", "x")], "doc_id int, pos int, original string, replacement string")
    got = {r.doc_id: r for r in checks.apply_corrections(articles, todo).collect()}
    assert (got[1].text, got[1].applied, got[1].flagged) == ("two two two 3", 2, 2)
    assert (got[2].text, got[2].applied, got[2].flagged) == ("untouched", 0, 0)


def test_list_groups(spark):
    frame = spark.createDataFrame([(1, "a\n- x\n- y\nb\n1. z")], "doc_id int, text string")
    assert tuple(checks.list_groups(frame).first()) == (1, 2, 3)


def test_instructions(spark):
    frame = spark.createDataFrame([("Remove this",), ("a better phrase",), ("ok",)], "replacement string")
    assert [r.is_instruction for r in checks.flag_instructions(frame).collect()] == [True, False, True]


def test_chains_and_clamps(spark):
    rows = [("t", "rain falls hard", "the river rises", "causes", 2.0), ("t", "the river rises fast", "flood", "odd", 0.1), ("t", "x", "too short", "causes", 0.5)]
    frame = spark.createDataFrame(rows, "topic_id string, cause string, effect string, relation string, confidence double")
    got = {r.cause: r for r in facts.mark_chains(facts.normalise_causal(frame)).collect()}
    assert set(got) == {"rain falls hard", "the river rises fast"}
    assert all(r.is_chain for r in got.values())
    assert (got["rain falls hard"].confidence, got["the river rises fast"].confidence, got["the river rises fast"].relation) == (0.95, 0.3, "causes")


def test_budget_lines(spark):
    rows = [("t", 1, "Red car: 2-5x"), ("t", 2, "blue: 3"), ("t", 3, "bare phrase"), ("t", 4, "red car: 1 – 4"), ("t", 5, " ")]
    got = {r.phrase: (r.low, r.high) for r in facts.parse_budgets(spark.createDataFrame(rows, "topic_id string, pos int, line string")).collect()}
    assert got == {"red car": (1, 4), "blue": (1, 3), "bare phrase": (1, 99)}


def test_facts_scripts_and_ranges(spark):
    frame = spark.createDataFrame([(1, "en", "costs $ 5.50, 12 % off, 3 kg on 2024-01-02 привет"), (2, "en", "$5.50 again"), (3, "en", None)], "doc_id int, lang string, text string")
    got = {(r.kind, r.value): r.n for r in facts.hard_facts(frame, FACTS).collect()}
    assert got == {("price", "$5.50"): 2, ("percent", "12%"): 1, ("measure", "3kg"): 1, ("date", "2024-01-02"): 1}
    assert [tuple(r) for r in checks.foreign_scripts(frame, SCRIPTS).collect()] == [(1, "cyrillic", "привет")]
    budgets = [("costs", 1, 1, 0.5), ("off", 3, 9, 0.5), (" kg", 0, 0, 0.5), ("absent", 1, None, 0.4), ("5", 9, 9, 1.0)]
    for strict, want in ((False, (1, 1, 1, 1, "absent", 50.0)), (True, (1, 0, 0, 1, "absent", 50.0))):
        cover = {r.doc_id: tuple(r)[1:] for r in checks.gram_coverage(frame, budgets, strict).collect()}
        assert cover[1] == want and cover[3][4] == ("costs, absent" if strict else "costs, off, absent")


def test_records_without_signature_stay(spark):
    rows = [(1, 0, "A b"), (1, 1, "ab"), (2, 0, " "), (2, 1, None)]
    got = facts.dedup_records(spark.createDataFrame(rows, "conv_id int, turn int, text string"), ["conv_id", "turn"])
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 0), (2, 1)]


def test_headings(spark):
    rows = [("t", "a", 1, 0, "Best red cars"), ("t", "b", 2, 0, "best RED cars!"), ("t", "c", 3, 0, "short"), ("t", "c", 3, 1, "add to cart now")]
    frame = spark.createDataFrame(rows, "topic_id string, src string, page_id int, pos int, heading string")
    assert [r.page_id for r in headings.clean_headings(frame, ["the"], ["add to cart"]).collect()] == [1]
    top = headings.topical_coverage(frame).orderBy("rank").first()
    assert (top.pattern, top.sources, top["class"]) == ("best red cars", 2, "HIGH")


def test_long_scan_equals_a_fold(spark):
    import random
    import re

    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["menu bar", "short", "x" * 60, "menu " + "y" * 200, ""]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]

    def fold(lines):
        skip, n, out = False, 0, []
        for line in lines:
            if re.search("menu", line) and len(line) < 150:
                skip, n = True, 0
            elif skip and not ((n + 1 > 3 and len(line) > 50) or n + 1 > 8):
                n += 1
            else:
                skip, n = False, 0
                out.append(line)
        return "\n".join(out)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in text.clean_lines(frame, "menu").collect()}
    assert got == {i: fold(t.split("\n")) for i, t in enumerate(texts)}


def test_grams_of_signals_keywords_and_lemmas(spark):
    rows = [("t", s, "g h") for s in "aabbc"] + [("t", None, "g h"), ("t", None, "only signal"), ("t", "a", "rare one"), ("t", "a", "lone gram")] + [("t", "a", "lone gram")] * 19 + [("t", s, "key word") for s in "abc"]
    topics = spark.createDataFrame([("t", 3, "key")], "topic_id string, n_sources long, keyword string")
    stats = grams.gram_stats(spark.createDataFrame(rows, "topic_id string, src_idx string, gram string"))
    got = {r.gram: (r.freq, r.freq_total, r.sources, r.in_signals, r.freq_min, r.freq_median, r.freq_max) for r in stats.collect()}
    assert got["g h"] == (5, 6, 3, True, 1, 2, 2) and got["only signal"] == (0, 1, 0, True, 1, 1, 1)
    kept = {r.gram: r.weight for r in grams.weight_grams(stats, topics).collect()}
    assert kept == {"g h": round(0.5 * 5 / 20 + 0.5 + 0.08, 4), "only signal": 0.08, "key word": round(round(0.5 * 3 / 20 + 0.5, 4) + 0.1, 4)}
    sources = spark.createDataFrame([("t", "a", 1, "Cats run cat run cats run"), ("t", "b", 2, "one")], "topic_id string, src_idx string, doc_id int, content string")
    forms = grams.lemma_grams(grams.tokens(sources, lexicon=spark.createDataFrame([("cats", "cat")], "surface string, lemma string")), 2, 3)
    shown = {r.gram: (r.display, r.freq) for r in grams.gram_displays(forms).collect()}
    assert shown == {"cat run": ("cats run", 3), "run cat": ("run cat", 2), "cat run cat": ("cat run cats", 2), "run cat run": ("run cat run", 2)}


def test_chrome_by_role_and_class(spark):
    html = '<div role=banner>a</div><div class="x cookie-bar">b</div><section id="menu-top">c</section><p class="text">kept</p><div role="main">also</div>'
    frame = spark.createDataFrame([(html,), (None,)], "h string")
    assert [r[0] for r in frame.select(text.html_main_text(F.col("h"))).collect()] == ["kept also", None]
    marks = spark.createDataFrame([("We use cookies here. Text ABCDEFGHIJKLMNOPQRSTUV1 end [3]",)], "t string")
    assert marks.select(text.strip_artifacts(F.col("t"))).first()[0].split() == ["Text", "end"]


def test_chrome_blocks_reach_to_their_own_closing_tag(spark):
    html = {
        1: '<div class="sidebar">a<div>b<div>c</div>d</div>e</div><p>kept</p>',
        2: "<article><nav><ul><li>a</li></ul></nav>kept<nav>open <p>stays</article>",
        3: '<table role="navigation"><tr><td>a</td></tr></table><span id="cookie-note">b<span>c</span></span>kept',
        4: '<script>var t="<nav>";</script>kept<!-- <nav> --> too<style>p{}</style><nav/> still<br/>',
        5: "</nav></div>kept<nav>a<nav>b</nav>c</nav>",
    }
    frame = spark.createDataFrame(sorted(html.items()), "id int, h string")
    got = {r.id: r.t for r in frame.select("id", text.html_main_text(F.col("h")).alias("t")).collect()}
    assert got == {1: "kept", 2: "kept open stays", 3: "kept", 4: "kept too still", 5: "kept"}
    lines = spark.createDataFrame([("<h1>One  two</h1><p>a<b>b</b></p><ul><li>x<li>y</ul>",)], "h string")
    assert lines.select(text.html_main_text(F.col("h"), lines=True)).first()[0] == "One two\na b\nx\ny"


def test_lines_are_judged_after_the_skip(spark):
    long = "this is a line that is long enough to end the skip, as it has over fifty characters."
    lines = ["menu", "1", "2", "3", long, "word", "word7", "Home", "", "Two Names", "it is as it was on the day of the visit.", "12", "a b ."]
    frame = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")
    kept = text.clean_lines(frame, "menu", ["is", "a", "that", "to", "the", "as", "it", "has", "was", "on", "of", "in"]).first()["text"].split("\n")
    assert kept == [long, "it is as it was on the day of the visit.", "a b ."]


def test_links_causes_and_effects_share_one_shuffle_of_the_texts(spark, tmp_path):
    rows = [("t", "a b c d", "e f g", "causes", 0.5), ("t", "a b c d", "e f g", "causes", 0.5), ("t", "e f g h", "i j k", "causes", 0.4), (None, "l m n", "a b c", "causes", 0.9), (None, "a b c", "o p q", "causes", 0.8)]
    spark.createDataFrame(rows, "topic_id string, cause string, effect string, relation string, confidence double").write.parquet(str(tmp_path / "links"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        links = facts.mark_chains(facts.different_links(facts.normalise_causal(spark.read.parquet(str(tmp_path / "links")))))
        plan = links._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    assert sorted((r.topic_id or "", r.cause, r.is_chain) for r in links.collect()) == [("", "a b c", False), ("", "l m n", False), ("t", "a b c d", True), ("t", "e f g h", True)]


def test_page_text_as_a_chain(spark):
    body = "The first paragraph of the page is long enough to be kept whole in the end [1]."
    other = "It is also as it was in the second one, see https://example.com/x for the rest."
    html = f'<nav>Menu of the page</nav><div class="menu">Start</div><h1>Unheard banner words</h1><p>{body}</p><p>{other}</p><div>Orphan caption phrase.</div><p>{body}</p>' + "<p>" + "All of it is in the text of the page as it was. " * 4 + "</p>"
    got = gaps.best_text(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), "(?i)cookie", ["the", "of", "is", "to", "be", "in", "it", "as", "was"]).orderBy("page_id").collect()
    lines = got[0].content.split("\n")
    assert lines[0] == "The first paragraph of the page is long enough to be kept whole in the end ."
    assert lines[1] == "It is also as it was in the second one, see for the rest." and len(lines) == 4
    assert not got[1].content


def test_the_key_path_prefers_a_chain(spark):
    rows = [("t", "a", "b", "causes", 0.9, False), ("t", "c", "d", "prevents", 0.4, True), ("t", "e", "f", "causes", 0.3, True), ("u", "g", "h", "causes", 0.5, False), ("u", "i", "j", "", 0.7, False)]
    frame = spark.createDataFrame(rows, "topic_id string, cause string, effect string, relation string, confidence double, is_chain boolean")
    assert {r.topic_id: r.path for r in facts.key_path(frame).collect()} == {"t": "c → prevents → d", "u": "i → j"}


def test_line_checks_equal_a_plain_reading(spark):
    rng = random.Random(6)
    pieces = ["The one. ", "de two! ", "other? ", "- item", "1. item", "", " ", "\n", "x. y. ", "The "]
    texts = [(k, "".join(rng.choice(pieces) + rng.choice(["", "\n"]) for _ in range(rng.randrange(1, 25)))) for k in range(120)] + [(200, None), (201, "")]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    want_openers, want_even, want_lists = {}, set(), {}
    for k, text in texts:
        if text is None:
            continue
        for s in re.split(r"[.!?]+\s+", text.lower()):
            for o in ("the ", "de "):
                if s.strip(" ").startswith(o):
                    want_openers[k, o] = want_openers.get((k, o), 0) + 1
                    break
        lines = text.split("\n")
        counted = [(i, sum(x.strip(" ") != "" for x in re.split(r"[.!?]+", p))) for i, p in enumerate(lines) if p.strip(" ")]
        want_even |= {(k, counted[i][0], counted[i][1]) for i in range(len(counted) - 3) if len({n for _, n in counted[i : i + 4]}) == 1}
        items = [bool(re.match(r"\s*(?:[-*|]|\d+[.)])\s?", x)) for x in lines]
        if any(items):
            want_lists[k] = (sum(x and not (i and items[i - 1]) for i, x in enumerate(items)), sum(items))
    assert {(r.doc_id, r.opener): r.n for r in checks.opener_hits(frame, ["The ", "de "]).collect()} == want_openers
    assert {tuple(r) for r in checks.uniform_paragraphs(frame).collect()} == want_even
    assert {r.doc_id: (r.groups, r.items) for r in checks.list_groups(frame).collect()} == want_lists


def test_few_pages_are_held_at_once(spark):
    frame = spark.createDataFrame([("<p>a</p><nav>b</nav>",), (None,)], "h string")
    rows = frame.select(text.html_main_text(F.col("h")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["a", None]
    assert "BatchEvalPython" in rows._jdf.queryExecution().executedPlan().toString()  # a hundred rows, not ten thousand
