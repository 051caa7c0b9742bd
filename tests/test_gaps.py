import random
import time
import numpy as np
from pyspark.sql import functions as F

from textloom.operators import gaps, vectors

SCHEMA = "cause string, effect string, confidence double"


def test_payloads_fenced_truncated_and_without_array(spark):
    texts = [
        'Here:\n```json\n[{"cause": "rain", "effect": "mud", "confidence": 0.9}]\n```',
        '[{"cause": "a", "effect": "b", "confidence": 0.5}, {"cause": "c", "eff',
        '[{"cause": "x", "effect": "y", "confidence": 1},]',
        "no array", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = sorted((r.id, r.cause, r.effect) for r in gaps.parse_triplets(frame, SCHEMA).collect())
    assert got == [(0, "rain", "mud"), (1, "a", "b"), (2, "x", "y")]


def test_questions_that_share_two_words_with_a_heading_are_covered(spark):
    questions = spark.createDataFrame([("t", 1, "where do blue whales sleep"), ("t", 2, "whales drink seawater often"), ("t", 3, "why"), ("u", 4, "blue whales sleep")], "topic_id string, id int, question string")
    headings = spark.createDataFrame([("t", "Blue whales"), ("t", None)], "topic_id string, heading string")
    tokens = spark.createDataFrame([("t", ["whales", "drink"]), ("u", ["blue", "whales", "sleep"])], "topic_id string, words array<string>")
    got = gaps.gap_unanswered(questions, headings, tokens, ["often"]).collect()
    assert [(r.topic_id, r.id, r.share, r.priority) for r in got] == [("t", 2, 0.666667, "medium")]


def test_crosscheck_keeps_long_and_confirmed_lines(spark):
    second = "alpha beta gamma " * 20
    rows = spark.createDataFrame([("alpha beta\nother stuff here\n" + "x" * 60, second), (" ", second), ("kept as is", "short")], "a string, b string")
    got = [r[0] for r in rows.select(gaps.crosscheck_lines(rows, "a", "b")).collect()]
    assert got == ["alpha beta\n" + "x" * 60, second, "kept as is"]


def test_classes_and_ties(spark):
    rows = spark.createDataFrame([("law and health",), ("heal the doc",), ("none",), (None,)], "t string")
    got = [r[0] for r in rows.select(gaps.topic_class(F.col("t"), {"legal": ["law"], "health": ["heal", "doc"]})["class"]).collect()]
    assert got == ["legal", "health", None, None]


def test_overlapping_sequences_and_variants(spark):
    toks = spark.createDataFrame([(1, ["a", "a", "a", "b"]), (2, [])], "doc_id int, words array<string>")
    assert {(r.doc_id, r.phrase, r.n) for r in gaps.sequence_hits(toks, ["a a", "a b", "b a"]).collect()} == {(1, "a a", 2), (1, "a b", 1)}
    heads = spark.createDataFrame([("Red Car",), ("Solo",)], "heading string")
    assert [r.variant for r in gaps.fallback_variants(heads).collect()] == ["red car", "car red", "solo"]


def test_issue_order_and_skips(spark):
    rows = spark.createDataFrame([(1, "bad then wrong and ugly"), (2, None)], "doc_id int, text string")
    got = gaps.rank_issues(rows, [("ugly", "style"), ("wrong", "grammar"), ("bad", "style"), ("then", "style")], {"grammar": 1, "style": 2}, ["then"]).collect()
    assert [(r.rank, r.rule, r.place) for r in got] == [(1, "wrong", 9), (2, "bad", 0), (3, "ugly", 19)]


def test_semantic_gaps_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) + np.array([1.0, 0, 0, 0, 0, 0])
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(999, [1.0] * 6, 7)]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for y in range(3):
        ids = [i for i, _, k in rows if k == y]
        scored = []
        for i in ids[1:]:
            sim = cos(x[i], x[ids[0]])
            others = [cos(x[i], x[j]) > 0.55 for j in ids[1:] if j != i]
            score = sim * (1 - sum(others) / len(others))
            if sim >= 0.15 and score >= 0.15:
                scored.append((-round(score, 9), i))
        want[y] = [i for _, i in sorted(scored)[:5]]
    for first, block in ((4, 16), (7, 5), (64, 2048)):
        got = {}
        for r in gaps.semantic_gaps(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int"), limit=5, first=first, block=block).orderBy("label", "rank").collect():
            got.setdefault(r.label, []).append(r.vec_id)
        assert got == {y: ids for y, ids in want.items() if ids}


def test_search_payloads(spark):
    full = '{"organic_results": [{"title": "T", "snippet": "S", "link": "L"}, {"snippet": "no title"}], "related_questions": [{"question": "Q?", "snippet": "A"}], "answer_box": {"title": "B", "snippet": "box"}, "ai_overview": {"text": "", "snippet": "over", "sources": [{"link": "x"}, {"link": "y"}]}, "related_searches": [{"query": "q1"}, {"query": ""}, {"query": "q2"}]}'
    rows = spark.createDataFrame([("a", full), ("b", '{"related_questions": []}'), ("c", "no json"), ("d", None)], "topic_id string, payload string")
    got = sorted((r.topic_id, r.kind, r.pos, r.text, r.answer, r.link) for r in gaps.flatten_serp(rows).collect())
    assert got == [("a", "answer", 0, "B", "box", None), ("a", "overview", 0, "over", None, "x y"), ("a", "query", 0, "q1", None, None), ("a", "query", 1, "q2", None, None), ("a", "question", 0, "Q?", "A", None), ("a", "result", 0, "T", "S", "L")]


def test_semantic_gaps_of_a_large_label_of_alike_vectors(spark):
    """5000 vectors that nearly all cover each other, and some far ones, against all pairs in numpy."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(4700, 16)) * 0.2 + 1, rng.normal(size=(300, 16)) + 0.4))
    x[17] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims, cover = unit[1:] @ unit[0], unit[1:] @ unit[1:].T > 0.55
    shares = (cover.sum(axis=1) - np.diag(cover)) / (len(x) - 2)
    scores = sims * (1 - shares)
    want = sorted(((-round(s, 9), i + 1) for i, s in enumerate(scores) if s >= 0.15 and sims[i] >= 0.15))[:15]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id int, embedding array<double>, label int")
    got = gaps.semantic_gaps(frame).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in want] and got
    assert all(abs(r.coverage - shares[r.vec_id - 1]) < 1e-5 for r in got)


def plain_matches(words, phrase, most, wider=2):
    """Exact places, then free windows from the left, as one reads them."""
    k, exact, used, fuzzy = len(phrase), [], set(), 0
    for i in range(len(words) - k + 1):
        if words[i : i + k] == phrase:
            exact.append(i)
            used |= set(range(i, i + k))
    for i in range(len(words)):
        for n in range(k, k + wider + 1):
            if i + n <= len(words) and fuzzy < most - len(exact) and not used & set(range(i, i + n)) and set(phrase) <= set(words[i : i + n]):
                fuzzy += 1
                used |= set(range(i, i + n))
                break
    return len(exact), fuzzy


def test_lemma_matches_equal_a_plain_search(spark):
    rng = random.Random(3)
    phrases = [("a", 3), ("a b", 4), ("b a a", 9), ("c b a", 2), ("cats run", 5)]
    lemmas = {"cats": "cat", "runs": "run"}
    texts = [(i, rng.choices(["a", "b", "c", "d", "cats", "cat", "runs", "run"], k=rng.randrange(0, 40))) for i in range(150)]
    got = {(r.doc_id, r.phrase): (r.exact, r.fuzzy) for r in gaps.lemma_matches(spark.createDataFrame(texts, "doc_id int, words array<string>"), phrases, lemmas).collect()}
    want = {(i, p): plain_matches([lemmas.get(w, w) for w in words], [lemmas.get(w, w) for w in p.split()], most) for i, words in texts for p, most in phrases}
    assert got == {k: v for k, v in want.items() if sum(v)}


def test_windows_of_a_long_text_do_not_take_the_square_of_its_length(spark):
    words = ["a", "x", "b", "x"] * 6_000
    frame = spark.createDataFrame([(1, words)], "doc_id int, words array<string>")
    began = time.monotonic()
    assert [tuple(r) for r in gaps.lemma_matches(frame, [("a b", 10_000)]).collect()] == [(1, "a b", 0, 6_000)]
    assert time.monotonic() - began < 30  # minutes when the exact places were found anew for every window


def test_payloads_of_other_shapes_keep_the_signals_that_they_hold(spark):
    payloads = {
        "extra": '{"organic_results": [{"title": "T", "snippet": 5, "position": 1, "rich": {"a": [1]}}, null, "odd", {"title": {"x": 1}, "snippet": "S"}, {"title": 7}], "more": {"organic_results": 3}}',
        "object": '{"organic_results": {"title": "only", "link": true}, "related_searches": ["plain", {"query": "q"}, {"other": 1}, 4, []]}',
        "wrong": '{"organic_results": "text", "related_questions": [{"question": ["no"]}, "Why?"], "answer_box": ["list"], "ai_overview": {"text": {"a": 1}, "snippet": "over", "sources": "none"}}',
        "array": '[1, 2]',
        "cut": '{"organic_results": [',
        "null": "null",
    }
    rows = spark.createDataFrame(sorted(payloads.items()), "topic_id string, payload string")
    got = sorted((r.topic_id, r.kind, r.pos, r.text, r.answer, r.link) for r in gaps.flatten_serp(rows).collect())
    assert got == [
        ("extra", "result", 0, "T", "5", None),
        ("extra", "result", 4, "7", None, None),
        ("object", "query", 0, "plain", None, None),
        ("object", "query", 1, "q", None, None),
        ("object", "query", 2, "4", None, None),
        ("object", "result", 0, "only", None, "true"),
        ("wrong", "overview", 0, "over", None, ""),
        ("wrong", "question", 1, "Why?", None, None),
    ]


def test_merged_gaps_have_headings_and_suggestions(spark):
    rows = [("t", k, "unanswered", f"is wooden boat{chr(97 + k)} hull strong? ", "high") for k in range(5)]
    rows += [("t", 9, "subtopic", "HULL of wooden boata strong", "medium"), ("t", 10, "depth", "Repair yards", "high"), ("t", 11, "subtopic", "are the", "high")]
    frame = spark.createDataFrame(rows, "topic_id string, id int, kind string, question string, priority string")
    got = {r.id: r for r in gaps.merge_gaps(frame, ["wooden", "hull", "strong"], leads=["is", "are"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 10] and [got[k].suggested for k in (0, 1, 2, 3, 4, 10)] == [True, True, True, False, False, False]
    assert got[0].heading == "Wooden boata hull strong" and got[10].heading == "Repair yards"


def test_similar_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(150, 8)), rng.normal(size=(150, 8)) * 0.3 + 1, np.zeros((1, 8))))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(900, x[0].tolist(), None), (901, None, 1), (902, (2 * x[0]).tolist(), 0), (903, x[1].tolist(), 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    known = [(i, np.array(v), k) for i, v, k in rows if v is not None and k is not None and np.linalg.norm(v) > 0]
    for least in (0.5, 0.9, 0.99):
        want = {(k, i, j) for i, a, k in known for j, b, m in known if k == m and i < j and cos(a, b) >= least}
        for block in (1000, 16):
            got = vectors.similar_pairs(frame, least, block).collect()
            assert len(got) == len(want) and {(r.label, r.a, r.b) for r in got} == want
            assert all(abs(r.sim - cos(rows[r.a][1] if r.a < 900 else rows[303][1], rows[r.b][1] if r.b < 900 else rows[303][1])) < 1e-9 for r in got)
