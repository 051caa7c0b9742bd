import numpy as np
from pyspark.sql import functions as F

from textloom.operators import checks, editing, meaning

FIX = "doc_id int, place int, length int, category string, sentence string, replacements array<string>"


def test_fixes_apply_from_the_end_and_only_safe_ones(spark):
    text = "teh cat sat on teh mat"
    fixes = [(1, 0, 3, "TYPOS", text, ["the"]), (1, 15, 3, "GRAMMAR", text, ["one very"]), (1, 4, 3, "STYLE", text, ["dog"]), (1, 8, 3, "TYPOS", text, ["a", "b"]), (1, 12, 2, "TYPOS", "elsewhere", ["at"]), (1, 99, 3, "TYPOS", text, ["x"]), (1, 19, 3, "TYPOS", text, ["far too long a word"])]
    docs = spark.createDataFrame([(1, text), (2, "kept"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.applied) for r in editing.apply_offset_fixes(docs, spark.createDataFrame(fixes, FIX)).collect()}
    assert got == {1: ("the cat sat on one very mat", 2), 2: ("kept", 0), 3: (None, 0)}


def test_corrections_tell_their_reasons(spark):
    docs = spark.createDataFrame([(1, "one two two three")], "doc_id int, text string")
    todo = spark.createDataFrame([(1, 1, "one", "remove it"), (1, 2, "two", "a pair of"), (1, 3, "three", "a triple"), (1, 4, "absent", "present")], "doc_id int, pos int, original string, replacement string")
    got = checks.apply_corrections(docs, checks.flag_instructions(todo)).first()
    assert (got.text, got.applied, got.flagged, got.reasons) == ("one two two a triple", 1, 3, ["instruction", "2 times", "applied", "0 times"])


def test_long_and_quoted_instructions(spark):
    texts = ["write: 'so'", "x" * 190 + " replace words", "please remove: the last", "a better wording", None]
    rows = spark.createDataFrame([(t,) for t in texts], "replacement string")
    assert [r.is_instruction for r in checks.flag_instructions(rows).collect()] == [True, True, True, False, True]


def test_issue_lists_become_one_table(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], []), (2, None, ["c"])], "doc_id int, one array<string>, two array<string>")
    got = editing.collect_issues(rows.fillna({}).withColumn("one", F.coalesce("one", F.array().cast("array<string>"))), {"one": "high", "two": "low"}).collect()
    assert sorted(map(tuple, got)) == [(1, "one", "high", "a"), (1, "one", "high", "b"), (2, "two", "low", "c")]


def test_references_by_part_then_by_word(spark):
    rows = spark.createDataFrame([("Divorce and child care",), ("the child",), ("nothing",), ("",), (None,)], "k string")
    acts = editing.match_references(F.col("k"), [("divorce", "A"), ("child support", "B"), ("divorce case", "A")])
    assert [r[0] for r in rows.select(acts).collect()] == [["A"], ["B"], [], [], []]


def test_publications_by_translated_words(spark):
    pubs = spark.createDataFrame([("t", 1, "weighted blanket trial"), ("t", 2, "Meta-analysis of blanket use"), ("t", 3, "heart imaging"), ("t", 4, None)], "topic_id string, id int, body string")
    topics = spark.createDataFrame([("t", "koldra obciazeniowa")], "topic_id string, keyword string")
    got = editing.relevant_publications(pubs, topics, [("koldra", "blanket"), ("koldra obciazeniowa", "weighted blanket")], ["meta-analysis", "review"]).collect()
    assert [(r.rank, r.id, r.evidence, r.share) for r in got] == [(1, 2, "meta-analysis", 0.5), (2, 1, "review", 1.0)]


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(12, 8)) * 0.4 for _ in range(4)])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(100, [0.0] * 8, 1), (200, [1.0] * 8, 2)]
    got = meaning.entity_clusters(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")).collect()
    cos = lambda a, b: 0.0 if not (np.linalg.norm(a) and np.linalg.norm(b)) else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    own = {i: np.array(v) for i, v, y in rows if y == 1}
    order = sorted((i for i in own if i), key=lambda i: (-cos(own[i], own[0]), i))[:50]
    free, want = set(order), []
    for i in order:
        if i in free and len({s for _, _, s in want}) < 8:
            members = [i] + [j for j in order if j in free and j != i and cos(own[i], own[j]) >= 0.72]
            free -= set(members)
            if len(members) > 1 or cos(own[i], own[0]) > 0.7:
                want += [(len({s for _, _, s in want}), j, i) for j in members]
    assert sorted((r.cluster, r.vec_id, r.seed) for r in got) == sorted(want) and want


def test_semantic_ranking(spark):
    one = lambda k, kind, v: ("t", kind, k, v)
    refs = [one(0, "keyword", [1.0, 0.0]), one(0, "question", [0.0, 1.0]), one(9, "question", [1.0, 0.0]), one(0, "heading", [1.0, 0.1]), one(1, "heading", [0.0, 1.0])]
    cands = [("t", 1, [1.0, 0.0]), ("t", 2, [0.0, 2.0]), ("t", 3, [0.0, 0.0])]
    got = meaning.rank_headings_semantic(spark.createDataFrame(cands, "topic_id string, id int, embedding array<double>"), spark.createDataFrame(refs, "topic_id string, kind string, k int, embedding array<double>")).collect()
    assert [(r.id, r["score"], r.priority) for r in got] == [(1, 0.6, "high"), (2, 0.4, "optional"), (3, 0.0, "optional")]


def test_texts_are_not_shuffled_by_few_topics(spark):
    pubs = spark.createDataFrame([("t", 1, "a weighted blanket"), ("t", 2, "nothing"), ("u", 3, "a weighted blanket")], "topic_id string, id int, body string")
    topics = spark.createDataFrame([("t", 2, "weighted blanket"), ("u", 1, "other")], "topic_id string, n_sources int, keyword string")
    found = editing.relevant_publications(pubs, topics, [], ["review", "none"], small=True)
    assert [r["id"] for r in found.collect()] == [1]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
