import random
import re

import pyarrow as pa
import pytest

from textloom.operators import entities

SOURCES = "topic_id string, src_idx string, doc_id bigint, content string"
GAZETTEER = "phrase string, etype string"
PHRASES = [("license", "A"), ("mit license", "B"), ("mit license terms", "C"), ("the gnu affero general public license", "D"), ("license terms apply", "E"), ("x", "short"), ("général", "F"), ("mit license", "B2")]


def brute(text, phrases):
    """All places of all phrases by trying each one at each word; those inside a longer one go."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text)]
    every = []
    for phrase, etype in phrases:
        parts = phrase.split()
        for i in range(len(words)):
            if len(phrase) >= 2 and [w for *_, w in words[i : i + len(parts)]] == parts:
                every.append((i, len(parts), phrase, etype, words[i][0], words[i + len(parts) - 1][1]))
    return sorted(e for e in every if not any(o[0] <= e[0] and o[0] + o[1] >= e[0] + e[1] and o[1] > e[1] for o in every))


def texts(n):
    rng = random.Random(n)
    words = ["mit", "MIT", "license", "License", "terms", "apply", "the", "gnu", "affero", "general", "public", "Général", "x", "42", "-", "other"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + " The GNU Affero General Public License. " + "pad " * 30 for _ in range(n)]


@pytest.mark.parametrize("whole_table", [1000, 0])
def test_places_equal_brute_force(spark, whole_table):
    rows = [("t", "s", i, text) for i, text in enumerate(texts(30))] + [("t", None, 100, "mit license"), ("t", "s", 101, None), (None, "s", 102, "Mit License " * 20)]
    found = entities.match_entities(spark.createDataFrame(rows, SOURCES), spark.createDataFrame(PHRASES, GAZETTEER), around=5, whole_table=whole_table).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.pos, r.n_words, r.phrase, r.etype, r.start_char, r.end_char))
        text = dict((i, t) for *_, i, t in rows)[r.doc_id]
        assert r.surface == text[r.start_char : r.end_char] and re.findall(r"[^\W\d_]+", r.surface.lower()) == r.phrase.split()
        assert r.context == text[max(0, r.start_char - 5) : r.end_char + 5]
    want = {i: brute(text, PHRASES) for _, _, i, text in rows if text and len(text) >= 100}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert any(p[1] == 6 for v in got.values() for p in v)


def test_phrases_without_letters_and_empty_gazetteer(spark):
    rows = spark.createDataFrame([("t", "s", 1, "word " * 40)], SOURCES)
    for listed in ([("42", "N"), ("--", "N")], []):
        for whole_table in (1000, 0):
            assert entities.match_entities(rows, spark.createDataFrame(listed, GAZETTEER), whole_table=whole_table).collect() == []


def test_details_take_the_first_contexts_however_many_there_are(spark):
    text = "Bob one. " + "bob again and again. " * 400
    rows = [("t", "s1", 2, text), ("t", "s0", 5, "Here is BOB with words. " + "pad " * 30), ("t", "s2", 7, text)]
    found = entities.match_entities(spark.createDataFrame(rows, SOURCES), spark.createDataFrame([("bob", "P")], GAZETTEER), around=6)
    r = entities.entity_details(found).first()
    assert (r.surface, r.freq_min, r.freq_median, r.freq_max) == ("BOB", 1, 401, 401)
    assert r.contexts == ["re is BOB with ", "Bob one. ", " one. bob again"]


def test_pairs_in_sentences_and_paragraphs(spark):
    """Two sentences of one source and one of another hold both; the short paragraph does not count."""
    one = "Ann met Bob here. Ann left. Bob and ann talked at length about it.\n\nAnn. Bob.\n\nCy was alone in this longer paragraph of words, far from any other."
    two = "The names: Bob, Ann, Cy in one sentence of the second text, long enough to be read by all of them at last."
    rows = [("t", "a", 1, one), ("t", "b", 2, two), ("t", "c", 3, "z" * 120)]
    gazetteer = spark.createDataFrame([("ann", "P"), ("bob", "P"), ("cy", "P")], GAZETTEER)
    found = entities.match_entities(spark.createDataFrame(rows, SOURCES), gazetteer, around=20)
    n_sources = spark.createDataFrame([("t", 3)], "topic_id string, n_sources int")
    got = {(r.a, r.b): r for r in entities.cooccurrence(found, entities.entity_stats(found, n_sources), n_sources).collect()}
    r = got["ann", "bob"]
    assert (r.n, r.paragraphs, r.sources, r.rank) == (3, 2, 2, 1) and r.context == "Ann met Bob here"
    assert r.strength == round((3 * 3 + 2) * 1.4 / 50, 6)
    assert (got["bob", "cy"].n, got["bob", "cy"].paragraphs, got["bob", "cy"].sources) == (1, 1, 1)
    five = spark.createDataFrame([("t", 5)], "topic_id string, n_sources int")
    assert {(r.a, r.b) for r in entities.cooccurrence(found, entities.entity_stats(found, five), five).collect()} == {("ann", "bob"), ("ann", "cy"), ("bob", "cy")}


def test_words_and_places_by_the_short_way():
    rng = random.Random(3)
    for text in ("Red fox, RED 2nd fox_x", "Réd ²fox İx", "", "a-b c'd"):
        assert entities.words_in(text) == [w.lower() for w in entities.WORD.findall(text)]
    phrases = [("a b", "X"), ("b", "X"), ("a b a c", "Y"), ("c a", "Y")]
    automaton = entities.PhraseAutomaton(phrases)
    assert automaton.known == {"a", "b", "c"}
    for _ in range(300):
        words = [rng.choice("abcxy") for _ in range(rng.randrange(12))]
        want = sorted((i, len(p.split()), p, k) for p, k in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted(automaton.find(words)) == want


def test_few_places_are_held_at_once():
    batch = pa.RecordBatch.from_pylist([{"topic_id": "t", "src_idx": "s", "doc_id": k, "content": "a b " * 100} for k in range(200)])
    automaton = entities.PhraseAutomaton([("a b", "X")])
    sizes = [b.num_rows for b in entities._places(iter([batch]), automaton.find, 50)]
    assert sum(sizes) == 20_000 and max(sizes) <= 4_100


def test_pairs_read_their_mentions_once(spark):
    rows = [("t", f"s{i % 3}", i, i // 4, i // 8, p, "ORG", f"text {i // 4}", 90) for i in range(16) for p in ("a", "b")]
    mentions = spark.createDataFrame(rows, "topic_id string, src_idx string, doc_id int, sentence long, paragraph long, phrase string, etype string, sentence_text string, paragraph_chars long")
    few = spark.sql("SELECT 't' AS topic_id, explode(array('a', 'b')) AS phrase")
    got = entities.cooccurrence(mentions, few, spark.sql("SELECT 't' AS topic_id, 3L AS n_sources"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert [(r.a, r.b, r.n, r.paragraphs, r.sources, r.context) for r in got.collect()] == [("a", "b", 16, 16, 3, "text 0")]


def test_uses_alone_are_counted_without_places(spark):
    sources = spark.createDataFrame([("t", "s", 1, "The License of a License. " * 8)], "topic_id string, src_idx string, doc_id int, content string")
    gazetteer = spark.createDataFrame([("license", "TERM")], "phrase string, etype string")
    whole, bare = (entities.match_entities(sources, gazetteer, placed=p) for p in (True, False))
    assert bare.columns == whole.columns and bare.select("doc_id", "pos", "n_words", "phrase", "etype").collect() == whole.select("doc_id", "pos", "n_words", "phrase", "etype").collect()
    assert bare.filter("start_char IS NOT NULL OR sentence IS NOT NULL").count() == 0 and bare.count() == 16
