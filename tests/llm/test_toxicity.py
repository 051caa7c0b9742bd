import itertools
import zlib

import numpy as np

from textloom.llm.toxicity import Chains, Tagger, drop_toxic, labelled_sample, marginals, split_words, toxicity

DOCS = "doc_id bigint, text string, score string"


def corpus(n=500, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(2000)]
    docs, labels = [], []
    for i in range(n):
        text, bad = list(rng.choice(words, 60)), i % 4 == 0
        if bad:
            text[int(rng.integers(0, 60))] = str(rng.choice(["vile", "rotten"]))
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    emission, trans = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    mask = np.ones((1, 6), dtype=bool)
    prob, moves, norm = marginals(emission, mask, trans)
    weight, one, moved = 0.0, np.zeros(6), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=6):
        s = np.exp(sum(e for e, x in zip(emission[0], states) if x) + sum(trans[a, b] for a, b in zip(states, states[1:])))
        weight += s
        one += s * np.array(states)
        for a, b in zip(states, states[1:]):
            moved[a, b] += s
    assert np.allclose(prob[0], one / weight) and np.allclose(moves, moved / weight) and np.isclose(norm[0], np.log(weight))


def test_chains_place_every_word_once():
    chains = Chains(np.array([3, 0, 130, 64]))
    assert chains.n == 1 + 1 + 3 + 1 and len(set(zip(chains.row.tolist(), chains.col.tolist()))) == 197


def test_stretches_of_a_text_are_one_chain():
    rng = np.random.default_rng(3)
    own = Tagger()
    own.trans = rng.normal(size=(2, 2)) * 2
    texts = [rng.normal(size=n) * 3 for n in (1, 0, 64, 65, 128, 700)]
    for e, p in zip(texts, own._marginals(texts)):
        if len(e):
            assert np.allclose(p, marginals(e[None], np.ones((1, len(e)), dtype=bool), own.trans)[0][0])


def test_rows_of_one_id_with_unlike_texts(spark):
    docs, labels = corpus(200)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    more = [(1, f"zz word{k} and more", None) for k in range(300)]
    a, b = (toxicity(spark.createDataFrame(x, DOCS).repartition(n), known).collect() for x, n in ((docs + more, 3), (more + docs, 7)))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b) and len(a) == 500
    texts, toxic = labelled_sample(spark.createDataFrame(docs + more + [(4, "w " * 200, None)], DOCS), known, "doc_id", "text", "toxic", (500, 500), 300)
    assert len(texts) == len(toxic) <= 200 and max(map(len, texts)) <= 300


def test_held_out_accuracy_and_spans(spark):
    docs, labels = corpus()
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth, texts = {i: y for i, _, y in labels}, {i: t for i, t, _ in docs}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.predicted and truth[r.doc_id]:
            assert {texts[r.doc_id][s.start : s.end] for s in r.spans} <= {"vile", "rotten"}


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    frame = spark.createDataFrame(docs, DOCS)
    a, b = ({r.doc_id: r.score for r in toxicity(frame, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    docs, labels = corpus(200)
    rows = [*docs, (900, None, None), (901, "", None), (902, "...", None), (903, "calm " * 30000 + "vile " + "calm " * 30000, None), (None, "vile word1", None), (0, docs[0][1], None)]
    got = toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].predicted == by[901].predicted == by[902].predicted == 0 and by[900].spans == []
    assert by[903].predicted == 1 and [(s.start, s.end) for s in by[903].spans] == [(150000, 150004)]
    none = toxicity(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert [r.score for r in none] == [0.0] * 3
    assert toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_drop_keeps_clean_rows_whole(spark):
    docs, labels = corpus(300)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    left = drop_toxic(frame, known)
    assert left.schema == frame.schema
    bad = {r.doc_id for r in toxicity(frame, known).collect() if r.predicted}
    assert sorted(map(tuple, left.collect())) == sorted(d for d in docs if d[0] not in bad)
    assert Tagger().tag(["", None])[0].size == 0 and split_words("A-b") == [b"a", b"b"]
