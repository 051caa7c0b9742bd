import numpy as np

from textloom.llm.cotraining import CoTrained, Logistic, calibrated, classify_quality, sigmoid

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=600, seed=9):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(w + ("%%%" if bad and rng.random() < 0.5 else "") for w in rng.choice(words, 50))
        source = f"s{int(rng.integers(0, 3)) + (3 if bad and rng.random() < 0.8 else 0)}"
        docs.append((i, text, "en", source, len(text), "clash"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_views_exchange_labels_and_score_unlabelled_rows(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in classify_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(docs)
    rest = [i for i in got if i % 2 == 0]
    assert np.mean([got[i].keep == (i % 3 != 0) for i in rest]) >= 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.content_score <= 1 and 0 <= r.metadata_score <= 1 for r in got.values())


def test_pool_changes_the_views():
    docs, labels = corpus()
    y = {i: q for i, q, _ in labels}
    known = [d for d in docs if d[0] in y][:40]
    model = CoTrained().fit([d[1:5] for d in known], np.array([y[d[0]] for d in known], dtype=float), [d[1:5] for d in docs if d[0] not in y])
    assert model.exchanged > 0


def test_logistic_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] > 0).astype(float)
    assert ((Logistic(3).fit(x, y).logit(x) > 0) == (y == 1)).mean() > 0.97
    z = rng.normal(size=(4000, 1))
    w = calibrated(z, (rng.random(4000) < sigmoid(0.5 + 2 * z[:, 0])).astype(float))
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] - 2) < 0.3


def test_rows_of_one_id_with_unlike_columns(spark):
    docs, labels = corpus(200)
    more = [(1, f"zz word{k}", "en", "s0", k, None) for k in range(300)]
    a, b = (classify_quality(spark.createDataFrame(x, DOCS).repartition(n), spark.createDataFrame(labels, LABELS)).collect() for x, n in ((docs + more, 3), (more + docs, 7)))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b) and len(a) == 500


def test_odd_rows(spark):
    docs, labels = corpus(200)
    rows = [*docs, (900, None, None, None, None, None), (901, "", "en", "s0", 0, None), (None, "word1", "en", "s0", 5, None), (0, *docs[0][1:]), (902, "word1 " * 50000, "en", "s0", 300000, None)]
    got = classify_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (2, None, 0)], LABELS)).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    none = classify_quality(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert [(r.score, r.keep) for r in none] == [(0.5, True)] * 3
    assert classify_quality(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
