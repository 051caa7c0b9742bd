import random
from collections import Counter, defaultdict

import pyarrow as pa

from textloom.operators import grams

WORDS = [*"abcde", "é"]


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield rng.choice(["t", "u", None]), rng.choice(["s0", "s1", "s2", None]), [rng.choice(WORDS) for _ in range(rng.randrange(9))]


def plain(rows):
    per = defaultdict(Counter)
    for topic, source, words in rows:
        for n in (2, 3, 4):
            for i in range(len(words) - n + 1 if topic else 0):
                per[topic, " ".join(words[i : i + n])][source] += 1
    out = {}
    for key, counts in per.items():
        own = sorted(n for source, n in counts.items() if source is not None)
        k = len(own)
        ends = (own[0], (own[(k - 1) // 2] + own[k // 2]) // 2, own[-1]) if own else (1, 1, 1)
        out[key] = (sum(own), sum(counts.values()), k, None in counts, *ends)
    return out


def figures(rows):
    return {(r["topic_id"], r["gram"]): tuple(r[c] for c in ("freq", "freq_total", "sources", "in_signals", "freq_min", "freq_median", "freq_max")) for r in rows}


def test_statistics_of_runs_equal_plain_counts(spark):
    rows = list(texts(300, 7))
    frame = spark.createDataFrame([(*r[:2], k, r[2]) for k, r in enumerate(rows)], "topic_id string, src_idx string, doc_id int, words array<string>")
    want = plain(rows)
    stats = grams.gram_stats(grams.gram_runs(frame))
    assert figures(stats.collect()) == want
    assert figures(grams.gram_stats(grams.gram_runs(frame), 10**8).collect()) == want  # in more tasks
    fewer = figures(grams.gram_stats(grams.gram_runs(frame), single=False).collect())
    assert fewer == {k: v for k, v in want.items() if v[:2] != (1, 1)} and len(fewer) < len(want)


def test_a_place_of_a_text_is_shuffled_once(spark):
    frame = spark.createDataFrame([("t", "s", 1, list("abcabc"))], "topic_id string, src_idx string, doc_id int, words array<string>")
    stats = grams.gram_stats(grams.gram_runs(frame))
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert grams.gram_runs(frame).count() == 5  # not one for every length


def test_a_task_takes_equal_runs_together(monkeypatch):
    monkeypatch.setattr(grams, "HELD_RUNS", 20)
    rows = list(texts(200, 3))
    runs = [(t, s, " ".join(w[i : i + 4])) for t, s, w in rows if t for i in range(len(w) - 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("topic_id", "src_idx", "run"), r)) for r in runs[k : k + 7]], pa.schema([(c, pa.string()) for c in ("topic_id", "src_idx", "run")])) for k in range(0, len(runs), 7)]
    found = [r for b in grams._counted(iter(batches), True) for r in b.to_pylist()]
    assert figures(found) == plain(rows) and len(found) == len(plain(rows))
    assert list(grams._counted(iter([]), True)) == []


def test_trigrams_of_a_text_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "one two three " * 5), (1, "one two three four"), (None, "seven eight nine " * 4), (2, None)], "doc_id int, text string")
    found = grams.repeated_trigrams(rows, ["the"])
    got = {(r.doc_id, r.gram): r.n for r in found.collect()}
    assert got == {(1, "one two three"): 5, (1, "two three one"): 4, (1, "three one two"): 4, (None, "seven eight nine"): 4}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    assert "REPARTITION" in found._jdf.queryExecution().executedPlan().toString()


ODD = [*"abcde", "é", "0", "!", "\x01", "a1"]  # some look like short forms


def odd_texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        words = None if k % 17 == 0 else [ODD[min(rng.randrange(10), rng.randrange(10))] for _ in range(rng.randrange(9))]
        yield rng.choice(["t", "u", None]), rng.choice(["s0", "s1", None]), k, words


def test_packed_runs_have_the_counts_of_all_grams(spark):
    rows = list(odd_texts(400, 5))
    frame = spark.createDataFrame(rows, "topic_id string, src_idx string, doc_id int, words array<string>")
    want = plain((t, s, w or []) for t, s, _, w in rows)
    stats, tops = grams.text_gram_stats(frame, 30_000_000)
    assert figures(stats.collect()) == want
    assert {r["topic_id"]: r["top"] for r in tops.collect()} == {t: max(v[1] for (x, _), v in want.items() if x == t) for t in "tu"}
    fewer = figures(grams.text_gram_stats(frame, single=False)[0].collect())
    assert fewer == {k: v for k, v in want.items() if v[:2] != (1, 1)} and len(fewer) < len(want)


def test_packs_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(grams, "HELD_RUNS", 25)
    monkeypatch.setattr(grams, "PACKED_WORDS", 25)
    rows = [r for r in odd_texts(300, 9) if r[0]]
    schema = pa.schema([("topic_id", pa.string()), ("src_idx", pa.string()), ("words", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (t, s, w))) for t, s, _, w in rows[k : k + 40]], schema) for k in range(0, len(rows), 40)]
    forms = {"a": "0", "b": "!", "é": "00"}
    packs = [r for b in grams._packed(iter(batches), 3, forms, 4) for r in b.to_pylist()]
    parts = {p: pa.RecordBatch.from_pylist([{c: r[c] for c in r if c != "part"} for r in packs if r["part"] == p]) for p in range(3)}
    found = [r for x in parts.values() for b in grams._counted_packs(iter([x]), True, {v: k for k, v in forms.items()}) for r in b.to_pylist()]
    want = plain((t, s, w or []) for t, s, _, w in rows)
    assert figures(found) == want and len(found) == len(want)  # no gram in two parts


def test_little_is_shuffled_of_frequent_words(spark):
    rng = random.Random(1)
    rows = [("t", f"s{k % 3}", k, ["frequent" + rng.choice("abcdefghij") for _ in range(200)]) for k in range(100)]
    frame = spark.createDataFrame(rows, "topic_id string, src_idx string, doc_id int, words array<string>")
    packed = grams.packed_runs(frame, 4, grams.short_forms(frame)).collect()
    runs = grams.gram_runs(frame).collect()
    assert len(packed) < len(runs) / 50
    assert sum(len(r["runs"]) for r in packed) < sum(len(r["run"]) for r in runs) / 4


def test_what_goes_to_a_task_is_compressed_together(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(1 + k % 2, f"s{k % 20}", k, [words[int(300 * rng.random() ** 2)] for _ in range(300)]) for k in range(200)]
    frame = spark.createDataFrame(rows, "topic_id int, src_idx string, doc_id int, words array<string>").coalesce(1)
    packed = grams.packed_runs(frame, 50, grams.short_forms(frame)).collect()
    assert len(packed) == 50  # not one for every topic and source too
    runs = sum(max(len(r[3]) - 1, 0) for r in rows)
    assert sum(len(r["runs"]) for r in packed) < 9 * runs  # 4 words of 1 to 3 characters and what parts them
    assert figures(grams.text_gram_stats(frame)[0].collect()) == plain((t, s, w) for t, s, _, w in rows)


def test_displays_of_packed_pairs(spark):
    rows = list(odd_texts(300, 11))
    frame = spark.createDataFrame(rows, "topic_id string, src_idx string, doc_id int, words array<string>")
    lemmas = {"b": "a", "c": "a", "é": "e"}
    toks = grams.lemma_words(frame, lemmas)
    per = defaultdict(Counter)
    for topic, _, _, words in rows:
        for x in zip(words or [], (words or [])[1:]):
            per[topic, " ".join(lemmas.get(w, w) for w in x)][" ".join(x)] += 1
    want = {k: (min(c, key=lambda s: (-c[s], s.encode())), sum(c.values())) for k, c in per.items()}
    found = grams.text_gram_displays(toks).collect()
    assert {(r["topic_id"], r["gram"]): (r["display"], r["freq"]) for r in found} == want and len(found) == len(want)


def test_extended_terms_of_the_first_grams_alone(spark):
    rng = random.Random(4)
    rows = [("t", f"g{k}", rng.randrange(2, 9), 10, rng.random()) for k in range(200)] + [("u", "x", 3, 10, 0.5)]
    weighted = spark.createDataFrame(rows, "topic_id string, gram string, sources int, n_sources int, weight double")
    top = grams.top_grams(weighted, 30)
    known = {r["gram"] for r in top.collect()}
    want = sorted((r for r in rows if r[0] == "t" and r[1] not in known and 3 <= r[2] <= 8), key=lambda r: (-r[2], -r[4], r[1]))[:15]
    extended = grams.extended_terms(weighted, top)
    assert [r["gram"] for r in extended.orderBy("rank").collect()] == [r[1] for r in want]
    assert extended._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3  # ranked before the join too


def test_displays_are_sought_where_a_gram_begins(spark):
    words = "the car drives a car the cars drive".split()
    rows = [("t", "s", i, [w for k, w in enumerate(words * 3) if (i + k) % 5]) for i in range(20)] + [("t", "s", 90, None), ("u", "s", 91, ["the", "car"])]
    toks = grams.lemma_words(spark.createDataFrame(rows, "topic_id string, src_idx string, doc_id int, words array<string>"), {"cars": "car", "drives": "drive"})
    top = spark.createDataFrame([("t", "the car", 1), ("t", "car drive", 2), ("t", "a car the", 3), ("t", "no such", 4), ("u", "the car", 1)], "topic_id string, gram string, rank int")
    shown = grams.with_displays(top, toks, True)
    assert "MapInArrow" in shown._jdf.queryExecution().executedPlan().toString()
    lemma, want = {"cars": "car", "drives": "drive"}, {}
    for r in top.collect():
        n, uses = len(r.gram.split()), {}
        for topic, _, _, w in rows:
            for i in range(len(w or []) - n + 1 if topic == r.topic_id else 0):
                if " ".join(lemma.get(x, x) for x in w[i : i + n]) == r.gram:
                    uses[" ".join(w[i : i + n])] = uses.get(" ".join(w[i : i + n]), 0) + 1
        want[r.topic_id, r.gram] = min(uses, key=lambda s: (-uses[s], s)) if uses else None
    assert {(r.topic_id, r.gram): r.display for r in shown.collect()} == want and want["t", "no such"] is None


def test_both_lists_of_one_pass_are_those_of_all_grams(spark):
    rows = [("t", f"g{i:03}", i % 11, i % 7 + 1, 10 if i % 3 else 2, ((i * 37) % 100) / 100) for i in range(200)]
    weighted = spark.createDataFrame(rows, "topic_id string, gram string, freq long, sources long, n_sources long, weight double")
    some = grams.listed_grams(weighted, 4, 6)
    assert some.count() <= 6 + 4 + 4 + 6 and some.columns == weighted.columns
    for of in (lambda w: grams.top_grams(w, 6), lambda w: grams.extended_terms(w, grams.top_grams(w, 6), 4, 6)):
        assert sorted(map(tuple, of(some).collect())) == sorted(map(tuple, of(weighted).collect()))
