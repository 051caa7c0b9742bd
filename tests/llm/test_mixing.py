import pytest
from pyspark.sql import functions as F

from textloom.llm.mixing import curriculum, mixed_documents, schedule_position

DOCS = "doc_id bigint, text string, source string, size string"


def docs(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None, "clash") for i in range(600)]
    rows += [(1000 + i, "w " * 5, "s0", "clash") for i in range(900)]
    return spark.createDataFrame(rows, DOCS)


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(sizes), share * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = cap * sizes[s]
            rest -= target[s]
        free -= above


def test_targets_and_taken_words(spark):
    got = curriculum(docs(spark)).collect()
    assert len(got) == 1500
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r["size"] and len(r.positions) == r.copies
    want = water_fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 7 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, curriculum(docs(spark).repartition(7)).collect()))


def test_position_inverts_the_integral_of_the_schedule(spark):
    for s, e in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)):
        for t in (0.0, 0.2, 0.7, 1.0):
            done = (s * t + (e - s) * t * t / 2) / ((s + e) / 2)
            at = spark.range(1).select(schedule_position(F.lit(done), F.lit(s), F.lit(e))).first()[0]
            assert at == pytest.approx(t, abs=1e-12)


def test_falling_source_stands_earlier(spark):
    got = curriculum(docs(spark)).filter("copies > 0").select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p").alias("p")).collect()
    by = {r.source: r.p for r in got}
    assert by["s0"] < by["s1"] < by["s2"]


def test_mixed_documents_repeat_rows_with_their_columns(spark):
    plan = {r.doc_id: r.copies for r in curriculum(docs(spark)).collect()}
    rows = mixed_documents(docs(spark)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "size"}
    counts = {}
    for r in rows:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for i, n in plan.items() if n}


def test_rows_that_share_ids_or_have_none(spark):
    rows = [(None, f"w {i}", "a", None) for i in range(40)] + [(7, f"v {i} x", "a", None) for i in range(40)] + [(8, "same text", None, None)] * 20 + [(8, "same text", "", None)] * 9
    frame = spark.createDataFrame(rows, DOCS)
    plan, taken = {}, {}
    for r in curriculum(frame).collect():
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.copies
    for r in mixed_documents(frame.repartition(5)).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + 1
    assert taken == {k: n for k, n in plan.items() if n}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, None, None, None), (1, "", "a", None), (1, "", "a", None), (2, "one two", "a", None), (2, "one two", "a", None)]
    got = curriculum(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 4
    assert sum(r.taken for r in got) == 6
    assert curriculum(spark.createDataFrame([], DOCS)).count() == 0
    assert mixed_documents(spark.createDataFrame([], DOCS)).count() == 0
