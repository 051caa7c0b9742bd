from textloom.operators import headings
from textloom.sources import pages


def test_json_sources_and_upsert(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"doc_id": 1, "text": "a b", "lang": "en", "source": "s", "other": 5}\n{"doc_id": 2, "lang": "de"}\n')
    rows = pages.read_sources(spark, str(tmp_path / "in.json"), "json")
    assert sorted(map(tuple, rows.collect())) == [("de", None, 2, None), ("en", "s", 1, "a b")]
    path = str(tmp_path / "out")
    pages.upsert_topics(rows.select("topic_id", "doc_id"), path)
    pages.upsert_topics(spark.createDataFrame([("en", 7), ("fr", 8)], "topic_id string, doc_id long"), path)
    got = spark.read.schema("doc_id long, topic_id string").parquet(path)
    assert sorted((r.topic_id, r.doc_id) for r in got.collect()) == [("de", 2), ("en", 7), ("fr", 8)]


def test_plan_size_is_clamped(spark):
    rows = spark.createDataFrame([(6, 5, 30, 2000), (1, 0, 0, 2000), (9, 12, 60, 4000), (6, 6, 18, 500)], "m long, s long, e long, l long")
    assert [r[0] for r in rows.select(headings.plan_size(rows.m, rows.s, rows.e, rows.l)).collect()] == [6, 4, 8, 4]


def test_stream_replaces_topics_of_each_batch(spark, tmp_path):
    schema, source, path = "topic_id string, doc_id long", str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("en", 1), ("de", 2)], [("en", 7)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        pages.upsert_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema("doc_id long, topic_id string").parquet(path)
    assert sorted((r.topic_id, r.doc_id) for r in got.collect()) == [("de", 2), ("en", 7)]
