import pytest
from pyspark.sql import functions as F

from textloom.streaming import budgets


LIMITS = [("red", 1, 3), ("blue", 0, 1)]
SCHEMA = "topic_id string, turn long, text string"
PARTS = [("a", 1, "red red blue"), ("a", 2, "red"), ("a", 3, "red blue"), ("a", 4, "blue red red"), ("b", 1, "none"), ("b", 3, None), ("c", 2, "red red red red"), ("c", 5, "red")]


@pytest.mark.parametrize("batches", [[[1], [2], [3], [4], [5]], [[1, 2, 3, 4, 5]], [[1, 2], [3, 4, 5]]])
def test_stream_gives_the_batch_rows_whatever_the_trigger(spark, tmp_path, batches):
    """Every batch of turns is a run of its own, so each one restarts from the stored state."""
    frame = spark.createDataFrame(PARTS, SCHEMA)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for turns in batches:
        frame.filter(F.col("turn").isin(turns)).orderBy(F.desc("turn")).coalesce(1).write.mode("append").parquet(source)
        stream = budgets.budget_stream(spark.readStream.schema(SCHEMA).parquet(source), LIMITS)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    columns = ["topic_id", "turn", "phrase", "used", "status", "low_left", "high_left"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    want = sorted(map(tuple, budgets.budget_batches(frame, LIMITS, "topic_id", "turn").select(columns).collect()))
    assert got == want
    assert ("a", 4, "red", 2, "OVER", 0, 0) in got and ("a", 2, "red", 1, "OK", 0, 0) in got


def test_parts_score(spark):
    frame = spark.createDataFrame([(1, "In summary 5%"), (2, None), (3, "%" * 200)], "id int, text string")
    got = {r.id: (r.n_phrases, r.n_chars, r.score) for r in budgets.check_parts(frame, ["in summary"], "%", ["id"]).collect()}
    assert got == {1: (1, 1, 94), 2: (0, 0, 100), 3: (0, 200, 0)}
