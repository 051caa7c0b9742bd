"""Phrase budgets over texts that arrive in batches, and checks of each text part (family K)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from textloom.operators.checks import occurrences

BUDGET = "phrase string, used long, status string, low_left long, high_left long"


def phrase_uses(texts: DataFrame, budgets: list[tuple[str, int, int]], keys: list[str], text: str = "text") -> DataFrame:
    """``(keys, phrase, low, high, used)`` of every budget in every text, without a join; a null text uses nothing."""
    low = F.lower(F.col(text))

    def use(phrase: str, least: int, most: int) -> Column:
        used = F.coalesce(occurrences(low, F.lit(phrase)), F.lit(0).cast("long"))
        return F.struct(F.lit(phrase).alias("phrase"), F.lit(least).cast("long").alias("low"), F.lit(most).cast("long").alias("high"), used.alias("used"))

    rows = texts.select(*keys, F.explode(F.array(*[use(*b) for b in budgets])).alias("u"))
    return rows.select(*keys, "u.phrase", "u.low", "u.high", "u.used")


def budget_batches(texts: DataFrame, budgets: list[tuple[str, int, int]], topic: str, order: str, text: str = "text") -> DataFrame:
    """``(topic, order, phrase, used, status, low_left, high_left)``: each text of a topic, in order, against what is left.

    As the upper limit is never below the lower one, what is left of both follows from the running sum
    of uses, so the fold is a window.
    """
    rows = phrase_uses(texts, budgets, [topic, order], text)
    so_far = F.sum("used").over(Window.partitionBy(topic, "phrase").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("spent", so_far)
    before = F.greatest(F.col("high") - (F.col("spent") - F.col("used")), F.lit(0))
    status = F.when(F.col("used") > before, "OVER").otherwise("OK")
    left = [F.greatest(F.col(c) - F.col("spent"), F.lit(0)).cast("long").alias(f"{c}_left") for c in ("low", "high")]
    return rows.select(topic, order, "phrase", "used", status.alias("status"), *left)


class SpentBudget(StatefulProcessor):
    """The uses of one phrase in one topic so far, as value state; each arriving text gets its own row against what is left then."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(rows).sort_values(self.order, kind="stable", na_position="first")
        before = (self.spent.get()[0] if self.spent.exists() else 0) + turns["used"].cumsum() - turns["used"]
        spent = before + turns["used"]
        left = (turns["high"] - before).clip(lower=0)
        self.spent.update((int(spent.iloc[-1]),))
        yield pd.DataFrame(
            {
                "topic": [key[0]] * len(turns),
                "turn": turns[self.order],
                "phrase": key[1],
                "used": turns["used"],
                "status": (turns["used"] > left).map({True: "OVER", False: "OK"}),
                "low_left": (turns["low"] - spent).clip(lower=0),
                "high_left": (turns["high"] - spent).clip(lower=0),
            }
        )

    def close(self) -> None:
        pass


def budget_stream(texts: DataFrame, budgets: list[tuple[str, int, int]], topic: str = "topic_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The rows of ``budget_batches`` on a stream, whatever the trigger: one for each text and phrase, in append mode.

    Texts of one micro-batch are taken in ``order``, micro-batches as they arrive; the state is one number for a topic and phrase, kept in the
    RocksDB store, which this asks of the session, and read again after a restart. Of a micro-batch only counts of a topic meet, no texts.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = phrase_uses(texts, budgets, [topic, order], text)
    kinds = {c: texts.schema[c].dataType.simpleString() for c in (topic, order)}
    schema = f"topic {kinds[topic]}, turn {kinds[order]}, {BUDGET}"
    spent = rows.groupBy(topic, "phrase").transformWithStateInPandas(SpentBudget(order), schema, "Append", "None")
    return spent.withColumnsRenamed({"topic": topic, "turn": order})


def check_parts(texts: DataFrame, phrases: list[str], chars: str, keys: list[str], entities: list[str] = [], main: str = "", text: str = "text") -> DataFrame:
    """``(keys, n_phrases, n_chars, n_missing, main_missing, severity, score)`` of each text part.

    Five points off per forbidden phrase, three per missing entity and for a missing main entity, one per banned character, at
    least 0; forbidden phrases are a high finding, missing entities a medium one. A projection only, so ``texts`` may be a table or a stream.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    count = lambda flags: sum([f.cast("long") for f in flags], F.lit(0).cast("long"))
    banned = (F.length(body) - F.length(F.translate(body, chars, ""))).cast("long")
    rows = texts.select(*keys, count([F.contains(low, F.lit(p.lower())) for p in phrases]).alias("n_phrases"), banned.alias("n_chars"), count([~F.contains(low, F.lit(e.lower())) for e in entities]).alias("n_missing"), (~F.contains(low, F.lit(main.lower()))).alias("main_missing"))
    severity = F.when(F.col("n_phrases") > 0, "high").when(F.col("n_missing") > 0, "medium").when(F.col("main_missing") | (F.col("n_chars") > 0), "low").otherwise("none")
    lost = 5 * F.col("n_phrases") + F.col("n_chars") + 3 * F.col("n_missing") + F.when(F.col("main_missing"), 3).otherwise(0)
    return rows.withColumn("severity", severity).withColumn("score", F.greatest(F.lit(0).cast("long"), 100 - lost))
