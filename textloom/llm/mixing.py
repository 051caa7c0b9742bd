"""Operator 10: mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Each source gets a target number of words: its weight's share of the mix, at most ``cap`` times its size,
the excess shared again by weight. Whole passes and one partial pass over the source, in a fixed hashed
order, meet the target to within half a document. A source's weight changes over training from ``start``
to ``end``; the schedule's integral is its cumulative token demand, and a document stands where that
demand reaches the middle of the document's words: the inverse of the integral. Rows are range-sorted by
this position.

Defined results: a null text has no words, is never needed and is taken any number of times at no cost;
a null source is a source of its own, after all others; null ids and repeated rows are rows like any
other; an empty table gives an empty result; extra columns are ignored. The order depends on a row's id,
source and text alone, so reruns agree and rows of one id, or without one, spread like others; only rows that
are equal in all three stand together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.llm.common import free_name, hashed_prefix, materialise

WORD = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, column: str) -> DataFrame:
    """Add ``rank`` from 0 by ``column`` in code point order, null last, over range partitions."""
    parts = materialise(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last())) - 1
    return parts.withColumn("__within", within).join(counts, "__part").withColumn("rank", F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` from ``sizes(source, size)``.

    The level, words per unit of weight, rises until no source stands above its cap; each step is one
    aggregation over the sources.
    """
    totals = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    totals = materialise(totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    demand = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)
    while True:
        free, held = totals.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most")))).first()
        higher = (demand - (held or 0.0)) / free if free else math.inf
        if higher <= level:
            break
        level, full = higher, F.lit(higher) * F.col("weight") > F.col("most")
        if math.isinf(level):
            break
    return totals.withColumn("target", F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("weight"))).drop("most")


def schedule_position(done: Column, start: Column, end: Column) -> Column:
    """The time in [0, 1] at which a weight that runs linearly from ``start`` to ``end`` has met the share ``done``."""
    root = F.sqrt(start * start + (end * end - start * start) * done)
    return F.when(start == end, done).otherwise((root - start) / F.when(start == end, F.lit(1.0)).otherwise(end - start))


def row_order(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash of a row's id, source and text: its place in the order of its source."""
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    return F.md5(F.concat_ws("|", named(doc_id.cast("string")), named(source), named(F.md5(text))))


def placed_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, schedules: tuple[tuple[float, float], ...]) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    order = row_order(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order")))
    targets = source_targets(rows, weights, share, cap)
    begin, finish = (F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), (F.pmod("rank", F.lit(len(schedules))) + 1).cast("int")) for k in (0, 1))
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target", begin.alias("begin"), finish.alias("finish"))
    placed = hashed_prefix(rows, ["source"], "order", [], "size", "before")
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["__source"])).drop("__source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    part = (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")) & (F.col("size") > 0)
    joined = joined.withColumn("copies", F.col("passes") + part.cast("long"))
    middle = lambda i: (i * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest("target", F.lit(1.0))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda i: schedule_position(F.least(F.lit(1.0), middle(i)), F.col("begin"), F.col("finish")))
    positions = F.when(F.col("copies") > 0, each).otherwise(F.array().cast("array<double>"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), "order")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken, positions``.

    ``positions`` has the training position of each copy. ``schedules`` (start, end) repeat over the
    sources like ``weights``.
    """
    return placed_rows(docs, id_col, text_col, source_col, weights, share, cap, schedules).drop("order")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken, range-sorted by position.

    Rows that agree in id, source and text are taken as often as all of them together, with the columns of one of them.
    """
    plan = placed_rows(docs, id_col, text_col, source_col, weights, share, cap, schedules).filter("copies > 0")
    row, at = free_name(docs, "row"), free_name(docs, "position")
    plan = plan.select(F.col("order").alias(row), F.explode("positions").alias(at))
    rows = docs.withColumn(row, row_order(F.col(id_col), F.col(source_col), F.col(text_col))).dropDuplicates([row])
    return rows.join(plan, row).orderBy(at, row).select(*docs.columns)
