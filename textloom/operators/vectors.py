"""Similarity of vectors within topics (family H)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def keyword_cosine(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, sim)``: cosine of each vector to its topic's keyword vector, the one with the smallest id.

    One keyword row per topic, found by an aggregation and joined back on the topic.
    """
    key = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("key"))
    return vectors.join(key, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("key")), 6).alias("sim"))


def similar_pairs(vectors: DataFrame, least: float = 0.9, block: int = 1024) -> DataFrame:
    """``(label, a, b, sim)``: all pairs of vectors of a label, ``a`` the smaller id, with a cosine of ``least`` or more; ``least`` is above 0.

    Two vectors whose angles to a third one differ by more than ``acos(least)`` are further apart than that, so vectors go to bins of that
    width by their angle to the label's keyword vector, and only equal and neighbouring bins meet. Bins are dealt to blocks and each pair of blocks is a
    product of matrices, so a task holds two blocks of about ``block`` vectors however large a label or a bin is, and writes no pair below the bound.
    Vectors without length, null ones and those of no label are in no pair.
    """
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    sized = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL").withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).filter("norm > 0 AND norm < 'Infinity'")
    units = sized.select("label", "vec_id", unit.alias("unit"))
    key = units.groupBy("label").agg(F.min_by("unit", "vec_id").alias("key"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("unit"), F.col("key")))))
    rows = units.join(key, "label").select("label", "vec_id", "unit", F.floor(angle / float(np.arccos(least))).cast("int").alias("bin"))
    bins = rows.groupBy("label", "bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = rows.join(bins, ["label", "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    # A vector meets the blocks of its own bin and those of the two bins beside it; a pair of blocks is named by the smaller one first.
    near = bins.select("label", F.col("bin").alias("of"), F.col("parts").alias("others"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    met = dealt.join(near, ["label", "bin"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own, far = F.struct(F.col("bin").alias("bin"), F.col("part").alias("part")), F.struct(F.col("of").alias("bin"), F.col("other").alias("part"))
    met = met.select("label", F.least(own, far).alias("low"), F.greatest(own, far).alias("high"), "vec_id", "unit", (own <= far).alias("left"), (own == far).alias("same"))
    kind = dict(vectors.dtypes)

    def product(held: pa.Table) -> pa.Table:
        matrix = held.column("unit").combine_chunks().flatten().to_numpy().reshape(held.num_rows, -1)
        left, same = held.column("left").to_numpy(), held.column("same").to_numpy()
        ids = held.column("vec_id").to_numpy()
        rows, columns = (np.arange(len(ids)),) * 2 if same[0] else (np.flatnonzero(left), np.flatnonzero(~left))
        sims = matrix[rows] @ matrix[columns].T
        x, y = np.nonzero(sims >= least)
        a, b = ids[rows[x]], ids[columns[y]]
        keep = a < b if same[0] else a != b
        a, b, sims = a[keep], b[keep], sims[x[keep], y[keep]]
        label = held.column("label").combine_chunks().take(pa.array(np.zeros(len(a), dtype=np.int64)))
        return pa.table({"label": label, "a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sims})

    return met.groupBy("label", "low", "high").applyInArrow(product, f"label {kind['label']}, a {kind['vec_id']}, b {kind['vec_id']}, sim double")
