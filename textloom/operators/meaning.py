"""Clusters and rankings by vectors within topics (family H)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.grams import ranked
from textloom.operators.vectors import cosine


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Add ``unit``, the vector by its length, or nulls for a zero vector."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0))))


def entity_clusters(vectors: DataFrame, most: int = 50, threshold: float = 0.72, strong: float = 0.7, limit: int = 8) -> DataFrame:
    """``(label, cluster, vec_id, seed, relevance, cover)``: greedy clusters of the ``most`` vectors nearest to each topic's keyword vector.

    The most relevant free vector gathers the free ones of cosine ``threshold``; groups of two or more, or of a seed over
    ``strong``, stay, ``limit`` of them. The rank limit bounds a topic's group, so one task holds at most ``most`` vectors of it.
    """
    key = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("key"), F.min("vec_id").alias("first"))
    rows = vectors.join(key, "label").filter("vec_id <> first").withColumn("relevance", cosine(F.col("embedding"), F.col("key")))
    rows = ranked(rows.select(F.col("label").alias("topic_id"), "vec_id", "embedding", "relevance"), most, F.desc("relevance"), F.asc("vec_id"))

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["relevance", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(group["embedding"].tolist(), dtype=float)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        near, free, out = unit @ unit.T >= threshold, np.ones(len(x), dtype=bool), []
        for k in range(len(x)):
            if not free[k] or len(out) >= limit:
                continue
            members = [k, *np.flatnonzero(near[k] & free & (np.arange(len(x)) != k)).tolist()]
            free[members] = False
            if len(members) >= 2 or group["relevance"][k] > strong:
                out.append(members)
        cover = lambda r: "must" if r > 0.65 else "should" if r >= 0.45 else "may"
        return pd.DataFrame([(group["topic_id"][0], c, group["vec_id"][m], group["vec_id"][ms[0]], round(float(group["relevance"][ms[0]]), 6), cover(group["relevance"][ms[0]])) for c, ms in enumerate(out) for m in ms], columns=["label", "cluster", "vec_id", "seed", "relevance", "cover"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return rows.groupBy("topic_id").applyInPandas(greedy, f"label {kinds['label']}, cluster bigint, vec_id {kinds['vec_id']}, seed {kinds['vec_id']}, relevance double, cover string")


def rank_headings_semantic(candidates: DataFrame, references: DataFrame, limit: int = 10) -> DataFrame:
    """``(topic_id, rank, id, score, keyword, question, coverage, priority)`` of ``candidates(topic_id, id, embedding)``.

    ``references(topic_id, kind, k, embedding)`` holds a topic's keyword, its first five questions and first twenty
    headings of competitors: a short array that travels with the topic, so no candidate meets another one.
    """
    short = references.filter(((F.col("kind") == "keyword") & (F.col("k") < 1)) | ((F.col("kind") == "question") & (F.col("k") < 5)) | ((F.col("kind") == "heading") & (F.col("k") < 20)))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("embedding"))).alias(kind)
    rows = candidates.join(short.groupBy("topic_id").agg(of("keyword"), of("question"), of("heading")), "topic_id")
    sims = lambda c: F.transform(c, lambda v: cosine(v, F.col("embedding")))
    close = F.filter(sims("heading"), lambda s: s > 0.75)
    rows = rows.withColumns({"kw": F.coalesce(F.get(sims("keyword"), F.lit(0)), F.lit(0.0)), "qs": F.coalesce(F.array_max(sims("question")), F.lit(0.0)), "cv": F.size(close) / F.greatest(F.size("heading"), F.lit(1))})
    score = 0.5 * F.col("kw") + 0.3 * F.col("qs") + 0.2 * F.col("cv")
    rows = rows.select("topic_id", "id", F.round(score, 4).alias("score"), F.round("kw", 4).alias("keyword"), F.round("qs", 4).alias("question"), F.round("cv", 4).alias("coverage"))
    rows = rows.withColumn("priority", F.when(F.col("score") >= 0.65, "must").when(F.col("score") >= 0.5, "high").otherwise("optional"))
    return ranked(rows, limit, F.desc("score"), F.asc("id"))
