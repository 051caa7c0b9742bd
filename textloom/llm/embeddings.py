"""Operator 9: near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so cosine >= c means Euclidean distance <= sqrt(2 - 2c). Each of ``tables`` tables
hashes a vector to the tuple floor((a_k . x + b_k) / width) of ``projections`` Gaussian projections
(2-stable), so close vectors share a bucket of some table with a probability that the parameters set: with
p(d) the chance that one projection joins vectors at distance d, the k projections of a table join a pair with
p(d)**k. k grows with the logarithm of the vectors of the largest label, so that unrelated unit vectors
(d = sqrt 2) meet in ``chance`` of its vectors per vector and table, whatever their number; the tables grow with
n**(ln p(near) / ln p(sqrt 2)), so that a pair at the bound is missed in all of them with ``miss`` at most.
Pairs of a bucket are checked by their cosine in double precision, and counted only in the first table
that they share. Equal vectors of a label are one node with a multiplicity, large buckets are compared in
blocks, and each block writes link counts per node and a spanning forest, never all its pairs. Equal vectors are
told by two 64-bit hashes of label and vector.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows whose
label is null, link with nothing; they are returned with no links, their own id and ``kept`` true. Vectors
of different lengths never link. Repeated rows and equal vectors link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import connected_components, forest, hot_blocks, materialise, near_pairs, scan_groups


def joined(distance: float, width: float) -> float:
    """The chance that one projection puts vectors at ``distance`` into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def index_sizes(vectors: int, cosine: float, width: float, chance: float, miss: float) -> tuple[int, int]:
    """(tables, projections) for the number of vectors that are compared with each other."""
    near, far = joined(math.sqrt(2 - 2 * min(cosine, 1 - 1e-9)), width), joined(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(vectors, 2) / chance) / -math.log(far)))
    return max(1, math.ceil(math.log(miss) / math.log(1 - near**projections))), projections


def projections_of(dims: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims])
    return rng.standard_normal((dims, tables * projections)), rng.uniform(0, width, tables * projections)


def bucket_ids(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket id for each row and table."""
    a, b = projections_of(unit.shape[1], tables, projections, width, seed)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, projections)
    odd = np.random.default_rng([seed, 7]).integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        mixed = (cells * odd).sum(axis=2)
        return mixed ^ (mixed >> np.int64(29)) ^ np.arange(tables, dtype=np.int64) * np.int64(0x5851F42D4C957F2D)


def unit_rows(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of ``dims`` numbers as unit rows in double precision, safe for very large and very small ones."""
    x = np.array(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_links(rows: DataFrame, cosine: float = 0.98, width: float = 2.0, chance: float = 0.1, miss: float = 0.005, seed: int = 11, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(node bigint, label, copies bigint, embedding)``, one row per distinct vector of a label:
    ``(edges(src, dst), counts(node, links))``, where ``links`` sums the copies of linked nodes.
    """
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, projections = index_sizes(largest, cosine, width, chance, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                part = batch.take(pa.array(at))
                ids = bucket_ids(unit_rows(part.column(3), n), tables, projections, width, seed)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables)
                buckets = pa.ListArray.from_arrays(offsets, pa.array(ids.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], part.column(3), buckets], names=["node", "label", "copies", "embedding", "buckets"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = rows.select("node", "label", "copies", "embedding").mapInArrow(hashed, f"node bigint, label {kinds['label']}, copies bigint, embedding {kinds['embedding']}, buckets array<bigint>")
    known = materialise(known.withColumn("dims", F.size("embedding")))
    lists = known.select("node", F.xxhash64("label", "dims").alias("within"), F.posexplode("buckets").alias("own", "bucket")).select("node", "own", F.xxhash64("within", "own", "bucket").alias("key"))
    crowded = lists.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    dealt = hot_blocks(lists.join(crowded, "key", "left_semi"), "key", "node", block).join(known, "node")

    def compare(group: np.ndarray, x: dict) -> Iterator[pa.RecordBatch]:
        node, copies, own, part = x["node"], x["copies"], x["own"], x["label"]
        values, sizes = x["embedding"], x["dims"]
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            unit = unit_rows(values.take(pa.array(at)).combine_chunks(), n)
            ids = np.array(x["buckets"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(at), tables)
            nodes, mult, table, label = node[at], copies[at], own[at], part[at]
            found = []
            for left, right in near_pairs(group[at], {c: x[c][at] for c in ("__i", "__j", "__b")}):
                ok = (nodes[left] != nodes[right]) & (label[left] == label[right])
                left, right = left[ok], right[ok]
                similar = np.einsum("ij,ij->i", unit[left], unit[right])
                ok = similar >= cosine
                left, right = left[ok], right[ok]
                ok = (ids[left] == ids[right]).argmax(axis=1) == table[left]
                if ok.any():
                    found.append((left[ok], right[ok]))
            if found:
                left, right = (np.concatenate(c) for c in zip(*found))
                links = np.bincount(left, mult[right], len(nodes)) + np.bincount(right, mult[left], len(nodes))
                kept = forest(nodes[left], nodes[right], np.zeros(len(left)))
                some = np.flatnonzero(links)
                out = [np.concatenate((nodes[some], nodes[left[kept]])), np.concatenate((np.full(len(some), -1), nodes[right[kept]])), np.concatenate((links[some].astype(np.int64), np.zeros(len(kept), dtype=np.int64)))]
                linked = np.concatenate((np.zeros(len(some), dtype=bool), np.ones(len(kept), dtype=bool)))
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), pa.array(linked)], names=["src", "dst", "links", "edge"])

    compared = materialise(scan_groups(dealt, ["key", "__i", "__j"], ["node", "label", "copies", "own", "dims", "embedding", "buckets"], compare, "src bigint, dst bigint, links bigint, edge boolean"))
    return compared.filter("edge").select("src", "dst"), compared.filter("NOT edge").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))


def vector_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, **index) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    numbers = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound = sound & F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists(numbers, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    bad = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.filter("ok").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("h0"), F.xxhash64(F.lit(1), "label", "embedding").alias("h1"))
    nodes = good.groupBy("h0", "h1").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    edges, counts = vector_links(nodes, cosine, **index)
    component = connected_components(edges)
    placed = nodes.select("node", "h0", "h1", "least", "copies").join(component, nodes["node"] == component["id"], "left").select("node", "h0", "h1", "least", "copies", F.coalesce("component", "node").alias("component"))
    placed = materialise(placed)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").join(counts, "node", "left").select("h0", "h1", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = good.select("vec_id", "h0", "h1").join(named, ["h0", "h1"])
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(bad)
