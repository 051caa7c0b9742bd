"""Shared Spark building blocks of the training-data operators.

* ``materialise``: cut lineage through the reliable checkpoint folder.
* ``hashed_prefix``: running sums in a fixed pseudo-random order, without one task per group.
* ``hot_blocks`` / ``scan_groups``: compare the members of a bucket in bounded blocks.
* ``connected_components``: alternating large-star / small-star.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows.

    The folder is the one that the cluster names in ``spark.checkpoint.dir`` (see ``shared_folder``).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return context.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove written rows that nothing reads any more, in whatever store they lie."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def hashed_prefix(df: DataFrame, group: list[str], order: str, ties: list[str], value: str, out: str, digits: int = 3) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, within ``group``, by ``order``.

    ``order`` is a lower-case hexadecimal hash, so its first ``digits`` characters split every group,
    however large, into ``16**digits`` even ranges that follow the same order. A window runs within a
    range only; the ranges' totals give the offsets. Null group keys form a group of their own.
    """
    ranged = df.withColumn("__range", F.substring(order, 1, digits))
    totals = ranged.groupBy(*group, "__range").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    within = Window.partitionBy(*group, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("__inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    right = totals.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__r"), "__offset")
    on = F.col("__range") == F.col("__r")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    drop = ["__range", "__inner", "__r", "__offset", *[f"__g{i}" for i in range(len(group))]]
    return inner.join(right, on).withColumn(out, F.col("__inner") + F.col("__offset")).drop(*drop)


def hot_blocks(rows: DataFrame, key: str, member: str, block: int, broadcast_limit: int = 5000) -> DataFrame:
    """Deal the rows of every bucket ``key`` to block pairs ``(__i, __j)`` of at most about 2 x ``block`` rows.

    A bucket of at most ``block`` rows is one pair (0, 0). A larger one is split by a hash of ``member``
    into blocks, and every pair of blocks meets once, so all pairs of rows can still be compared while no
    task holds the whole bucket. The list of large buckets is broadcast only if it is at most
    ``broadcast_limit`` rows; beyond that it is joined by a shuffle. ``__b`` is the row's own block: two rows
    of one block are to be compared in its pair with itself alone (see ``near_pairs``).
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block)
    hot = materialise(hot.select(F.col(key).alias("__hot"), F.ceil(F.col("__n") / F.lit(block)).cast("int").alias("__nb")))
    known = hot.count()
    if known == 0:
        return rows.withColumns({"__i": F.lit(0), "__j": F.lit(0), "__b": F.lit(0)})
    joined = rows.join(F.broadcast(hot) if known <= broadcast_limit else hot, rows[key] == hot["__hot"], "left").drop("__hot")
    nb = F.coalesce(F.col("__nb"), F.lit(1))
    dealt = joined.withColumn("__nb", nb).withColumn("__b", F.pmod(F.xxhash64(member), F.col("__nb")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return dealt.withColumns({"__i": F.least("__b", "__o"), "__j": F.greatest("__b", "__o")}).drop("__o", "__nb")


def scan_groups(rows: DataFrame, keys: list[str], columns: list[str], compare: Callable[[np.ndarray, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``compare(group_number, columns)`` over whole groups, several groups at a time.

    Rows are shuffled and sorted by ``keys``; a task streams through its rows and keeps back only the
    last, perhaps unfinished group, which is bounded by what ``hot_blocks`` dealt to it.
    """
    columns = list(dict.fromkeys([*columns, "__i", "__j", "__b"]))
    dealt = rows.select(*dict.fromkeys([*keys, *columns])).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])]).combine_chunks()
            group = _numbered(whole, keys)
            first = int(np.searchsorted(group, group[-1]))
            kept = whole.slice(first)
            if first:
                yield from compare(group[:first], _arrays(whole.slice(0, first), columns))
        if kept is not None and kept.num_rows:
            yield from compare(np.zeros(kept.num_rows, dtype=np.int64), _arrays(kept, columns))

    return dealt.mapInArrow(run, schema)


def _numbered(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _arrays(rows: pa.Table, columns: list[str]) -> dict:
    return {c: rows.column(c).to_numpy() if pa.types.is_primitive(rows.schema.field(c).type) else rows.column(c) for c in columns}


def near_pairs(group: np.ndarray, x: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (left, right) of all row pairs to compare in each group, one distance in the list at a time."""
    own, alone = x["__b"], x["__i"] == x["__j"]
    n, shift = len(group), 1
    while shift < n:
        left = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(left):
            return
        left = left[alone[left] | (own[left] != own[left + shift])]
        if len(left):
            yield left, left + shift
        shift += 1


def forest(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the minimum spanning forest of the given edges: at most one edge per node joins it.

    Equal weights are ordered by the nodes, so lists with the same nodes give the same edges. Every component takes its
    least edge to another one until none is left.
    """
    if not len(left):
        return np.zeros(0, dtype=np.int64)
    low, high = np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((high, low, weight))
    nodes, ends = np.unique(np.concatenate((low[order], high[order])), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    component, keep = np.arange(len(nodes)), np.zeros(len(order), dtype=bool)
    while True:
        x, y = component[a], component[b]
        alive = np.flatnonzero(x != y)
        if not len(alive):
            return np.sort(order[keep])
        both, edge = np.concatenate((x[alive], y[alive])), np.concatenate((alive, alive))
        by = np.argsort(edge, kind="stable")
        own, first = np.unique(both[by], return_index=True)
        least = edge[by][first]
        keep[least] = True
        parent = np.arange(len(nodes))
        parent[own] = np.where(x[least] == own, y[least], x[least])
        parent = np.where((parent[parent] == np.arange(len(nodes))) & (np.arange(len(nodes)) < parent), np.arange(len(nodes)), parent)
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        component = parent[component]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """``(id, component)`` for every node of ``edges``; ``component`` is the smallest id that is reachable.

    Alternating large-star and small-star steps: each keeps the components and pulls nodes towards the
    smallest one they know, in O(log^2 n) rounds. Minima are aggregated before the shuffle and joined
    back, so a hub is a skewed join, which adaptive execution splits, never one group in one task.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v").filter("u IS NOT NULL AND v IS NOT NULL")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(e)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().join(leaves.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
