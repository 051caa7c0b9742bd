"""Operator 3: minimax contiguous partition into shards, in DataFrame operations only.

Copies of a text are one atomic group; groups stand in the order of their text's digest. The smallest
capacity is searched for which greedy filling needs no more than the given number of shards. Filling from the
front gives the last place where each cut may lie under that capacity, filling from the back the first; between
them a cut stands at the known running sum nearest to its even share. The greedy check needs running sums at a few places only: the
driver holds a summary of at most ``points`` running sums, bounds the capacity from both sides with it, and
refines just the stretches in which a cut can still lie until both bounds meet. So the answer is exact
while the driver never holds more than the summary.

Defined results: a null text has size 1 and checksum 0 and groups with other null texts; repeated rows are
rows of their group; fewer groups than shards leave shards empty; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hashed_prefix, materialise


class RunningSums:
    """What is known of increasing running sums: some of them, and where others may lie between."""

    def __init__(self, ends: list[int], open_before: list[bool]):
        self.ends, self.open = np.array(ends, dtype=np.int64), np.array(open_before, dtype=bool)

    def reach(self, limit: int, hopeful: bool) -> int:
        """The largest sum within ``limit``: of the known ones, or at most what an unknown one may be."""
        k = int(np.searchsorted(self.ends, limit, side="right"))
        if hopeful and k < len(self.ends) and self.open[k]:
            return limit
        return int(self.ends[k - 1]) if k else 0

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where greedy filling stands after each shard."""
        out, at = [], 0
        for _ in range(shards):
            out.append(at := self.reach(at + capacity, hopeful))
        return out

    def least_capacity(self, shards: int, least: int, hopeful: bool) -> int:
        low, high, total = least, int(self.ends[-1]), int(self.ends[-1])
        while low < high:
            half = (low + high) // 2
            if self.cuts(half, shards, hopeful)[-1] >= total:
                high = half
            else:
                low = half + 1
        return low

    def refine(self, low: int, high: int, ends: list[int], open_before: list[bool]) -> None:
        """Replace what is known in (low, high] by ``ends``."""
        keep = (self.ends <= low) | (self.ends > high)
        at = np.concatenate((self.ends[keep], np.array(ends, dtype=np.int64)))
        gaps, order = np.concatenate((self.open[keep], np.array(open_before, dtype=bool))), np.argsort(at, kind="stable")
        self.ends, self.open = at[order], gaps[order]


def look_closer(sums: DataFrame, known: RunningSums, stretches: list[tuple[int, int]], points: int) -> None:
    """One aggregation that splits each of ``stretches`` (low, high] of running sums into cells and learns what these hold."""
    bands: list[list[int]] = []
    for a, b in sorted(stretches):
        if bands and a < bands[-1][1]:
            bands[-1][1] = max(b, bands[-1][1])
        else:
            bands.append([a, b])
    share = max(2, points // (2 * len(bands)))
    steps = [max(1, -(-(b - a) // share)) for a, b in bands]
    inside = [(F.col("end") > a) & (F.col("end") <= b) for a, b in bands]
    cell = F.coalesce(*[F.when(c, F.array(F.lit(k).cast("long"), F.floor((F.col("end") - 1 - a) / F.lit(s)).cast("long"))) for k, (c, (a, _), s) in enumerate(zip(inside, bands, steps))])
    found = sums.filter(reduce(lambda x, y: x | y, inside)).groupBy(cell.alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
    by: dict[int, list] = {}
    for r in found.collect():  # at most ``points`` rows
        by.setdefault(r["cell"][0], []).append((r["first"], r["last"], r["n"]))
    for k, (a, b) in enumerate(bands):
        ends, gaps = [], []
        for first, last, n in sorted(by[k]):
            ends.append(first)
            gaps.append(False)
            if n > 1:
                ends.append(last)
                gaps.append(n > 2)
        known.refine(a, b, ends, gaps)


def greedy_capacity(sums: DataFrame, known: RunningSums, shards: int, least: int, points: int, capacity: int | None = None) -> tuple[int, list[int]]:
    """The smallest capacity (or the given one) and where greedy filling cuts under it, both exact."""
    while True:
        low, high = (capacity,) * 2 if capacity else (known.least_capacity(shards, least, hopeful) for hopeful in (True, False))
        sure, hoped = known.cuts(low, shards, hopeful=False), known.cuts(high, shards, hopeful=True)
        if low == high and (capacity is None or sure == hoped):
            return high, known.cuts(high, shards, hopeful=False)[:-1]
        stretches = []
        for a, b in zip(sure, hoped):
            first = int(np.searchsorted(known.ends, a + 1, side="left"))
            last = min(int(np.searchsorted(known.ends, b, side="left")), len(known.ends) - 1)
            within = np.flatnonzero(known.open[first : last + 1]) + first
            if len(within):
                stretches.append((int(known.ends[within[0] - 1]) if within[0] else 0, int(known.ends[within[-1]])))
        look_closer(sums, known, stretches, points)


def minimax_cuts(sums: DataFrame, shards: int, points: int = 4096) -> tuple[int, list[int]]:
    """The smallest capacity for ``sums(size, end)`` and the running sums after which to cut, as even as it allows."""
    total, most = sums.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, []
    known, least = RunningSums([total], [True]), max(most, -(-total // shards))
    look_closer(sums, known, [(0, total)], points)
    capacity, latest = greedy_capacity(sums, known, shards, least, points)
    mirrored, back = sums.select("size", (total - F.col("end") + F.col("size")).alias("end")), RunningSums([total], [True])
    _, found = greedy_capacity(mirrored, back, shards, least, points, capacity)
    earliest = [total - c for c in reversed(found)]
    ends, cuts = np.unique(np.concatenate((known.ends, [e for e in earliest if e > 0]))), []
    for k, (a, b) in enumerate(zip(earliest, latest), 1):
        even, before = total * k / shards, cuts[-1] if cuts else 0
        may = ends[(ends >= max(a, before)) & (ends <= min(b, before + capacity))]
        cuts.append(int(may[np.abs(may - even).argmin()]) if len(may) else max(a, before))
    return capacity, cuts


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, points: int = 4096) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row; the law is ``bytes``."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("null")).cast("binary"), 256).alias("digest"),
    )
    rows = materialise(rows)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    sums = hashed_prefix(groups, [], "digest", [], "size", "before").withColumn("end", F.col("before") + F.col("size"))
    sums = materialise(sums.select("digest", "size", "end"))
    _, cuts = minimax_cuts(sums, shards, points)
    shard = sum([(F.col("end") > c).cast("int") for c in cuts], F.lit(0))
    placed = rows.join(sums.select("digest", shard.alias("shard")), "digest").withColumn("order", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")))
    placed = hashed_prefix(placed.withColumn("one", F.lit(1).cast("long")), ["shard"], "order", ["doc_id"], "one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
