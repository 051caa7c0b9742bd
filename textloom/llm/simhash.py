"""Operator 5: SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of B bytes that differ in at most d bits agree in at least B - d byte positions, the
guaranteed minimum. Posting lists of single bytes hold 1/256 of all rows, so pairs from them would grow
with the square of the input. The index is therefore keyed by (byte positions, their values) for a set of
position tuples of which every agreement of the guaranteed size contains one. Within a posting list the
shared positional bytes of each pair are tallied, pairs below the minimum are discarded, and the rest is
verified by the exact bit distance. A pair is taken only from the first list that it shares, and of the
links found in a block only a spanning forest is written, so a group of copies never becomes all its pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; repeated rows and equal texts share a fingerprint and so a component; rows without an id get the
component of their fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import connected_components, forest, free_name, hot_blocks, materialise, near_pairs, scan_groups
from textloom.llm.decontaminate import bitmap_of

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers (fixed values) that derive further 64-bit words of a wide fingerprint from one hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

#: Links that a task holds before it thins them to a forest.
FOUND = 100_000
#: Room for rounding in bounds on counts of shingles.
SLACK = 1e-6
#: Columns of the 256 parity bits of a shingle set.
PARITIES = ("s0", "s1", "s2", "s3")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle, repeats included; fewer words give one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 if set in over half the hashes."""
    out = np.zeros(words, dtype=np.uint64)
    if len(hashes):
        for w in range(words):
            h = hashes if w == 0 else _mixed(hashes, MIX[w - 1])
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(h), 65536):
                part = np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[w] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _mixed(h: np.ndarray, odd: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """``(doc_id, f0 .. f<words-1>, content)`` per row; ``content`` hashes the set of shingles."""
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, content = np.zeros((batch.num_rows, words), dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.uint64)
            for k, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_py(), shingle)
                prints[k] = fingerprint(h, words)
                content[k] = xxhash.xxh64_intdigest(np.unique(h).tobytes(), 42) if words > 1 else prints[k, 0]
            columns = [batch.column(0), *[pa.array(prints[:, w].view(np.int64)) for w in range(words)], pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} bigint" for n in names], "content bigint"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def covering_triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions contain one: 20 of them for eight positions.

    Three groups; triples within a group, and two of one group with one of the next.
    """
    groups = [list(range(g, positions, 3)) for g in range(3)]
    out = {t for g in groups for t in combinations(g, 3)}
    for g, following in zip(groups, [*groups[1:], groups[0]]):
        out |= {tuple(sorted((a, b, c))) for a, b in combinations(g, 2) for c in following}
    return sorted(out)


def grouped_pairs(groups: int = 6, size: int = 5) -> list[tuple[int, ...]]:
    """All pairs within consecutive groups of byte positions, for wide fingerprints and larger distances."""
    return [(g * size + a, g * size + b) for g in range(groups) for a, b in combinations(range(size), 2)]


def spanning(node: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right, distance = (np.concatenate(c) for c in zip(*found))
    kept = forest(node[left], node[right], distance)
    return left[kept], right[kept], distance[kept]


def index_links(nodes: DataFrame, words: int, keys: list[tuple[int, ...]], max_distance: int, min_match: int, block: int = 512) -> DataFrame:
    """``(src, dst, distance)``: links of a spanning forest per block of ``nodes(content, f0 ..)``.

    Every pair within ``max_distance`` bits that shares a key is compared, once; the links that are
    written connect the same nodes as all such pairs do.
    """
    names = [f"f{w}" for w in range(words)]
    wide = len(keys[0]) * 8

    def value(positions: tuple[int, ...]):
        bits = F.lit(0).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(F.col(names[p // 8]), 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long"))
            bits = F.shiftleft(bits, 8).bitwiseOR(byte)
        return bits

    lists = F.array(*[F.lit(k << wide).cast("long").bitwiseOR(value(p)) for k, p in enumerate(keys)])
    rows = nodes.select("content", *names, F.explode(lists).alias("key"))
    dealt = hot_blocks(rows, "key", "content", block)
    table = np.array(keys)

    def compare(group: np.ndarray, x: dict) -> Iterator[pa.RecordBatch]:
        node, own = x["content"], x["key"] >> wide
        prints = np.stack([x[n] for n in names], axis=1).view(np.uint64)
        octets = np.ascontiguousarray(prints).view(np.uint8).reshape(len(node), 8 * words)
        found, held = [], 0
        for left, right in near_pairs(group, x):
            tally = (octets[left] == octets[right]).sum(axis=1)
            ok = tally >= min_match
            left, right = left[ok], right[ok]
            distance = np.bitwise_count(prints[left] ^ prints[right]).sum(axis=1, dtype=np.int64)
            ok = (distance <= max_distance) & (node[left] != node[right])
            left, right, distance = left[ok], right[ok], distance[ok]
            if len(left):
                same = octets[left] == octets[right]
                first = same[:, table].all(axis=2).argmax(axis=1)
                ok = first == own[left]
                found.append((left[ok], right[ok], distance[ok]))
                held += int(ok.sum())
            if held > FOUND:  # the forest of a forest and further links is the forest of all links
                found = [spanning(node, found)]
                held = len(found[0][0])
        if found:
            left, right, distance = spanning(node, found)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right]), pa.array(distance)], names=["src", "dst", "distance"])

    return scan_groups(dealt, ["key", "__i", "__j"], ["content", *names, "key"], compare, "src bigint, dst bigint, distance bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``: 64 bits, links at ``max_distance`` (at most 4)."""
    if not 0 <= max_distance <= 4:
        raise ValueError("the covering triples guarantee distances of at most 4")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle).drop("content"))
    nodes = prints.groupBy("f0").agg(F.min("doc_id").alias("least"))
    links = index_links(nodes.select(F.col("f0").alias("content"), "f0"), 1, covering_triples(), max_distance, 8 - max_distance)
    component = connected_components(links)
    placed = nodes.join(component, nodes["f0"] == component["id"], "left").select("f0", "least", F.coalesce("component", "f0").alias("component"))
    placed = materialise(placed)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select(F.col("f0").alias("print"), "component_id")
    joined = prints.join(named, prints["f0"] == named["print"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, text_col: str, shingle: int, sample: int = 5000, least: int = 4, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that are frequent in a sample of the texts.

    They only place frequent shingles last in the order of the prefixes; any order gives the same links.
    """
    part = max(1, docs.count() // sample)
    taken = docs.select(F.col(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), shingle)).view(np.int64))], names=["h"])

    counted = taken.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    hashes, counts = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    by = np.argsort(hashes)
    return hashes[by], counts[by]


def shingle_prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, words: int = 0) -> DataFrame:
    """``(doc_id, row, content, size, s0 .. s3, wide, prefix)`` per row of ``docs``, and the ``f0 .. f<words-1>`` of ``fingerprints``.

    ``row`` is the XXH64 of the text, ``content`` hashes its set of shingles and ``size`` counts them. A bit
    of ``s`` is the parity of the shingles that fall to it, so two sets differ in at least as many shingles
    as their bits differ; ``wide`` is the same with a bit for each shingle, rounded up to a power of two.
    ``prefix`` has the rarest shingles, so many that sets of Jaccard ``similarity`` share one.
    """
    common, names = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle)), [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = common.value
        for batch in batches:
            n = batch.num_rows
            content, size, bits = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64), np.zeros((n, 4), dtype=np.uint64)
            prefixes, wide, prints = [], [], np.zeros((n, words), dtype=np.uint64)
            for k, text in enumerate(batch.column(2)):
                h = shingle_hashes(text.as_py(), shingle)
                prints[k] = fingerprint(h, words)
                h = np.unique(h)
                wide.append(parities(h, 1 << max(8, (len(h) - 1).bit_length())).tobytes())
                content[k], size[k] = xxhash.xxh64_intdigest(h.tobytes(), 42), len(h)
                bits[k] = parities(h >> np.uint64(56), 256).view(np.uint64)
                if len(hashes) and len(h):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
                prefixes.append(h[: max(0, len(h) - math.ceil(similarity * len(h) - SLACK) + 1)].view(np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32))
            values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64))
            columns = [pa.array(content.view(np.int64)), pa.array(size), *[pa.array(bits[:, w].view(np.int64)) for w in range(4)], pa.array(wide, type=pa.binary()), pa.ListArray.from_arrays(offsets, values), *[pa.array(prints[:, w].view(np.int64)) for w in range(words)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "content", "size", *PARITIES, "wide", "prefix", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}, row bigint, content bigint, size bigint", *[f"{s} bigint" for s in PARITIES], "wide binary, prefix array<bigint>", *[f"{f} bigint" for f in names]])
    return docs.select(F.col(id_col).alias("doc_id"), row_of(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the parities of the hashes that fall to each of ``bits`` places, a power of two."""
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def row_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def prefix_pairs(rows: DataFrame, similarity: float, whole: bool, block: int = 512) -> DataFrame:
    """``(src, dst, thinned)``: the pairs of ``rows(key, pos, content, size, s0 .. s3, component)`` that may be similar.

    Pairs of one component are left out. Length, places and parities only reject pairs whose similarity is
    below the bound. Unless ``whole``, lists with several times as many pairs as rows give a minimum spanning forest,
    the same for lists of the same sets, and a row with their key in ``thinned``: those keys are to be read again,
    ``whole``, with the components found.
    """
    dealt = hot_blocks(rows, "key", "content", block)
    share = similarity / (1 + similarity)

    def out(node: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        left, right = (np.concatenate(c) for c in list(zip(*found))[:2])
        pairs = np.unique(np.stack([np.minimum(node[left], node[right]), np.maximum(node[left], node[right])], axis=1), axis=0)
        return batch_of(pairs[:, 0], pairs[:, 1], None)

    def batch_of(src, dst, thinned) -> pa.RecordBatch:
        n = len(src) if src is not None else len(thinned)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, type=pa.int64()) for c in (src, dst, thinned)], names=["src", "dst", "thinned"])

    def compare(group: np.ndarray, x: dict) -> Iterator[pa.RecordBatch]:
        node, size, rest, part = x["content"], x["size"], x["size"] - x["pos"], x["component"]
        bits = np.stack([x[s] for s in PARITIES], axis=1).view(np.uint64)
        found, held, thinned, limit = [], 0, set(), 4 * len(node)
        for left, right in near_pairs(group, x):
            need = share * (size[left] + size[right]) - SLACK
            ok = (part[left] != part[right]) & (np.minimum(rest[left], rest[right]) >= need)
            left, right, need = left[ok], right[ok], need[ok]
            distance = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64)
            ok = distance <= size[left] + size[right] - 2 * need
            left, right, distance = left[ok], right[ok], distance[ok]
            if len(left):
                found.append((left, right, distance))
                held += len(left)
            if held > limit:
                if whole:
                    yield out(node, found)
                    found, held = [], 0
                else:
                    thinned |= set(np.unique(x["key"][np.concatenate([f[0] for f in found])]).tolist())
                    found = [spanning(node, found)]
                    held = len(found[0][0])
        if thinned:
            found = [spanning(node, found)]
        if held:
            yield out(node, found)
        if thinned:
            yield batch_of(None, None, sorted(thinned))

    return scan_groups(dealt, ["key", "__i", "__j"], ["content", "size", "pos", "component", *PARITIES, "key"], compare, "src bigint, dst bigint, thinned bigint")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """``(doc_id, row, content, group_id, kept)``: groups of texts linked by a Jaccard of ``similarity`` or more of their shingle sets.

    Exact: two such sets share a shingle of their prefixes, and every candidate pair that could join two
    groups is checked on the sets themselves. ``kept`` marks one text of a group: of the smallest id, else,
    if no row of the group has one, of a row without.
    """
    prints = materialise(shingle_prefixes(docs, id_col, text_col, shingle, similarity))
    nodes = materialise(prints.drop("doc_id").dropDuplicates(["content"]))
    rows = shared_rows(nodes)
    first = materialise(prefix_pairs(rows.withColumn("component", F.col("content")), similarity, False, block).distinct())
    thinned = first.filter("thinned IS NOT NULL").select(F.col("thinned").alias("key")).distinct()
    again = materialise(rows.join(thinned, "key", "left_semi"))
    asked = first.filter("thinned IS NULL").select("src", "dst")
    links = similar_pairs(docs, text_col, nodes, asked, shingle, similarity)
    component = materialise(connected_components(links))
    known = again.join(component.withColumnRenamed("id", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    further = prefix_pairs(materialise(known), similarity, True, block).select("src", "dst").distinct().join(asked, ["src", "dst"], "left_anti")
    more = similar_pairs(docs, text_col, nodes, materialise(further), shingle, similarity)
    component = materialise(connected_components(links.unionByName(more)))
    return kept_rows(prints, component)


def kept_rows(prints: DataFrame, component: DataFrame) -> DataFrame:
    """``(doc_id, row, content, group_id, kept)`` of ``prints(doc_id, row, content)`` under ``component(id, component)`` of the contents."""
    placed = prints.select("doc_id", "row", "content").join(component.withColumnRenamed("id", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    placed = materialise(placed)
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    joined = placed.join(placed.groupBy("component").agg(first_row), "component")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return joined.select("doc_id", "row", "content", F.col("least.doc_id").alias("group_id"), kept.alias("kept"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_distance: int = 54) -> DataFrame:
    """The columns and the groups of ``near_duplicate_groups``, found through the inverted index of 256-bit fingerprints and completed.

    60 posting lists of two byte positions each find a pair of similarity 0.8 with a probability of about 0.95, and nearly
    all above 0.9. Of the pairs of a block within ``max_distance`` bits the links of a minimum spanning forest are checked on the shingle
    sets themselves. What a forest leaves out or the index misses follows: every pair of two groups so far that shares a shingle of its
    prefixes and that length, places and parities allow is checked on the sets, so no link is lost. Pairs of one group are not made.
    """
    names = [f"f{w}" for w in range(4)]
    prints = materialise(shingle_prefixes(docs, id_col, text_col, shingle, similarity, words=4))
    nodes = materialise(prints.drop("doc_id").dropDuplicates(["content"]))
    asked = materialise(index_links(nodes.select("content", *names), 4, grouped_pairs(), max_distance, 2).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    links = similar_pairs(docs, text_col, nodes, asked, shingle, similarity)
    component = materialise(connected_components(links))
    known = shared_rows(nodes).join(component.withColumnRenamed("id", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    further = prefix_pairs(materialise(known), similarity, True).select("src", "dst").distinct().join(asked, ["src", "dst"], "left_anti")
    more = similar_pairs(docs, text_col, nodes, materialise(further), shingle, similarity)
    return kept_rows(prints, connected_components(links.unionByName(more)))


def shared_rows(nodes: DataFrame, bits: int = 25) -> DataFrame:
    """``(content, size, s0 .. s3, pos, key)`` of the prefixes' shingles that more than one prefix may hold.

    A bitmap of fixed size tells them; where its places meet, a shingle of one prefix stays, which pairs with none.
    """
    often = nodes.select(F.explode("prefix").alias("hash")).groupBy("hash").count().filter("count > 1").select("hash")
    seen = nodes.sparkSession.sparkContext.broadcast(np.packbits(bitmap_of(often, bits)))
    names = ["content", "size", *PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = seen.value
        for batch in batches:
            lists = batch.column(len(names))
            key, length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(length)), length)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
            low = key & ((1 << bits) - 1)
            ok = np.flatnonzero(packed[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            for at in range(0, len(ok), 10_000):
                k = ok[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of[k])) for c in range(len(names))], pa.array(pos[k].astype(np.int64)), pa.array(key[k])], names=[*names, "pos", "key"])

    return materialise(nodes.select(*names, "prefix").mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "pos", "key"])))


def shingle_members(docs: DataFrame, text_col: str, nodes: DataFrame, asked: DataFrame, shingle: int, bits: int = 25) -> DataFrame:
    """``(content, members)``: the shingle sets of the contents ``asked``.

    A bitmap of fixed size keeps most texts that are not asked for out of the shuffle.
    """
    asked = materialise(asked.distinct().join(nodes.select("content", "row"), "content"))
    seen = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap_of(asked.select(F.col("row").alias("hash")), bits)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(0).to_numpy() & ((1 << bits) - 1)
            at = np.flatnonzero(seen.value[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            if len(at):
                yield batch.take(pa.array(at))

    texts = docs.select(row_of(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(held, "row bigint, text string").join(asked, "row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.unique(shingle_hashes(text.as_py(), shingle)).view(np.int64) for text in batch.column(1)]
            values = pa.array(np.concatenate(members) if members else np.zeros(0, dtype=np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["content", "members"])

    return materialise(texts.dropDuplicates(["content"]).select("content", "text").mapInArrow(sets, "content bigint, members array<bigint>"))


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(src, dst)`` whose wide parities allow Jaccard ``similarity``; they reject pairs below it only."""
    side = lambda end, k: nodes.select(F.col("content").alias(end), F.col("size").alias(f"size{k}"), F.col("wide").alias(f"wide{k}"))
    both = pairs.join(side("src", 0), "src").join(side("dst", 1), "dst").select("src", "dst", "size0", "size1", "wide0", "wide1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = total - 2 * (similarity / (1 + similarity) * total - SLACK)
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            yield batch.select(["src", "dst"]).filter(pa.array([parity_distance(x, y) <= m for x, y, m in zip(a, b, most)], type=pa.bool_()))

    return both.mapInArrow(run, "src bigint, dst bigint")


def parity_distance(a: bytes, b: bytes) -> int:
    """Differing parities, the longer ones folded to the length of the shorter."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar_pairs(docs: DataFrame, text_col: str, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs(src, dst)`` of contents whose shingle sets have Jaccard ``similarity`` or more."""
    return jaccard_pairs(docs, text_col, nodes, materialise(plausible_pairs(pairs, nodes, similarity)), shingle, similarity)


def jaccard_pairs(docs: DataFrame, text_col: str, nodes: DataFrame, asked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of ``asked(src, dst)`` whose shingle sets themselves have the similarity; of ``nodes(content, row)``."""
    held = shingle_members(docs, text_col, nodes, asked.select(F.explode(F.array("src", "dst")).alias("content")), shingle)
    pair = asked.join(held.select(F.col("content").alias("src"), F.col("members").alias("a")), "src").join(held.select(F.col("content").alias("dst"), F.col("members").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return materialise(pair.filter(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared) - F.lit(SLACK)).select("src", "dst"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, once even if that row is repeated.

    The groups are those of ``simhash_groups``. Rows without an id stay only if no member of their group has one, and then once.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, similarity)
    key = free_name(docs, "key")
    kept = groups.filter("kept").select(row_key(F.col("doc_id"), F.col("row")).alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col(id_col), row_of(text_col))).join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def row_key(doc_id: Column, row: Column) -> Column:
    """A row's id and text, also where the id is null, as one column: the join and the removal of repeats share its shuffle."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), row.cast("string"))
