"""Operator 6: benchmark decontamination by template canonicalisation.

Numbers, quantities, units and names become typed placeholders; runs of names become one. A second form
leaves names as words whatever their case, for passages quoted in capitals. Windows of
``window`` template tokens are hash-joined between the benchmark and the documents. A document side window
reaches the join only if a bitmap of fixed size, filled from the benchmark's windows, knows its hash, so
the shuffle is small whatever the size of either side. Along each alignment (document place minus item
place) the placeholders' values must be consistent: one value of the item always stands for one value in
the document. That catches an item with other numbers or names, and rejects chance meetings of templates.
A document is contaminated by an item if consistent alignments cover at least ``coverage`` of its windows
in either form. An item without a window of at least ``plain`` ordinary words is one window of its own
length, of its very words and numbers in any case.

Defined results: items without a word or number are never matched; null and empty texts match nothing; repeated rows give equal
results once; rows without an id are told apart by their text; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

#: Units that follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr hrs day days week weeks year years hour hours minute minutes second seconds c f k hz khz mhz ghz v w kw mw j kj cal kcal pa kpa bar percent dollars euros cents usd eur gbp meters metres kilometers kilometres miles feet inches grams kilograms liters litres pounds".split())
EDGE = " \t\"'`.,;:!?()[]{}<>*_#|«»“”‘’…-–—&%$"
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
QUANTITY = re.compile(r"[+-]?\d[\d.,]*[a-z°%€$£]+")
WORD, NUM, QTY, NAME, UNIT = range(5)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Forms of windows: typed names, names as words, whole short items.
TYPED, BLIND, WHOLE = range(3)


class Canonicaliser:
    """Texts to template tokens: hashes, kinds and the values behind placeholders."""

    def __init__(self, memory: int = 150_000):
        self.memory = memory
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes, self.flags = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.int64)
        self.cores: list[str] = []

    def _learn(self, chunk: str) -> int:
        core = chunk.strip(EDGE)
        low = core.lower()
        kind = WORD
        if core[:1].isdigit() or core[:1] in ("+", "-"):
            kind = NUM if NUMBER.fullmatch(core) else QTY if QUANTITY.fullmatch(low) else WORD
        capital = core[:1].isupper()
        ends = chunk.rstrip("\"')]}»”*_#$%&|").endswith((".", "!", "?", ":"))
        self.known[chunk] = at = len(self.cores)
        if at == len(self.flags):
            self.hashes, self.flags = np.concatenate((self.hashes, self.hashes)), np.concatenate((self.flags, self.flags))
        self.hashes[at] = xxhash.xxh64_intdigest(low, 42)
        self.flags[at] = kind | (8 if capital else 0) | (16 if ends else 0) | (32 if not core else 0) | (64 if low in UNITS else 0)
        self.cores.append(low)
        return at

    def read(self, text: str) -> tuple[np.ndarray, list[int]]:
        """(index of the value of each chunk, first chunk of each line)."""
        if len(self.known) > self.memory:
            self.clear()
        chunks, starts = [], []
        for line in text.split("\n"):
            if words := line.split():
                starts.append(len(chunks))
                chunks += words
        known, learn = self.known, self._learn
        return np.array([known[c] if c in known else learn(c) for c in chunks], dtype=np.int64), starts

    def template(self, text: str, names: bool = True, read: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, index of the value) of each template token; without ``names`` these are words."""
        ids, starts = read or self.read(text)
        if not len(ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), ids
        flags, hashes = self.flags[ids], self.hashes[ids]
        first = np.zeros(len(ids), dtype=bool)
        first[starts] = True
        first[1:] |= (flags[:-1] & 16) > 0
        kind = flags & 7
        if names:
            kind[(flags & 8 > 0) & ~first] = NAME
        follows = np.zeros(len(ids), dtype=bool)
        follows[1:] = kind[:-1] == NUM
        kind[(flags & 64 > 0) & follows] = UNIT
        keep = flags & 32 == 0
        hashes, kind, ids = hashes[keep], kind[keep], ids[keep]
        repeat = np.zeros(len(ids), dtype=bool)
        repeat[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
        hashes, kind, ids = hashes[~repeat], kind[~repeat], ids[~repeat]
        hashes = np.where(kind == WORD, hashes, kind.astype(np.uint64))
        return hashes, kind, ids

    def windows(self, text: str, size: int, plain: int, names: bool = True, read: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, window hashes, kinds, value ids): places of the windows with enough ordinary words."""
        hashes, kind, ids = self.template(text, names, read)
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), kind, ids
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            mixed = (mixed ^ (mixed >> np.uint64(32))) * BASE + hashes[k : n + k]
        mixed ^= mixed >> np.uint64(29)
        words = np.concatenate(([0], np.cumsum(kind == WORD)))
        at = np.flatnonzero(words[size:] - words[:-size] >= plain)
        return at, mixed[at], kind, ids

    def whole(self, read: tuple, lengths: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of each of ``lengths`` words and numbers as they are, by default of all of them."""
        ids = read[0]
        h = self.hashes[ids[self.flags[ids] & 32 == 0]]
        lengths = [n for n in ([len(h)] if lengths is None else lengths) if 0 < n <= len(h)]
        if not lengths:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(h) - 1, b)))) for b in (BASE, INVERSE))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((h ^ (h >> np.uint64(32))) * power)))
        runs = [(sums[n:] - sums[:-n]) * back[: len(h) - n + 1] * BASE + np.uint64(n) for n in lengths]
        return np.concatenate([np.arange(len(r)) for r in runs]), np.concatenate([r ^ (r >> np.uint64(29)) for r in runs])


def window_rows(df: DataFrame, id_col: str, text_col: str, window: int, plain: int, known: np.ndarray | None = None, lengths: list[int] | None = None) -> DataFrame:
    """``(id, row, form, total, place, hash, words, slots)`` of every window, or of those whose hash the bitmap knows.

    ``slots`` has "place:value" for each placeholder of the window; ``total`` counts the text's windows of
    that form. Without a bitmap the texts are items: one without windows of names as words is ``WHOLE``, of
    ``words`` tokens. With one, the runs of ``lengths`` tokens are such windows.
    """
    seen = None if known is None else df.sparkSession.sparkContext.broadcast(np.packbits(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Canonicaliser()
        bits = None if seen is None else np.unpackbits(seen.value).view(bool)
        for batch in batches:
            ids, out = [], {c: [] for c in ("row", "form", "total", "place", "hash", "words", "slots")}
            for k, text in enumerate(batch.column(1).to_pylist()):
                read = own.read(text or "")
                row = None
                sought = lengths or []
                for form in (TYPED, BLIND, WHOLE):
                    if form == WHOLE:
                        at, mixed = own.whole(read, sought)
                        kind, total = None, 1
                    else:
                        at, mixed, kind, values = own.windows("", window, plain, form == TYPED, read)
                        total = len(at)
                        if form == BLIND and bits is None and not total:
                            sought = None
                    if bits is not None and len(at):
                        ok = bits[(mixed & np.uint64(len(bits) - 1)).astype(np.int64)]
                        at, mixed = at[ok], mixed[ok]
                    if not len(at):
                        continue
                    if row is None:
                        row = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
                    if kind is None:
                        out["slots"] += [[]] * len(at)
                    else:
                        slot = kind != WORD
                        for p in at.tolist():
                            out["slots"].append([f"{q - p}:{own.cores[values[q]]}" for q in (np.flatnonzero(slot[p : p + window]) + p).tolist()])
                    ids += [k] * len(at)
                    out["row"] += [row - (1 << 64) if row >> 63 else row] * len(at)
                    out["form"] += [form] * len(at)
                    out["total"] += [total] * len(at)
                    out["place"] += at.tolist()
                    out["hash"] += mixed.view(np.int64).tolist()
                    out["words"] += [int((own.flags[read[0]] & 32 == 0).sum()) if kind is None and bits is None else 0] * len(at)
            kinds = {"slots": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, type=pa.int64())), *[pa.array(v, type=kinds.get(c, pa.int64())) for c, v in out.items()]], names=["id", *out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, row bigint, form bigint, total bigint, place bigint, hash bigint, words bigint, slots array<string>")


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places, built by Spark; its size does not depend on the data."""
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    parts = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(1 << 15))).alias("map")).collect()
    known = np.zeros(1 << bits, dtype=bool)
    for r in parts:
        known[r["part"] << 15 : (r["part"] + 1) << 15] = np.unpackbits(np.frombuffer(bytes(r["map"]), dtype=np.uint8), bitorder="little").view(bool)
    return known


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, plain: int = 5, coverage: float = 0.5, bits: int = 22) -> DataFrame:
    """``(doc_id, row, item_id, windows, matched, coverage)`` for every contaminated pair of document and item.

    ``row`` is the XXH64 of the document's text; ``windows`` and ``matched`` are those of the form that covers more.
    """
    items = materialise(window_rows(benchmark, item_col, item_text_col, window, plain).select(F.col("id").alias("item_id"), "row", "form", "total", "words", F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots")).distinct())
    lengths = sorted(r.words for r in items.filter(F.col("form") == WHOLE).select("words").distinct().collect())
    found = window_rows(docs, id_col, text_col, window, plain, bitmap_of(items, bits), lengths).select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "form", "place", "hash", "slots").distinct()
    met = found.join(items, ["hash", "form"]).withColumn("shift", F.col("place") - F.col("item_place"))
    key = ["doc_id", "doc_row", "item_id", "row", "form", "total"]
    met = materialise(met.select(*key, "shift", "item_place", "slots", "item_slots"))
    pairs = met.select(*key, "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).select(*key, "shift", F.substring_index("z.item_slots", ":", 1).alias("slot"), F.expr("substring(z.item_slots, instr(z.item_slots, ':') + 1)").alias("asked"), F.expr("substring(z.slots, instr(z.slots, ':') + 1)").alias("given")).select(*key, "shift", "asked", "given").distinct()
    wrong = pairs.groupBy(*key, "shift").agg((F.count(F.lit(1)) > F.countDistinct("asked")).alias("wrong")).filter("wrong").drop("wrong")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*key, "shift"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    right = met.alias("m").join(wrong.alias("w"), on, "left_anti")
    covered = right.groupBy(*key).agg(F.countDistinct("item_place").alias("matched"))
    share = F.col("matched") / F.col("total")
    best = covered.filter(share >= coverage).groupBy("doc_id", "doc_row", "item_id", "row").agg(F.max(F.struct(share.alias("share"), (-F.col("form")).alias("by"), "total", "matched")).alias("b"))
    return best.select("doc_id", F.col("doc_row").alias("row"), "item_id", F.col("b.total").alias("windows"), "b.matched", F.round("b.share", 6).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = materialise(contaminated(docs, benchmark, id_col, text_col, **params).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct())
    on = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["__row"])
    return docs.join(bad, on, "left_anti")
