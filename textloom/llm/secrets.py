"""Operator 13: secret scan by grammar inference.

Base rules find assignments, access keys and long hexadecimal runs. The values that they find are the labelled
credentials of their kind. From a bounded sample of these a probabilistic automaton is inferred per kind: the values'
prefix tree is read breadth first and states whose outgoing frequencies agree within Hoeffding's bound, down to
their leaves, are merged (state merging by statistical compatibility). Prefixes shared by many values stay literal, the rest of
a value is written as one class of characters, the smallest that holds its letters and digits, and its punctuation,
so that lengths and separators have counts worth comparing. Every run of credential characters in every text is
then scored by its likelihood under each automaton. It is a span of kind ``format`` if it is as likely as all but
``tail`` of the labelled values that were kept out of the inference, and if no base span overlaps it.

Bounds of the fit alone (every text is searched and scored whole): ``sample`` distinct values of a kind, those of the
smallest hashes, of at most ``longest`` characters.

Defined results: null and empty texts have no span and the hash of the empty string; repeated rows and rows without an id
are scanned each; without labelled values there are base spans only; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise

#: The base rules with the least length of their values, in the order of kinds.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
)
FORMAT = "format"
#: Words of which a text with an assignment holds one, in any case.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
#: Character classes from narrow to wide: the first that holds all letters and digits of a value writes them.
CLASSES = tuple((name, re.compile(f"(?:[{chars}]|[^A-Za-z0-9])*")) for name, chars in (("d", "0-9"), ("l", "a-z"), ("u", "A-Z"), ("x", "0-9a-f"), ("X", "0-9A-F"), ("z", "0-9a-z"), ("Z", "0-9A-Z"), ("a", "A-Za-z0-9")))
ALNUM = re.compile("[A-Za-z0-9]")
#: Symbols that a value can show: the characters, the classes and the end.
SYMBOLS = 76


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base rules' matches, in order."""
    low, out = text.lower(), []
    if any(w in low for w in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in BASE[0][1].finditer(text) if len(m[2]) >= BASE[0][2]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in BASE[1][1].finditer(text) if len(m[0]) >= BASE[1][2]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, strings: list[str], alpha: float = 0.05, smoothing: float = 0.01):
        self.ends, self.totals = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.bound, self.smoothing = math.sqrt(0.5 * math.log(2 / alpha)), smoothing
        for s in strings:
            at = 0
            self.totals[0] += 1
            for c in s:
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    for grown, empty in ((self.ends, 0), (self.totals, 0), (self.next, {}), (self.counts, {})):
                        grown.append(empty)
                at = self.next[at][c]
                self.totals[at] += 1
            self.ends[at] += 1
        self.states = self._merge()

    def _merge(self) -> list[int]:
        kept, waiting = [0], [(0, c) for c in sorted(self.next[0])]
        while waiting:
            at, c = waiting.pop(0)
            new = self.next[at][c]
            if new in kept:
                continue
            for old in kept:
                if self._compatible(old, new):
                    self.next[at][c] = old
                    self._fold(old, new)
                    break
            else:
                kept.append(new)
            waiting = [(q, x) for q in kept for x in sorted(self.next[q]) if self.next[q][x] not in kept]
        return kept

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.totals[a], self.totals[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a].get(c, 0), n, self.counts[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.ends[a] += self.ends[b]
            self.totals[a] += self.totals[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child
                self.counts[a][c] = self.counts[a].get(c, 0) + self.counts[b][c]

    def likelihood(self, s: str) -> float:
        """Natural logarithm of the probability of ``s``; a symbol that a state never saw has the smoothed share."""
        at, log = 0, 0.0
        for c in s:
            if at is None:
                log -= math.log(SYMBOLS)
                continue
            log += math.log((self.counts[at].get(c, 0) + self.smoothing) / (self.totals[at] + self.smoothing * SYMBOLS))
            at = self.next[at].get(c)
        return log - math.log(SYMBOLS) if at is None else log + math.log((self.ends[at] + self.smoothing) / (self.totals[at] + self.smoothing * SYMBOLS))


class Format:
    """The format of one kind of credential: literal prefixes, automaton and the least likelihood that is accepted."""

    def __init__(self, values: list[str], share: float = 0.2, tail: float = 0.02):
        fitted, kept_out = values[::2], values[1::2] or values
        starts: dict[str, int] = {}
        for v in fitted:
            for n in range(1, len(v) + 1):
                starts[v[:n]] = starts.get(v[:n], 0) + 1
        least = max(2, share * len(fitted))
        self.prefixes = frozenset(p for p, n in starts.items() if n >= least)
        self.automaton = Automaton([self.write(v) for v in fitted])
        scores = sorted(self.automaton.likelihood(self.write(v)) for v in kept_out)
        self.least = scores[int(tail * len(scores))]

    def write(self, value: str) -> str:
        """The value's literal prefix, then its class of characters and its punctuation."""
        n = 0
        while n < len(value) and value[: n + 1] in self.prefixes:
            n += 1
        rest = value[n:]
        name = next(name for name, holds in CLASSES if holds.fullmatch(rest))
        return value[:n] + ALNUM.sub(name, rest)

    def score(self, value: str) -> float:
        """Likelihood above the least accepted one; 0 or more is accepted."""
        return self.automaton.likelihood(self.write(value)) - self.least


def labelled_values(docs: DataFrame, text_col: str = "text", longest: int = 128) -> DataFrame:
    """``(kind, value)``, distinct: what the base rules find in all texts, of at most ``longest`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(kind, value) for t in batch.column(0) for _, kind, _, value in base_spans(t.as_py() or "") if len(value) <= longest}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], type=pa.int32()), pa.array([v for _, v in found], type=pa.string())], names=["kind", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind int, value string").distinct()


def formats(docs: DataFrame, text_col: str = "text", sample: int = 2000, longest: int = 128, share: float = 0.2, tail: float = 0.02) -> list[Format]:
    """The formats of all kinds that have labelled values, each from at most ``sample`` of them."""
    values = materialise(labelled_values(docs, text_col, longest).withColumn("h", F.xxhash64("kind", "value")))
    known = {r.kind: r.n for r in values.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return []
    # About twice the sample by hash, so that ranking meets few rows whatever the number of values.
    places = 1 << 30
    near = values.filter(" OR ".join(f"(kind = {k} AND pmod(h, {places}) <= {min(places, 2 * sample * places // n)})" for k, n in known.items()))
    order = Window.partitionBy("kind").orderBy(F.pmod("h", F.lit(places)), "value")
    rows = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).collect()
    return [Format([r.value for r in sorted((r for r in rows if r.kind == k), key=lambda r: r.r)], share, tail) for k in sorted(known)]


def scan(text: str, models: list[Format]) -> dict:
    """Counts, base hash, all spans, and the best score of a span of the formats (null without one)."""
    spans = base_spans(text)
    more, best, reach = [], None, 0
    starts, ends = [s[0] for s in spans], []
    for s in spans:
        reach = max(reach, s[2])
        ends.append(reach)
    for m in CANDIDATE.finditer(text) if models else ():
        value = m[0].rstrip("+/_.-")
        end, value = m.start() + len(value), value.lstrip("+/_.-")
        start = end - len(value)
        before = bisect_left(starts, end)
        if not value or (before and ends[before - 1] > start):
            continue
        score = max(f.score(value) for f in models)
        if score >= 0:
            more.append((start, len(BASE), end, value))
            best = score if best is None else max(best, score)
    names = (*(name for name, *_ in BASE), FORMAT)
    written = lambda found: ",".join(f"{names[kind]}:{a}:{b}" for a, kind, b, _ in sorted(found))
    counts = {f"n_{name}": sum(s[1] == i for s in spans) for i, name in enumerate(names[: len(BASE)])}
    return counts | {"base_sha256": hashlib.sha256(written(spans).encode()).hexdigest(), "spans": written(spans + more), "n_format": len(more), "score": best}


COLUMNS = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_format": pa.int64(), "score": pa.float64()}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, longest: int = 128, share: float = 0.2, tail: float = 0.02) -> DataFrame:
    """One row per document: counts of the base rules, hash of their spans, and all spans."""
    models = formats(docs, text_col, sample, longest, share, tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "", models) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[c] for f in found], type=k) for c, k in COLUMNS.items()]], names=["doc_id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint, score double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
