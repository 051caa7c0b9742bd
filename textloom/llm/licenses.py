"""Operator 7: licence scan with fuzzy search for short notices.

A text becomes its lower-case words, single-spaced. Phrases are counted where their words stand
consecutively. A notice with at most k errors, split into k + 1 pieces, contains one piece unharmed
(pigeonhole), so exact finds of pieces locate candidates: a match that holds a piece begins within k characters
of where the piece puts it. At each word that begins there the ``regex`` library matches the notice with at most
k errors up to a word border. Of matches of a notice that overlap, those with fewer errors stay, then the first.
The score is 1 for a phrase, else the largest share of a matched notice's characters that is without error.

Defined results: a null, empty or wordless text has no words, no places, empty label strings and score 0;
repeated rows are scanned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices, their labels and the errors allowed in each.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license", "apache", 1),
    ("released under the mit license", "mit", 3),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("bsd license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("free and unencumbered software released into the public domain", "unlicense", 5),
    ("all rights reserved", "reserved", 1),
)
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(notice: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` stretches of even length with their places."""
    at = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = []
        for notice, label, errors in notices:
            raw = notice.encode()
            pattern = regex.compile(rb"(?b)(?:" + regex.escape(raw, special_only=True) + rb"){e<=%d}(?= )" % errors)
            self.notices.append((raw, label, errors, pieces(raw, errors), pattern))

    def places(self, line: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every phrase's exact places."""
        out = []
        for phrase, label in self.phrases:
            at, counted, words = line.find(phrase), 0, 0
            while at >= 0:
                words += line.count(b" ", counted, at)
                counted = at
                out.append((words, label))
                at = line.find(phrase, at + 1)
        return out

    def spans(self, line: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, words, errors, characters of the notice) of every fuzzy match."""
        out = []
        for raw, label, errors, seeds, pattern in self.notices:
            starts = set()
            for offset, piece in seeds:
                at = line.find(piece)
                while at >= 0:
                    first, last = max(0, at - offset - errors - 1), at - offset + errors
                    while (first := line.find(b" ", first, max(0, last))) >= 0:
                        first += 1
                        starts.add(first)
                    at = line.find(piece, at + 1)
            found = []
            for at in starts:
                if m := pattern.match(line, at, min(len(line), at + len(raw) + errors + 1)):
                    found.append((sum(m.fuzzy_counts), at, m.end()))
            taken: list[tuple[int, int, int]] = []
            for e, a, b in sorted(found):
                k = bisect(taken, (a, b, e))
                if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b, e))
            words, counted = 0, 1
            for a, b, e in taken:
                words += line.count(b" ", counted, a)
                counted = a
                out.append((label, words, line.count(b" ", a, b) + 1, e, len(raw)))
        return sorted(set(out))

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
        line = b" " + b" ".join(words) + b" "
        exact, fuzzy = self.places(line), self.spans(line)
        similar = [1 - e / size for *_, e, size in fuzzy]
        base = sorted({label for _, label in exact})
        return {
            "n_words": len(words),
            "n_base": len(exact),
            "first_word": min((w for w, _ in exact), default=None),
            "last_word": max((w for w, _ in exact), default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(s[0] for s in fuzzy)})),
            "score": 1.0 if exact else max(similar, default=0.0),
            "spans": [dict(zip(("label", "first_word", "words", "errors", "notice_chars"), s)) for s in fuzzy],
        }


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("errors", pa.int64()), ("notice_chars", pa.int64())]))
KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": SPANS}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """One row per document: counts, labels, score, and the spans of fuzzy matches in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[c] for f in found], type=k) for c, k in KINDS.items()]], names=["doc_id", *KINDS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,words:bigint,errors:bigint,notice_chars:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
