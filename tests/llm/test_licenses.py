import random
import re

from textloom.llm.licenses import NOTICES, PHRASES, Scanner, pieces, scan_licenses

DOCS = "doc_id bigint, text string, labels string"
TEXTS = [
    "Released under the MIT License. mit-license! See the GNU General Public License, MIT  license",
    "Licensed under CC BY-NC 4.0. cc by cc by",
    "Licenced under the Apache Licence 2.0",
    "permision is herby granted, free of charge, to any person obtaining a copy",
    "mit dem license hut; commit license; mit licenses",
    "ümit license, mit licenseé",
    "",
    None,
    "..!",
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], DOCS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)


def test_fuzzy_matches_add_labels_and_spans():
    s = Scanner()
    r = s.scan(TEXTS[2])
    assert r["labels"] == "apache" and r["base_labels"] == "" and 0 < r["score"] < 1
    assert {"label": "apache", "first_word": 3, "words": 2, "errors": 1, "notice_chars": 14} in r["spans"]
    assert r["score"] == max(1 - x["errors"] / x["notice_chars"] for x in r["spans"])
    assert s.scan("a mit licence")["score"] == 1 - 1 / len("mit license")
    assert s.scan(TEXTS[3])["labels"] == "mit"
    assert s.scan("plain words about a permit or license")["labels"] == ""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_spans(text, notice, errors):
    """(first word, errors) of the notice's matches: fewest errors first, then the first word; later ones must not overlap."""
    words = text.split()
    found = []
    for i in range(len(words)):
        ends = [(distance(" ".join(words[i:j]), notice), j) for j in range(i + 1, min(len(words), i + len(notice.split()) + errors + 1) + 1)]
        e, j = min(ends)
        if e <= errors:
            found.append((e, i, j))
    taken = []
    for e, i, j in sorted(found):
        if all(j <= a or b <= i for _, a, b in taken):
            taken.append((e, i, j))
    return sorted((i, e) for e, i, _ in taken)


def damaged(rng, notice, n):
    out = list(notice)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "q"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "z")
    return " ".join("".join(out).split())


def test_spans_equal_edit_distance_over_all_substrings():
    rng = random.Random(4)
    for notice, label, errors in [n for n in NOTICES if len(n[0]) < 40]:
        own = Scanner(notices=((notice, label, errors),))
        for gap in (0, 1, 2, 3):
            for _ in range(12):
                parts = [damaged(rng, notice, rng.randrange(errors + 2)) for _ in range(3)]
                text = "see " + (" " + "of the x "[: 3 * gap] + " ").join(parts) + " end"
                text = " ".join(text.split())
                got = sorted((r["first_word"], r["errors"]) for r in own.scan(text)["spans"])
                assert got == brute_spans(text, notice, errors), (notice, text)


def test_adjacent_notices_are_all_reported():
    s = Scanner()
    spans = lambda text, label: [(x["first_word"], x["errors"]) for x in s.scan(text)["spans"] if x["label"] == label]
    assert {(0, 1), (3, 0)} <= set(spans("mit licensa x mit license", "mit"))
    assert [x for x in spans("gnu genral public licnse see gnu general public license", "gpl")] == [(0, 2), (5, 0)]


def test_every_notice_is_found_with_its_errors():
    s = Scanner()
    for notice, label, errors in NOTICES:
        assert b"".join(p for _, p in pieces(notice.encode(), errors)) == notice.encode()
        for step in (3, 5, 7):
            broken = list(notice)
            for k in range(errors):
                at = (step + k * len(notice) // (errors + 1)) % len(notice)
                if broken[at] != " ":
                    broken[at] = "x"
            text = "".join(broken)
            assert distance(text, notice) <= errors
            assert label in s.scan(f"before {text} after")["labels"].split(",")


def test_long_text_and_empty_table(spark):
    text = "mit license " * 20000
    r = Scanner().scan(text)
    assert r["n_base"] == 20000 and r["last_word"] == 39998
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
