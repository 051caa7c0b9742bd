import random
import re
import zlib
from collections import Counter

from textloom.llm.spelling import near_words, roots, spelling_groups

DOCS = "doc_id bigint, text string, word string, n bigint, near string"


def one_edit(a, b):
    """Equal but for one inserted, deleted or replaced code point, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def neighbours(words):
    return {(a, b) for a in words for b in words if one_edit(a, b)}


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def found(spark, words):
    rows = [(r.word, r.near) for r in near_words(frame(spark, words)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(1)
    dense = {"".join(rng.choices("ab", k=rng.randrange(1, 8))) for _ in range(90)}
    wide = set()
    for _ in range(60):
        w = "".join(rng.choices("abcdeéÿ", k=rng.randrange(4, 12)))
        wide.add(w)
        for _ in range(3):
            k = rng.randrange(len(w))
            wide.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("xé") + w[k + 1 :]]))
    for words in (dense, wide, {"a"}, {"ab", "a"}, {"aaaa", "aaa", "aa", "a"}):
        words.discard("")
        assert found(spark, words) == neighbours(words)
    assert found(spark, set()) == set()


def test_very_long_words_take_few_levels(spark):
    long = "ab" * 20_000
    words = {long, long + "c", long[:-1], "x" + long, long[:100] + "z" + long[101:], long * 2, "a" * 5_000, "a" * 5_001, "a" * 5_003}
    assert found(spark, words) == neighbours(words)


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, out = {}, {}
    for a, b in neighbours(words):
        near.setdefault(a, []).append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= 5 * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near.get(w, [])), words[form[w]] if w in form else None)
    return out


def corpus(rng):
    base = ["lettera", "letterb", "lettersa", "Étagère", "étagere", "ÉTAGÈRE", "colour", "colours", "color", "colourss", "short", "vielleicht"]
    weights = [400, 40, 6, 60, 9, 5, 300, 50, 90, 7, 30, 20]
    return [(rng.randrange(200), rng.choice([" ", ", ", "1"]).join(rng.choices(base, weights, k=rng.randrange(40)))) for _ in range(150)]


def test_groups_equal_brute_force_with_odd_rows(spark):
    rows = [*corpus(random.Random(2)), (1, None), (2, ""), (None, "colour " * 3000), (3, "colour"), (3, "colour"), (4, "ab" * 100_000), (5, "÷×÷×÷×÷ " * 6)]
    got = {r.word: tuple(r)[1:] for r in spelling_groups(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS)).collect()}
    assert got == brute(rows) and any(v[0] for v in got.values())
    assert spelling_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w13" for k in range(13)} | {"x": "w13", "y": "z"}
