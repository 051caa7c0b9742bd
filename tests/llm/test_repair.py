import hashlib
import heapq
import random
import re
import zlib

import pytest

from textloom.llm.repair import best_edits, repair_conversations

ROWS = "conv_id bigint, turn bigint, role string, text string, cost string, audit string"


def spaced(x):
    return " " if x is None else str(x)


def after_damage(rows):
    """The rows of one conversation, (conv_id, turn, role, text), as the contract words the damage."""
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, spaced(r[2]).encode(), "" if False else spaced(r[3]).encode())):
        h = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def searched(rows):
    """Every sequence of edits in order of cost and then of ASCII; the first that ends in a legal way."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        for r in NEXT[last]:
            if r != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*lines, {"u": "user:", "a": "assistant:"}[r])))
        if i < len(rows):
            role, text, must, short = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if not must:
                for r in NEXT[last]:
                    if role[:1] == r:
                        heapq.heappush(heap, (cost + 5 * short, audit + "K", i + 1, r, (*lines, f"{role}:{text}")))
                    elif r != "s":
                        heapq.heappush(heap, (cost + 1 + 5 * short, audit + "R", i + 1, r, (*lines, {"u": "user:", "a": "assistant:"}[r] + text)))


def brute(rows):
    kept = after_damage(rows)
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in kept:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        short = not blank and not again and re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?"
        counts = [a + b for a, b in zip(counts, (blank, again and not blank, short))]
        marked.append((role, text, blank or again, short))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    turns = {t for t, _, _ in kept if t is not None}
    cost, audit, lines = searched(marked)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        size = rng.randrange(1, most + 1)
        for k in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "unknown"]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice(["Hello.", "Yes", "", None, " \t", "What? ", "No!x", "Ünd.", "a\nb."]) if rng.random() < 0.5 else f"Turn {k} of {conv}{rng.choice(['.', '!', '', '? '])}"
            rows.append((conv if conv else None, k if rng.random() < 0.9 else rng.choice([None, 0, 2, -3]), role, text, "clash", "clash"))
    return rows


@pytest.mark.parametrize("block, most", [(128, 7), (2, 7), (3, 6)])
def test_equals_exhaustive_search(spark, block, most):
    rng = random.Random(block)
    rows = conversations(rng, 120, most)
    rng.shuffle(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, ROWS), block=block).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert got == {conv: brute(held) for conv, held in by.items()}


def test_rows_that_are_all_dropped_and_an_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "x", "", "")], ROWS)
    assert [tuple(r) for r in repair_conversations(df).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_conversations(df.limit(0)).collect() == []


def plain(rows):
    """Cheapest (cost, audit) by phase, row after row."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for last, (c, x) in list(best.items()):
                for r in NEXT[last]:
                    if r != "s" and (r not in best or (c + 5, x + "I") < best[r]):
                        best[r] = (c + 5, x + "I")
        return best

    for initial, must, extra in rows:
        now = {}
        for last, (c, x) in inserted(best).items():
            moves = [(last, c + 2, x + "D")]
            for r in () if must else NEXT[last]:
                if initial == r:
                    moves.append((r, c + extra, x + "K"))
                elif r != "s":
                    moves.append((r, c + extra + 1, x + "R"))
            for r, *to in moves:
                if r not in now or tuple(to) < now[r]:
                    now[r] = tuple(to)
        best = now
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def test_bands_keep_the_best_of_long_conversations():
    rng = random.Random(9)
    for n in (0, 1, 2, 12, 30, 60):
        for bias in (0, 0.5, 1):
            rows = [(rng.choice("uasx") if rng.random() < 0.3 else "u" if rng.random() < bias else "ua"[k % 2], rng.random() < 0.2, 5 * (rng.random() < 0.2)) for k in range(n)]
            assert best_edits(rows) == plain(rows)


def test_one_long_conversation_of_many_blocks_with_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(7, k // 2, rng.choice(["user", "assistant"]), f"Words {rng.randrange(60)}.", "", "") for k in range(700)] + [(7, 3, "user", "Same.", "", "")] * 50 + [(8, 0, "user", "Hi.", "", ""), (8, 1, "assistant", "Ho.", "", "")]
    df = spark.createDataFrame(rows, ROWS)
    one, many = ({r.conv_id: tuple(r) for r in repair_conversations(df, block=b).collect()} for b in (10_000, 32))
    assert one == many and len(one[7][7]) >= 700
