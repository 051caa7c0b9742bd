"""Operator 12: conversation structure repair by alignment to the role grammar ``(s?(ua)+)?``.

Rows are damaged by a checksum of their conversation and turn, then the faults of each row are audited and the cheapest edits are
sought that give legal roles: Keep 0, Rerole 1 (to user or assistant), Delete 2 (a must for blank and duplicate
rows), Insert 5 (an empty user or assistant turn); a truncated row that stays adds 5. The turns are aligned to the alternating
string of each feasible length by Wagner and Fischer's table. The best cost so far bounds the lengths and, after Ukkonen, the
diagonals of each table. Of equal costs the audits, walked back through the table, are compared, the least in ASCII order stays.

A conversation of more than ``block`` rows is no task of its own: its rows are range-partitioned in their order and cut into
blocks, each aligned between all phases of the grammar (start, after s, after u, after a). The blocks' tables compose, since no
audit of a block begins another one of equal cost. Only the audit, which is one value of the result, and the text hash,
which must see the text in order, pass one task, as streams of blocks.

Defined results: a null conversation, turn, role or text counts as one space in the checksum and in the rows; rows without a
conversation form one; turns without a number come first and are left out of gaps; rows of one turn are ordered by role
and text; repeated rows are repeated turns; empty texts are blank; roles count by their first character, an empty role has none; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

RULE_REROLE, RULE_DELETE, RULE_INSERT, RULE_TRUNCATED = 1, 2, 5, 5
START, S, U, A = range(4)
PHASES = {"s": S, "u": U, "a": A}
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
INK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: 0 copies of a row that is dropped, 2 of one that is repeated."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    return rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(spaced(role_col)).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def streams(entry: int) -> list[str]:
    """The grammar's strings after a phase, as (first character, repeated rest)."""
    return {START: ["s", "u"], S: ["u"], U: ["a"], A: ["u"]}[entry]


def string(first: str, length: int) -> str:
    return ("s" + "ua" * (length // 2) if first == "s" else ("ua" if first == "u" else "au") * (length // 2 + 1))[:length]


def align(rows: list[tuple], target: str, most: int) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits of ``rows`` to ``target``, if it costs ``most`` at most.

    A row is (role's initial, must go, extra cost if it stays). The table runs from the end, so that the audit is read from its
    start; it holds only the diagonals that ``most`` allows before and after a cell.
    """
    n, m = len(rows), len(target)
    free = [0]
    for _, must, _ in rows:
        free.append(free[-1] + (not must))
    slack = most - RULE_DELETE * (n - free[n])
    if slack < 0:
        return None
    down, up = slack // RULE_DELETE, slack // RULE_INSERT
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        after = free[n] - free[i]
        low = max(0, free[i] - down, m - after - up)
        high = min(m, free[i] + up, m - after + down)
        own, below = table[i], table[i + 1] if i < n else {}
        for j in range(high, low - 1, -1):
            best = 0 if i == n and j == m else None
            if i < n:
                initial, must, extra = rows[i]
                if (c := below.get(j)) is not None:
                    best = c + RULE_DELETE
                if not must and j < m and (c := below.get(j + 1)) is not None:
                    if initial == target[j]:
                        c += extra
                    elif target[j] != "s":
                        c += extra + RULE_REROLE
                    else:
                        c = None
                    if c is not None and (best is None or c < best):
                        best = c
            if j < m and target[j] != "s" and (c := own.get(j + 1)) is not None and (best is None or c + RULE_INSERT < best):
                best = c + RULE_INSERT
            if best is not None:
                own[j] = best
    cost = table[0].get(0)
    if cost is None or cost > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = table[i][j]
        if i < n and table[i + 1].get(j) == left - RULE_DELETE:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i].get(j + 1) == left - RULE_INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def best_edits(rows: list[tuple], entry: int = START, ends: tuple[int, ...] = (START, A)) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from phase ``entry`` to one of ``ends``, over all feasible lengths; None if there are none."""
    n = len(rows)
    must = sum(r[1] for r in rows)
    free = n - must
    lengths = [(k, first) for first in streams(entry) for k in range(4) if (PHASES[string(first, k)[-1]] if k else entry) in ends]
    whole = [RULE_DELETE * n + RULE_INSERT * k for k, first in lengths if "s" not in string(first, k)]
    most = min(whole, default=RULE_DELETE * n + RULE_INSERT * 3 + n * (RULE_TRUNCATED + RULE_REROLE))
    found = None
    reach = free + (most - RULE_DELETE * must) // RULE_INSERT
    for far, length in sorted((abs(k - free), k) for k in range(reach + 1)):
        away = RULE_INSERT * far if length > free else RULE_DELETE * far
        if away + RULE_DELETE * must > most:
            continue
        for first in streams(entry) if length else streams(entry)[:1]:
            target = string(first, length)
            if (PHASES[target[-1]] if length else entry) not in ends:
                continue
            got = align(rows, target, most)
            if got is not None and (found is None or got < found):
                found, most = got, got[0]
    return found


def faulty(rows: list[tuple[str, str, bool]]) -> tuple[list[tuple], list[int]]:
    """Rows for ``align``, and the numbers of blank, duplicate, truncated rows and of illegal neighbours; a row is (role, text, seen earlier)."""
    out, counts, last = [], [0, 0, 0, 0], None
    for role, text, seen in rows:
        blank = not INK.search(text)
        short = not blank and not seen and text.rstrip(SPACE)[-1] not in ".!?"
        for k, held in enumerate((blank, seen and not blank, short)):
            counts[k] += held
        out.append((role[:1], blank or seen, RULE_TRUNCATED * short))
        counts[3] += last is not None and last + role[:1] not in LEGAL
        last = role[:1]
    return out, counts


def repaired(rows: list[tuple], audit: str, target: str) -> list[str]:
    """``role:text`` of the turns after the edits."""
    lines, i, j = [], 0, 0
    for edit in audit:
        if edit in "KR":
            lines.append(f"{rows[i][0] if edit == 'K' else ROLES[target[j]]}:{rows[i][1]}")
        elif edit == "I":
            lines.append(f"{ROLES[target[j]]}:")
        i, j = i + (edit != "I"), j + (edit != "D")
    return lines


def goal(audit: str) -> str:
    """The string that a whole conversation's audit leads to: its length tells it."""
    length = len(audit) - audit.count("D")
    return string("s" if length % 2 else "u", length)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows that agree in their first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row[keys:])
    if rows:
        yield key, rows


COLUMNS = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
DDL = ", ".join(f"{c} {'bigint' if k == pa.int64() else 'string'}" for c, k in COLUMNS.items())


def _whole(rows: list[tuple]) -> tuple:
    """The result of one conversation from its (turn, role, text, copies) in order."""
    kept = [r for r in rows for _ in range(r[3])]
    turns = {r[0] for r in kept if r[0] is not None}
    seen: set = set()
    marked = []
    for _, role, text, _ in kept:
        marked.append((role, text, (role, text) in seen))
        seen.add((role, text))
    aligned, counts = faulty(marked)
    cost, audit = best_edits(aligned)
    text = "\n".join(repaired(marked, audit, goal(audit)))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _emit(found: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*found), kinds)], names=names)


def _batched(results: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 2000) -> Iterator[pa.RecordBatch]:
    found = []
    for r in results:
        found.append(r)
        if len(found) == size:
            yield _emit(found, kinds, names)
            found = []
    if found:
        yield _emit(found, kinds, names)


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 128) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of the cheapest repair, and the hash of the repaired turns."""
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    long = materialise(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter(F.col("n") > block).select(F.col("conv_id").alias("long")))
    if long.isEmpty():
        return _short(rows)
    met = rows["conv_id"].eqNullSafe(long["long"])
    return _short(rows.join(long, met, "left_anti")).unionByName(_long(rows.join(long, met, "left_semi"), block))


def _in_order(rows: DataFrame) -> list:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _short(rows: DataFrame) -> DataFrame:
    kind = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((*key, *_whole(turns)) for key, turns in by_key(batches, 1)), [kind, *COLUMNS.values()], ["conv_id", *COLUMNS])

    dealt = rows.repartition("conv_id").sortWithinPartitions(*_in_order(rows))
    return dealt.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {DDL}")


BLOCK = {"n": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "cost": pa.list_(pa.int64()), "audit": pa.list_(pa.string())}


def _table(aligned: list[tuple]) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits of a block between all phases."""
    found = {(a, b): best_edits(aligned, a, (b,)) for a in range(4) for b in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def _composed(left: dict, right: dict) -> dict:
    out: dict = {}
    for (a, b), (c, x) in left.items():
        for (b_, d), (e, y) in right.items():
            if b == b_ and ((a, d) not in out or (c + e, x + y) < out[a, d]):
                out[a, d] = (c + e, x + y)
    return out


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of many rows, by blocks."""
    id_kind = rows.schema["conv_id"].dataType.simpleString()
    kind = pa.int64() if id_kind == "bigint" else None
    once = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    span = once.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = once.groupBy("conv_id", "role", "text").agg(F.min(order).alias("first")).select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "text")], "first")
    met = once["conv_id"].eqNullSafe(first["__conv_id"]) & (once["role"] == first["__role"]) & (once["text"] == first["__text"])
    turns = once.join(first, met).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    turns = turns.withColumn("seen", (F.col("copy") > 1) | ~order.eqNullSafe(F.col("first")))
    order_by = [*_in_order(turns), F.col("copy")]
    placed = turns.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed.select("conv_id", F.floor(F.col("place") / block).alias("part"), "place", "role", "text", "seen"))
    blocks = placed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "part", "role", "text", "seen")

    def aligned_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for key, held in by_key(batches, 2):
                aligned, counts = faulty(held)
                table = _table(aligned)
                entries = [table.get((a, b)) for a in range(4) for b in range(4)]
                yield *key, len(held), *counts, held[0][0][:1], held[-1][0][:1], [e and e[0] for e in entries], [e and e[1] for e in entries]

        yield from _batched(results(), [kind, pa.int64(), *BLOCK.values()], ["conv_id", "part", *BLOCK], 100)

    numbers = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    tables = materialise(blocks.mapInArrow(aligned_blocks, f"conv_id {id_kind}, part bigint, {numbers}, head string, tail string, cost array<bigint>, audit array<string>"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block its share of the cheapest audit and the phase before it; totals stand in the first block's row."""

        def finish(key: tuple, sizes: list, counts: list, stack: list) -> Iterator[tuple]:
            while len(stack) > 1:
                stack[-2:] = [(stack[-2][0], _composed(stack[-2][1], stack[-1][1]))]
            cost, audit = min(v for (a, b), v in stack[0][1].items() if a == START and b in (START, A))
            target, at, j = goal(audit), 0, 0
            for k, (part, n) in enumerate(sizes):
                end, left = at, n
                while end < len(audit) and (left or k == len(sizes) - 1):
                    left -= audit[end] != "I"
                    end += 1
                own = audit[at:end]
                take = len(own) - own.count("D")
                yield *key, part, own, target[j : j + take], *([*counts, cost, audit] if k == 0 else [None] * 6)
                at, j = end, j + take

        def results() -> Iterator[tuple]:
            key, sizes, counts, stack, tail = None, [], [], [], None
            for batch in batches:
                for conv, part, n, blank, duplicate, truncated, illegal, head, last, costs, audits in zip(*[c.to_pylist() for c in batch.columns]):
                    if (conv,) != key:
                        if sizes:
                            yield from finish(key, sizes, counts, stack)
                        key, sizes, counts, stack, tail = (conv,), [], [0, 0, 0, 0], [], None
                    across = int(tail is not None and tail + head not in LEGAL)
                    counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, illegal + across))]
                    sizes.append((part, n))
                    tail = last
                    stack.append((1, {(k // 4, k % 4): (c, a) for k, (c, a) in enumerate(zip(costs, audits)) if c is not None}))
                    while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                        stack[-2:] = [(2 * stack[-1][0], _composed(stack[-2][1], stack[-1][1]))]
            if sizes:
                yield from finish(key, sizes, counts, stack)

        yield from _batched(results(), [kind, pa.int64(), pa.string(), pa.string(), *list(COLUMNS.values())[1:7]], ["conv_id", "part", "edits", "target", *list(COLUMNS)[1:7]], 100)

    totals = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in list(COLUMNS)[1:7])
    shares = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(folded, f"conv_id {id_kind}, part bigint, edits string, target string, {totals}")
    shares = materialise(shares)
    share = shares.select(F.col("conv_id").alias("__conv_id"), F.col("part").alias("__part"), "edits", "target")
    edited = placed.join(share, placed["conv_id"].eqNullSafe(share["__conv_id"]) & (placed["part"] == share["__part"])).select("conv_id", "part", "edits", "target", "place", "role", "text")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = ((*key[:2], repaired([r[1:] for r in held], *key[2:])) for key, held in by_key(batches, 4))
        yield from _batched(results, [kind, pa.int64(), pa.list_(pa.string())], ["conv_id", "part", "lines"], 100)

    lines = edited.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(lines_of, f"conv_id {id_kind}, part bigint, lines array<string>")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            key, digest, begun = None, None, False
            for batch in batches:
                for conv, lines in zip(*[c.to_pylist() for c in batch.columns]):
                    if (conv,) != key:
                        if digest:
                            yield *key, digest.hexdigest()
                        key, digest, begun = (conv,), hashlib.sha256(), False
                    for line in lines:
                        digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                        begun = True
            if digest:
                yield *key, digest.hexdigest()

        yield from _batched(results(), [kind, pa.string()], ["__conv_id", "repaired_sha256"])

    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "lines").mapInArrow(hashed, f"__conv_id {id_kind}, repaired_sha256 string")
    result = shares.filter("cost IS NOT NULL").drop("part", "edits", "target")
    result = result.join(hashes, result["conv_id"].eqNullSafe(hashes["__conv_id"])).drop("__conv_id")
    span = span.withColumnRenamed("conv_id", "__conv_id")
    return result.join(span, result["conv_id"].eqNullSafe(span["__conv_id"])).select("conv_id", *COLUMNS)
