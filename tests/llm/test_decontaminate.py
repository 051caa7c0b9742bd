import numpy as np
import pytest

from textloom.llm.decontaminate import NAME, NUM, QTY, UNIT, WORD, Canonicaliser, contaminated, drop_contaminated

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string"
ITEM = "A train leaves the old station with Anna at 40 km per hour and reaches the far river after 3 hours of slow travel. How far did Anna travel from the station in 40 km steps?"
OTHER = "The quick brown fox jumps over the lazy dog while seven grey wolves watch from the dark forest edge tonight."


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"word{i}" for i in range(300)], n))


def test_template_kinds():
    own = Canonicaliser()
    hashes, kind, ids = own.template("The boy Tom Smith ran 5 km, or 7kg.\nNew line 3,5 Anna")
    assert kind.tolist() == [WORD, WORD, NAME, WORD, NUM, UNIT, WORD, QTY, WORD, WORD, NUM, NAME]
    assert own.template("") [0].size == 0


def found(spark, docs, items, **params):
    frame = spark.createDataFrame(docs, DOCS)
    return {(r.doc_id, r.item_id): r for r in contaminated(frame, spark.createDataFrame(items, ITEMS), **params).collect()}


def test_verbatim_and_reparameterised_items(spark):
    other = ITEM.replace("Anna", "Peter").replace("40", "65").replace("3", "9")
    clash = ITEM.replace("Anna at 40", "Anna at 65")
    docs = [(1, words(50, 1) + "\n" + ITEM + "\n" + words(40, 2), "x"), (2, words(50, 3) + ".\n" + other, "x"), (3, words(300, 4), "x"), (4, clash, "x"), (5, OTHER + " " + OTHER, "x"), (6, None, None), (7, "", None), (8, " ".join(ITEM.split()[:12]), "x")]
    got = found(spark, docs, [(10, ITEM), (11, OTHER), (12, "too short"), (13, None)])
    assert set(got) >= {(1, 10), (2, 10), (5, 11)}
    assert {d for d, _ in got} == {1, 2, 5}
    assert got[(1, 10)].coverage == 1.0


def brute(docs, items, window=8, coverage=0.5):
    """Verbatim windows only."""
    own, out = Canonicaliser(), set()
    for d, text, _ in docs:
        have = set(own.windows(text or "", window, 5)[1].tolist())
        for i, item in items:
            w = own.windows(item or "", window, 5)[1].tolist()
            if w and sum(x in have for x in w) >= coverage * len(w):
                out.add((d, i))
    return out


@pytest.mark.parametrize("bits", [15, 22])
def test_equals_brute_force_without_placeholders(spark, bits):
    items = [(i, words(30, 100 + i)) for i in range(12)]
    docs = [(i, words(60, i) + " " + " ".join(items[i % 12][1].split()[: 8 + i % 22]) + " " + words(60, 1000 + i), "x") for i in range(60)]
    got = found(spark, docs, items, bits=bits)
    assert set(got) == brute(docs, items)
    assert 0 < len(got) < 60


def test_drop_keeps_columns_repeats_and_clean_rows(spark):
    rows = [(1, ITEM, "x"), (1, "clean text", "x"), (None, ITEM, None), (2, "clean", "x"), (2, "clean", "x"), (3, None, "x")]
    left = drop_contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(10, ITEM)], ITEMS))
    assert left.columns == ["doc_id", "text", "item_id"]
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 2, 3]
    assert drop_contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([(10, ITEM)], ITEMS)).count() == 0
    assert drop_contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], ITEMS)).count() == 6


def test_passages_in_capitals_and_short_items(spark):
    short, heavy = "What is 12 times 7?", "Anna Bell 4 5 6 7 8 9 10 11 12 Tom Smith 13 14 15"
    docs = [(1, words(30, 1) + "\n" + ITEM.upper() + "\n" + words(20, 2), "x"), (2, words(9, 3) + " " + OTHER.title(), "x"), (3, "so WHAT IS 12 TIMES 7? and on", "x"), (4, "a b " + heavy.lower() + " c", "x"), (5, "what is 13 times 7?", "x"), (6, "what is 12 times", "x")]
    got = found(spark, docs, [(10, ITEM), (11, OTHER), (12, short), (13, heavy), (14, "..."), (15, None)])
    assert set(got) == {(1, 10), (2, 11), (3, 12), (4, 13)}
