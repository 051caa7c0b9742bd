"""The stages one by one, on the sample tables and on odd rows, and all of them against a plain Python version."""

import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"long{i}" for i in range(30000))


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Sample documents beside rows with nulls, empty and long texts, repeats and shared ids, and a clashing column."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    kind = docs.schema
    rows = [(None, None, None, None, None), (None, "words without an id", None, "s", 3), (None, "other words without an id", None, "s", 3), (-1, "", "en", "s", 0), (-2, " \n ", "en", None, 3), (-3, LONG, "en", "s", len(LONG)), (-4, "one id and one text here", "en", "s", 24), (-4, "one id and one text here", "en", "s", 24), (-4, "one id but quite another text", "en", "s", 29)]
    return docs.union(spark.createDataFrame(rows, kind)).withColumns({c: F.lit(k) for k, c in enumerate(("position", "row", "key", "__row", "size"))})


def test_every_stage_takes_odd_rows(spark, sf, odd):
    own = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    before = own(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns, name
        after = own(got)
        if name == "mixing":
            assert set(after) <= set(before) and (-3, LONG) in after
            continue
        assert not after - before, name
        for row in [(None, "words without an id"), (None, "other words without an id"), (-3, LONG), (-4, "one id but quite another text"), (-4, "one id and one text here")]:
            assert after[row] == (1 if name == "near_duplicates" else before[row]), (name, row[0])
        wordless = sum(n for (_, t), n in after.items() if not (t or "").strip())
        assert wordless == (1 if name == "near_duplicates" else 3), name
    tokens = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    assert len(tokens) == sum(before.values()) and sum(r.n_tokens == 1 for r in tokens) == 3


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def jaccard_groups(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group, holders = list(range(len(sets))), {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders.get(x, ())} | ({k for k in range(i) if not sets[k]} if not s else set()):
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
        for x in s:
            holders.setdefault(x, []).append(i)
    return group


def test_all_stages_equal_a_plain_version(spark, sf):
    """Near-duplicates by sets, leaks by what stage 3 reports, the mix by its plan, tokens by the tokenizer."""
    from tokenizers import Tokenizer

    from textloom.llm import mixing, toxicity
    from textloom.llm.decontaminate import contaminated

    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(table("documents"), table("labels")).collect()}
    docs = sorted((r for r in table("documents").collect() if not scores[r.doc_id]), key=lambda r: r.doc_id)
    kept = [r for k, (r, g) in enumerate(zip(docs, jaccard_groups([r.text or "" for r in docs]))) if g == k]
    left = spark.createDataFrame(kept, table("documents").schema)
    bad = {r.doc_id for r in contaminated(left, table("benchmark")).collect()}
    items = [r.text for r in table("benchmark").collect()]
    assert bad >= {r.doc_id for r in kept if any(i and i in (r.text or "") for i in items)}
    clean = [r for r in kept if r.doc_id not in bad]
    copies = {r.doc_id: r.copies for r in mixing.curriculum(spark.createDataFrame(clean, table("documents").schema)).collect()}
    plain, start, want = Tokenizer.from_file(corpus_pipeline.word_vocabulary()), 0, []
    for r in clean:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids), zlib.crc32(raw)))
            start += len(ids)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("stage-")]
