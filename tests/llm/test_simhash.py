import itertools

import numpy as np
import xxhash

from textloom.llm.simhash import covering_triples, drop_near_duplicates, near_duplicate_groups, simhash_components, simhash_groups

DOCS = "doc_id bigint, text string, lang string"


def brute_print(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, linked):
    ids = sorted(rows)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(rows[a], rows[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(n // 4)]
    texts = []
    for i in range(n):
        words = list(base[i % len(base)])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = "changed"
        texts.append(" ".join(words))
    return texts


def test_triples_cover_every_four_of_eight():
    triples = covering_triples()
    assert len(triples) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in triples)


def test_components_equal_brute_force(spark):
    texts = [*corpus(), None, "", " \n ", "One", "one", "Två ord"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame(rows, DOCS)).collect()}
    prints = {i: brute_print(t) for i, t, _ in rows}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert len(set(want.values())) < len(want)


def test_large_group_is_dealt_in_blocks(spark):
    from textloom.llm.simhash import index_links, grouped_pairs  # noqa: F401
    from textloom.llm.common import connected_components

    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))}
    nodes = spark.createDataFrame([(p, p) for p in prints], "content bigint, f0 bigint")
    links = index_links(nodes, 1, covering_triples(), 4, 4, block=16)
    assert links.count() < 20 * 40 * len(prints)
    assert connected_components(links).select("component").distinct().count() == 1


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "same text here", "a"), (1, "same text here", "a"), (None, "same text here", "b"), (None, None, None)]
    got = simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.component_id) == [(-1, 1), (1, 1), (1, 1)]
    assert simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicate_groups_hold_only_similar_texts(spark):
    texts = corpus(7, 80)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(docs).collect()}
    want = brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)
    for i, g in got.items():
        assert want[i] == want[g]
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] != i for i in linked) >= 0.9 * len(linked)


def test_drop_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (2, "A b c d e f g", "y"), (3, "other words", None), (3, "other words", None), (4, None, None)]
    left = drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def boundary_texts(seed=11):
    """Texts of few and many words with copies whose Jaccard similarity lies about 0.8."""
    rng = np.random.default_rng(seed)
    texts = []
    for n in [*range(5, 30)] * 4 + [60, 120, 300] * 8:
        words = [f"v{i}" for i in rng.integers(0, 5000, n)]
        texts.append(" ".join(words))
        texts.append(" ".join([*words, *[f"x{i}" for i in rng.integers(0, 5000, max(1, n // 6))]]))
        changed = list(words)
        for at in rng.integers(0, n, max(1, n // 55)):
            changed[at] = "changed"
        texts.append(" ".join(changed))
    return texts


def test_near_duplicate_groups_lose_no_link(spark):
    texts = boundary_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(docs).collect()}
    assert got == brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)


def test_lists_that_are_thinned_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(260):
        words = list(base)
        for at in rng.integers(0, 100, int(rng.integers(1, 4))):
            words[at] = f"y{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(docs, block=64).collect()}
    assert got == brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)


def test_repeated_lines_do_not_hide_a_link(spark):
    rng = np.random.default_rng(2)
    line = " ".join(f"l{i}" for i in range(20))
    texts = []
    for n, times in enumerate((5, 20, 60)):
        words = [f"d{n}w{i}" for i in rng.integers(0, 10**6, 400)]
        texts += [" ".join(words) + "\n" + line, " ".join([*words[:200], "changed", *words[201:]]) + ("\n" + line) * times]
    assert all(jaccard(a, b) > 0.9 for a, b in zip(texts[::2], texts[1::2]))
    got = {r.doc_id: r.group_id for r in near_duplicate_groups(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_drop_tells_rows_without_or_with_shared_ids_apart(spark):
    text = "one text that also has a row with an id"
    rows = [(1, text, "x"), (None, text, "x"), (None, "second words of another kind", "x"), (None, "third text entirely", "x"), (None, "third text entirely", "y"), (5, "shared id and first text", "x"), (5, "other words under that id", "x"), (5, "other words under that id", "x")]
    left = drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "second words of another kind"), (0, "third text entirely"), (1, text), (5, "other words under that id"), (5, "shared id and first text")]


def test_drop_takes_its_groups_from_the_fingerprint_index(spark, monkeypatch):
    from textloom.llm import simhash

    asked, own = [], simhash.index_links
    monkeypatch.setattr(simhash, "index_links", lambda nodes, *more: asked.append(more[0]) or own(nodes, *more))
    texts = boundary_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    left = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    assert asked == [4]
    want = brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)
    got = {r.doc_id: r.group_id for r in simhash_groups(docs).collect()}
    assert left == {i for i, g in got.items() if i == g} and all(want[i] == want[g] for i, g in got.items())
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] != i for i in linked) >= 0.9 * len(linked)


def test_index_and_completion_lose_no_link(spark):
    texts = boundary_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.group_id for r in simhash_groups(docs).collect()}
    assert got == brute_components(dict(enumerate(texts)), lambda a, b: jaccard(a, b) >= 0.8)
