import numpy as np

from textloom.llm.embeddings import index_sizes, vector_components

VECTORS = "vec_id bigint, embedding array<float>, label int, extra string"


def brute(rows, cosine=0.98):
    n_links, parent = {}, {}
    good = [(i, np.array(v, dtype=float), y) for i, v, y, _ in rows if y is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    parent = {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_links = {i: 0 for i, *_ in rows}
    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[k + 1 :]:
            if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                n_links[i] += 1
                n_links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return n_links, {i: root(i) for i in parent}


def cloud(seed=5, n=200):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 16))
    rows = []
    for i in range(n):
        v = centres[i % 20] + rng.standard_normal(16) * 0.06 * (i % 3)
        rows.append((i, [float(np.float32(c)) for c in v], i % 20 % 4, "x"))
    return rows


def test_links_and_components_reach_brute_force(spark):
    rows = cloud()
    got = {r.vec_id: r for r in vector_components(spark.createDataFrame(rows, VECTORS)).collect()}
    links, component = brute(rows)
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(links.values())
    assert sum(got[i].component_id == component[i] for i in got) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def near_bound(n=6000, dims=64, seed=8):
    """Pairs of unit vectors whose cosine lies within 0.975 and 0.99, in two labels."""
    rng = np.random.default_rng(seed)
    a, b = (rng.standard_normal((n // 2, dims)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.975, 0.99, (n // 2, 1))
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * b)).astype(np.float32)
    return x, np.concatenate((np.arange(n // 2) % 2,) * 2)


def test_recall_about_the_bound(spark):
    x, label = near_bound()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int(((unit[label == y] @ unit[label == y].T) >= 0.98).sum() - (label == y).sum()) for y in (0, 1))
    frame = spark.createDataFrame([(i, v.tolist(), int(y), "x") for i, (v, y) in enumerate(zip(x, label))], VECTORS)
    got = sum(r.n_links for r in vector_components(frame).select("n_links").collect())
    assert 0.98 * want <= got <= want and want > 3000


def test_the_index_grows_with_a_small_power_of_the_vectors():
    sizes = [index_sizes(10**k, 0.98, 2.0, 0.1, 0.005) for k in range(2, 10)]
    assert all(p < q for (_, p), (_, q) in zip(sizes, sizes[1:]))
    assert sizes[-1][0] < 10**7 ** 0.2 * sizes[0][0]


def test_large_bucket_in_blocks_counts_each_pair_once(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(c)) for c in base + rng.standard_normal(16) * 0.01], 1, "x") for i in range(150)]
    got = vector_components(spark.createDataFrame(rows, VECTORS), block=16, width=4.0).collect()
    assert {r.n_links for r in got} == {149}
    assert {r.component_id for r in got} == {0}


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, "x"), (2, [], 1, "x"), (3, [0.0, 0.0], 1, "x"), (4, [1.0, None], 1, "x"), (5, [nan, 1.0], 1, "x"), (6, [inf, 1.0], 1, "x"), (7, [1.0, 0.0], None, "x"), (8, [1.0, 0.0], None, "x"), (9, [1.0, 0.0], 1, "x"), (9, [1.0, 0.0], 1, "x"), (10, [2.0, 0.0], 1, "x"), (11, [1.0, 0.0, 0.0], 1, "x"), (None, [0.0, 1.0], 2, "x")]
    got = vector_components(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert [by[i].n_links for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, None)] == [0] * 10
    assert by[9].n_links == 2 and by[10].n_links == 2 and by[10].component_id == 9
    assert by[7].component_id == 7 and by[7].kept
    assert vector_components(spark.createDataFrame([], VECTORS)).count() == 0
