import numpy as np
import pytest

from textloom.llm.common import connected_components, forest, free_name


def kruskal(left, right, weight):
    parent, out = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k in sorted(range(len(left)), key=lambda k: (weight[k], min(left[k], right[k]), max(left[k], right[k]))):
        a, b = root(left[k]), root(right[k])
        if a != b:
            parent[a] = b
            out.append((weight[k], min(left[k], right[k]), max(left[k], right[k])))
    return sorted(out)


def test_forest_is_the_minimum_spanning_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 300))
        left, right, weight = rng.integers(0, n, m) * 7 - 50, rng.integers(0, n, m) * 7 - 50, rng.integers(0, 5, m)
        kept = forest(left, right, weight)
        assert sorted((weight[k], min(left[k], right[k]), max(left[k], right[k])) for k in kept.tolist()) == kruskal(left.tolist(), right.tolist(), weight.tolist())


def test_components_of_a_long_chain_and_of_too_few_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "src bigint, dst bigint")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    with pytest.raises(RuntimeError):
        connected_components(edges, rounds=1)


def test_free_names(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "key int, key_ int"), "key") == "key__"
