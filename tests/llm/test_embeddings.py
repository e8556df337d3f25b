import numpy as np
import pytest

from foliograph.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    n = len(rows)
    good = [label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if good[i] and good[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    component = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                least = min(component[i], component[j])
                if component[i] != component[j]:
                    component[i] = component[j] = least
                    changed = True
    least = {}
    for i, c in enumerate(component):
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((r[0], len(links[i]), least[component[i]], r[0] == least[component[i]]) for i, r in enumerate(rows))


def clustered(n=250, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.15, 0.6])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3 == 0)))
    rows[9] = (9, [2 * x for x in rows[10][1]], rows[10][2])
    return rows


@pytest.mark.parametrize(("cell", "block", "most"), [(30, 16, 2048), (40, 1000, 16), (10_000, 1000, 2048), (10_000, 20, 2048)])
def test_equals_brute_force(spark, cell, block, most):
    rows = clustered()
    got = embeddings.near_links(spark.createDataFrame(rows, SCHEMA), 0.98, cell=cell, block=block, most_pivots=most)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 0.98)


def test_edge_cases(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [3.0, 0.1], 1),
            (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [3e38, 0.0], 1), (14, [-1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    got = embeddings.near_links(spark.createDataFrame(rows, SCHEMA), 0.98)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 0.98)


def test_empty_table_and_extra_columns(spark):
    assert embeddings.near_links(spark.createDataFrame([], SCHEMA), 0.98).count() == 0
    df = spark.createDataFrame([(1, [1.0], 1, 5, "x"), (2, [2.0], 1, 6, "y")], SCHEMA + ", cell int, rep string")
    assert sorted(tuple(r) for r in embeddings.near_links(df, 0.98).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_hot_class(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(3000)] + [(5000 + i, [float(i), 1.0], 0) for i in range(20)]
    got = {r.vec_id: r for r in embeddings.near_links(spark.createDataFrame(rows, SCHEMA), 0.98, cell=64, block=32).collect()}
    assert got[0].n_links == 2999 and got[2999].component_id == 0 and got[0].kept and not got[1].kept
