import random

import pytest

from foliograph.llm import ngrams

DOCS = "doc_id long, text string"


def brute(rows, threshold=0.8, n=5):
    sh, sets = ngrams.Shingler(n), {}
    for d, t in rows:
        if d is not None:
            s = frozenset(sh(t).tolist())
            if d not in sets or s:
                sets[d] = s
    ids = sorted(sets)
    links = {d: {e for e in ids if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e]) - 1e-9} for d in ids}
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for d in ids:
            least = min([root[d], *(root[e] for e in links[d])])
            if least < root[d]:
                root[d], changed = least, True
    same = {d: min(e for e in ids if sets[e] == sets[d]) if sets[d] else d for d in ids}
    return sorted((d, same[d], len(links[d]), root[d], root[d] == d) for d in ids)


def corpus(seed=5, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 200]))]
        rows.append((i, " ".join(words)))
    return rows


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"members": 4}, {"unit": 300}])
def test_equals_brute_force(spark, options):
    rows = corpus() + [(900, None), (901, ""), (902, "?!"), (903, "?!"), (904, "a b"), (905, "A, b!"), (0, corpus()[0][1]), (None, "x y z"), (906, "the " * 400), (907, "the the the the the")]
    got = result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS), **options))
    assert got == brute(rows) and any(r[2] for r in got)


def test_hot_groups_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(500)]
    rows += [(1000 + i, " ".join(base[:50] + [f"own{i}"] + base[51:])) for i in range(150)]
    got = {r[0]: r for r in result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS), members=32))}
    assert got[0][2] == 499 + 150 and got[1000][2] == 500 + 149 and {r[3] for r in got.values()} == {0}


def test_long_text_and_order_of_rows(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(10**6)}" for _ in range(50_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-2000])), (3, " ".join(reversed(long)))]
    want = [(1, 1, 1, 1, True), (2, 2, 1, 1, False), (3, 3, 0, 3, True)]
    assert result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS))) == want
    assert result(ngrams.near_duplicates(spark.createDataFrame(rows[::-1], DOCS).repartition(3))) == want


def test_empty_table_and_clashing_names(spark):
    assert ngrams.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], DOCS + ", rep int, cluster int")
    assert result(ngrams.near_duplicates(df)) == [(1, 1, 1, 1, True), (2, 1, 1, 1, False)]


def test_prefix_reaches_the_target_recall():
    k = ngrams.least_depth(0.8, 16, 0.9995)
    assert 1 - (1 - 0.8**k) ** 16 >= 0.9995 > 1 - (1 - 0.8 ** (k + 1)) ** 16


def test_different_texts_under_one_key(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w")]
    got = result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS)))
    assert [r[0] for r in got] == [1, 2, 3] and got[0][2] == 1 and got[1][2] + got[2][2] == 1


def test_null_and_empty_rows_of_a_key_give_way_to_its_text(spark):
    rows = [(1, "a b c d e f g"), (2, None), (2, "a b c d e f g"), (3, ""), (3, "a b c d e f g"), (4, None), (4, "?")]
    want = [(1, 1, 2, 1, True), (2, 1, 2, 1, False), (3, 1, 2, 1, False), (4, 4, 0, 4, True)]
    assert result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS))) == want


def test_prefixes_are_shortened_until_the_links_found_say_that_nearly_all_are(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(40)]
    close = [(2 * i + j, " ".join(b + ["x"] * j)) for i, b in enumerate(base) for j in (0, 1)]  # one shingle apart
    far = close + [(1000 + i, " ".join(b[:330])) for i, b in enumerate(base)]  # near the threshold
    depths = {}
    for name, rows in (("close", close), ("far", far)):
        told = []
        got = result(ngrams.near_duplicates(spark.createDataFrame(rows, DOCS), told=told))
        depths[name] = [k for k, _, _ in told]
        assert got == brute(rows) and sum(r[2] for r in got) == 2 * told[-1][1]  # each link is found once
    assert depths["close"] == [8] and depths["far"] == [8, 7, 6, 5, 4]


def test_a_pair_is_fresh_in_one_node_only():
    import numpy as np

    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (60, 4)).astype(np.uint64))
    size, every = np.full(60, 9.0), slice(0, 60)
    met = np.zeros((60, 60), int)
    for k in range(8, 0, -1):
        for t in range(4):
            prefix = codes[:, t] >> np.uint64(ngrams.SHIFT[k])
            met += (prefix[:, None] == prefix[None, :]) & ngrams.fresh(size, codes, every, every, k, t, 0.8)
    np.fill_diagonal(met, 1)
    top = (codes >> np.uint64(ngrams.SHIFT[1]))
    assert (met == np.where(np.eye(60, dtype=bool), 1, (top[:, None, :] == top[None, :, :]).any(axis=2))).all()
