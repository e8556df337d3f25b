import zlib

import numpy as np
import pytest

from foliograph.llm import quality as q

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def auc(u, y):
    order = np.argsort(np.argsort(u, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0


def test_held_out_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = q.op4_bradley_terry(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert ((held.score >= 0.3).astype(int) == held.predicted).all() and out.score.between(0, 1).all()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.99 and (held.predicted == held.quality).mean() > 0.99


def test_fold_is_by_crc32(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", q.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_features_are_finite_for_any_text():
    for t in ("", " ", "\n\n", "a", "!" * 100_000, "word " * 50_000, "é🙂", "\x00"):
        x = q.features(t)
        assert len(x) == len(q.FEATURES) and np.isfinite(x).all()


def test_pairs_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(q.FEATURES)))
    y = (x[:, 3] + 0.1 * rng.normal(size=400) > 0.5).astype(int)
    r = q.fit(x, y, pairs=4000)
    assert auc(r.utility(x), y) > 0.95 and abs((r.utility(x) < r.cut).mean() - (y == 0).mean()) < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0)], [(None, 1), (2, None), (3, 7)]])
def test_labels_without_pairs_keep_everything(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "x"), (3, "")], DOCS)
    got = q.score(docs, q.train(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and got[0].score >= 0.3


def test_copies_and_nulls_score_alike_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(i, "GOOD text here, and more of it." if i % 2 else "bad bad bad bad !!") for i in range(40)] + [(100, None), (101, ""), (102, "x " * 200_000)], DOCS)
    r = q.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], LABELS))
    got = {x.doc_id: x.score for x in q.score(docs, r).collect()}
    assert got[1] == got[3] > 0.3 > got[0] == got[2] and got[100] == got[101]
    assert q.score(docs.limit(0), r).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * (1 + i % 3)) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], LABELS)
    assert q.train(docs, labels, rows=50) == q.train(docs.repartition(3), labels.repartition(5), rows=50)


def test_fit_is_the_least_loss_and_the_cut_has_the_fewest_errors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, len(q.FEATURES)))
    y = (x[:, 2] - x[:, 7] + rng.normal(size=120) > 0.3).astype(int)
    r = q.fit(x, y, pairs=500, seed=9)
    draw = np.random.default_rng(9)  # the same pairs, one by one
    good, bad = ([i for i in range(120) if y[i] == k] for k in (1, 0))
    pairs = list(zip(draw.choice(good, 500), draw.choice(bad, 500), strict=True))
    b = [r.basis(row[None])[0] for row in x]

    def loss(w):
        return sum(np.log1p(np.exp(-float((b[i] - b[j]) @ w))) for i, j in pairs) / len(pairs) + 1e-3 / 2 * float(w @ w)

    w = np.array(r.weights)
    least = loss(w)
    for k in range(len(w)):
        e = np.eye(len(w))[k] * 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-5
    assert all(loss(w + rng.normal(size=len(w)) * s) > least for s in (1e-3, 0.1, 1) for _ in range(5))
    u = [float(v @ w) for v in b]
    errors = lambda cut: sum((s >= cut) != (k == 1) for s, k in zip(u, y, strict=True))
    assert errors(r.cut) == min(errors(c) for c in u)
    assert r.share == sum(s < r.cut for s in u) / len(u)


def test_score_is_the_formula_and_other_columns_stay(spark):
    rows = [(i, ("Good text here, and more of it. " if i % 2 else "bad bad !! ") * (i + 1), 0.5, 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, __key int")
    r = q.train(docs, spark.createDataFrame([(i, i % 2, 1) for i in range(12)], "doc_id long, quality int, text int"))
    got = {x.doc_id: x for x in q.score(docs, r).collect()}
    for i, text, _, _ in rows:
        z = [max(-6, min(6, (a - c) / s)) for a, c, s in zip(q.features(text), r.centre, r.spread, strict=True)]
        base = z + [max(0, a - 1) for a in z] + [max(0, -a - 1) for a in z] + [max(0, a - 2.5) for a in z]
        u = sum(a * w for a, w in zip(base, r.weights, strict=True)) - r.cut
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-u) * 0.7 / 0.3), abs=1e-9) and got[i]["__key"] == 3
        assert (got[i].score >= 0.3) == (u >= 0)
