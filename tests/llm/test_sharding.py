import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import sharding


def brute(rows, shards, whole=0.01):
    """Shard and slot of each (doc_id, text) by sorting everything."""
    keyed = sorted(((int(hashlib.md5(t.encode()).hexdigest()[:15], 16) if t is not None else -1), d if d is not None else sharding.LOW + 1, len((t or "").encode()) + 8) for d, t in rows)
    total = sum(s for *_, s in keyed)
    group, before, out, at = {}, {}, {}, 0
    for k, d, s in keyed:
        group.setdefault(k, [at, 0])[1] += s
        before.setdefault((k, d), at)
        at += s
    n = {}
    for k, d, _ in keyed:
        first, size = group[k]
        shard = shards * (first if size <= whole * total / shards else before[k, d]) // total
        out.setdefault((k, d), []).append((shard, n.get(shard, 0)))
        n[shard] = n.get(shard, 0) + 1
    return sorted(x for v in out.values() for x in v)


TEXTS = ["", "a", "same", "é🙂" * 10, "long " * 4000] + [f"text {i} " * (i % 7) for i in range(300)]
CASES = {
    "mixed": [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, "same") for i in range(120)] + [(7, "text 2 " * 2), (7, "text 2 " * 2), (None, None), (None, "x"), (2000, None)],
    "all copies": [(i, "copy") for i in range(200)], "one": [(5, "only")], "few": [(1, "a"), (2, "b"), (3, None)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("shards", [1, 7, 24])
def test_equals_sorting_everything(spark, name, shards):
    df = spark.createDataFrame(CASES[name], "doc_id long, text string")
    got = sharding.shard(df, shards, part_bytes=2000)
    assert sorted((r.shard, r.slot) for r in got.collect()) == brute(CASES[name], shards)


def test_bytes_are_near_equal_and_slots_gapless(spark):
    df = spark.createDataFrame(CASES["mixed"] + [(10_000 + i, f"filler {i} " * 20) for i in range(2000)], "doc_id long, text string")
    got = sharding.shard(df, 10, part_bytes=3000).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() < 2.2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty, 4).count() == 0
    df = spark.createDataFrame([(1, "a", "x", 9, 1.0)], "doc_id long, text string, shard string, k long, size double")
    r = sharding.shard(df, 3).first()
    assert (r.shard, r.slot, r.k, r["size"]) == (0, 0, 9, 1.0)


def test_splitters_cut_only_large_groups(spark):
    rows = [(i, "hot") for i in range(1000)] + [(5000 + i, f"t{i}") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, part_bytes=500).toPandas()
    assert got[got.text == "hot"]["shard"].nunique() > 1
    n = got.groupby("shard").size().to_numpy()
    assert np.ptp(n) < 0.1 * n.mean()


def test_columns_named_like_those_inside_stay(spark):
    df = spark.createDataFrame([(1, "a", 7, "p", 8, 9)], "doc_id long, text string, __k long, __P string, __part long, ___d long")
    r = sharding.shard(df, 3).first()
    assert (r["__k"], r["__P"], r["__part"], r["___d"], r.slot) == (7, "p", 8, 9, 0) and len(r) == 8
