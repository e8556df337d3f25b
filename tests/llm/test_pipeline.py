import random

import public_tokenizers as public
import pytest
import tiktoken

import corpus_pipeline
from foliograph.llm import bpe, common, queries


def test_components_of_any_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(6000, 6300)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_filter_has_no_false_negatives(spark):
    a = spark.range(20_000).withColumnRenamed("id", "x")
    keys = a.where("x % 7 = 0")
    got = common.maybe_among(a, "x", keys)
    assert got.where("x % 7 = 0 AND NOT __may").count() == 0 and got.where("x % 7 <> 0 AND __may").count() < 100
    assert common.maybe_among(a, "x", keys.limit(0)).where("__may").count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    d = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda n=60: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda: " ".join(["SPAM!!"] * rng.randint(20, 50))
    docs = [(i, good(), "en", "s", 1) for i in range(120)] + [(200 + i, junk() + str(i), "en", "s", 1) for i in range(40)]
    item = good(30)
    docs += [(300, docs[0][1], "en", "s", 1), (301, docs[1][1].replace(" ", "  "), "en", "s", 1), (302, good(20) + " " + item, "en", "s", 1), (303, good() + " token = f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "en", "s", 1)]
    docs += [(304, good(), None, None, None), (304, None, "en", "s", 1), (5, docs[5][1], "en", "s", 1)]
    spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, lang string, source string, n_chars long, shard string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(100)] + [(200 + i, 0) for i in range(30)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.DOCUMENTS)
    assert not kept[0] & set(range(200, 240)) and set(range(100)) <= kept[0]
    assert kept[0] - kept[1] == {300, 301} and kept[1] - kept[2] == {302} and kept[2] == kept[3] == kept[4]
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0 and docs.where("doc_id = 304").first().n_tokens > 0


def test_near_duplicates_are_judged_by_the_rows_that_stay(spark):
    a, z = " ".join(f"a{i}" for i in range(30)), " ".join(f"z{i}" for i in range(30))
    rows = [(1, a), (2, None), (2, a), (3, z), (4, a), (4, z), (5, a + " more"), (5, "")]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, None).collect())
    assert got == [(1, a), (3, z)]


def test_documents_without_an_id_are_compared_and_dropped(spark, tmp_path):
    a, z, item = (" ".join(f"{c}{i}" for i in range(30)) for c in "azb")
    rows = [(1, a), (None, a), (None, a + " more"), (None, z), (None, z), (None, item), (None, "x " + item), (None, None), (None, None), (2, None)]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: sorted((r.doc_id or 0, (r.text or "").removeprefix("x ")) for r in df.collect())
    once = corpus_pipeline.keep_one_of_each(spark, docs, None)
    assert texts(once) == sorted([(1, a), (0, z), (0, item), (0, ""), (0, ""), (2, "")])
    assert texts(corpus_pipeline.drop_benchmark(spark, once, str(tmp_path))) == sorted([(1, a), (0, z), (0, ""), (0, ""), (2, "")])
    found = sorted(tuple(-1 if x is None else x for x in r) for r in queries.QUERIES["op6_minhash_forest"](spark, str(tmp_path)).collect())
    none = [(-1, -1, 0, -1, True)] * 2
    pairs = [(-1, -1, 1, -1, k) for k in (False, False, True, True)]
    assert found == sorted([(1, 1, 2, 1, True), (-1, 1, 2, 1, False), (-1, -1, 2, 1, False), *pairs, *none, (2, 2, 0, 2, True)])


def test_run_masks_and_encodes(spark, folder):
    tokens = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert "f3ef4d6b" not in enc.decode(got[303].ids) and "[SECRET]" in enc.decode(got[303].ids)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100").collect()}
    assert all(got[i].ids == enc.encode_ordinary(texts[i]) for i in range(100) if i in got)


def test_empty_documents(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
