import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliograph.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, threshold=0.8, n=5):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    out = {}
    for doc, text in docs:
        g = grams(words(text))
        for item, said in items:
            own = grams(words(said))
            if not own or not g:
                continue
            m = min(len(own), len(g))
            for s in range(len(g) - m + 1):
                a, b = Counter(g[s : s + m]), Counter(own)
                shared = sum((a & b).values())
                similarity = shared / (m + len(own) - shared)
                best = out.get((doc, item))
                if similarity >= threshold and (best is None or similarity > best[0]):
                    out[doc, item] = (similarity, s, len(own) + n - 1)
    return {k: (round(v[0], 9), v[1], v[2]) for k, v in out.items()}


def found(df):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in df.collect()}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(12, 60))) for i in range(25)]
    items += [(100, "la " * 20), (101, "too short here"), (102, None), (103, ""), (104, "one two three four five")]
    docs = []
    for i in range(120):
        words = text(rng.randint(0, 150)).split()
        if i % 3 == 0:
            passage = items[rng.randrange(25)][1].split()
            if i % 6 == 0:
                at = rng.randrange(len(passage))
                passage = passage[:at] + rng.choice([[], ["new"], ["new", "er"]]) + passage[at + rng.randint(0, 1) :]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, (", " if i % 2 else " ").join(words).title()))
    b = items[3][1].split()
    docs += [(500, " ".join(b[:-1])), (501, " ".join(b[5:] + b[:5])), (502, "La " * 300), (503, None), (504, ""), (505, "la"), (506, items[0][1] + " " + items[1][1]), (507, "ONE two, three. Four-five"), (507, "ONE two, three. Four-five"), (None, items[2][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    got = found(d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    want = brute(docs, items)
    assert got == want and len(want) > 30


def test_long_text_and_hot_passage(spark):
    docs, items = corpus()
    hot = [(1000 + i, f"x{i} " + items[5][1]) for i in range(400)] + [(2000, "filler words here " * 20000 + items[7][1])]
    got = found(d.contaminated(spark.createDataFrame(hot, DOCS), spark.createDataFrame(items, ITEMS)))
    assert set(got) == {(1000 + i, 5) for i in range(400)} | {(2000, 7)}


def test_empty_tables_and_clashing_names(spark):
    docs, items = spark.createDataFrame([(1, "one two three four five", 3, "k")], DOCS + ", start int, key string"), spark.createDataFrame([(1, "one two three four five", 9)], ITEMS + ", len int")
    assert found(d.contaminated(docs, items)) == {(1, 1): (1.0, 0, 5)}
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = random.Random(1)
    parts = d.blocks(20)
    assert sum(w for _, w in parts) == 64
    for _ in range(500):
        mask = sum(1 << b for b in rng.sample(range(64), 20))
        assert any((mask >> s & ((1 << w) - 1)).bit_count() <= 2 for s, w in parts)


def test_simhash_is_the_majority_of_bits(spark):
    rows = [([1, 3, 3],), ([-1],), ([],), ([-(1 << 63), -1, 5],)]
    got = d.with_simhash(spark.createDataFrame(rows, "g array<long>"), "g", "fp").select("g", "fp").collect()
    for r in got:
        want = sum(1 << k for k in range(64) if 2 * sum((x >> k) & 1 for x in r.g) > len(r.g))
        assert r.fp == (want - (1 << 64) if want >> 63 else want)


def test_runs_without_python(spark):
    docs, items = corpus()
    plan = d.contaminated(spark.createDataFrame(docs, DOCS).withColumn("text", F.col("text")), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("radius", [8, 20, 23])
def test_blocks_cover(radius):
    assert d.blocks(radius)[0][0] == 0 and sum(w for _, w in d.blocks(radius)) == 64
