"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

DataFrame functions only. The weight of a shingle is how often it occurs: similarity is the Jaccard similarity of
multisets of word shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_among, written

WORD = r"[\p{L}\p{M}\p{N}]+"
#: Bytes of benchmark shingles, or of index entries, up to which they are broadcast; more are joined by a shuffle.
SMALL = 64 << 20


def words(text: str) -> Column:
    """Runs of letters, marks and digits, in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def with_grams(df: DataFrame, text: str, n: int, into: str) -> DataFrame:
    """The hash of the n words from each position on; empty for fewer words. The words are a column of their own, so
    that they are found once, not again for each position."""
    hashes = F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.xxhash64(F.slice("__w", i, n)))
    found = F.when(F.size("__w") >= n, hashes).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__w", words(text)).withColumns({into: found, "n_words": F.size("__w")}).drop("__w")


def with_simhash(df: DataFrame, shingles: str, into: str) -> DataFrame:
    """Bit i of the fingerprint is set when more than half of the shingles have it; they vote once for each occurrence.

    A long sum holds the votes for bits k and k + 32 in its halves, so 32 sums do for 64 bits.
    """
    votes = f"transform(sequence(0, 31), k -> aggregate(`{shingles}`, 0L, (s, h) -> s + (shiftrightunsigned(h, k) & {1 | 1 << 32}L)))"
    low, high = f"(v & {(1 << 32) - 1}L) * 2 > size(`{shingles}`)", f"shiftrightunsigned(v, 32) * 2 > size(`{shingles}`)"
    bits = f"transform({votes}, (v, k) -> IF({low}, shiftleft(1L, k), 0L) | IF({high}, shiftleft(1L, k + 32), 0L))"
    return df.withColumn(into, F.expr(f"aggregate({bits}, 0L, (s, x) -> s | x)"))


def blocks(radius: int, each: int = 2) -> list[tuple[int, int]]:
    """(shift, width) of the fewest blocks of 64 bits of which one holds at most `each` of any `radius` differences."""
    n = radius // (each + 1) + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_value(fingerprint: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(fingerprint), shift).bitwiseAND(F.lit((1 << width) - 1))


def bounded(df: DataFrame, size: Column | int) -> DataFrame:
    """df, to be broadcast if its rows of that many bytes add up to little."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(size))).first()[0] or 0) <= SMALL else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = 0.8, n: int = 5, radius: int = 20,
) -> DataFrame:
    """One row for each document and benchmark item of similarity >= threshold: key, item, similarity, start_word, n_words.

    An item of w words is compared with every window of w words (the whole document where that is shorter), and the
    window with the greatest similarity, of those the first, is returned. Windows that hold too few of an item's
    shingles to reach the threshold get no fingerprint. The blocks find all fingerprints within `radius` bits; a
    similarity of 0.8 is about 10 bits, and beyond 20 bits lie fewer than one in a thousand such pairs.

    Null and empty texts, and items of fewer than n words, match nothing; repeated rows give the rows of one; null keys
    and items are kept as such. Empty tables give an empty result. Other columns are not read. A document's work is
    bounded by its own length; hot sources, copies and common passages only add rows, spread as the documents are.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).distinct()
    items = with_grams(items, "text", n, "ig").select("item", F.col("n_words").alias("len"), "ig").where(F.col("len") >= n)
    items = written(with_simhash(items, "ig", "ifp"))
    marks = items.select(F.col("item").alias("i"), "len", F.explode(F.array_distinct("ig")).alias("g"))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    # outer, as a filter on the array's size would be pushed down to where the words aren't a column yet
    shingled = with_grams(rows, "text", n, "dg").select("key", "th", "dg")
    hits = shingled.select("key", "th", F.size("dg").alias("long"), F.posexplode_outer("dg").alias("pos", "g")).join(bounded(marks, 48), "g")
    hits = hits.groupBy("key", "th", "long", "i", "len").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    size = F.least(F.col("len") - (n - 1), F.col("long"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("len") - (n - 1) + F.col("m")) - 1e-9).cast("int")
    hits = hits.withColumn("m", size).withColumn("need", F.greatest(need, F.lit(1))).where("size(at) >= need")

    def starts(i: Column) -> Column:
        """Of windows that hold the hits from the i-th on, as many as are needed."""
        a, b = F.get("at", i), F.get("at", i + F.col("need") - 1)
        first, last = F.greatest(F.lit(0), b - F.col("m") + 1), F.least(a, F.col("long") - F.col("m"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    begins = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), starts)))
    found = hits.select("key", "th", F.transform(begins, lambda s: F.struct(F.col("len").alias("len"), F.col("m").alias("m"), s.alias("start"))).alias("w")).where("size(w) > 0")
    found = written(found.groupBy("key", "th").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w")))

    # null keys meet, too
    likely = maybe_among(rows, "th", found.select("th")).where("__may").drop("__may")
    here = likely.join(found.withColumnsRenamed({"key": "k", "th": "h"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")))
    here = with_grams(here.dropDuplicates(["key", "th"]), "text", n, "dg").select("key", "th", "w", "dg")
    windows = here.select("key", "th", "dg", F.explode("w").alias("x")).select("key", "x.len", "x.start", F.slice("dg", F.col("x.start") + 1, F.col("x.m")).alias("wg"))
    windows = with_simhash(windows, "wg", "fp")

    parts = blocks(radius)
    masks = [[sum(1 << b for b in c) for r in range(3) for c in combinations(range(w), r)] for _, w in parts]
    keys = [F.transform(F.array(*(F.lit(x).cast("long") for x in m)), near(j, block_value("ifp", s, w))) for j, ((s, w), m) in enumerate(zip(parts, masks, strict=True))]
    index = items.select("item", "len", "ig", "ifp", F.explode(F.flatten(F.array(*keys))).alias("b"))
    probes = F.array(*(F.struct(F.lit(j).alias("block"), block_value("fp", s, w).alias("value")) for j, (s, w) in enumerate(parts)))
    probed = windows.withColumn("b", F.explode(probes)).join(bounded(index.select("item", "len", "ifp", "b"), 64), ["len", "b"])
    close = probed.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    close = close.drop("b").dropDuplicates(["key", "item", "len", "start", "fp", "wg"])
    pairs = close.join(bounded(items.select("item", "len", "ig", "ifp"), 64 + 8 * F.size("ig")), ["item", "len", "ifp"])

    common = F.array_intersect("wg", "ig")
    plain = (F.size(F.array_distinct("wg")) == F.size("wg")) & (F.size(F.array_distinct("ig")) == F.size("ig"))
    times = lambda a, g: F.size(F.filter(a, lambda x: x == g))
    shared = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, g: s + F.least(times("wg", g), times("ig", g))))
    similar = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("wg") + F.size("ig") - F.col("shared")).cast("double"))
    best = similar.where(F.col("similarity") >= threshold - 1e-12).groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "len")).alias("x"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "x.similarity", (-F.col("x.s")).alias("start_word"), F.col("x.len").alias("n_words"))


def near(block: int, value: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value"))


def op3_simhash_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
