"""What the operators of this subpackage share: tables, cut lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kept import drop, release, shared_dir, written

__all__ = ["connected_components", "drop", "hot", "identified", "look_up", "maybe_among", "release", "shared_dir", "spare", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names behind as many underscores as it takes for df to have no such column, in any case."""
    own, front = {c.lower() for c in df.columns}, "__"
    while any(f"{front}{n}".lower() in own for n in names):
        front += "_"
    return [f"{front}{n}" for n in names]


def identified(df: DataFrame, key: str = "doc_id", into: str = "__id") -> tuple[DataFrame, DataFrame | None]:
    """df with `into`, the key or, for each row with a null key, a number of its own from 2^62 on; and these numbers, if any.

    Rows with a null key are written first, so that each keeps its number however often the table is read.
    """
    unnamed = df.where(F.col(key).isNull())
    if unnamed.isEmpty():
        return df.withColumn(into, F.col(key).cast("long")), None
    unnamed = written(unnamed.withColumn(into, F.lit(1 << 62).bitwiseOR(F.monotonically_increasing_id())))
    return df.where(F.col(key).isNotNull()).withColumn(into, F.col(key).cast("long")).unionByName(unnamed), unnamed.select(into)


def maybe_among(df: DataFrame, column: str, keys: DataFrame, into: str = "__may") -> DataFrame:
    """df with a flag that is true for every row whose column is in keys (one column of its name), and false for most others.

    A filter of 2^26 bits, 8 MB in pieces of 4 KB however many keys there are, is broadcast; a join that follows then
    moves the rows it needs and few more. With very many keys the flag is true more often, and costs nothing else.
    """
    hashed = lambda: F.pmod(F.xxhash64(column), F.lit(1 << 26)) + 1
    bits = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(hashed()).alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(hashed())).alias("__bits"))
    at = F.bitmap_bit_position(hashed())
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    found = df.join(F.broadcast(bits), F.bitmap_bucket_number(hashed()) == F.col("__piece"), "left")
    return found.withColumn(into, F.coalesce(hit, F.lit(False))).drop("__piece", "__bits")


def hot(counted: DataFrame, key: str, n: str, total: int, parts: int = 4096) -> list:
    """The keys with more than a parts-th of all rows (and 256): parts of them at most. counted: a row a key."""
    return [k for (k,) in counted.where(F.col(n) > max(256, total // parts)).select(key).collect()]


def look_up(rows: DataFrame, table: DataFrame, key: str, keys: list) -> DataFrame:
    """rows left-joined with table, which has one row a key. Rows of the hot keys stay where they are and get theirs by
    broadcast, so that none of these keys is a task's work."""
    if not keys:
        return rows.join(table, key, "left")
    among = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.where(~among).join(table.where(~among), key, "left").unionByName(rows.where(among).join(F.broadcast(table.where(among)), key, "left"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), component the smallest node that links reach.

    Contraction in a new random order each round: every node moves to the first of itself and its neighbours in that
    order, edges are relabelled, and loops fall away. A round leaves two thirds of the nodes or fewer on average, stars
    take two or three rounds, and no neighbourhood is ever gathered: min() combines on the map side, and nodes with very
    many edges, or that very many have moved to, are looked up by broadcast. Nulls and loops link nothing; an empty input
    gives an empty result.
    """
    spark = edges.sparkSession
    old: list[str] = []
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), old)
    labels, turn = None, 0
    while n := e.count():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = e.select("a", order("b").alias("o")).unionByName(e.select(F.col("b").alias("a"), order("a").alias("o")))
        first = both.groupBy("a").agg(F.min("o").alias("o"), F.count("*").alias("degree")).select("a", F.least("o", order("a"))["n"].alias("to"), "degree")
        fresh: list[str] = []
        first = written(first, fresh)
        hubs = hot(first, "a", "degree", n)
        first = first.drop("degree")
        if labels is None:
            labels = written(first.select(F.col("a").alias("node"), F.col("to").alias("at")), fresh)
        else:
            full = hot(labels.groupBy("at").agg(F.count("*").alias("n")), "at", "n", labels.count())
            moved = look_up(labels, first.withColumnRenamed("a", "at"), "at", full)
            labels = written(moved.select("node", F.coalesce("to", "at").alias("at")), fresh)
        a, b = (first.select(F.col("a").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        e = look_up(look_up(e, a, "a", hubs), b, "b", hubs).where("a2 <> b2")
        e = written(e.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), fresh)
        drop(spark, old)
        old = fresh
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("at").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    full = hot(least, "at", "n", labels.count())
    return look_up(labels, least.drop("n"), "at", full).select("node", "component")
