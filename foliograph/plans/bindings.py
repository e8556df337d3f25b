"""Bindings: the relational tables of a store as inputs of the document operators.

Each gives an operator its ordinals explicitly, as partition order means nothing, and reads only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def document_lines(spark, sf_dir) -> DataFrame:
    """doc_id, ord (from 0), line: every line of every document."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def order_events(spark, sf_dir) -> DataFrame:
    """A customer's orders as ordered field events: doc_id, ord, status, priority, day."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))


def line_cells(spark, sf_dir) -> DataFrame:
    """An order's lines as rows of a table: doc_id, row (from 1, unique), line number, quantity, price and flags.

    Line numbers repeat, so further columns break ties.
    """
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    return li.withColumn("row", F.row_number().over(w)).withColumnRenamed("l_orderkey", "doc_id")


def customer_chain(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as styles that are based on one another: style_id, based_on, and declared values."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("style_id"), F.lit(None).cast("string").alias("based_on"), F.col("r_name").alias("name"), F.lit(True).alias("declared"), F.col("r_regionkey").cast("double").alias("value"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("style_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("based_on"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 0).alias("declared"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("double")).alias("value"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("style_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("based_on"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("declared"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal")).alias("value"))
    return r.unionByName(n).unionByName(c)


def page_headings(spark, sf_dir) -> DataFrame:
    """doc_id, ord, level, text of the headings h1 to h6 of every page."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(h[1-6])[^>]*>.*?</h[1-6]>"), F.lit(0))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("ord", "h"))
    return rows.select("doc_id", "ord", F.substring("h", 3, 1).cast("int").alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("text"))


def page_blocks(spark, sf_dir) -> DataFrame:
    """doc_id, ord, kind, text of the h1, p and li elements of every page, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li)>.*?</(?:h1|p|li)>"), F.lit(0))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("ord", "h"))
    return rows.select("doc_id", "ord", F.regexp_extract("h", "^<(h1|p|li)>", 1).alias("kind"), F.regexp_replace("h", "<[^>]*>", "").alias("text"))


def comments(spark, sf_dir) -> DataFrame:
    """Turns as threaded comments: each answers the turn before it."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), F.col("role").alias("author"), "text")
