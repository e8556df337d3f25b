"""Exact metric range join of embeddings.

Vectors on the unit sphere are within cosine c of each other exactly when they are within r = sqrt(2 - 2c). Pivots part
the vectors into cells, by the nearest pivot; a vector is also sent to a cell with a smaller number when the triangle
inequality, in its form for Euclidean space, allows a vector within r of it there. Every pair within r then meets in
the cell of one of its two homes, and cells join independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hot, look_up, written

SLACK = 1e-9  # for the rounding of distances; cells may only grow by it


def unit(vectors) -> np.ndarray:
    x = np.vstack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n pivots of the sample, each the farthest from those before it."""
    chosen, near = [0], 1 - sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - sample @ sample[chosen[-1]])
    return sample[chosen]


def pivots(classes: DataFrame, cell: int, most: int) -> dict:
    """(label, dimensions) -> pivots, for labels of more than `cell` vectors; `most` pivots in all, from most x 4 vectors."""
    counts = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    each = max(cell, -(-2 * total // most))  # vectors a pivot
    large = {(r["label"], r["dims"]): -(-r["n"] // each) for r in counts.where(F.col("n") > each).collect()}  # most / 2 at most
    share = F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) < F.lit((1 << 30) * 4) / F.lit(each)
    some = classes.where(share).join(counts.where(F.col("n") > each).select("label", "dims"), ["label", "dims"], "left_semi")
    rows = some.select("label", "dims", "vector").orderBy("h1", "h2").limit(4 * most).toPandas()
    return {k: spread(unit(g["vector"]), large[k]) for k, g in rows.groupby(["label", "dims"]) if large.get(k, 0) > 1}


def near_links(
    df: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cell: int = 2048, most_pivots: int = 2048, block: int = 1024,
) -> DataFrame:
    """One row per vector: its key, n_links, component_id and kept, for links of cosine >= threshold between equal labels.

    n_links counts the other vectors linked directly, component_id is the smallest key that links reach, kept says that
    it is the vector's own. Vectors that are null, empty or zero, or hold null or non-finite components, and those with
    a null label link with nothing, as do vectors of unlike length. Repeated rows count as vectors of their own; a null
    key counts but never names a component. An empty table gives an empty result. Other columns are not read.

    Equal vectors (equal by a 128-bit hash) are one class, joined once and counted with its size. A cell of more than
    `block` vectors is joined in pairs of blocks. Tasks return counts and one link to a root for each vector, never
    pairs, so neither hot labels nor dense groups widen the output. Nothing is approximate.
    """
    v = F.col("vector")
    usable = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & usable, F.lit(False))
    rows = rows.withColumns({"h1": F.when(good, F.xxhash64(v)), "h2": F.when(good, F.xxhash64(F.lit(7), v)), "dims": F.size(v)})
    one = ["label", "dims", "h1", "h2"]
    classes = rows.where("h1 is not null").groupBy(*one).agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))  # a number that stays, as it is written
    at = pivots(classes, cell, most_pivots)
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby(["label", "dims"], sort=False):
                p, n = at.get(k), len(g)
                if p is None:
                    yield g.assign(cell=0, home=True)
                    continue
                far = np.maximum(0, 2 - 2 * unit(g["vector"]) @ p.T)  # squared distances
                home = far.argmin(axis=1)
                apart = np.sqrt(np.maximum(1e-18, 2 - 2 * p @ p.T))[home]
                sent = (far - far[np.arange(n), home][:, None]) / (2 * apart) <= reach
                sent &= np.arange(len(p)) < home[:, None]
                i, j = np.nonzero(sent)
                yield pd.concat([g.assign(cell=home, home=True), g.iloc[i].assign(cell=j, home=False)])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("label", "dims", "rep", "copies", "vector", "id")) + ", cell int, home boolean"
    placed = classes.select("label", "dims", "rep", "copies", "vector", "id").mapInPandas(cells, schema)
    sizes = placed.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.col("id"), F.col("blocks")).cast("int")
    dealt = placed.join(sizes, ["label", "dims", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("other", "blocks")

    def join(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["own"] == k[3]], g[g["own"] == k[4]]
        x, y = unit(a["vector"]) if len(a) else None, unit(b["vector"]) if len(b) else None
        if x is None or y is None:
            return g.head(0)[["id", "rep"]].assign(links=0, root=g.head(0)["rep"])
        near = x @ y.T >= threshold
        near &= a["home"].to_numpy()[:, None] | b["home"].to_numpy()[None, :]
        if k[3] == k[4]:
            np.fill_diagonal(near, False)
        ids = pd.concat([a, b])[["id", "rep", "copies"]] if k[3] != k[4] else a[["id", "rep", "copies"]]
        w, u = a["copies"].to_numpy(), b["copies"].to_numpy()
        links = near @ u if k[3] == k[4] else np.concatenate([near @ u, near.T @ w])
        n, root = len(a), np.arange(len(ids))
        cols = root if k[3] == k[4] else root[n:]
        while True:  # the smallest position that links reach, here
            left = np.minimum(root[:n], np.where(near, root[cols][None, :], len(root)).min(axis=1))
            new = root.copy()
            new[:n] = left
            new[cols] = np.minimum(new[cols], np.where(near, left[:, None], len(root)).min(axis=0))
            if (new == root).all():
                break
            root = new
        out = ids.assign(links=links, root=ids["id"].to_numpy()[root])
        return out[out["links"] > 0][["id", "rep", "links", "root"]]

    found = written(units.groupBy("label", "dims", "cell", "b1", "b2").applyInPandas(lambda k, g: join(k, g), f"id long, rep {kinds['rep']}, links long, root long"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    parts = written(parts.join(classes.select("id", "rep"), "id"))
    least = parts.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    full = hot(least, "component", "n", parts.count())
    parts = look_up(parts.select("id", "component"), least.drop("n"), "component", full).select("id", "least")
    own = classes.where("copies > 1").select("id", (F.col("copies") - 1).alias("links"), "rep")
    known = own.unionByName(found.select("id", "links", "rep")).groupBy("id").agg(F.sum("links").alias("links"), F.min("rep").alias("rep"))
    known = known.join(parts, "id", "left").select("id", "links", F.coalesce(F.least("least", "rep"), "rep", "least").alias("least"))
    known = written(classes.select("id", "copies", *one).join(known, "id"))
    # the rows of a class with very many copies get its answer by broadcast, the others by exchange
    many = F.col("copies") > max(256, (classes.agg(F.sum("copies")).first()[0] or 0) // 4096)
    every = rows.select("key", *one).join(F.broadcast(known.where(many).select(*one, "links", "least")), one, "left")
    rest = every.where("links is null").drop("links", "least").join(known.where(~many).select(*one, "links", "least"), one, "left")
    component = F.coalesce("least", "key")
    return every.where("links is not null").unionByName(rest).select(
        F.col("key").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"),
    )


def op2_metric_range_join(spark, sf_dir):
    return near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)
