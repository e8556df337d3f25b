"""N-gram Jaccard join: a MinHash LSH forest proposes, exact Jaccard similarity of word shingles decides.

Each set of shingles has a code in each of 16 trees: the top bits of 8 minhashes, one after the other, in 64 bits. Sorted
codes are the tree's prefix trie in depth-first order, and a node of depth k is the run of codes that share their first k
levels. Two sets meet in the deepest node that holds both, in the first tree that has one so deep, and are compared there
and nowhere else. The join descends from the full codes: prefixes are shortened level by level until the similarities
found so far say that nearly all links are found, or until even a pair of just the threshold would have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, identified, maybe_among, written

WORD = r"[\p{L}\p{M}\p{N}]+"
CACHE = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a code that each level of the trie takes, the root's children first: 64 in all. Sets whose bits agree by chance
#: are compared for nothing; none is lost by it.
LEVELS = (12, 12, 12, 12, 4, 4, 4, 4)
#: Bits that a code is shifted by to leave its first k levels, k = 0, 1, ..
SHIFT = tuple(64 - sum(LEVELS[:k]) for k in range(len(LEVELS) + 1))


class Hashes(dict):
    """Words to their hashes, made when first asked for."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = self.hash(word)
        return h


class Shingler:
    """Word shingles of a text as sorted distinct 64-bit hashes. Words are runs of letters, marks and digits in lower
    case. A text of fewer than n words has one shingle, of all its words; one without words has none."""

    def __init__(self, n: int):
        import regex

        self.n, self.hashes, self.split = n, Hashes(), regex.compile(WORD).findall

    def words(self, text: str | None) -> np.ndarray:
        found = self.split((text or "").lower())
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * ODD + w[i : len(w) - n + 1 + i]
        return np.unique(mixed(h))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_hash(s: np.ndarray) -> np.int64:
    return mixed(s).sum(dtype=np.uint64).astype(np.int64)


def met(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The chance that a pair of that similarity shares a prefix of `depth` levels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, target: float) -> int:
    """The longest prefix at which a pair of just the threshold meets in some tree with the chance `target`."""
    return next((k for k in range(len(LEVELS), 1, -1) if met(threshold, k, trees) >= target), 1)


def coded(df: DataFrame, key: str, text: str, n: int, trees: int) -> DataFrame:
    """key, h1, h2 (of the shingle set; null without shingles), size, and the code in each tree."""
    # a permutation is a product with an odd number and a sum
    a, c = (mixed(np.arange(1, trees * len(LEVELS) + 1, dtype=np.uint64) * np.uint64(x)) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
    a |= np.uint64(1)
    keep, up = (np.array(x, np.uint64) for x in ([64 - b for b in LEVELS], SHIFT[1:]))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for b in batches:
            out: list[tuple] = []
            for x in b.column(1):
                s = shingles(x.as_py())
                if not len(s):
                    out.append((None, None, 0, None))
                    continue
                low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 512):
                    h = s[i : i + 512, None] * a
                    h += c
                    np.minimum(low, h.min(axis=0), out=low)
                codes = ((mixed(low).reshape(trees, len(LEVELS)) >> keep) << up).sum(axis=1, dtype=np.uint64)
                out.append((int(set_hash(s)), int(set_hash(s ^ ODD)), len(s), codes.astype(np.int64).tolist()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], names=["key", "h1", "h2", "size", "codes"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(sign, "key long, h1 long, h2 long, size int, codes array<long>")


def forest_nodes(classes: DataFrame, trees: int, floor: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The tries' leaves with company at the floor: (tree, code, rep), sorted within tasks; and the nodes to compare: (k, tree, prefix, n).

    Of nodes that hold the same sets, in whatever trees and depths, one stays: the deepest, of those the one in the first
    tree. Nodes are counted by partial sums, and a node's leaves lie in one task, so little of this is exchanged.
    """
    leaves = classes.select("rep", F.posexplode("codes").alias("tree", "code")).withColumn("top", F.shiftrightunsigned("code", SHIFT[floor]))
    company = leaves.groupBy("tree", "top").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sibling = company.select(F.xxhash64("tree", "top").alias("at"))
    leaves = maybe_among(leaves.withColumn("at", F.xxhash64("tree", "top")), "at", sibling).where("__may").drop("at", "__may")
    forest = written(leaves.join(company, ["tree", "top"]).select("tree", "code", "rep").sortWithinPartitions("tree", "code"), keep)
    nodes = passed(forest, floor).groupBy("tree", "k", "prefix").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("s2")
    )
    one = F.max(F.struct("k", (-F.col("tree")).alias("t"), "prefix")).alias("x")
    nodes = nodes.where("n > 1").groupBy("n", "s1", "s2").agg(one).select("x.k", (-F.col("x.t")).alias("tree"), "x.prefix", "n")
    return forest, written(nodes, keep)


def passed(forest: DataFrame, floor: int) -> DataFrame:
    """tree, rep, k, prefix: the nodes that each leaf lies under, down from the floor."""
    nodes = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("code", SHIFT[k]).alias("prefix")) for k in range(floor, len(LEVELS) + 1)))
    return forest.select("tree", "rep", F.explode(nodes).alias("x")).select("tree", "rep", "x.k", "x.prefix")


def fresh(size: np.ndarray, codes: np.ndarray, a: slice, b: slice, k: int, tree: int, threshold: float) -> np.ndarray:
    """Which pairs of rows in a and in b, both in a node of depth k, meet in no deeper node and in none so deep of a tree
    before, and may reach the threshold by their sizes."""
    new = np.minimum(size[a, None], size[None, b]) >= threshold * np.maximum(size[a, None], size[None, b]) - 1e-9
    for t in range(codes.shape[1]):
        if (deep := k if t < tree else k + 1) <= len(LEVELS):
            s = np.uint64(SHIFT[deep])
            new &= (codes[a, t] >> s)[:, None] != (codes[b, t] >> s)[None, :]
    if a == b:
        np.fill_diagonal(new, False)
    return new


def by_node(g: pd.DataFrame) -> tuple[dict[str, np.ndarray], list[tuple[slice, slice]]]:
    """A unit's columns ordered by node, and for each node the rows of its two blocks (the same rows twice if it is one block)."""
    order = np.lexsort([g[c].to_numpy() for c in ("own", "prefix", "tree", "k")])
    at = {c: g[c].to_numpy()[order] for c in g.columns if c != "codes"}
    at["codes"] = np.vstack(g["codes"].to_list()).astype(np.int64).view(np.uint64)[order]
    at["size"] = at["size"].astype(np.float64)
    new = (np.diff(at["prefix"]) != 0) | (np.diff(at["tree"]) != 0) | (np.diff(at["k"]) != 0)
    ends = [0, *(np.flatnonzero(new) + 1), len(g)]
    blocks = []
    for i, j in zip(ends, ends[1:]):
        cut = i + int(np.searchsorted(at["own"][i:j], at["b2"][i]))
        blocks.append((slice(i, j), slice(i, j)) if at["b1"][i] == at["b2"][i] else (slice(i, cut), slice(cut, j)))
    return at, blocks


def blocked(rows: DataFrame, sizes: DataFrame, units: int) -> DataFrame:
    """rows of nodes (k, tree, prefix, rep, ..) dealt to units: a node with one block to a unit with others, one of several
    blocks in all pairs of blocks. sizes: the nodes with `blocks`."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, ["k", "tree", "prefix"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("k", "tree", "prefix")
    unit = F.when(F.col("blocks") == 1, F.pmod(node, F.lit(units))).otherwise(node)
    return dealt.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other"), "unit": unit}).drop("other", "blocks")


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, columns: int = 1 << 11) -> np.ndarray:
    """Sizes of the intersections of the sets in a with those in b (None: a), as products of blocks of 0/1 columns."""
    sets = a + (b or [])
    flat = np.concatenate(sets)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n[at] > 1  # what one set alone holds is in no intersection
    at, owner = at[shared], owner[shared]
    values, at = np.unique(at, return_inverse=True)
    out = np.zeros((len(a), len(b) if b is not None else len(a)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, len(values), columns):
        i, j = np.searchsorted(at, [first, first + columns])
        m = np.zeros((len(sets), min(columns, len(values) - first)), np.float32)
        m[owner[i:j], at[i:j] - first] = 1
        out += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return out


def links_of(near: np.ndarray, same: bool, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """near: links of n rows with the others; -> (weighted links, position of the root) of all, rows first."""
    links = near @ weights if same else np.concatenate([near @ weights[n:], near.T @ weights[:n]])
    root = np.arange(len(weights))
    cols = slice(0, n) if same else slice(n, None)
    while True:
        new = root.copy()
        new[:n] = np.minimum(root[:n], np.where(near, root[cols][None, :], len(root)).min(axis=1, initial=len(root)))
        new[cols] = np.minimum(new[cols], np.where(near, new[:n][:, None], len(root)).min(axis=0, initial=len(root)))
        if (new == root).all():
            return links, root
        root = new


def shared_by(x: list[np.ndarray], y: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of wanted pairs (0 for others): one by one if they are few, else all by products."""
    if wanted.sum() > max(32, wanted.size // 16):
        return overlaps(x, y)
    out = np.zeros(wanted.shape, np.float32)
    for i, j in np.argwhere(wanted):
        a, b = (x[i], y[j]) if len(x[i]) <= len(y[j]) else (y[j], x[i])
        at = np.searchsorted(b, a)
        out[i, j] = (b[np.minimum(at, len(b) - 1)] == a).sum()
    return out


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, trees: int = 16, recall: float = 0.99999, target: float = 0.9995,
    unit: int = 1 << 20, members: int = 1024, told: list | None = None,
) -> DataFrame:
    """One row per distinct key: key, class_id, n_links, component_id, kept, for links of Jaccard similarity >= threshold.

    class_id is the smallest key with the same set of shingles; n_links counts the other documents linked directly,
    copies among them; component_id is the smallest key that links reach, and kept says that it is the document's own.
    Null and empty texts, and those without words, link with nothing. Repeated rows of a key count once, and of a key
    with different texts the one whose shingles hash lowest counts, one without words only if there is no other. Null keys are left out. An empty table gives an
    empty result. Other columns are not read.

    Copies are one class before anything is compared. Prefixes are shortened from full codes until, by the similarities
    of the links found, a share `recall` of all links is found: a link of similarity s counts once and stands for the
    1 / met(s) - 1 that the depth misses. They are never shortened below the depth at which a pair of just the threshold
    meets with the chance `target`. A pair is compared once, and rows that have no pair left in a node are not sent there.
    Nodes of more than `members` classes, or more than `unit` shingles, are compared in pairs of blocks; small ones share
    tasks of about `unit` shingles. Tasks return counts and a root for each class, never pairs, so a hot class or a dense
    group doesn't widen the output, and nothing is capped. told, if given, collects (depth, links found, links missed by
    the estimate) of each round.
    """
    depth, floor = len(LEVELS), least_depth(threshold, trees, target)
    old: list[str] = []
    signed = coded(df.where(F.col(key).isNotNull()), key, text, n, trees)
    one = F.min(F.struct(F.col("h1").isNull().alias("bare"), "h1", "h2", "size", "codes")).alias("s")
    signed = written(signed.groupBy("key").agg(one, F.count("*").alias("times")).select("key", "s.h1", "s.h2", "s.size", "s.codes", "times"))
    first = F.min(F.struct(F.col("key").alias("rep"), "size", "codes", "times")).alias("s")
    classes = written(signed.where("h1 is not null").groupBy("h1", "h2").agg(first, F.count("*").alias("copies")).select("h1", "h2", "copies", "s.*"))

    forest, nodes = forest_nodes(classes, trees, floor, old)
    sizes = nodes.select("k", "tree", "prefix", F.ceil(F.col("n") / members).cast("int").alias("blocks"))
    inside = passed(forest, floor).join(nodes.select("k", "tree", "prefix"), ["k", "tree", "prefix"])
    inside = inside.join(classes.select("rep", "size", "codes"), "rep")
    units = (nodes.agg(F.sum("n")).first()[0] or 0) // 4096 + 1

    def unmet(g: pd.DataFrame) -> pd.DataFrame:
        at, blocks = by_node(g)
        left = np.zeros(len(g), bool)
        for a, b in blocks:
            new = fresh(at["size"], at["codes"], a, b, int(at["k"][a.start]), int(at["tree"][a.start]), threshold) if a.stop > a.start and b.stop > b.start else np.zeros((1, 1), bool)
            if new.any():
                left[a] |= new.any(axis=1)
                left[b] |= new.any(axis=0)
        return pd.DataFrame({c: at[c][left] for c in ("k", "tree", "prefix", "rep")})

    places = "k int, tree int, prefix long, rep long"
    open_ = blocked(inside, sizes, units).select("k", "tree", "prefix", "rep", "size", "codes", "own", "b1", "b2", "unit").groupBy("unit", "b1", "b2").applyInPandas(lambda g: unmet(g), places)
    open_ = written(open_.distinct(), old)

    wanted = classes.join(open_.select("rep").distinct(), "rep", "left_semi").select("rep", "h1", "copies", "size", "codes", "times")
    wanted = written(wanted, old)
    texts = maybe_among(df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")), "rep", wanted.select("rep")).where("__may").drop("__may")
    kinds = "rep long, copies long, size int, codes array<long>, shingles binary"

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(n)
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            own = [len(s) > 0 and int(set_hash(s)) == h for s, h in zip(sets, b["h1"], strict=True)]
            b = b.assign(shingles=[s.tobytes() for s in sets])[own]
            yield b[["rep", "copies", "size", "codes", "shingles"]]

    sets = wanted.join(texts, "rep").mapInPandas(shingled, kinds)
    if not wanted.where("times > 1").isEmpty():  # keys with several rows, some of which may have the same text
        sets = sets.dropDuplicates(["rep"])
    sets = written(sets, old)
    sizes = open_.join(sets.select("rep", "size"), "rep").groupBy("k", "tree", "prefix").agg(
        F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("size") / unit)).cast("int").alias("blocks"), F.sum("size").alias("total")
    )
    sizes = written(sizes, old)
    totals = dict(sizes.groupBy("k").agg(F.sum("total")).collect())  # a row a depth

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        at, blocks = by_node(g)
        out: list[tuple[np.ndarray, ...]] = []
        similar = [np.zeros(0)]
        for a, b in blocks:
            if a.stop == a.start or b.stop == b.start:
                continue
            new = fresh(at["size"], at["codes"], a, b, int(at["k"][a.start]), int(at["tree"][a.start]), threshold)
            i, j = (np.flatnonzero(new.any(axis=x)) for x in (1, 0))
            if not len(i):
                continue
            same, new = a == b, new[np.ix_(i, j)]  # of one block, i and j are the same
            i, j = i + a.start, j + b.start
            x, y = ([np.frombuffer(s, np.uint64) for s in at["shingles"][r]] for r in (i, j))
            both = shared_by(x, y, np.triu(new) if same else new)
            if same:
                both = np.maximum(both, both.T)
            either = at["size"][i, None] + at["size"][None, j] - both
            near = new & (both >= threshold * either - 1e-9)
            if not near.any():
                continue
            similar.append((both / either)[np.triu(near) if same else near])
            rows = i if same else np.concatenate([i, j])
            links, root = links_of(near, same, at["copies"][rows], len(i))
            keys, linked = at["rep"][rows], links > 0
            out.append((keys[linked], links[linked].astype(np.int64), keys[root][linked]))
        s = np.concatenate(similar)
        missed = [0.0] + [float((1 / met(s, d, trees) - 1).sum()) for d in range(1, depth + 1)]
        rep, links, root = (np.concatenate([o[c] for o in out] or [np.zeros(0, np.int64)]) for c in range(3))
        own = pd.DataFrame({"rep": rep, "links": links, "root": root}).assign(found=0, missed=None)
        return pd.concat([own, pd.DataFrame({"rep": [-1], "links": [0], "root": [-1], "found": [len(s)], "missed": [missed]})])

    rounds, counted = [], 0
    lost = np.zeros(depth + 1)
    for k in range(depth, floor - 1, -1):
        if k in totals:
            here = open_.where(F.col("k") == k)
            some = maybe_among(sets, "rep", here.select("rep")).where("__may").drop("__may")
            at = blocked(here, sizes.where(F.col("k") == k).drop("total"), 4 * totals[k] // unit + 1).join(some, "rep")
            rounds.append(written(at.groupBy("unit", "b1", "b2").applyInPandas(lambda g: compare(g), "rep long, links long, root long, found long, missed array<double>")))
            sums = rounds[-1].where("missed is not null").agg(F.sum("found"), *(F.sum(F.get("missed", F.lit(d))) for d in range(depth + 1))).first()
            counted += sums[0] or 0
            lost += [x or 0.0 for x in sums[1:]]
        if told is not None:
            told.append((k, counted, float(lost[k])))
        if counted and lost[k] <= (1 - recall) * (counted + lost[k]):
            break
    drop(df.sparkSession, old)

    known = classes.select("h1", "h2", "rep", "copies")
    if rounds:
        near = rounds[0]
        for x in rounds[1:]:
            near = near.unionByName(x)
        near = near.where("missed is null")
        counts = near.groupBy("rep").agg(F.sum("links").alias("links"))
        parts = connected_components(near.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
        known = known.join(counts, "rep", "left").join(parts, "rep", "left")
    else:
        known = known.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    known = known.where("copies > 1 or links is not null")
    least = F.coalesce("component", "rep", "key")
    return signed.select("key", "h1", "h2").join(known, ["h1", "h2"], "left").select(
        F.col("key").alias(key), F.coalesce("rep", "key").alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        least.alias("component_id"), (F.col("key") == least).alias("kept"),
    )


def op6_minhash_forest(spark, sf_dir):
    """Each row with a null id is a document of its own; its ids are null where they would name such a document."""
    docs, unnamed = identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = near_duplicates(docs, key="__id")
    if unnamed is not None:
        for c in ("__id", "class_id", "component_id"):
            found = found.join(unnamed.select(F.col("__id").alias("__own")), F.col(c) == F.col("__own"), "left").withColumn(c, F.when(F.col("__own").isNull(), F.col(c))).drop("__own")
    return found.select(F.col("__id").alias("doc_id"), "class_id", "n_links", "component_id", "kept")
