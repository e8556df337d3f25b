"""Histogram sort: shards of near equal bytes over a total order, with one exchange of the rows.

The order is (k, d): k the first 60 bits of the text's MD5, d the id, so that equal texts lie side by side. The bytes
below candidate boundaries are counted exactly in every partition, the boundaries are refined until each splitter is
exact to one key, and only then are the rows exchanged, straight to their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, written

KEY_END = 1 << 60
LOW = -(1 << 63)


def text_key(text: str) -> F.Column:
    """The first 60 bits of the text's MD5; -1 for a null text."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def bytes_below(keys: DataFrame, column: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of keys below each of the sorted probes: one pass, a partial histogram a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            np.add.at(rows, at, 1)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(rows[at])], names=["i", "size", "rows"])

    parts = keys.select(column, "size").mapInArrow(count, "i long, size long, rows long")
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for i, s, r in parts.groupBy("i").agg(F.sum("size"), F.sum("rows")).collect():  # one row for each probe at most
        size[i], rows[i] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def refine(keys: DataFrame, column: str, targets: np.ndarray, lo: int, hi: int, total: tuple[int, int], most: int):
    """For each target the smallest boundary with that many bytes below it, to within one key.

    Returns arrays (lo, hi, bytes below lo, bytes below hi): where hi - lo = 1, hi lies behind the rows of key lo.
    most: probes a round.
    """
    n = len(targets)
    lo_at, hi_at = np.full(n, lo, object), np.full(n, hi, object)
    lo_size, hi_size = np.zeros(n, np.int64), np.full(n, total[0], np.int64)
    lo_rows, hi_rows = np.zeros(n, np.int64), np.full(n, total[1], np.int64)
    while (open_ := [i for i in range(n) if hi_at[i] - lo_at[i] > 1 and hi_rows[i] - lo_rows[i] > 1]):
        brackets = sorted({(lo_at[i], hi_at[i]) for i in open_})
        each = max(3, min(255, most // len(brackets)))
        probes = sorted({a + (b - a) * j // (each + 1) for a, b in brackets for j in range(1, each + 1)} - {a for a, _ in brackets})
        size, rows = bytes_below(keys, column, at := np.array(probes, np.int64))
        for i in open_:
            left, right = np.searchsorted(at, [lo_at[i], hi_at[i]], side="left")
            j = left + int(np.searchsorted(size[left:right], targets[i], side="left"))  # the first with enough below
            if j < right:
                hi_at[i], hi_size[i], hi_rows[i] = probes[j], size[j], rows[j]
            if j > left and probes[j - 1] > lo_at[i]:
                lo_at[i], lo_size[i], lo_rows[i] = probes[j - 1], size[j - 1], rows[j - 1]
    return lo_at, hi_at, lo_size, hi_size


def splitters(keys: DataFrame, shards: int, parts: int, whole: float, most: int) -> tuple[list[tuple[int, int]], int]:
    """shards x parts - 1 boundaries (k, d): rows at or above the j-th one belong to parts j and on."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("d"), F.max("d")).first()
    n = shards * parts
    if not total[1]:
        return [], 0
    targets = np.array([-(-j * total[0] // n) for j in range(1, n)], np.int64)
    lo, hi, below, through = refine(keys, "k", targets, -1, KEY_END, (total[0], total[1]), most)
    found: list[tuple[int, int]] = [(int(x), LOW) for x in hi]
    inside: dict[int, list[int]] = {}
    for j in range(n - 1):
        small = max(whole * total[0] / shards, 0 if (j + 1) % parts == 0 else total[0] / n / 4)
        if hi[j] - lo[j] == 1 and through[j] - below[j] > small:  # it cuts a group of copies that is too large to stay whole
            inside.setdefault(int(lo[j]), []).append(j)
    for k, js in inside.items():
        group = keys.where(F.col("k") == k)
        left = np.array([targets[j] - below[j] for j in js], np.int64)
        rows = group.count()
        _, at, _, _ = refine(group, "d", left, int(total[2]), int(total[3]) + 1, (int(through[js[0]] - below[js[0]]), rows), most)
        for j, x in zip(js, at, strict=True):
            found[j] = (k, int(x)) if x <= total[3] else (k + 1, LOW)
    return found, total[0]


def shard(
    df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", part_bytes: int = 8 << 20, max_parts: int = 4096,
    whole: float = 0.01, probes: int = 1 << 16,
) -> DataFrame:
    """df with shard (0 .. shards - 1) and slot (gapless from 0 in each shard), the shards near equal in bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. With the rows in the order (MD5 of the text, id),
    a row goes to shard floor(shards * bytes before it / all bytes), where equal texts count as one unless they hold
    more than `whole` of a shard's bytes: such a group is cut between ids. Shards are dealt out in parts of about
    part_bytes (max_parts a shard at most, larger ones above that), each one task; what reaches the driver is bounded
    by the probes of a round and the number of parts. Null ids count as the smallest id; repeated rows (same id, same
    text) share a shard and take neighbouring slots in any order. An empty table gives an empty one. All columns of df
    stay; those named shard or slot are replaced.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    at, d = text_key(text), F.coalesce(F.col(key).cast("long"), F.lit(LOW + 1))
    keys = written(df.select(at.alias("k"), d.alias("d"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = int(min(max_parts, max(1, -(-total // (shards * part_bytes)))))
    found, _ = splitters(keys, shards, parts, whole, probes)
    ks, ds = np.array([k for k, _ in found], np.int64), np.array([x for _, x in found], np.int64)

    def part_of(k: np.ndarray, d: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(ks, k, side="left"), np.searchsorted(ks, k, side="right")
        out = right.copy()
        for i in np.flatnonzero(right > left):
            out[i] = left[i] + np.searchsorted(ds[left[i] : right[i]], d[i], side="right")
        return out

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shards * parts, np.int64)
        for b in batches:
            n += np.bincount(part_of(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["part", "n"])

    rows = np.zeros(shards * parts, np.int64)
    for p, n in keys.select("k", "d").mapInArrow(tally, "part long, n long").groupBy("part").agg(F.sum("n")).collect():
        rows[p] = n
    before = np.cumsum(rows) - rows
    before -= before[(np.arange(len(rows)) // parts) * parts]  # rows of earlier parts of the same shard

    @F.pandas_udf("part int, before long")
    def place(k: pd.Series, d: pd.Series) -> pd.DataFrame:
        p = part_of(k.to_numpy(), d.to_numpy())
        return pd.DataFrame({"part": p.astype(np.int32), "before": before[p]})

    k_, d_, p_, part, before_ = inner = spare(df, "k", "d", "p", "part", "before")
    rest = df.withColumns({k_: at, d_: d}).drop("shard", "slot")
    placed = rest.withColumn(p_, place(k_, d_)).withColumn(part, F.col(f"{p_}.part")).withColumn(before_, F.col(f"{p_}.before"))
    dealt = placed.repartitionById(shards * parts, F.col(part))
    slot = F.row_number().over(Window.partitionBy(part).orderBy(k_, d_)) - 1 + F.col(before_)
    return dealt.withColumns({"slot": slot.cast("long"), "shard": F.floor(F.col(part) / parts).cast("int")}).drop(*inner)


def op1_histogram_sort(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shard(docs, 24).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
