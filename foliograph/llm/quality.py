"""Pairwise quality: document scores learnt from preference pairs, cut at a quantile of the scores.

A document of label 1 is preferred to one of label 0. The Bradley-Terry model gives the preferred document of a pair
the chance sigmoid(u(a) - u(b)); with u linear in the features this is logistic loss on feature differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "chars", "words", "word_length", "distinct_words", "top_word", "repeated_bigrams", "same_word_runs", "lines", "repeated_lines", "line_words",
    "upper", "digits", "spaces", "stops", "marks", "symbols", "symbol_runs", "bangs", "brackets", "high_bytes", "byte_entropy", "capital_words",
    "short_words", "long_words", "sentence_words",
)


def _counts(n: np.ndarray) -> float:
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum())


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES: shares, means and logarithms, all finite."""
    data = text.encode()
    n, bins = max(1, len(data)), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    pairs = list(zip(words, words[1:]))
    of = lambda s: float(sum(int(bins[b]) for b in s.encode()))
    upper = sum(map(str.isupper, words))
    low = [len(x) for x in words]
    symbols = of("#$%&*+=<>@^_|~\\/")
    ends = of(".!?")
    runs = sum(data.count(bytes([b]) * 2) for b in b"#$%&*!?~=_|")
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(text) / w), len(seen) / w, max(seen.values(), default=0) / w,
        1 - len(set(pairs)) / max(1, len(pairs)), sum(a == b for a, b in pairs) / max(1, len(pairs)), math.log1p(len(lines)), 1 - len(set(lines)) / m, math.log1p(w / m),
        upper / w, float(bins[48:58].sum()) / n, float(bins[[9, 10, 32]].sum()) / n, of(".") / w, of(",;:") / w, symbols / w, runs / w, of("!?") / w, of("()[]{}") / w,
        float(bins[128:].sum()) / n, _counts(bins), sum(x[:1].isupper() for x in words) / w, sum(x < 4 for x in low) / w, sum(x > 12 for x in low) / w, math.log1p(w / (1 + ends)),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [features(x.as_py() or "") for x in texts]
        flat = np.array(rows, np.float64).reshape(len(rows), len(FEATURES)).ravel()
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(flat))


@dataclass
class Ranking:
    """Utility u(x) = weights . basis(x); cut is the score quantile at which documents are kept; scale only shapes the score."""

    centre: list[float]
    spread: list[float]
    weights: list[float]
    cut: float
    scale: float
    share: float = 0.0
    pairs: int = 0
    steps: int = field(default=0)

    def basis(self, x: np.ndarray) -> np.ndarray:
        return basis(np.clip((x - np.array(self.centre)) / np.array(self.spread), -6, 6))

    def utility(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ np.array(self.weights)


def basis(z: np.ndarray) -> np.ndarray:
    """Each standard feature with its hinges, so that a utility may rise and fall along it."""
    return np.concatenate([z, np.maximum(0, z - 1), np.maximum(0, -z - 1), np.maximum(0, z - 2.5)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 40, seed: int = 1) -> Ranking:
    """The ranking of labelled feature rows. With one label only, or no rows, there are no pairs: every utility is 0."""
    x, y = np.asarray(x, np.float64).reshape(-1, len(FEATURES)), np.asarray(y)
    if not len(x) or y.min() == y.max():
        k = len(FEATURES)
        return Ranking([0.0] * k, [1.0] * k, [0.0] * 4 * k, 0.0, 1.0, share=float(y.mean()) if len(y) else 1.0)
    centre = np.median(x, axis=0)
    spread = np.maximum(1e-3, np.subtract(*np.percentile(x, [90, 10], axis=0)) / 2.56)
    b = basis(np.clip((x - centre) / spread, -6, 6))
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = b[rng.choice(good, pairs)] - b[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):  # Newton's method on the mean loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = b @ w
    order = np.sort(u)
    # the quantile of the scores with the fewest errors among the labelled rows, ties to the fewest rejected
    rejected = np.searchsorted(order, order, side="left")
    lost = np.searchsorted(np.sort(u[good]), order, side="left")
    errors = lost + (len(bad) - (rejected - lost))
    at = int(np.flatnonzero(errors == errors.min())[0])
    below = order[order < order[at]]
    cut = float((order[at] + below[-1]) / 2) if len(below) else float(order[at]) - 1.0
    return Ranking(centre.tolist(), spread.tolist(), w.tolist(), cut, 1.0, share=float(rejected[at] / len(u)), pairs=pairs)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 20_000, where: Column | None = None) -> Ranking:
    """Fits on at most `rows` labelled documents, those whose keys hash lowest: a bounded sample, the same at every run.

    where, a condition on the key, keeps rows out. Labels other than 0 and 1 and repeated labels of a key that disagree
    are left out, as are null keys.
    """
    clean = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label")).where("__key is not null and __label in (0, 1)")
    clean = clean.groupBy("__key").agg(F.min("__label").alias("__label"), F.max("__label").alias("__other")).where("__label = __other").drop("__other")
    if where is not None:
        clean = clean.withColumn(key, F.col("__key")).where(where).drop(key)
    chosen = clean.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    found = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    got = found.select("__key", "__label", text_features("__text").alias("f")).groupBy("__key").agg(F.first("__label").alias("y"), F.min("f").alias("f")).toArrow().sort_by("__key")
    return fit(np.array(got["f"].to_pylist(), np.float64), np.array(got["y"].to_pylist()))


def score(df: DataFrame, ranking: Ranking, *, text: str = "text", into: str = "score", threshold: float = 0.3) -> DataFrame:
    """df with a score from 0 to 1 of the whole text, at least `threshold` exactly where the utility reaches the ranking's
    quantile. Null texts score as empty ones; repeated rows score alike; a column named `into` is replaced."""
    offset = math.log(threshold / (1 - threshold))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py() or "") for t in texts], np.float64).reshape(-1, len(FEATURES))
            u = ranking.utility(x) - ranking.cut
            s = 1 / (1 + np.exp(-np.clip(u * ranking.scale + offset, -30, 30)))
            yield pa.array(np.where(u >= 0, np.maximum(s, threshold), np.minimum(s, np.nextafter(threshold, 0))))

    return df.withColumn(into, scored(F.col(text)))


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op4_bradley_terry(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranking = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out())
    return score(docs, ranking).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
