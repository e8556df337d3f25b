"""A corpus pipeline of the operators: each stage works on all documents that its predecessor kept.

Documents that the quality ranking rejects go; of each group of near duplicates the one with the smallest id stays;
documents with a benchmark passage go; secrets are masked; the rest is encoded, and decoded to prove it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.llm import bpe, decontaminate, ngrams, quality, secrets
from foliograph.llm.common import drop, identified, maybe_among, written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs, gone, key="doc_id"):
    """The documents whose keys are not among those of gone; a null key is nobody's. Only those that may be are joined."""
    gone = written(gone.select(key).where(F.col(key).isNotNull()).distinct())
    columns = docs.columns
    docs = maybe_among(docs, key, gone)
    unsure = docs.where("__may").join(gone, key, "left_anti")
    return docs.where("not __may").select(*columns).unionByName(unsure.select(*columns))


def keep_quality(spark, docs, sf_dir):
    """Documents that score at or above the ranking's quantile; with no labels of both kinds all stay. A null text scores as
    an empty one, rows with a null id are scored and never learnt from, repeated rows score alike."""
    ranking = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*DOCUMENTS), ranking, into="__score").where("__score >= 0.3").select(*DOCUMENTS)


def keep_one_of_each(spark, docs, sf_dir):
    """One row of each id, of rows that differ the one with the greatest text, so that a null text gives way; and of
    these rows one of each group of near duplicates, the one with the smallest id. Each row with a null id is a document
    of its own, and gives way to its copies that have an id. Texts without words, null and
    empty ones too, have no near duplicates."""
    docs = docs.select(*DOCUMENTS)
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"))
    if not again.isEmpty():
        rows = docs.join(again.select("doc_id"), "doc_id", "left_semi")
        once = written(rows.groupBy("doc_id").agg(F.max(F.struct(*DOCUMENTS[1:])).alias("row")).select("doc_id", "row.*"))
        docs = without(docs, again).unionByName(once)
    docs, _ = identified(docs)
    return without(docs, ngrams.near_duplicates(docs, key="__id").where("not kept"), "__id").select(*DOCUMENTS)


def drop_benchmark(spark, docs, sf_dir):
    """Documents without a benchmark item or a near copy of one; each row with a null id is a document of its own. Null and
    empty texts stay, rows of one id go together, and an empty benchmark drops nothing."""
    docs, _ = identified(docs.select(*DOCUMENTS))
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__id"), "__id").select(*DOCUMENTS)


def mask_secrets(spark, docs, sf_dir):
    """All documents, every span of a secret replaced by a mark and n_chars counted anew where the text changed. A text
    without spans, null too, stays as it is; each row is masked by itself."""
    masked = secrets.scan(docs.select(*DOCUMENTS)).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def encode(spark, docs, sf_dir):
    """The token ids of each text, how many, and the SHA-256 of ids and of the decoded bytes; a null text has none. A row
    for each row, repeated ones and such with null ids too."""
    import public_tokenizers as public

    tokens = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), tokens, public.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", encode),
]
#: SQL can't express the learnt ranking; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order. A stage's rows are written before the next one begins, and deleted once it is written; what the
    last stage reads stays, as its result is read later."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        own = []
        docs = written(stage(spark, docs, sf_dir), own)
        drop(spark, last)
        last = own
    return STAGES[-1][1](spark, docs, sf_dir)
