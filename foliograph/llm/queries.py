"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embeddings, ngrams, pages, quality, secrets, sharding
from .oracles import SQL

QUERIES = {
    "op1_histogram_sort": sharding.op1_histogram_sort,
    "op2_metric_range_join": embeddings.op2_metric_range_join,
    "op3_simhash_windows": decontaminate.op3_simhash_windows,
    "op4_bradley_terry": quality.op4_bradley_terry,
    "op5_sentencepiece_bpe": bpe.op5_sentencepiece_bpe,
    "op6_minhash_forest": ngrams.op6_minhash_forest,
    "op7_entropy_windows": secrets.op7_entropy_windows,
    "op8_typed_parts": chat.op8_typed_parts,
    "op9_rank_synchronous": bpe.op9_rank_synchronous,
    "op10_nearest_url": pages.op10_nearest_url,
}
ORACLES = {k: v for k, v in SQL.items() if k in QUERIES}
