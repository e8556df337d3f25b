"""Byte-level BPE: encoding through a sentencepiece model made from the vocabulary, decoding, and token counts by
rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import base64
import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: Strings held at once while a batch is split, and cached results of pre-tokens; memory stays bounded by them.
CHUNK_CHARS, CACHE = 1 << 19, 1 << 17


def byte_chars() -> list[str]:
    """The usual character for each byte: printable ones stand for themselves, the others follow U+0100 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """A file of base64 tokens and ranks, as the tokens by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(n), base64.b64decode(t)) for t, n in map(bytes.split, f) if t)
    if [n for n, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [t for _, t in pairs]


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes, an unsigned number, or a 32-bit float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of the tokens: byte-mapped pieces scored by negative rank, no normalisation.

    Piece 0 is the unknown piece, which no byte-mapped text reaches; token n is piece n + 1.
    """
    chars = byte_chars()
    pieces = [_field(1, "\ue000".encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(n)) + _field(3, 1) for n, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, in lists of about CHUNK_CHARS bytes (one longer text is a list of its own); null is empty."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_CHARS)) + 1
        yield [x or "" for x in texts.slice(at, end - at).to_pylist()]
        at = end


class Coder:
    """Encodes and decodes lists of texts in a Python worker; made from a model and shipped with it."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.model = tokens, pattern, sentencepiece_model(tokens)

    def encode(self, batches: Iterator[pa.Array]) -> Iterator[pa.ListArray]:
        """ids of the texts, in lists of about CHUNK_CHARS bytes of text, so that no more is held at once."""
        import regex
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        split = regex.compile(self.pattern).findall
        whole = {t: n for n, t in enumerate(self.tokens)}
        table = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        cache: dict[str, array] = {}
        for texts in batches:
            for chunk in _chunks(texts):
                words = [split(x) for x in chunk]
                if len(cache) > CACHE:
                    cache.clear()
                rest = []
                for w in {w for ws in words for w in ws}:
                    if w not in cache:
                        if (found := whole.get(w.encode())) is not None:
                            cache[w] = array("i", [found])
                        else:
                            rest.append(w)
                mapped = [w.encode().decode("latin-1").translate(table) for w in rest]
                for w, pieces in zip(rest, sp.encode(mapped, num_threads=1) if mapped else [], strict=True):
                    cache[w] = array("i", [n - 1 for n in pieces])
                ids, ends = array("i"), [0]
                for ws in words:
                    for w in ws:
                        ids.extend(cache[w])
                    ends.append(len(ids))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))

    def decoding(self):
        """A function from lists of ids to bytes, by the inverse mapping."""
        flat, size = np.frombuffer(b"".join(self.tokens), np.uint8), np.array([len(t) for t in self.tokens], np.int64)
        begin = np.cumsum(size) - size

        def decode(lists: pa.ListArray) -> pa.Array:
            out: list[bytes] = []
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            values, at = lists.flatten().to_numpy(zero_copy_only=False), 0
            while at < len(lists):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_CHARS, side="right")) - 1)
                ids = values[ends[at] : ends[stop]]
                n = size[ids]
                until = np.cumsum(n)
                text = flat[np.repeat(begin[ids] - (until - n), n) + np.arange(until[-1] if len(n) else 0)].tobytes()
                marks = np.concatenate([[0], until])[ends[at : stop + 1] - ends[at]].tolist()
                out += [text[a:b] for a, b in zip(marks, marks[1:])]
                at = stop
            return pa.array(out, pa.binary())

        return decode


def encoder(tokens: list[bytes], pattern: str):
    """A column function text -> ids (array<int>): every match of pattern is encoded by itself, without special tokens.

    A match that is a token as a whole is that token; others are merged by lowest rank. Null and empty texts have no
    ids. The pattern covers every character of a text, so ids decode to the text's UTF-8 bytes.
    """
    coder = Coder(tokens, pattern)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from coder.encode(texts)

    return encode


def decoder(tokens: list[bytes]):
    """A column function ids (array<int>) -> bytes. Null gives no bytes; unknown ids are an error."""
    coder = Coder(tokens, "")

    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(coder.decoding(), ids)

    return decode


def encode_documents(df: DataFrame, tokens: list[bytes], pattern: str, *, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with ids, and unless decoded is None the bytes that the ids decode to; columns so named are replaced.

    Repeated rows are encoded each by themselves; other columns pass unread; an empty table gives an empty one. Both
    columns come from one Python worker, which decodes what it has encoded.
    """
    if decoded is None:
        return df.withColumn(ids, encoder(tokens, pattern)(F.col(text)))
    coder = Coder(tokens, pattern)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = coder.decoding()
        for lists in coder.encode(texts):
            yield pa.StructArray.from_arrays([lists, decode(lists)], ["ids", "decoded"])

    (coded,) = spare(df, "coded")
    return df.withColumn(coded, both(F.col(text))).withColumns({ids: F.col(f"{coded}.ids"), decoded: F.col(f"{coded}.decoded")}).drop(coded)


def plain_spec(spec: dict) -> None:
    """An error for a tokenizer file that asks for more than byte-level BPE with plain added tokens: it would be counted wrongly."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    asked = [f"normalizer {spec['normalizer'].get('type')}"] if spec.get("normalizer") else []
    asked += [f"model {model['type']}"] if model.get("type", "BPE") != "BPE" else []
    asked += [f"model {k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    asked += [] if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) else ["another pre_tokenizer"]
    asked += [f"added token {k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if asked:
        raise ValueError(f"not counted: {', '.join(asked)}")


class Merges:
    """The merges of a byte-level BPE as sorted arrays: pair of ids -> rank and merged id."""

    def __init__(self, spec: dict):
        plain_spec(spec)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.bytes = np.array([vocab[c] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each word."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        band = np.ceil(np.log2(np.maximum(size, 64))).astype(int)  # a long word doesn't hold up many short ones
        for k in np.unique(band):
            at = np.flatnonzero(band == k)
            for part in np.array_split(at, max(1, int(size[at].sum() >> 20))):
                out[part] = self._merge([words[i] for i in part], size[part])
        return out

    def _merge(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        none = len(self.keys)
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        out = size.copy()
        while len(sym) > 1:
            pos = np.flatnonzero(seq[:-1] == seq[1:])
            key = sym[pos] << 32 | sym[pos + 1]
            i = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[i] == key, self.rank[i], none)
            best = np.full(len(words), none)
            np.minimum.at(best, seq[pos], rank)
            hit = (rank == best[seq[pos]]) & (rank < none)
            p, to = pos[hit], self.to[i[hit]]
            if not len(p):
                break
            fresh = np.concatenate([[True], np.diff(p) != 1])  # of "aaa" the first pair merges, then the third symbol stays
            run = np.arange(len(p)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            p, to = p[run % 2 == 0], to[run % 2 == 0]
            sym[p] = to
            np.subtract.at(out, seq[p], 1)
            stay = best[seq] < none  # words without a pair that merges are done
            stay[p + 1] = False
            sym, seq = sym[stay], seq[stay]
        return out


def counter(spec: dict, pattern: str):
    """A column function text -> tokens (long), as the library of the file counts them; added tokens found in a text are one each."""
    merges = Merges(spec)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        split = regex.compile(pattern).findall
        parts = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or "(?!)")
        cache: dict[str, int] = {}
        for texts in batches:
            out: list[int] = []
            for chunk in _chunks(texts):
                extra = [len(parts.findall(x)) for x in chunk]
                words = [split(x) if not e else [w for p in parts.split(x) for w in split(p)] for x, e in zip(chunk, extra, strict=True)]
                if len(cache) > CACHE:
                    cache.clear()
                new = [w for w in {w for ws in words for w in ws} if w not in cache]
                if new:
                    cache.update(zip(new, merges.counts([w.encode() for w in new]).tolist(), strict=True))
                out += [e + sum(map(cache.__getitem__, ws)) for e, ws in zip(extra, words, strict=True)]
            yield pa.array(out, pa.int64())

    return count


def count_tokens(df: DataFrame, spec: dict, pattern: str, *, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit; columns so named are replaced. A null text is an empty one.

    spec is the content of a tokenizer's JSON file of the byte-level BPE kind; one that asks for more is an error.
    """
    n = counter(spec, pattern)(F.col(text))
    size: Column = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return df.withColumn("n_bytes", size).withColumn("n_tokens", n).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_sentencepiece_bpe(spark, sf_dir):
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_rank_synchronous(spark, sf_dir):
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, spec, public.PATTERN).select("doc_id", "n_bytes", "n_tokens", "over_limit")
