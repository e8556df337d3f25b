import json
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliograph.llm import bpe

MULTI, JSON = public.path("byte_bpe_multi_50k.tiktoken"), public.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " ", "a" * 3000, "<|endoftext|>x<|endoftext|>", "日本語のテキスト  \n\n\t x", "é" * 500 + "!!!" * 300, "\x00 \x1f𝒳🙂🙂" * 20, "  lead  trail  ", "''s's 't ll'll", "ab" * 2000 + "xyzzy" * 100]
    out += ["".join(rng.choice("aeiou thés1!\n") for _ in range(300)) for _ in range(20)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(150)) for _ in range(20)]
    out += ["".join(rng.choice("abcdefghij") for _ in range(20_000)), "word " * 60_000]
    return out


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(MULTI)


@pytest.fixture(scope="module")
def theirs(tokens):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ids_equal_the_library_and_decode(spark, tokens, theirs):
    texts = odd_texts()
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts), tokens, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == theirs.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()


def test_coding_in_two_steps(spark, tokens):
    df = frame(spark, ["one two", None, ""])
    ids = df.withColumn("ids", bpe.encoder(tokens, public.PATTERN)("text"))
    assert [bytes(r[0]) for r in ids.orderBy("doc_id").select(bpe.decoder(tokens)("ids")).collect()] == [b"one two", b"", b""]


def test_counts_equal_the_library(spark):
    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    library, texts = Tokenizer.from_file(JSON), odd_texts()
    got = {r.doc_id: r for r in bpe.count_tokens(frame(spark, texts), spec, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=8))
def test_merging_equals_one_by_one(words):
    with open(JSON, encoding="utf-8") as f:
        merges = test_merging_equals_one_by_one.__dict__.setdefault("m", None) or bpe.Merges(json.load(f))
    test_merging_equals_one_by_one.m = merges
    pairs = {int(k): (int(r), int(t)) for k, r, t in zip(merges.keys, merges.rank, merges.to)} if not hasattr(merges, "d") else merges.d
    merges.d = pairs
    want = []
    for w in words:
        s = [int(merges.bytes[b]) for b in w]
        while True:
            ranked = [(pairs[s[i] << 32 | s[i + 1]][0], i) for i in range(len(s) - 1) if s[i] << 32 | s[i + 1] in pairs]
            if not ranked:
                break
            i = min(ranked)[1]
            s[i : i + 2] = [pairs[s[i] << 32 | s[i + 1]][1]]
        want.append(len(s))
    assert merges.counts(words).tolist() == want


def test_empty_tables_and_clashing_names(spark, tokens):
    df = spark.createDataFrame([(1, "x", "a", 3)], "doc_id long, text string, ids string, n_tokens int")
    r = bpe.encode_documents(df, tokens, public.PATTERN).first()
    assert r.ids == [bpe.read_ranks(MULTI).index(b"x")] and r.n_tokens == 3
    assert bpe.encode_documents(df.limit(0), tokens, public.PATTERN).count() == 0


def test_gaps_in_ranks_are_refused(tmp_path):
    p = tmp_path / "r"
    p.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(p))


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
    {"added_tokens": [{"content": "<x>", "lstrip": True}]}, {"added_tokens": [{"content": "<x>", "single_word": True}]}, {"model": {"type": "WordPiece"}}, {"model": {"ignore_merges": True}},
])
def test_files_that_ask_for_more_are_errors(change):
    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.plain_spec(spec)
    with pytest.raises(ValueError, match="not counted"):
        bpe.plain_spec(spec | change | ({"model": spec["model"] | change["model"]} if "model" in change else {}))


def test_a_column_named_like_the_one_inside_stays(spark, tokens):
    df = spark.createDataFrame([("x", 5)], "text string, __coded long")
    r = bpe.encode_documents(df, tokens, public.PATTERN).first()
    assert r["__coded"] == 5 and bytes(r.decoded) == b"x"
