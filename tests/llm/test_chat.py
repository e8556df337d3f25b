import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.llm import chat

ROWS = "conv_id long, turn long, role string, parts array<" + chat.PART + ">"


def part(type_="text", text=None, ref=None, **more):
    return {"type": type_, "text": text, "ref": ref, "width": None, "height": None, "seconds": None, "pages": None} | more


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>ab/[turnend", max_size=30))
def test_escaping_is_reversible_and_leaves_no_control(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb%<|turn|>", ""]), st.lists(st.text(alphabet="<|\\>\nx%:0image", max_size=12), max_size=3)), max_size=4))
def test_round_trip(turns):
    v = chat.Flatten()
    for i, (role, texts) in enumerate(turns):
        v.turn(i, role, [part(text=t) for t in texts])
    out = "".join(v.out)
    assert [(t["role"], t["text"]) for t in chat.turns_of(out)] == [(r, "".join(t)) for r, t in turns]
    assert "".join(chat.unescape(out[s["start"] : s["end"]]) for s in v.loss) == "".join("".join(t) for r, t in turns if r == "assistant")


def test_parts_become_placeholders(spark):
    parts = [part(text="see "), part("image", ref="i.png", width=57, height=28), part("Audio", ref="a.wav", seconds=1.5), part("document", ref="d.pdf", pages=3), part("video", ref="v"), None, part(text=" end"), part("image", ref="j.png")]
    df = spark.createDataFrame([(1, 1, "assistant", [part(text="ok")]), (1, 0, "user", parts)], ROWS)
    r = chat.read_back(chat.format_conversations(df)).first()
    assert r.formatted.startswith("<|turn|>user\nsee <|image:0|><|audio:1|><|document:2|><|part:3|> end<|image:4|><|end|>\n")
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 1536), ("part", "v", 0), ("image", "j.png", 1)]
    assert r.expanded_tokens == 3 + 38 + 1536 + 1 and r.loss_text == "ok"
    assert [(t.role, t.text, t.numbers) for t in r.turns] == [("user", "see  end", [0, 1, 2, 3, 4]), ("assistant", "ok", [])]


def test_nulls_ties_and_repeated_rows(spark):
    t = lambda x: [part(text=x)]
    rows = [(1, 0, "user", t("b")), (1, 0, "user", t("a")), (1, 0, "user", t("a")), (None, 0, "user", t("n")), (2, None, None, None), (2, 1, "assistant", t(None)), (3, 0, "assistant", t("x" * 100_000))]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, ROWS))).collect()}
    assert [x.text for x in got[1].turns] == ["a", "a", "b"] and [x.role for x in got[2].turns] == ["", "assistant"]
    assert got[None].turns[0].text == "n" and len(got[3].loss_text) == 100_000


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", [part(text="a")], "x", 2)], ROWS + ", key string, turns int")
    assert chat.format_conversations(df).first().conv_id == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(4, 1, "assistant", "two <|end|>"), (4, 0, "user", None), (5, 0, "system", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_typed_parts(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert (got[4].n_turns, got[4].turns_sha256, got[4].loss_chars, got[4].loss_sha256) == (2, sha("user\n\nassistant\ntwo <|end|>\n"), 11, sha("two <|end|>"))
    assert (got[-7].turns_sha256, got[-7].loss_sha256) == (sha(f"user\n{said}\nassistant\n{said}\n"), sha(said))
    assert got[5].loss_chars == 0 and got[5].loss_sha256 == sha("") and F is not None
