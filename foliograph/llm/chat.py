"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn in order: text is escaped, an image, audio or document part becomes a numbered
placeholder, and its reference and the tokens that it expands to are recorded as an attachment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:int,number:int,kind:string,ref:string,tokens:int>"
SPAN = "struct<start:int,end:int>"

#: The template: <|turn|>role, a line feed, the content, <|end|> and a line feed. Nothing else stands between turns.
TURN, END = "<|turn|>", "<|end|>\n"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
ROLE, UNROLE = {"%": "%25", "\n": "%0A", "<": "%3C"}, {"%25": "%", "%0A": "\n", "%3C": "<"}


def escape(text: str) -> str:
    """One backslash more after each "<" that backslashes, or none, part from "|": no control string is left."""
    return CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


class Flatten:
    """Visits the parts of a conversation's turns and gathers the formatted text, attachments and loss spans.

    Tokens: an image has one for each tile of `tile` pixels a side that is begun, audio `rate` a second, a document
    `page` a page; a part without such measures counts as one tile, second or page. Parts of an unknown kind are
    attachments without tokens; null parts are skipped.
    """

    def __init__(self, tile: int = 28, rate: float = 25.0, page: int = 512, loss_role: str = "assistant"):
        self.tile, self.rate, self.page, self.loss_role = tile, rate, page, loss_role
        self.out: list[str] = []
        self.at = 0
        self.attachments: list[dict] = []
        self.loss: list[dict] = []

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def turn(self, number: int, role: str | None, parts: list[dict | None] | None) -> None:
        role = role or ""
        self.put(TURN + re.sub("[%\n<]", lambda m: ROLE[m[0]], role) + "\n")
        whole: list[dict] = []
        for part in parts or []:  # texts side by side are one text, or they might make a control string between them
            if part is not None:
                part = part | {"type": (part["type"] or "text").lower()}
                if whole and whole[-1]["type"] == part["type"] == "text":
                    whole[-1]["text"] = (whole[-1]["text"] or "") + (part["text"] or "")
                else:
                    whole.append(part)
        for part in whole:
            getattr(self, f"visit_{part['type']}", self.visit_other)(number, role, part)
        self.put(END)

    def visit_text(self, number: int, role: str, part: dict) -> None:
        start = self.at
        self.put(escape(part["text"] or ""))
        if role == self.loss_role:
            self.loss.append({"start": start, "end": self.at})

    def attach(self, number: int, kind: str, ref: str | None, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"turn": number, "number": n, "kind": kind, "ref": ref, "tokens": tokens})
        self.put(f"<|{kind}:{n}|>")

    def visit_image(self, number: int, role: str, part: dict) -> None:
        sides = [max(1, math.ceil((part.get(k) or 1) / self.tile)) for k in ("width", "height")]
        self.attach(number, "image", part["ref"], sides[0] * sides[1])

    def visit_audio(self, number: int, role: str, part: dict) -> None:
        self.attach(number, "audio", part["ref"], max(1, math.ceil((part.get("seconds") or 1) * self.rate)))

    def visit_document(self, number: int, role: str, part: dict) -> None:
        self.attach(number, "document", part["ref"], max(1, part.get("pages") or 1) * self.page)

    def visit_other(self, number: int, role: str, part: dict) -> None:
        self.attach(number, "part", part["ref"], 0)


def turns_of(formatted: str) -> list[dict]:
    """The turns read back from a formatted conversation: role, text (placeholders taken out), attachments' numbers."""
    out = []
    for piece in formatted.split(TURN)[1:]:
        head, _, body = piece.partition("\n")
        body = body.removesuffix(END)
        marks = re.findall(r"<\|[a-z]+:(\d+)\|>", body)
        text = unescape(re.sub(r"<\|[a-z]+:\d+\|>", "", body))
        out.append({"role": re.sub("%(25|0A|3C)", lambda m: UNROLE[m[0]], head), "text": text, "numbers": list(map(int, marks))})
    return out


def format_conversations(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", **options) -> DataFrame:
    """One row per conversation: key, formatted, attachments, loss (spans in code points) and expanded_tokens.

    df has a row for each turn, with parts an array of typed parts. Turns are ordered by number, then role and parts
    for ties, null first, so that repeated rows are repeated turns; a null key is a conversation of its own; null or empty
    parts make an empty turn and a null role an empty one. An empty table gives an empty result. Other columns are not
    read. A conversation is one string in the end, so it must fit in a task; conversations are spread by their key.
    """
    rows = df.select(F.col(key).alias("key"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, out = b.slice(i, 256), []
                for turns in part.column(1):
                    v = Flatten(**options)
                    for n, t in enumerate(turns.as_py()):
                        v.turn(n, t["role"], t["parts"])
                    out.append({"formatted": "".join(v.out), "attachments": v.attachments, "loss": v.loss, "expanded_tokens": sum(a["tokens"] for a in v.attachments)})
                if schema is None:
                    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                    held = pa.struct([("turn", pa.int32()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
                    schema = pa.schema([("formatted", pa.string()), ("attachments", pa.list_(held)), ("loss", pa.list_(span)), ("expanded_tokens", pa.int64())])
                made = pa.RecordBatch.from_pylist(out, schema=schema)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], names=["key", *schema.names])

    done = grouped.mapInArrow(run, f"key {kind}, formatted string, attachments array<{ATTACHMENT}>, loss array<{SPAN}>, expanded_tokens long")
    return done.withColumnRenamed("key", key)


def read_back(df: DataFrame) -> DataFrame:
    """df, as format_conversations() made it, with turns (role, text, numbers of attachments) and loss_text, read from `formatted`."""

    @F.arrow_udf("struct<turns:array<struct<role:string,text:string,numbers:array<int>>>,loss_text:string>")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("numbers", pa.list_(pa.int32()))])
        kind = pa.struct([("turns", pa.list_(turn)), ("loss_text", pa.string())])
        for texts, spans in batches:
            out = []
            for text, loss in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                out.append({"turns": turns_of(text), "loss_text": "".join(unescape(text[s["start"] : s["end"]]) for s in loss)})
            yield pa.array(out, kind)

    (got,) = spare(df, "read")
    return df.withColumn(got, read("formatted", "loss")).withColumns({"turns": F.col(f"{got}.turns"), "loss_text": F.col(f"{got}.loss_text")}).drop(got)


def op8_typed_parts(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    done = read_back(format_conversations(rows.withColumn("parts", F.array(text))))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
