"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what counts (of group 2 for assign, of the match for the others).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex")

SPAN = "struct<start:int,end:int,kind:string,rank:int>"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `alphabet` with at least `window` characters are candidates; a window counts when its entropy in bits a
    character reaches `bits` and it holds a digit and a letter."""

    name: str
    alphabet: str
    window: int
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdef", 24, 2.9),
    CharacterClass("entropy_base64", UPPER + LOWER + DIGITS + "+/_-", 24, 4.0),
)
#: Candidates that hold one of these, in any case, are known to be harmless: placeholders, alphabets and digit rows.
ALLOWED = ("example", "placeholder", "changeme", "xxxxxxxx", "abcdefghij", "0123456789", "1234567890", "00000000")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def block_size(items: Column) -> Column:
    return F.sqrt(F.size(items)).cast("int") + 8


def folded(items: Column, start: Column, state: str, out: str, step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """A fold of items with a state and a list: step(state, list, item) gives both anew. Returns the state and the list of
    each block of about sqrt(n) items (s, out); the list begins anew with each block. An array that grows by one is
    copied each time; in blocks that makes n sqrt(n) copied elements, not n squared. state, out: their types."""
    nothing = F.array().cast(out)

    def blocks(xs: Column) -> Column:
        def block(done: Column, b: Column) -> Column:
            own = F.struct(F.when(b == 0, start).otherwise(F.element_at(done, -1)["s"]).alias("s"), nothing.alias("out"))

            def one(a: Column, x: Column) -> Column:
                s, o = step(a["s"], a["out"], x)
                return F.struct(s.alias("s"), o.alias("out"))

            return F.concat(done, F.array(F.aggregate(F.slice(xs, b * block_size(xs) + 1, block_size(xs)), own, one)))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(xs) / block_size(xs)).cast("int")), F.array().cast(f"array<struct<s:{state},out:{out}>>"), block)

    return let(items, blocks)


def appended(states: Column) -> Column:
    return F.flatten(F.transform(states, lambda s: s["out"]))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, own: length of the group, word: the match), in code
    points, end exclusive.

    split() and regexp_extract_all() walk over the same matches, so the pieces between them give the offsets.
    """
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    both = let(hits, lambda h: F.zip_with(h, h if group == 0 else F.regexp_extract_all(text, p, F.lit(group)), lambda w, g: F.struct(w.alias("word"), F.length(g).alias("own"))))
    parts = F.zip_with(gaps, both, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))  # one gap more than there are hits

    def step(at: Column, out: Column, x: Column) -> tuple[Column, Column]:
        a, word = at + x["gap"], x["hit"]["word"]
        b = a + F.length(word)
        return b, F.when(word.isNull(), out).otherwise(F.concat(out, F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"]["own"].alias("own"), word.alias("word")))))

    return appended(folded(parts, F.lit(0), "int", "array<struct<start:int,end:int,own:int,word:string>>", step))


def base_spans(text: Column) -> Column:
    """The spans of the base patterns, by start and then kind. Texts without any match are only searched once a kind.

    A run of hex digits or of access-key characters is a maximal run, so the least length may stand in its pattern;
    assignments keep theirs outside, as a match too short still uses up its characters.
    """
    none = F.array().cast(f"array<{SPAN}>")
    hex_, access = f"[0-9a-f]{{{LEAST['hex']},}}", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"

    def of(rank: int, kind: str, pattern: str, group: int) -> Column:
        spans = F.filter(found(text, pattern, group), lambda x: x["own"] >= LEAST[kind])
        typed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))
        return F.when(text.rlike(pattern), typed.cast(f"array<{SPAN}>")).otherwise(none)

    return by_start(F.concat(of(0, "assign", ASSIGN, 2), of(1, "access", access, 0), of(2, "hex", hex_, 0)))


def by_start(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["rank"].alias("rank")))


def windows(word: Column, begin: Column, c: CharacterClass, rank: int) -> Column:
    """The parts of a candidate that windows of high entropy cover, as spans.

    One pass with counts that change by the character that enters and the one that leaves: with S the sum of n log2 n
    over the counts, a window of w characters has the entropy log2 w - S / w. The counts lie side by side in a few longs.
    """
    w, bits = c.window, c.window.bit_length()
    each = 62 // bits
    table = lambda xs, t: F.array(*(F.lit(x).cast(t) for x in xs))
    places = range(len(c.alphabet))
    # by the place in the alphabet from 1 on; 0 is no character
    long_of, shift, one = table([-1, *(i // each for i in places)], "int"), table([0, *(bits * (i % each) for i in places)], "int"), table([0, *(1 << bits * (i % each) for i in places)], "bigint")
    digit = table([0, *(int(x.isdigit()) for x in c.alphabet)], "int")
    gain = table([0.0, *(n * math.log2(n) - ((n - 1) * math.log2(n - 1) if n > 1 else 0.0) for n in range(1, w + 1))], "double")  # n log2 n over that of n - 1
    chars = F.filter(F.transform(F.split(word, ""), lambda x: F.instr(F.lit(c.alphabet), x)), lambda x: x > 0)
    empty = F.struct(
        F.array(*[F.lit(0).cast("bigint")] * -(-len(c.alphabet) // each)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("digits"), F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("b")
    )
    moves = let(chars, lambda x: F.zip_with(x, F.slice(F.concat(F.array_repeat(F.lit(0), w), x), F.lit(1), F.size(x)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    most = w * math.log2(w) - c.bits * w + 1e-9

    def step(s: Column, out: Column, m: Column) -> tuple[Column, Column]:
        x, y = m["x"], m["y"]
        count = lambda z: F.call_function("shiftright", F.get(s["n"], F.get(long_of, z)), F.get(shift, z)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        left = F.when(y > 0, F.get(gain, count(y))).otherwise(F.lit(0.0))
        total = s["s"] - left + F.get(gain, count(x) + F.when(x == y, 0).otherwise(1))
        digits = s["digits"] + F.get(digit, x) - F.get(digit, y)
        i = s["i"] + 1
        hit = (i >= w) & (total <= most) & (digits > 0) & (digits < w)
        fresh = hit & ((s["a"] < 0) | (i - w > s["b"]))
        counts = F.transform(s["n"], lambda v, k: v + F.when(k == F.get(long_of, x), F.get(one, x)).otherwise(0) - F.when(k == F.get(long_of, y), F.get(one, y)).otherwise(0))
        state = F.struct(
            F.when(x == y, s["n"]).otherwise(counts).alias("n"), total.alias("s"), digits.alias("digits"), i.alias("i"),
            F.when(fresh, i - w).otherwise(s["a"]).alias("a"), F.when(hit, i).otherwise(s["b"]).alias("b"),
        )
        return state, F.when(fresh & (s["a"] >= 0), F.concat(out, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(out)

    def close(states: Column) -> Column:
        return F.concat(appended(states), F.filter(F.array(F.struct(F.element_at(states, -1)["s"]["a"].alias("a"), F.element_at(states, -1)["s"]["b"].alias("b"))), lambda x: x["a"] >= 0))

    spans = let(folded(moves, empty, "struct<n:array<bigint>,s:double,digits:int,i:int,a:int,b:int>", "array<struct<a:int,b:int>>", step), close)
    return F.transform(spans, lambda x: F.struct((begin + x["a"]).alias("start"), (begin + x["b"]).alias("end"), F.lit(c.name).alias("kind"), F.lit(rank).alias("rank"))).cast(f"array<{SPAN}>")


def entropy_spans(text: Column, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """The spans that the entropy windows of each class cover, without candidates that hold an allowed string."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(rank: int, c: CharacterClass) -> Column:
        run = "[" + "".join("\\" + x if x in "+/_-" else x for x in c.alphabet) + f"]{{{c.window},}}"
        spans = found(text, run)
        kept = F.filter(spans, lambda x: ~F.lower(x["word"]).rlike("|".join(allowed))) if allowed else spans
        own = F.flatten(F.transform(kept, lambda x: windows(x["word"], x["start"], c, rank)))
        return F.when(text.rlike(run), own).otherwise(none)

    return F.concat(none, *(of(rank, c) for rank, c in enumerate(classes, len(KINDS))))


def scan(df: DataFrame, *, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """df with base and spans: arrays of (start, end, kind, rank) by start, then kind; columns so named are replaced.

    base holds the spans of the fixed patterns; spans holds those and the entropy spans that no base span covers. The
    allow-list suppresses entropy spans only. Null and empty texts have none. A text's time grows with its length and, for n
    matches, with n sqrt(n) copied references: 100,000 matches in one text take seconds. Offsets are code points, end exclusive.
    Each row is scanned by itself, so hot sources, copies and repeated rows need no exchange.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("base", base_spans(t))
    more = let(entropy_spans(t, classes, allowed), lambda m: F.when((F.size(m) > 0) & (F.size("base") > 0), uncovered(m, F.col("base"))).otherwise(m))
    return base.withColumn("spans", by_start(F.concat("base", more)))


def uncovered(spans: Column, base: Column) -> Column:
    """The spans that no base span covers: one pass over both by start, with the farthest end of a base span so far."""
    tagged = lambda xs, kind: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("more"), x.alias("x")))
    both = F.array_sort(F.concat(tagged(base, 0), tagged(spans, 1)))  # of equal starts the base spans come first

    def step(far: Column, out: Column, y: Column) -> tuple[Column, Column]:
        end = y["x"]["end"]
        return F.when(y["more"] == 0, F.greatest(far, end)).otherwise(far), F.when((y["more"] == 1) & (end > far), F.concat(out, F.array(y["x"]))).otherwise(out)

    return appended(folded(both, F.lit(-1), "int", f"array<{SPAN}>", step))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by one mark; spans are in order of their start.

    Pieces are cut from a block of the text, as finding a code point takes a walk from the beginning: sqrt(n) walks over
    the text and short ones within blocks.
    """
    t = F.coalesce(text, F.lit(""))
    nothing = F.array().cast("array<string>")

    def blocks(xs: Column) -> Column:
        def block(done: Column, b: Column) -> Column:
            begin = F.when(b == 0, F.lit(0)).otherwise(F.element_at(done, -1)["at"])
            own = F.slice(xs, b * block_size(xs) + 1, block_size(xs))
            cut = let(F.struct(begin.alias("begin"), own.alias("own")), lambda c: F.struct(c["begin"], c["own"], F.substring(t, c["begin"] + 1, F.coalesce(F.get(c["own"], F.size(c["own"]) - 1)["start"] - c["begin"], F.lit(0))).alias("text")))

            def pieces(c: Column) -> Column:
                def step(s: Column, x: Column) -> Column:
                    piece = F.concat(F.substring(c["text"], s["at"] - c["begin"] + 1, x["start"] - s["at"]), F.lit(mark))
                    return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

                return F.aggregate(c["own"], F.struct(c["begin"].alias("at"), nothing.alias("out")), step)

            return F.concat(done, F.array(let(cut, pieces)))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(xs) / block_size(xs)).cast("int")), F.array().cast("array<struct<at:int,out:array<string>>>"), block)

    joined = let(let(spans, blocks), lambda s: F.concat(F.array_join(appended(s), ""), F.substring(t, F.element_at(s, -1)["at"] + 1, F.length(t))))
    return F.when(F.size(spans) == 0, text).otherwise(joined)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_entropy_windows(spark, sf_dir):
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *map(count, KINDS), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
