"""Number formats: lists, pages, fields. Arabic, roman, letters, ordinals and hex are expressions; spelled-out and
East Asian numbers come from Python, a batch at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ColumnOrName, col


def roman(n: ColumnOrName, beyond: str = "decimal") -> Column:
    """Upper-case roman numerals of 1 to 3999; others are decimal digits, or null for pages (beyond="null")."""
    n = col(n).cast("int")
    digit = lambda place, one, five, ten: F.element_at(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), F.floor(n / place).cast("int") % 10 + 1)
    text = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return F.when((n >= 1) & (n <= 3999), text).otherwise(n.cast("string") if beyond == "decimal" else F.lit(None).cast("string"))


def letters(n: ColumnOrName, zero: str | None = "") -> Column:
    """Bijective base 26: A to Z, AA, AB, ...; for 0 and less it is `zero`, '' in lists and null on pages."""
    n = col(n).cast("long")
    start = F.struct(n.alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.when(a["n"] > 0, F.concat(F.char(65 + (a["n"] - 1) % 26), a["s"])).otherwise(a["s"]).alias("s"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["s"]).otherwise(F.lit(zero).cast("string"))


def ordinal(n: ColumnOrName) -> Column:
    n = col(n)
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred"))
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def card_text(n: int) -> str:
    """123 -> one hundred twenty-three: without "and", tens hyphenated."""
    if n < 0:
        return "minus " + card_text(-n)
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    size, name = next(s for s in SCALES if n >= s[0])
    return f"{card_text(n // size)} {name}" + (f" {card_text(n % size)}" if n % size else "")


def ord_text(n: int) -> str:
    head, cut, last = card_text(n).rpartition("-") if "-" in card_text(n).rpartition(" ")[2] else card_text(n).rpartition(" ")
    return head + cut + ORDINALS.get(last, last[:-1] + "ieth" if last.endswith("y") else last + "th")


def dollar_text(value: float) -> str:
    cents = int(abs(value) * 100 + 0.5)
    return f"{'minus ' if value < 0 and cents else ''}{card_text(cents // 100)} and {cents % 100:02d}/100"


SINO = "영일이삼사오육칠팔구"
GANADA, CHOSUNG = "가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
NATIVE_ONES = " 하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉".split(" ")
NATIVE_TENS = " 열 스물 서른 마흔 쉰 예순 일흔 여든 아흔".split(" ")


def korean_digits(n: int) -> str:
    """Sino-Korean numerals: 23 -> 이십삼."""
    out = ""
    for size, name in ((10**8, "억"), (10**4, "만")):
        if n >= size:
            out += (korean_digits(n // size) if n // size > 1 or size > 10**4 else "") + name
            n %= size
    for size, name in ((1000, "천"), (100, "백"), (10, "십")):
        if n >= size:
            out += (SINO[n // size] if n // size > 1 else "") + name
            n %= size
    return out + (SINO[n] if n or not out else "")


def korean_count(n: int) -> str:
    """Native Korean numerals to 99: 21 -> 스물하나; beyond that Sino-Korean."""
    return NATIVE_TENS[n // 10] + NATIVE_ONES[n % 10] if 0 < n < 100 else korean_digits(n)


def _roman(n: int) -> str:
    if not 0 < n < 4000:
        return str(n)
    out = ""
    for size, mark in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split()):
        out += mark * (n // size)
        n %= size
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        out, n = chr(65 + (n - 1) % 26) + out, (n - 1) // 26
    return out


MOST_REPEATS = 1024  # fixed value


def cycled(n: int, marks: str) -> str:
    """가 ... 하, then 가가 ...: the mark is repeated once more for each round, MOST_REPEATS times at most."""
    return marks[(n - 1) % len(marks)] * min((n - 1) // len(marks) + 1, MOST_REPEATS) if n > 0 else ""


def in_range(n: int, first: int, last: int, least: int = 1) -> str:
    return chr(first + n - least) if least <= n < least + last else str(n)


#: Format codes of legacy lists -> formatter. Fixed values.
STYLES = {
    0x00: str, 0x01: _roman, 0x02: lambda n: _roman(n).lower(), 0x03: _letters, 0x04: lambda n: _letters(n).lower(),
    0x05: lambda n: f"{n}{'th' if 10 < n % 100 < 14 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}", 0x06: card_text, 0x07: ord_text,
    0x0E: lambda n: str(n).translate({48 + i: 0xFF10 + i for i in range(10)}), 0x12: lambda n: in_range(n, 0x2460, 20), 0x16: lambda n: f"{n:02d}", 0x17: lambda n: "",
    0x18: lambda n: cycled(n, GANADA), 0x19: lambda n: cycled(n, CHOSUNG), 0x1A: lambda n: in_range(n, 0x2488, 20), 0x1B: lambda n: in_range(n, 0x2474, 20), 0xFF: lambda n: "",
    0x29: korean_digits, 0x2A: korean_count,
}


def style_text(n: int, code: int) -> str:
    return STYLES.get(code, str)(n)


@F.pandas_udf(T.StringType())
def format_style(n: pd.Series, code: pd.Series) -> pd.Series:
    """The number in a list's format code; unknown codes are decimal, null gives null."""
    return pd.Series([None if pd.isna(a) or pd.isna(c) else style_text(int(a), int(c)) for a, c in zip(n, code)])


#: Names of \\* number switches of fields; roman, alphabetic and their like are case-sensitive.
def field_number(value: float, name: str) -> str | None:
    n = int(abs(value) + 0.5) * (1 if value >= 0 else -1)
    plain = name.lower()
    if plain == "arabic":
        return str(n)
    if plain == "arabicdash":
        return f"- {n} -"
    if plain in ("roman", "alphabetic"):
        if not (0 < n < 4000 if plain == "roman" else n > 0):
            return None
        text = _roman(n) if plain == "roman" else _letters(n)
        return text if name[0].isupper() else text.lower()
    if plain == "ordinal":
        return STYLES[0x05](n)
    if plain == "cardtext":
        return card_text(n)
    if plain == "ordtext":
        return ord_text(n)
    if plain == "hex":
        return f"{n:X}" if n >= 0 and abs(value - n) < 1e-12 else None
    if plain == "dollartext":
        return dollar_text(value)
    return None


@F.pandas_udf(T.StringType())
def format_field_number(value: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or s is None else field_number(float(v), s) for v, s in zip(value, name)])
