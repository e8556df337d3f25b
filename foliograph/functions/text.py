"""Text functions over columns. All are built-in expressions, so they stay in code generation and need no exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_controls(text: ColumnOrName) -> Column:
    """Field marks, NUL and other C0 controls go, tabs stay; every kind of break is a line feed, U+001E a hyphen, NBSP a space."""
    gone = "".join(chr(i) for i in range(32) if i not in (9, 10, 11, 12, 13, 14, 30))
    return F.translate(col(text), "\r\x0b\x0c\x0e\x1e\xa0" + gone, "\n\n\n\n- ")


def normalize_lines(text: ColumnOrName) -> Column:
    """Trims lines, drops empty ones, and drops a line equal to the line kept before it unless it holds a tab or is a
    line of numbers. Trailing white space goes except on lines of tabs alone; of leading characters only spaces go.

    A dropped line equals the kept one before it, so comparing with the neighbour among non-empty lines is exact and one
    pass over an array does it, without an exchange.
    """
    lines = F.split(F.regexp_replace(col(text), r"\r\n?", "\n"), "\n")
    trimmed = F.transform(lines, lambda x: F.when(x.rlike(r"^\t+$"), x).otherwise(F.regexp_replace(F.regexp_replace(x, r"[\s\x{85}\p{Z}]+$", ""), "^ +", "")))
    kept = F.filter(trimmed, lambda x: x != "")
    number = lambda x: x.rlike(r"^[0-9 \t\-‐‑/\\]+$") & x.rlike("[0-9]")
    stays = lambda p: p["x"].isNotNull() & (~p["x"].eqNullSafe(p["before"]) | p["x"].contains("\t") | number(p["x"]))
    return F.array_join(F.transform(F.filter(with_before(kept), stays), lambda p: p["x"]), "\n")


def with_before(items: Column) -> Column:
    """Each item with the one before it, null for the first; one pair more, behind the last, has a null item. (A lambda that looked into `items` by index would make Spark
    evaluate the whole array again for every item.)"""
    return F.zip_with(items, F.concat(F.array(F.lit(None).cast("string")), items), lambda x, p: F.struct(x.alias("x"), p.alias("before")))


def finalize(text: ColumnOrName) -> Column:
    return normalize_lines(strip_controls(text))


def has_indexable(text: ColumnOrName) -> Column:
    """Whether any letter or number is left to index."""
    return col(text).rlike(r"[\p{L}\p{N}]")


def caps(text: ColumnOrName) -> Column:
    """The first letter of each word in upper case, the rest as it is; a word starts after anything but a letter or digit."""
    alnum = lambda x: x.rlike(r"[\p{L}\p{N}]")
    begins = lambda p: alnum(p["x"]) & ~F.coalesce(alnum(p["before"]), F.lit(False))
    return F.array_join(F.transform(with_before(F.split(col(text), "")), lambda p: F.when(begins(p), F.upper(p["x"])).otherwise(p["x"])), "")


def first_cap(text: ColumnOrName) -> Column:
    """The first letter of the text in upper case."""
    at = F.regexp_instr(col(text), F.lit(r"\p{L}"))
    t = col(text)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.upper(F.substring(t, at, F.lit(1))), F.substring(t, at + 1, F.length(t)))).otherwise(t)


def wildcard_pattern(pattern: ColumnOrName) -> Column:
    quoted = F.regexp_replace(col(pattern), r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def wildcard_match(text: ColumnOrName, pattern: ColumnOrName) -> Column:
    """Case-sensitive match of * (any run) and ? (one character)."""
    return F.regexp_like(col(text), wildcard_pattern(pattern))


def text_equal(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Equality of two operands of which either may hold wildcards; the right one is taken as the pattern first."""
    a, b = col(left), col(right)
    wild = lambda x: x.rlike(r"[*?]")
    return F.when(wild(b), wildcard_match(a, b)).when(wild(a), wildcard_match(b, a)).otherwise(a == b)


def property_key(name: ColumnOrName) -> Column:
    return F.upper(F.regexp_replace(col(name), r"[_\-\s]", ""))


def markdown_escape(text: ColumnOrName) -> Column:
    return F.regexp_replace(col(text), r"([\\`*_\[\]<>|])", r"\\$1")


def markdown_url(url: ColumnOrName) -> Column:
    return F.replace(F.replace(col(url), F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("%29"))


def html_escape(text: ColumnOrName, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def xml_escape(text: ColumnOrName, attribute: bool = False) -> Column:
    """HTML escapes without the characters that XML 1.0 forbids."""
    return html_escape(F.regexp_replace(col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", ""), attribute)


def data_uri(mime: ColumnOrName, content: ColumnOrName) -> Column:
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.base64(col(content)))


def heading_level(name: ColumnOrName) -> Column:
    """1 to 9 from a style's id or name, "Heading 2", "heading2" or "제목 2"; else null."""
    level = F.regexp_extract(col(name), r"(?i)^\s*(?:heading|제목)\s*([1-9])\s*$", 1)
    return F.when(level != "", level.cast("int"))


def instruction_parts(instruction: ColumnOrName) -> Column:
    """The tokens of a field instruction: runs without white space outside double quotes, quotes kept."""
    return F.regexp_extract_all(col(instruction), F.lit(r'(?:"[^"]*"?|[^"\s])+'), F.lit(0))


def resolve_target(source: ColumnOrName, target: ColumnOrName) -> Column:
    """A relationship's target as a part name: absolute, or relative to the source part's folder, with . and .. resolved."""
    s, t = col(source), col(target)
    folder = F.regexp_replace(s, "[^/]*$", "")
    path = F.when(t.startswith("/"), t).otherwise(F.concat(folder, t))
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def relative_number(target: ColumnOrName, field: ColumnOrName) -> Column:
    """A dotted number without the leading parts that it has in common with the field's; whole if none would be left."""
    t, f = F.split(col(target), r"\."), F.split(col(field), r"\.")
    same = F.zip_with(t, f, lambda a, b: a.eqNullSafe(b))
    n = F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1
    rest = F.slice(t, n.cast("int") + 1, F.greatest(F.size(t) - n, F.lit(0)).cast("int"))
    return F.when(n >= F.size(t), col(target)).otherwise(F.array_join(rest, "."))


#: Suffix -> MIME type of media parts. Fixed values.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
    "emf": "image/x-emf", "wmf": "image/x-wmf", "svg": "image/svg+xml",
}


def mime_of(name: ColumnOrName) -> Column:
    suffix = F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream"))


#: Private-use and ASCII positions of a symbol font -> Unicode. Fixed values.
SYMBOLS = {
    "symbol": dict(zip(range(0x61, 0x7B), "αβχδεφγηιϕκλμνοπθρστυϖωξψζ")) | dict(zip(range(0x41, 0x5B), "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ")) | {0xB7: "•", 0xA3: "≤", 0xB3: "≥", 0xB9: "≠", 0xB1: "±", 0xB4: "×", 0xAE: "→", 0xAC: "←", 0xA5: "∞", 0xD6: "√", 0xE5: "∑", 0xF2: "∫"},
    "wingdings": {0x6C: "●", 0x6E: "■", 0xA7: "▪", 0xA8: "◻", 0xD8: "➢", 0xFC: "✓", 0xFB: "✗", 0x4A: "☺", 0x46: "☞", 0xE0: "→", 0xDF: "←", 0x71: "❑", 0x76: "❖"},
}


def symbol_text(font: ColumnOrName, text: ColumnOrName) -> Column:
    """Characters of the Symbol and Wingdings fonts as Unicode; others, and other fonts, as they are."""
    name = F.lower(F.trim(col(font)))
    out = col(text)
    for font_name, table in SYMBOLS.items():
        codes = [*table, *(0xF000 + c for c in table)]
        mapped = F.translate(col(text), "".join(map(chr, codes)), "".join(table.values()) * 2)
        out = F.when(name == font_name, mapped).otherwise(out)
    return out
