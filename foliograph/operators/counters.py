"""Numbering as ordered state: windows over (document, order), never loops.

Every function takes rows with explicit ordinals and returns them with one more column. All windows of a function share
their partition and order, so one exchange on the document serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

LEVELS = 9


def running(doc: list[str] | str, *order: str) -> Window:
    return Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def level_counters(df: DataFrame, doc: list[str] | str = "doc_id", order: str = "ord", level: str = "level", start: Column | int = 1, levels: int = LEVELS) -> DataFrame:
    """df with counters: array of `levels` counts after each item. An item advances its own level, seeded with
    max(start, 1), and zeroes deeper ones.

    The count at a level is the start plus the items of that level since the last item of a lower level, less one. The
    last lower item is a running maximum, and counts since it are a difference of running counts.
    """
    at = F.col(level)
    w = running(doc, order)
    out = df
    seed = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    for k in range(levels):
        out = out.withColumn(f"__n{k}", F.sum(F.when(at == k, 1).otherwise(0)).over(w))
    for k in range(levels):  # how many of the level there were at the last lower item: counts only grow, so a maximum finds it
        out = out.withColumn(f"__b{k}", F.max(F.when(at < k, F.col(f"__n{k}"))).over(w))
    one = lambda k: F.when(at < k, 0).otherwise(F.greatest(F.col(f"__n{k}") - F.coalesce(f"__b{k}", F.lit(0)), F.lit(0)))
    counts = F.array(*(F.when(one(k) > 0, one(k) + seed - 1).otherwise(0).cast("int") for k in range(levels)))
    return out.withColumn("counters", counts).drop(*(f"__{x}{k}" for x in "nb" for k in range(levels)))


def formatted(n: Column, style: str) -> Column:
    """One level's number as decimal, upperRoman, lowerRoman, upperLetter, lowerLetter or decimalZero."""
    return {
        "decimal": lambda: n.cast("string"),
        "upperRoman": lambda: numbers.roman(n),
        "lowerRoman": lambda: F.lower(numbers.roman(n)),
        "upperLetter": lambda: numbers.letters(n, "A"),
        "lowerLetter": lambda: F.lower(numbers.letters(n, "A")),
        "decimalZero": lambda: F.lpad(n.cast("string"), 2, "0"),
    }.get(style, lambda: n.cast("string"))()


def list_labels(df: DataFrame, styles: list[str], patterns: list[str], level: str = "level", bullet: list[bool] | None = None) -> DataFrame:
    """df (with counters) with label, the level's pattern with %1 to %9 replaced by the formatted counts, and
    full_label, the counts of all levels down to the item's joined by dots: null where an ancestor has no count or is a bullet."""
    bullets = bullet or [False] * len(styles)
    at = F.col(level)
    label, full = F.lit(None).cast("string"), F.lit(None).cast("string")
    text = [formatted(F.get("counters", F.lit(k)), s) for k, s in enumerate(styles)]
    for k, pattern in enumerate(patterns):
        out = F.lit(pattern)
        if not bullets[k]:
            for j in range(k + 1):
                out = F.replace(out, F.lit(f"%{j + 1}"), text[j])
        label = F.when(at == k, F.when(out != "", out)).otherwise(label)
        known = F.lit(not any(bullets[: k + 1]))
        for j in range(k + 1):
            known = known & (F.get("counters", F.lit(j)) > 0)
        full = F.when((at == k) & known, F.concat_ws(".", *text[: k + 1])).otherwise(full)
    return df.withColumn("label", label).withColumn("full_label", full)


def sequence_numbers(df: DataFrame, doc: str = "doc_id", order: str = "ord", name: str | None = None, action: str = "action", value: str = "value", reset: Column | None = None) -> DataFrame:
    """SEQ fields: action next (n), current (c) or reset (r, to value); anything else doesn't advance.

    A reset, or a heading that `reset` marks, begins a segment; within it the number is what the segment began with plus
    the next-actions so far. current is null until the name has a number.
    """
    keys = [doc, *([name] if name else [])]
    w = running(keys, order)
    act = F.col(action)
    sets = (act == "r") & (F.col(value) >= 0)
    breaks = sets | (reset if reset is not None else F.lit(False))
    out = df.withColumn("__seg", F.sum(F.when(breaks, 1).otherwise(0)).over(w))
    s = running([*keys, "__seg"], order)
    base = F.first(F.when(sets, F.col(value)).otherwise(0)).over(s)
    begun = F.max(F.when(act.isin("n", "r"), 1).otherwise(0)).over(s)
    n = base + F.sum(F.when(act == "n", 1).otherwise(0)).over(s)
    return out.withColumn("number", F.when(act.isin("n", "r", "c") & (begun > 0), n)).drop("__seg")


def auto_numbers(df: DataFrame, valid: Column, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """AUTONUM and its kin share one counter, which only valid fields advance; the others have none."""
    return df.withColumn("number", F.when(valid, F.sum(F.when(valid, 1).otherwise(0)).over(running(doc, order))))


def note_ordinals(df: DataFrame, custom: Column, doc: list[str] | str = "doc_id", order: str = "ord", start: int = 1) -> DataFrame:
    """Footnote or endnote numbers: notes with a mark of their own neither count nor have one."""
    keys = [doc] if isinstance(doc, str) else doc
    return df.withColumn("number", F.when(~custom, F.sum(F.when(custom, 0).otherwise(1)).over(running(keys, order)) + (start - 1)))


def list_markers(df: DataFrame, level: str = "level", ordered: str = "ordered", label: str = "label", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """A captured label if there is one, else "n." counted within a run of one level, or a bullet by level modulo three."""
    numbered = level_counters(df.where(F.col(level).isNotNull()), doc, order, level)
    own = F.concat(F.get("counters", F.col(level)).cast("string"), F.lit("."))
    bullet = F.element_at(F.array(*map(F.lit, "•◦▪")), (F.col(level) % 3 + 1).cast("int"))
    return numbered.withColumn("marker", F.coalesce(label, F.when(F.col(ordered), own).otherwise(bullet))).drop("counters")


def page_numbers(df: DataFrame, is_break: Column, doc: str = "doc_id", order: str = "ord", start: int = 1) -> DataFrame:
    """page: 1 (or start) plus the breaks before or at a row; section breaks to an even or odd page are section_pages()."""
    return df.withColumn("page", F.sum(F.when(is_break, 1).otherwise(0)).over(running(doc, order)) + start)


def section_pages(df: DataFrame, kind: str = "kind", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """doc, order, page, section: pages through breaks of kind page, nextPage, evenPage, oddPage, continuous or null. An even
    or odd break moves on by one page, and one more if that has the wrong parity.

    The parity of the page after an even or odd break is known, so what the next one adds follows from the plain breaks in
    between: pages are running sums, and one window order serves them all.
    """
    keys = [Window.partitionBy(doc).orderBy(order, kind).rowsBetween(Window.unboundedPreceding, x) for x in (0, -1)]
    here, ahead = keys
    k = F.col(kind)
    parity = F.when(k == "evenPage", 0).when(k == "oddPage", 1)
    out = df.select(doc, order, kind).withColumn("__plain", F.count(F.when(k.isin("page", "nextPage"), 1)).over(here))
    marked = F.when(parity.isNotNull(), F.col("__plain"))
    between = F.col("__plain") - F.coalesce(F.last(marked, ignorenulls=True).over(ahead), F.lit(0))
    before = F.coalesce(F.last(parity, ignorenulls=True).over(ahead), F.lit(1))
    adds = F.when(parity.isNotNull(), between + 1 + F.pmod(before + between + 1 - parity, F.lit(2)))
    out = out.withColumns({"__adds": adds, "__since": F.col("__plain") - F.coalesce(F.last(marked, ignorenulls=True).over(here), F.lit(0))})
    page = F.coalesce(F.sum("__adds").over(here), F.lit(0)) + F.col("__since") + 1
    section = F.count(F.when(k.isin("nextPage", "evenPage", "oddPage", "continuous"), 1)).over(here) + 1
    return out.select(doc, order, page.cast("int").alias("page"), section.cast("int").alias("section"))


def with_section_pages(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """df (doc, section, page) with section_pages, from the first page to the last of the section. Rows that are already
    together by document need no further exchange."""
    w = Window.partitionBy(doc, "section")
    return df.withColumn("section_pages", F.max("page").over(w) - F.min("page").over(w) + 1)
