"""Text of documents: flattening, regions, stories, revision views, contents, captions, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finalize
from ..kept import drop, written


def in_order(order: Column | str, text: Column | str, glue: str) -> Column:
    """An aggregate: the texts joined in order; nulls are left out."""
    o, t = (F.col(x) if isinstance(x, str) else x for x in (order, text))
    pairs = F.sort_array(F.collect_list(F.when(t.isNotNull(), F.struct(o.alias("o"), t.alias("t")))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), glue)


def flatten(blocks: DataFrame, cells: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """doc, text: paragraphs each followed by a line feed, breaks as line feeds, a table row as its cells joined by tabs.

    blocks: doc, ord, kind (paragraph, table, break), text. cells: doc, ord of the table, row, col, text of one cell's
    paragraphs; a cell's paragraphs are joined by spaces, empty ones skipped.
    """
    line = F.when(F.col("kind") == "paragraph", F.concat("text", F.lit("\n"))).when(F.col("kind") == "break", F.lit("\n"))
    rows = blocks.where("kind <> 'table'").select(doc, "ord", F.lit(-1).alias("row"), line.alias("t"))
    if cells is not None:
        cell = cells.groupBy(doc, "ord", "row", "col").agg(in_order("para", F.when(F.trim("text") != "", F.regexp_replace("text", r"\s*\n\s*", " ")), " ").alias("t"))
        rows = rows.unionByName(cell.groupBy(doc, "ord", "row").agg(F.concat(in_order("col", "t", "\t"), F.lit("\n")).alias("t")))
    return rows.groupBy(doc).agg(in_order(F.struct("ord", "row"), "t", "").alias("text"))


def story_text(blocks: DataFrame, stories: list[str] | None = None, doc: str = "doc_id") -> DataFrame:
    """Normalized text of the documents' blocks of those stories (all of them by default), stories in the order given by
    story_ord. main_text() of a document is story "body" alone."""
    chosen = blocks if stories is None else blocks.where(F.col("story").isin(stories))
    return chosen.groupBy(doc).agg(finalize(in_order(F.struct("story_ord", "ord"), "text", "\n")).alias("text"))


def region_text(regions: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text of each source region: the blocks in its range without separators, a line feed for a page break."""
    b = blocks.select(F.col(doc).alias("__d"), F.col("ord").alias("__o"), F.when(F.col("kind") == "break", "\n").otherwise(F.col("text")).alias("__t"))
    inside = regions.join(b, (F.col(doc) == F.col("__d")) & (F.col("__o") >= F.col("block_start")) & (F.col("__o") < F.col("block_end")), "left")
    return inside.groupBy(doc, "ord", "kind").agg(in_order("__o", "__t", "").alias("text"))


def stats(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, paragraphs, tables, figures, text_chars (code points): one aggregation with partial sums."""
    is_ = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    return blocks.groupBy(doc).agg(
        F.count_if(is_("paragraph")).alias("paragraphs"), F.count_if(is_("table")).alias("tables"), F.count_if(is_("image")).alias("figures"),
        F.coalesce(F.sum(F.when(is_("paragraph"), F.char_length("text"))), F.lit(0)).cast("long").alias("text_chars"),
    )


def split_breaks(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """A paragraph with page-break marks (form feeds) as several, with breaks in between: adds part and kind; blank parts go."""
    parts = paragraphs.select(*[c for c in paragraphs.columns if c != text], F.posexplode(F.split(text, "\f")).alias("part", text))
    breaks = parts.where("part > 0").withColumns({text: F.lit(""), "kind": F.lit("break"), "part": F.col("part") * 2 - 1})
    return parts.where(F.trim(text) != "").withColumns({"kind": F.lit("paragraph"), "part": F.col("part") * 2}).unionByName(breaks)


VIEWS = ("accepted", "original", "annotated")


def revision_text(view: Column | str, kind: Column, text: Column) -> Column:
    """A segment in a view: accepted shows what is inserted or moved here, original what is deleted or moved away, and
    annotated both with marks. A null kind is unchanged text."""
    v = F.lit(view) if isinstance(view, str) else view
    marks = F.create_map(*(F.lit(x) for kv in {"ins": "[+", "del": "[-", "moveFrom": "[~", "moveTo": "[~->"}.items() for x in kv))
    marked = F.concat(F.try_element_at(marks, kind), text, F.when(kind == "moveFrom", F.lit("->]")).otherwise(F.lit("]")))
    accepted = F.when(kind.isNull() | kind.isin("ins", "moveTo"), text)
    original = F.when(kind.isNull() | kind.isin("del", "moveFrom"), text)
    return F.when(v == "accepted", accepted).when(v == "original", original).otherwise(F.when(kind.isNull(), text).otherwise(marked))


def revision_views(segments: DataFrame, doc: str = "doc_id", views: tuple[str, ...] = VIEWS) -> DataFrame:
    """doc and a column for each view: segments (doc, ord, kind, text) joined by spaces and normalized."""
    one = lambda v: finalize(in_order("ord", revision_text(v, F.col("kind"), F.col("text")), " ")).alias(v)
    return segments.groupBy(doc).agg(*map(one, views))


def current(segments: DataFrame) -> DataFrame:
    """What counts everywhere but in views: rows that aren't deleted or moved away."""
    return segments.where("kind IS NULL OR kind NOT IN ('del', 'moveFrom')")


def toc_entries(entries: DataFrame, low: int = 1, high: int = 3, outline: bool = False, custom: dict[str, int] | None = None, tc: str | None = None, tc_levels: tuple[int, int] = (1, 9), sequence: str | None = None) -> DataFrame:
    """Entries (doc_id, ord, source, level, style, type, text) that a contents field selects, with their level there.

    source is heading, outline, tc or seq. Standard selections come first, custom styles second; names of styles, types
    and sequences are compared without case.
    """
    lower = lambda c: F.lower(F.col(c))
    level = F.when((F.col("source") == "heading") & F.col("level").between(low, high), F.col("level"))
    if outline:
        level = F.coalesce(level, F.when((F.col("source") == "outline") & F.col("level").between(low, high), F.col("level")))
    if tc is not None:
        of_type = (lower("type") == tc.lower()) if tc else F.lit(True)
        level = F.coalesce(level, F.when((F.col("source") == "tc") & of_type & F.col("level").between(*tc_levels), F.col("level")))
    if sequence is not None:
        level = F.coalesce(level, F.when((F.col("source") == "seq") & (lower("type") == sequence.lower()), F.lit(1)))
    for name, at in (custom or {}).items():
        level = F.coalesce(level, F.when(lower("style") == name.lower(), F.lit(at)))
    return entries.withColumn("toc_level", level.cast("int")).where("toc_level is not null")


def toc_text(selected: DataFrame, start: int = 1, doc: str = "doc_id") -> DataFrame:
    """One line an entry, indented by two spaces a level below the first; lines joined by line feeds."""
    line = F.concat(F.repeat(F.lit("  "), F.col("toc_level") - start), "text")
    return selected.groupBy(doc).agg(in_order("ord", line, "\n").alias("toc"))


def caption_text(text: Column, label: str) -> Column:
    """A caption without its label and number; null if it isn't the label's."""
    pattern = rf"(?is)^\s*{label}\s+[0-9ivxlcdmA-Za-z]+(?:[.:)\-–—]|\s)*(.*)$"
    return F.when(text.rlike(rf"(?is)^\s*{label}\s+[0-9]"), F.trim(F.regexp_extract(text, pattern, 1)))


def inherit_styles(styles: DataFrame, limit: int = 32, doc: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """styles (style_id, based_on, declared, value) with the value of the nearest style that declares one, up the chain,
    and its depth. With columns, each of them is such a value, declared where <c>_declared, and comes with <c>_depth.

    A declared null is a value: it hides what lies above. The chain is followed `limit` links at most, and cycles end
    there. Pointers jump: each round a style takes over what its ancestor knows and where that points to, so the way known
    doubles and a few joins do for any number of styles.
    """
    keys = [doc] if doc else []
    flag = {c: f"{c}_declared" for c in columns} if columns else {"value": "declared"}
    far = {c: f"{c}_depth" for c in columns} if columns else {"value": "depth"}
    known = [x for c in flag for x in (f"{c}", flag[c], far[c])]
    start = {c: F.when(F.col(flag[c]), F.col(c)) for c in flag} | {flag[c]: F.coalesce(F.col(flag[c]), F.lit(False)) for c in flag} | {far[c]: F.when(F.col(flag[c]), 0) for c in flag}
    old: list[str] = []
    state = written(styles.select(*keys, "style_id", F.col("based_on").alias("next"), F.lit(1).alias("hop"), *(x.alias(n) for n, x in start.items())), old)
    for _ in range(limit.bit_length()):
        above = state.select(*(F.col(k).alias(f"__{k}") for k in [*keys, "style_id", "next", "hop", *known]))
        on = F.col("next") == F.col("__style_id")
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        got = F.col("__style_id").isNotNull()
        taken = []
        for c in flag:
            depth = F.col("hop") + F.col(f"__{far[c]}")
            take = ~F.col(flag[c]) & got & F.col(f"__{flag[c]}") & (depth <= limit)
            taken += [F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c), (F.col(flag[c]) | F.coalesce(take, F.lit(False))).alias(flag[c]), F.when(take, depth).otherwise(F.col(far[c])).alias(far[c])]
        fresh: list[str] = []
        state = written(state.join(above, on, "left").select(*keys, "style_id", F.when(got, F.col("__next")).alias("next"), F.when(got, F.col("hop") + F.col("__hop")).otherwise(F.col("hop")).cast("int").alias("hop"), *taken), fresh)
        drop(styles.sparkSession, old)
        old = fresh
        if state.where(F.col("next").isNotNull()).isEmpty():
            break
    return state.select(*keys, "style_id", *(F.col(x) for c in flag for x in (c, far[c])))


def overlay(blocks: DataFrame, styles: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """Direct properties over a style's: blocks joined with resolved styles; a direct value counts where <c>_declared."""
    s = styles.select(*on, *(F.col(c).alias(f"__{c}") for c in columns))
    out = blocks.join(s, on, "left")
    return out.withColumns({c: F.when(F.col(f"{c}_declared"), F.col(c)).otherwise(F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def tab_stops(changes: Column, most: int = 256) -> Column:
    """Tab stops after a cascade of (pos, align) changes, "clear" taking one away: by position, the last change wins."""
    last = F.filter(changes, lambda x, i: ~F.exists(F.slice(changes, i + 2, F.size(changes)), lambda y: y["pos"] == x["pos"]))
    return F.slice(F.sort_array(F.filter(last, lambda x: x["align"] != "clear")), 1, most)
