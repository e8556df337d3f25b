"""Exports of block rows: Markdown, HTML and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, markdown_escape, markdown_url
from .content import in_order

MOST_COLUMNS = 64


def by_exchange(df: DataFrame) -> DataFrame:
    """df for a join with as many rows as the other side: never broadcast. Records of many documents pack so well into
    files that Spark takes millions of rows for a few megabytes, and sends them through the driver."""
    return df.hint("merge")


def styled_markdown(text: Column, bold: Column, italic: Column, strike: Column, url: Column | None = None) -> Column:
    """One run: escaped, then emphasis within strike-through, then its link. Blank runs are not marked."""
    t = markdown_escape(text)
    blank = F.trim(text) == ""
    mark = lambda on, m, x: F.when(F.coalesce(on, F.lit(False)) & ~blank, F.concat(F.lit(m), x, F.lit(m))).otherwise(x)
    out = mark(strike, "~~", mark(bold, "**", mark(italic, "*", t)))
    return out if url is None else F.when(url.isNotNull(), F.concat(F.lit("["), out, F.lit("]("), markdown_url(url), F.lit(")"))).otherwise(out)


def styled_html(text: Column, bold: Column, italic: Column, underline: Column, strike: Column, hidden: Column) -> Column:
    """One run: strong outside em outside u outside s; hidden runs are left out."""
    out = html_escape(text)
    for on, tag in ((strike, "s"), (underline, "u"), (italic, "em"), (bold, "strong")):
        out = F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return F.when(~F.coalesce(hidden, F.lit(False)), out)


def markdown(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, markdown: blocks (ord, kind, level, ordered, label, text) with escaped text as chunks with a blank line between.

    heading: level 1 to 6; list: level from 0; table: ready text; break: a page break. Empty chunks are skipped.
    """
    k, t = F.col("kind"), F.col("text")
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level"), F.lit(0)).cast("int"))
    item = F.concat(indent, F.when(F.col("ordered"), F.lit("1. ")).otherwise(F.lit("- ")), t)
    chunk = (
        F.when(k == "break", F.lit("\\pagebreak")).when(t == "", F.lit(None)).when(k == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), t))
        .when(k == "list", item).otherwise(t)
    )
    return blocks.groupBy(doc).agg(in_order("ord", chunk, "\n\n").alias("markdown")).where("markdown <> ''")


def markdown_table(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, text: a simple grid (row, col from 0, no spans) with its first row as header, short rows filled up.

    More than 64 columns aren't filled. Escaped cell text keeps its line feeds as <br>.
    """
    width = cells.groupBy(*table).agg((F.max("col") + 1).alias("__w"))
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("<br>"))
    rows = cells.groupBy(*table, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", text.alias("t")))).alias("m"), (F.max("col") + 1).alias("n")).join(by_exchange(width), table)
    size = F.when(F.col("__w") <= MOST_COLUMNS, F.col("__w")).otherwise(F.col("n"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), size.cast("int")))
    lines = rows.select(*table, "row", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("t"))
    return lines.groupBy(*table).agg(in_order("row", "t", "\n").alias("text"))


def html(blocks: DataFrame, doc: str = "doc_id", levels: int = 9) -> DataFrame:
    """doc, html: blocks (ord, kind, level, ordered, text) with escaped text; list items open and close nested lists.

    The lists open at an item are as deep as its level, so what to open and close follows from the neighbours' levels: a
    window, no stack. A list whose kind differs from its neighbour's at the same level is closed and opened again.
    """
    w = Window.partitionBy(doc).orderBy("ord")
    is_list = F.col("kind") == "list"
    depth = F.when(is_list, F.least(F.greatest(F.col("level"), F.lit(0)), F.lit(levels - 1)) + 1).otherwise(0)
    out = blocks.withColumn("__d", depth.cast("int"))
    kind = F.when(F.col("ordered"), "ol").otherwise("ul")
    out = out.withColumns({"__k": kind, "__pd": F.coalesce(F.lag("__d").over(w), F.lit(0)), "__nd": F.coalesce(F.lead("__d").over(w), F.lit(0))})
    out = out.withColumns({"__pk": F.lag("__k").over(w), "__nk": F.lead("__k").over(w)})
    turn = lambda d, k: (F.col(d) == F.col("__d")) & (F.col(k) != F.col("__k"))
    opens = F.when(turn("__pd", "__pk"), 1).otherwise(F.greatest(F.col("__d") - F.col("__pd"), F.lit(0)))
    closes = F.when(turn("__nd", "__nk"), 1).otherwise(F.greatest(F.col("__d") - F.col("__nd"), F.lit(0)))
    tag = F.concat(F.lit("h"), F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(6)).cast("string"))
    item = F.concat(F.repeat(F.concat(F.lit("<"), F.col("__k"), F.lit(">")), opens.cast("int")), F.lit("<li>"), "text", F.lit("</li>"), F.repeat(F.concat(F.lit("</"), F.col("__k"), F.lit(">")), closes.cast("int")))
    align = F.when(F.col("align").isNotNull(), F.concat(F.lit(' style="text-align:'), "align", F.lit('"'))).otherwise("") if "align" in blocks.columns else F.lit("")
    one = (
        F.when(is_list, item).when(F.col("kind") == "heading", F.concat(F.lit("<"), tag, align, F.lit(">"), "text", F.lit("</"), tag, F.lit(">")))
        .when(F.col("kind") == "break", F.lit("<hr>")).when(F.col("kind") == "table", F.col("text")).otherwise(F.concat(F.lit("<p"), align, F.lit(">"), "text", F.lit("</p>")))
    )
    return out.withColumn("__h", one).groupBy(doc).agg(in_order("ord", "__h", "").alias("html"))


def html_table(cells: DataFrame, table: list[str]) -> DataFrame:
    """table, text: rows with spans; leading header rows are a thead."""
    h = F.coalesce(F.col("is_header"), F.lit(False))
    tag = F.when(h, "th").otherwise("td")
    span = lambda c, n: F.when(F.col(c) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("col_span", "colspan"), span("row_span", "rowspan"), F.lit(">"), "text", F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("__c", cell).groupBy(*table, "row").agg(F.concat(F.lit("<tr>"), in_order("col", "__c", ""), F.lit("</tr>")).alias("t"), F.min(h.cast("int")).alias("h"))
    lead = rows.withColumn("h", F.min("h").over(Window.partitionBy(*table).orderBy("row")))
    head, body = (in_order("row", F.when(F.col("h") == x, F.col("t")), "") for x in (1, 0))
    got = lead.groupBy(*table).agg(head.alias("a"), body.alias("b"))
    wrap = lambda c, n: F.when(F.col(c) != "", F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))).otherwise("")
    return got.select(*table, F.concat(F.lit("<table>"), wrap("a", "thead"), wrap("b", "tbody"), F.lit("</table>")).alias("text"))


def json_report(**fields: Column) -> Column:
    """A JSON object with the fields in the order given, nulls written out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})
