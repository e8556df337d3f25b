"""Answers over opened documents: text, views, Markdown, HTML, reports. Inputs are the records that open_documents() makes.

All are grouped by document, so that one exchange on doc_id serves an answer; keep the opened records in a table when
several answers are wanted, as parsing is the dear part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finalize, html_escape, markdown_escape
from ..operators import content, export, reports
from ..operators.export import by_exchange
from ..sources.packages import records

CORE = ("title", "subject", "creator", "description", "keywords", "category", "content_status", "last_modified_by", "created", "modified", "last_printed", "revision", "version")


def blocks(opened: DataFrame) -> DataFrame:
    """Top-level blocks of all stories, with story_ord: body, notes, headers and footers, others."""
    types = {"kind": "string", "heading_level": "int", "list_level": "int", "list_ordered": "boolean", "list_label": "string", "align": "string", "in_table": "string", "simple": "boolean", "page": "int", "section": "int", "style_name": "string", "lines": "string"}
    story = F.when(F.col("story") == "body", 0).when(F.col("story") == "footnote", 1).when(F.col("story") == "endnote", 2).when(F.col("story").startswith("header"), 3).when(F.col("story").startswith("footer"), 4).otherwise(5)
    return records(opened, "block", types).withColumn("story_ord", story)


def runs(opened: DataFrame) -> DataFrame:
    types = {"run": "int", "bold": "boolean", "italic": "boolean", "underline": "boolean", "strike": "boolean", "hidden": "boolean", "url": "string", "revision": "string"}
    return records(opened, "run", types)


def text(opened: DataFrame, story: str | None = None) -> DataFrame:
    """doc_id, text: normalized text of all stories, or of one: body, footnote, endnote, header, footer, textbox. A table is
    a line for each row, its cells joined by tabs."""
    if story == "textbox":
        boxes = records(opened, "text_box")
        return boxes.groupBy("doc_id").agg(finalize(content.in_order("ord", "text", "\n")).alias("text"))
    own = blocks(opened).where("in_table IS NULL")
    if story:
        own = own.where(F.col("story").startswith(story))
    lines = own.withColumn("text", F.when(F.col("kind") == "break", "").otherwise(F.coalesce("text", "lines")))
    return lines.groupBy("doc_id").agg(finalize(content.in_order(F.struct("story_ord", "story", "path"), "text", "\n")).alias("text"))


def view(opened: DataFrame, which: str) -> DataFrame:
    """doc_id, text: the body as accepted, original or annotated; segments of one kind are joined, then by spaces."""
    r = runs(opened).where("story = 'body'").select("doc_id", F.struct("path", "run").alias("ord"), F.col("revision").alias("kind"), "text")
    return r.groupBy("doc_id").agg(finalize(content.in_order("ord", content.revision_text(which, F.col("kind"), F.col("text")), " ")).alias("text"))


def _block_text(opened: DataFrame, plain: Column, styled: Column) -> DataFrame:
    """Body blocks with their text made of styled runs; blocks without runs of their own path have plain text."""
    r = content.current(runs(opened).where("story = 'body'").withColumnRenamed("revision", "kind")).withColumn("t", styled)
    made = r.groupBy("doc_id", "path").agg(content.in_order("run", "t", "").alias("made"))
    return blocks(opened).where("story = 'body' AND in_table IS NULL").join(by_exchange(made), ["doc_id", "path"], "left").withColumn("text", F.coalesce("made", plain, F.lit(""))).drop("made")


def _cells(opened: DataFrame) -> DataFrame:
    types = {"row": "int", "cell": "int", "grid_col": "int", "col_span": "int", "row_span": "int", "is_header": "boolean", "nested": "boolean"}
    return records(opened, "cell", types).where("story = 'body' AND NOT nested").withColumn("col", F.col("grid_col"))


def markdown(opened: DataFrame) -> DataFrame:
    """doc_id, markdown. Simple grids are GFM tables, tables with merged cells HTML."""
    own = _block_text(opened, markdown_escape("text"), export.styled_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("strike"), F.col("url")))
    cells = _cells(opened)
    keys = ["doc_id", "path"]
    grids = export.markdown_table(cells.withColumn("text", markdown_escape("text")), keys).withColumnRenamed("text", "grid")
    merged = export.html_table(cells.withColumn("text", html_escape("text")), keys).withColumnRenamed("text", "merged")
    own = own.join(by_exchange(grids), keys, "left").join(by_exchange(merged), keys, "left")
    kind = F.when(F.col("heading_level").isNotNull(), "heading").when(F.col("list_level").isNotNull(), "list").otherwise(F.col("kind"))
    shown = F.when(F.col("kind") == "table", F.when(F.col("simple"), F.col("grid")).otherwise(F.col("merged"))).otherwise(F.col("text"))
    level = F.coalesce("heading_level", "list_level", F.lit(0))
    return export.markdown(own.select("doc_id", F.col("path").alias("ord"), kind.alias("kind"), level.alias("level"), F.coalesce("list_ordered", F.lit(False)).alias("ordered"), shown.alias("text")))


def html(opened: DataFrame) -> DataFrame:
    """doc_id, html. Hidden runs are left out."""
    styled = export.styled_html(F.col("text"), F.col("bold"), F.col("italic"), F.col("underline"), F.col("strike"), F.col("hidden"))
    own = _block_text(opened, html_escape("text"), styled)
    merged = export.html_table(_cells(opened).withColumn("text", html_escape("text")), ["doc_id", "path"]).withColumnRenamed("text", "merged")
    own = own.join(by_exchange(merged), ["doc_id", "path"], "left")
    kind = F.when(F.col("heading_level").isNotNull(), "heading").when(F.col("list_level").isNotNull(), "list").otherwise(F.col("kind"))
    shown = F.when(F.col("kind") == "table", F.col("merged")).otherwise(F.col("text"))
    return export.html(own.select("doc_id", F.col("path").alias("ord"), kind.alias("kind"), F.coalesce("heading_level", "list_level", F.lit(1)).alias("level"), F.coalesce("list_ordered", F.lit(False)).alias("ordered"), "align", shown.alias("text")))


def features(opened: DataFrame) -> DataFrame:
    """One row a document with its feature counts: a single aggregation over the records."""
    tag, name = F.col("tag"), F.col("name")
    mark = lambda *names: (tag == "mark") & name.isin(*names)
    of = lambda k, v: F.col("fields")[k] == v
    n = F.count_if
    got = opened.groupBy("doc_id").agg(
        n(tag == "comment").alias("comments"), n((tag == "note") & of("kind", "footnote")).alias("footnotes"), n((tag == "note") & of("kind", "endnote")).alias("endnotes"), n(tag == "text_box").alias("text_boxes"),
        n(mark("ins")).alias("tracked_insertions"), n(mark("del")).alias("tracked_deletions"), n(mark("moveFrom", "moveTo")).alias("tracked_moves"), n(mark("property_change")).alias("tracked_property_changes"),
        n(tag == "field").alias("fields"), (n(tag == "hyperlink") + n((tag == "field") & (name == "Hyperlink"))).alias("hyperlinks"),
        F.greatest(n(tag == "content_control"), n(mark("sdt"))).alias("content_controls"), n((tag == "block") & of("kind", "table") & of("nested", "true")).alias("nested_tables"),
        F.greatest(n(tag == "shape"), n((tag == "shape") & of("anchored", "true")) + n(mark("alternate_drawing"))).alias("floating_shapes"), n(tag == "chart").alias("charts"), n((tag == "chart") & of("kind", "unknown") | (tag == "chart") & of("kind", "malformed")).alias("unsupported_charts"),
        n(tag == "ole_object").alias("ole_objects"), n(tag == "metafile").alias("unsupported_metafiles"), n((tag == "field") & F.col("fields")["unsupported_reason"].isNotNull()).alias("unsupported_fields"),
        n(tag == "error").alias("errors"),
    )
    return got


def warnings_of(f: DataFrame) -> DataFrame:
    """features with warnings, names in their fixed order."""
    moved = F.col("tracked_insertions") + F.col("tracked_deletions") + F.col("tracked_moves")
    seen = f.withColumns({"tracked_changes": moved, "incomplete_revision_view": F.col("tracked_property_changes")})
    names = ["unsupported_fields", "tracked_changes", "incomplete_revision_view", "floating_shapes", "unsupported_charts", "ole_objects", "unsupported_metafiles"]
    return seen.withColumn("warnings", reports.warnings(names)).drop("tracked_changes", "incomplete_revision_view")


def report(opened: DataFrame) -> DataFrame:
    """doc_id, report: a JSON object a document with its format, statistics, properties, what stands against editing, feature
    counts and warnings with their counts, keys in a fixed order. Edited parts are none, as opened documents are as read."""
    stats = content.stats(blocks(opened).where("kind <> 'paragraph' OR trim(text) <> ''")).drop("figures")  # blank paragraphs don't count
    figures = opened.groupBy("doc_id").agg(F.count_if(F.col("tag") == "image").alias("figures"))
    props = opened.where("tag = 'prop'").groupBy("doc_id", F.col("fields")["group"].alias("g")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "text")))).alias("m"))
    core = props.where("g = 'core'").select("doc_id", F.col("m").alias("core"))
    custom = props.where("g = 'custom'").select("doc_id", F.col("m").alias("custom"))
    f = records(opened, "field", {"unsupported_reason": "string"})
    counted = lambda rows, key, out: reports.kinds_first_seen(rows, "doc_id", key, "ord").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", F.col(key).alias("k"), "n"))), lambda x: F.struct(x["k"].alias("kind" if key == "name" else "reason"), x["n"].alias("count"))).alias(out))
    kinds = counted(f, "name", "field_kinds")
    unsupported = counted(f.where("unsupported_reason IS NOT NULL"), "name", "unsupported_field_kinds")
    reasons = counted(f.where("unsupported_reason IS NOT NULL"), "unsupported_reason", "unsupported_field_reasons")
    meta = {"format": "string", "size": "long", "compressed": "boolean", "width": "long", "height": "long"}
    metafiles = records(opened, "metafile", meta).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(
        F.col("name").alias("path"), "format", F.col("size").alias("bytes"), "compressed", F.col("width").alias("width_px"), F.col("height").alias("height_px")).alias("m")))), lambda x: x["m"]).alias("metafiles"))
    formats = opened.where("tag = 'package'").groupBy("doc_id").agg(F.min("name").alias("format"))
    rows = features(opened)
    for more in (stats, figures, core, custom, kinds, unsupported, reasons, metafiles, formats):
        rows = rows.join(by_exchange(more), "doc_id", "left")
    snake = lambda c: "".join("_" + x.lower() if x.isupper() else x for x in c)
    keys = ("title", "subject", "creator", "description", "keywords", "category", "contentStatus", "lastModifiedBy", "created", "modified", "lastPrinted", "revision", "version")
    none = F.create_map().cast("map<string,string>")
    core_json = F.struct(*(F.try_element_at(F.coalesce("core", none), F.lit(k)).alias(snake(k)) for k in keys))
    empty = lambda c, k: F.coalesce(c, F.array().cast(f"array<struct<{k}:string,count:bigint>>"))
    plain = [c for c in ("comments", "footnotes", "endnotes", "text_boxes", "tracked_insertions", "tracked_deletions", "tracked_moves", "tracked_property_changes", "fields")]
    rest = [c for c in ("hyperlinks", "content_controls", "nested_tables", "floating_shapes", "charts", "unsupported_charts", "ole_objects", "unsupported_metafiles")]
    no_files = F.array().cast("array<struct<path:string,format:string,bytes:bigint,compressed:boolean,width_px:bigint,height_px:bigint>>")
    made = F.struct(*plain, empty("field_kinds", "kind").alias("field_kinds"), empty("unsupported_field_kinds", "kind").alias("unsupported_field_kinds"), empty("unsupported_field_reasons", "reason").alias("unsupported_field_reasons"), *rest, F.coalesce("metafiles", no_files).alias("metafiles"))
    numbers = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("paragraphs", "tables", "figures", "text_chars")))
    format_ = F.coalesce("format", F.lit("docx"))
    against = reports.edit_reasons(format_, F.col("errors") == 0, F.lit(False))
    edit = F.struct((F.size(against) == 0).alias("package_preserving"), against.alias("read_only_reasons"))
    head = export.json_report(format=format_, stats=numbers, core_properties=core_json, custom_properties=F.coalesce("custom", none), edit=edit, edited_parts=F.array().cast("array<string>"), features=made)
    said = F.array_join(reports.warning_details(empty("unsupported_field_kinds", "kind"), against), ",")
    return rows.select("doc_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"warnings":['), said, F.lit("]}")).alias("report"))


#: Answers by the name that the command line gives them.
ANSWERS = {"text": text, "md": markdown, "html": html, "diagnose": report}
