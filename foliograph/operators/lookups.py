"""Cross-references as joins and windows: bookmarks, pages, notes, styles, comments, properties, merge data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import property_key, relative_number
from ..kept import drop, written


def bookmark_text(runs: DataFrame, bookmarks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, name, text: the runs with start <= ord <= end of each bookmark, in order; a paragraph's end is a line feed
    between texts that aren't empty.

    runs: doc, ord, text, para. An interval join inside the document's equality key: bookmarks may overlap. The pairs
    are as many as runs lie in bookmarks, which is the size of the result's text.
    """
    b = bookmarks.select(F.col(doc).alias("__d"), "name", "start", "end")
    inside = runs.join(b, (F.col(doc) == F.col("__d")) & F.col("ord").between(F.col("start"), F.col("end")))
    paras = inside.groupBy(doc, "name", "para").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("t"))
    lines = paras.where("t <> ''").groupBy(doc, "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return bookmarks.select(doc, "name").distinct().join(lines, [doc, "name"], "left").select(doc, "name", F.coalesce("text", F.lit("")).alias("text"))


def ref_lookup(fields: DataFrame, bookmarks: DataFrame, local: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """fields (doc, ord, name) with text, start, end of the bookmark, position (above, below; null inside) and unresolved.

    A value that SET or ASK gave the name before the field (local: doc, ord, name, value) comes first; later ones don't
    count. Names are compared as they are.
    """
    out = fields.join(bookmarks.select(doc, "name", F.col("text").alias("__text"), "start", "end"), [doc, "name"], "left")
    if local is not None:
        out = last_assignment(out, local, doc).withColumn("__text", F.coalesce("assigned", "__text")).drop("assigned")
    where = F.when(F.col("ord") > F.col("end"), "above").when(F.col("ord") < F.col("start"), "below")
    return out.withColumn("position", where).withColumn("unresolved", F.col("__text").isNull()).withColumnRenamed("__text", "text")


def last_assignment(fields: DataFrame, assigned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """fields with assigned, the value given to their name most recently before them: an as-of window over both event kinds."""
    extra = [c for c in fields.columns if c not in (doc, "ord", "name")]
    f = fields.select(doc, "name", "ord", F.struct(*extra).alias("__row") if extra else F.struct(F.lit(1).alias("x")).alias("__row"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("__kind"))
    a = assigned.select(doc, "name", "ord", F.lit(None).cast(f.schema["__row"].dataType).alias("__row"), F.col("value").cast("string").alias("value"), F.lit(0).alias("__kind"))
    w = Window.partitionBy(doc, "name").orderBy("ord", F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = f.unionByName(a).withColumn("assigned", F.last("value", ignorenulls=True).over(w)).where("__kind = 1")
    return out.select(doc, "name", "ord", *([f"__row.{c}" for c in extra]), "assigned")


def ref_relative(pairs: DataFrame, target: str = "target", field: str = "field") -> DataFrame:
    return pairs.withColumn("relative", relative_number(target, field))


def page_ref(fields: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """PAGEREF: fields (doc, ord, name, page) with result, the target's page, and relative, "above" or "below" on the same
    page and "on page N" elsewhere; null for unknown names and pages that aren't known."""
    t = targets.select(doc, "name", F.col("ord").alias("__at"), F.col("page").alias("__page"))
    out = fields.join(t, [doc, "name"], "left")
    same = F.when(F.col("__page") != F.col("page"), F.concat(F.lit("on page "), F.col("__page").cast("string")))
    relative = same.when(F.col("__at") < F.col("ord"), "above").when(F.col("__at") > F.col("ord"), "below")
    return out.withColumn("result", F.col("__page").cast("string")).withColumn("relative", F.when(F.col("__page").isNotNull(), relative)).drop("__at", "__page")


def note_ref(fields: DataFrame, notes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """NOTEREF: the number of the note that the bookmark marks; null for a note with a mark of its own, and for no note."""
    n = notes.select(doc, "name", F.when(~F.col("custom"), F.col("number")).alias("result"))
    return fields.join(n, [doc, "name"], "left")


def note_marks(events: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Numbers of the marks that REF \\f makes: real markers of the kind before it, plus such marks before it, plus one.
    events: doc, ord, kind, generated."""
    w = Window.partitionBy(doc, "kind").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("number", F.when(F.col("generated"), F.count(F.lit(1)).over(w) + 1))


def style_ref(rows: DataFrame, matches: Column, text: str = "text", doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """STYLEREF from every row: the text of the nearest row before that matches, else of the nearest after: two frames of
    one window, so an as-of join in both directions without joining."""
    back = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(doc).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    hit = F.when(matches, F.col(text))
    return rows.withColumn("styleref", F.coalesce(F.last(hit, ignorenulls=True).over(back), F.first(hit, ignorenulls=True).over(on)))


def inherited(rows: DataFrame, value: Column, name: str, doc: list[str] | str = "doc_id", order: str = "ord") -> DataFrame:
    """An omitted header or footer is the last one given: last value that isn't null up to the row."""
    keys = [doc] if isinstance(doc, str) else doc
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def header_footer_kind(part: Column, kind: Column) -> Column:
    """header or footer x first, even or default (any other type) as one word."""
    which = F.when(kind.isin("first", "even"), kind).otherwise("default")
    return F.concat(which, F.when(part == "footer", "Footer").otherwise("Header"))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows without later duplicates of their keys; the first by order stays. Keys with null are equal, too."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def threads(comments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, id, root, depth: comments followed to the top of their thread, however deep. Answers of a missing parent are
    roots, a repeated id counts once, and a cycle reaches no root and is left out.

    Pointers jump: each round a comment takes over where its ancestor points to, so the way known doubles. Tops are done,
    and the rounds end when none gets done: as long as a thread is open, some comment of it gets done.
    """
    c = comments.groupBy(doc, "id").agg(F.min("parent_id").alias("parent_id"))
    known = c.select(F.col(doc).alias("__d"), F.col("id").alias("__p"))
    c = c.join(known, (F.col(doc) == F.col("__d")) & (F.col("parent_id") == F.col("__p")), "left")
    old: list[str] = []
    # up: the ancestor `depth` links above, a top if it is done
    state = written(c.select(doc, "id", F.coalesce("__p", "id").alias("up"), F.when(F.col("__p").isNull(), 0).otherwise(1).alias("depth"), F.col("__p").isNull().alias("done")), old)
    left = state.where("NOT done").count()
    while left:
        above = state.select(F.col(doc).alias("__d"), F.col("id").alias("__i"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        moved = state.where("NOT done").join(above, (F.col(doc) == F.col("__d")) & (F.col("up") == F.col("__i")))
        moved = moved.select(doc, "id", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).cast("int").alias("depth"), F.col("__done").alias("done"))
        fresh: list[str] = []
        state = written(state.where("done").unionByName(moved), fresh)
        drop(comments.sparkSession, old)
        old, before = fresh, left
        left = state.where("NOT done").count()
        if left == before:  # cycles
            break
    return state.where("done").select(doc, "id", F.col("up").alias("root"), "depth")


def comment_parents(comments: DataFrame, extended: DataFrame, doc: str = "doc_id") -> DataFrame:
    """comments with parent_id: their own, or else the comment that the parent paragraph of their last paragraph ends."""
    x = extended.select(doc, F.col("para_id"), "para_id_parent", "done")
    ends = comments.select(doc, F.col("id").alias("__parent"), F.col("para_id").alias("para_id_parent"))
    out = comments.join(x, [doc, "para_id"], "left").join(ends, [doc, "para_id_parent"], "left")
    return out.withColumn("parent_id", F.coalesce("parent_id", "__parent")).withColumnRenamed("done", "resolved").drop("__parent", "para_id_parent")


def anchors(records: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Records with anchor, the text of the block that refers to them; ambiguous references have none."""
    w = Window.partitionBy(*on)
    one = blocks.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n = 1").select(*on, F.col("text").alias("anchor"))
    return records.join(one, on, "left")


def hyperlinks(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """runs (doc_id, part, rid, anchor) with url: the relationship's target, "#" and the anchor, or both."""
    r = rels.select("doc_id", F.col("source_part").alias("part"), "rid", F.col("target").alias("__t"))
    fragment = F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), "anchor")).otherwise("")
    url = F.concat(F.coalesce("__t", F.lit("")), fragment)
    return runs.join(r, ["doc_id", "part", "rid"], "left").withColumn("url", F.when(url != "", url)).drop("__t")


def property_lookup(fields: DataFrame, props: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Fields (doc, name) with value, the property whose key is the same but for case, spaces, "_" and "-"; the first by
    name of several."""
    key = props.withColumn("__k", property_key("name"))
    one = first_of_each(key, [doc, "__k"], "name").select(doc, "__k", "value")
    return fields.withColumn("__k", property_key("name")).join(one, [doc, "__k"], "left").drop("__k")


def merge_fields(template: DataFrame, rows: DataFrame, name: str = "name", before: str = "before", after: str = "after") -> DataFrame:
    """Every template row x the value of its field in each merge record; text before and after only with a value.

    template: ord, name, before, after, literal; it is one document's, counted and broadcast. rows: record, values (map).
    """
    out = rows.crossJoin(F.broadcast(template)) if template.limit(10_001).count() <= 10_000 else rows.crossJoin(template)
    v = F.coalesce(F.try_element_at("values", F.col(name)), F.lit(""))
    around = F.concat(F.coalesce(before, F.lit("")), v, F.coalesce(after, F.lit("")))
    return out.withColumn("text", F.coalesce("literal", F.when(v != "", around).otherwise("")))
