"""Operators on small tables worked by hand, and extensions that no table query shows."""

import time

import pytest

from pyspark.sql import functions as F

from foliograph.operators import content, counters, lookups, reports, tables
from foliograph.sources import packages
from foliograph.sources import writer as w
from foliograph.streaming import append_to, arrivals, watch_documents


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sequence_resets_and_current(spark):
    e = [(1, i, a, v) for i, (a, v) in enumerate([("c", None), ("n", None), ("n", None), ("r", 7), ("n", None), ("x", None), ("c", None), ("r", -1), ("n", None)])]
    df = spark.createDataFrame(e, "doc_id int, ord int, action string, value int")
    got = rows(counters.sequence_numbers(df).orderBy("ord"), "number")
    assert [n for n, in got] == [None, 1, 2, 7, 8, None, 8, 8, 9]


def test_level_counters_and_labels(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate((0, 1, 1, 0, 2, 1))], "doc_id int, ord int, level int")
    out = counters.list_labels(counters.level_counters(df, levels=3), ["upperRoman", "lowerLetter", "decimal"], ["%1.", "%1.%2)", "%3"]).orderBy("ord")
    assert rows(out, "label", "full_label") == [("I.", "I"), ("I.a)", "I.a"), ("I.b)", "I.b"), ("II.", "II"), ("1", None), ("II.a)", "II.a")]


def test_markers(spark):
    df = spark.createDataFrame([(1, 0, 0, True, None), (1, 1, 1, False, None), (1, 2, 0, True, None), (1, 3, 0, True, "x)")], "doc_id int, ord int, level int, ordered boolean, label string")
    assert [m for m, in rows(counters.list_markers(df).orderBy("ord"), "marker")] == ["1.", "◦", "2.", "x)"]


def test_section_pages(spark):
    kinds = [None, "page", "oddPage", "evenPage", "continuous", "evenPage", "oddPage"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "doc_id int, ord int, kind string")
    assert rows(counters.section_pages(df).orderBy("ord"), "page", "section") == [(1, 1), (2, 1), (3, 2), (4, 3), (4, 4), (6, 5), (7, 6)]


def test_vertical_merges(spark):
    cells = [(1, r, c, m) for r, row in enumerate([("restart", "continue"), ("continue", "continue"), (None, "continue"), ("continue", None)]) for c, m in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id int, row int, grid_col int, vmerge string")
    assert sorted(rows(tables.row_spans(df), "grid_col", "row", "row_span")) == [(0, 0, 2), (0, 2, 1), (0, 3, 1), (1, 0, 3), (1, 3, 1)]
    assert (1, 0, 1) in rows(tables.row_spans(df, promote=False), "grid_col", "row", "row_span")


def test_directions_are_poisoned_by_bad_cells(spark):
    df = spark.createDataFrame([(1, r, 0, v) for r, v in enumerate((1.0, 2.0, None, 4.0))], "doc_id int, row int, col int, value double")
    total = lambda side: [x for x, in rows(tables.directional(df, "SUM", side).orderBy("row"), "result")]
    assert total("ABOVE") == [None, 1.0, 3.0, None] and total("BELOW") == [None, None, 4.0, None] and total("C") == [None, None, 7.0, None]
    product = [x for x, in rows(tables.directional(df.where("row < 2"), "PRODUCT", "C").orderBy("row"), "result")]
    assert product == [2.0, 1.0]


def test_declared_nulls_hide_what_lies_above(spark):
    s = spark.createDataFrame([("a", None, True, 1.0), ("b", "a", True, None), ("c", "b", False, None), ("d", "a", False, None), ("x", "y", False, None), ("y", "x", False, None)], "style_id string, based_on string, declared boolean, value double")
    assert sorted(rows(content.inherit_styles(s), "style_id", "value", "depth")) == [("a", 1.0, 0), ("b", None, 0), ("c", None, 1), ("d", 1.0, 1), ("x", None, None), ("y", None, None)]


def test_threads_and_parents(spark):
    c = spark.createDataFrame([(1, "0", None, "p0"), (1, "1", None, "p1"), (1, "2", "1", "p2")], "doc_id int, id string, parent_id string, para_id string")
    x = spark.createDataFrame([(1, "p1", "p0", True)], "doc_id int, para_id string, para_id_parent string, done boolean")
    got = lookups.comment_parents(c, x)
    assert sorted(rows(got, "id", "parent_id", "resolved"), key=str) == [("0", None, None), ("1", "0", True), ("2", "1", None)]
    assert sorted(rows(lookups.threads(got), "id", "root", "depth")) == [("0", "0", 0), ("1", "0", 1), ("2", "0", 2)]


def test_anchors_links_and_regions(spark):
    notes, blocks = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id int, note string"), spark.createDataFrame([(1, "a", "one"), (1, "b", "x"), (1, "b", "y")], "doc_id int, note string, text string")
    assert sorted(rows(lookups.anchors(notes, blocks, ["doc_id", "note"]), "note", "anchor")) == [("a", "one"), ("b", None)]
    runs = spark.createDataFrame([("d", "p", "r1", None), ("d", "p", "r1", "s"), ("d", "p", None, "s"), ("d", "p", "gone", None)], "doc_id string, part string, rid string, anchor string")
    rels = spark.createDataFrame([("d", "p", "r1", "http://x")], "doc_id string, source_part string, rid string, target string")
    assert set(rows(lookups.hyperlinks(runs, rels), "url")) == {("#s",), ("http://x",), ("http://x#s",), (None,)}
    regions = spark.createDataFrame([(1, 0, "main", 0, 3)], "doc_id int, ord int, kind string, block_start int, block_end int")
    b = spark.createDataFrame([(1, 0, "paragraph", "a"), (1, 1, "break", None), (1, 2, "paragraph", "b"), (1, 3, "paragraph", "c")], "doc_id int, ord int, kind string, text string")
    assert rows(content.region_text(regions, b), "text") == [("a\nb",)]


def test_contents_selection(spark):
    e = spark.createDataFrame([(1, 0, "heading", 1, "Heading 1", None, "A"), (1, 1, "outline", 2, "Body", None, "B"), (1, 2, "heading", 5, "Heading 5", None, "C"), (1, 3, "tc", 2, None, "F", "D"), (1, 4, "seq", None, None, "Figure", "E"), (1, 5, "text", None, "My Style", None, "G")],
                              "doc_id int, ord int, source string, level int, style string, type string, text string")
    pick = lambda **k: rows(content.toc_text(content.toc_entries(e, **k)), "toc")[0][0]
    assert pick() == "A" and pick(outline=True) == "A\n  B" and pick(tc="f") == "A\n  D" and pick(sequence="FIGURE") == "A\nE" and pick(custom={"my style": 2}) == "A\n  G"


def test_tab_stops_and_breaks(spark):
    df = spark.createDataFrame([([(10, "left"), (20, "left"), (10, "clear"), (20, "right"), (5, "left")],)], "c array<struct<pos:int,align:string>>")
    assert [(t.pos, t.align) for t in df.select(content.tab_stops(F.col("c")).alias("t")).first().t] == [(5, "left"), (20, "right")]
    p = spark.createDataFrame([(1, "a\fb\f")], "doc_id int, text string")
    assert sorted(rows(content.split_breaks(p), "part", "kind", "text")) == [(0, "paragraph", "a"), (1, "break", ""), (2, "paragraph", "b"), (3, "break", "")]


def test_reasons_gates_and_reports(spark):
    df = spark.createDataFrame([("Ref", None, True, False), ("Page", "1", True, None), ("Unknown", None, True, None), ("Seq", None, False, None), ("Toc", None, True, None)], "k string, v string, ok boolean, t boolean")
    assert [x for x, in df.select(reports.unsupported_reason(F.col("k"), F.col("v"), F.col("ok"), F.col("t"))).collect()] == ["UnresolvedBookmark", None, "UnknownField", "UnsupportedSwitch", "NoComputedResult"]
    s = spark.createDataFrame([(0.9, None)], "a double, b double")
    assert sorted(rows(reports.gates(s, {"a": 0.8, "b": 0.1}), "gate", "passed")) == [("a", True), ("b", False)]
    empty = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), (["a", "b", "a"], ["a"])], "r array<string>, c array<string>")
    assert [tuple(round(x, 3) for x in r[0]) for r in empty.select(reports.prf(F.col("r"), F.col("c"))).collect()] == [(1, 1, 1), (0, 0, 0), (1, 0, 0), (0.5, 1, 0.667)]
    assert [round(x, 3) for x, in empty.select(reports.list_recall(F.col("r"), F.col("c"))).collect()] == [1, 0, 1, 0.667]


def test_documents_stream_in(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(w.Builder().text("streamed").save())
    (folder / "b.docx").write_bytes(b"PK\x03\x04bad")
    q = append_to(watch_documents(spark, str(folder), wanted=["block", "error"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {(r.tag, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("block", "streamed") in got and any(t == "error" for t, _ in got)


def test_windows_over_late_events(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    path = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(path))
    stream = spark.readStream.schema(schema).parquet(str(path)).withColumn("at", F.col("ts").cast("timestamp"))
    q = arrivals(stream, "at", "event_type", "1 day").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM arrived").first()[0] == spark.read.parquet(str(path)).count()
    assert time.time() > 0


def test_dangling_relationships(spark):
    from foliograph.operators.edits import dangling

    p = w.Builder().text("x").package()
    files = spark.createDataFrame([("d", p.save())], "path string, content binary")
    opened = packages.open_documents(files)
    rels = packages.records(opened, "rel", {"resolved": "string", "external": "boolean"})
    assert dangling(rels, packages.records(opened, "part")).count() == 0
    assert dangling(rels, packages.records(opened, "part").where("name <> 'word/styles.xml'")).count() == 1


def test_deep_threads_cycles_and_many_comments(spark):
    import pyspark.sql.functions as F

    deep = [(1, i, i - 1 if i else None) for i in range(300)] + [(2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 5, 9)]
    got = {tuple(r) for r in lookups.threads(spark.createDataFrame(deep, "doc_id int, id int, parent_id int")).collect()}
    assert got == {(1, i, 0, i) for i in range(300)} | {(3, 5, 5, 0)}
    many = spark.range(1_200_000).select((F.col("id") % 1000).alias("doc_id"), F.col("id"), F.when(F.col("id") >= 1000, F.col("id") - 1000).alias("parent_id"))
    r = lookups.threads(many).agg(F.count("*"), F.max("depth"), F.count_if(F.col("root") == F.col("doc_id"))).first()
    assert tuple(r) == (1_200_000, 1199, 1_200_000)


def test_styles_by_the_million_and_several_properties(spark):
    import pyspark.sql.functions as F

    s = spark.range(1_100_000).select(F.col("id").alias("style_id"), F.when(F.col("id") % 50 > 0, F.col("id") - 1).alias("based_on"), (F.col("id") % 50 == 0).alias("declared"), (F.col("id") * 1.0).alias("value"))
    r = content.inherit_styles(s).agg(F.count("*"), F.max("depth"), F.count("depth"), F.count_if(F.col("value") == F.col("style_id") - F.col("style_id") % 50)).first()
    assert tuple(r) == (1_100_000, 32, 22_000 * 33, 22_000 * 33)  # 32 links at most
    two = spark.createDataFrame([(1, "a", None, "x", True, None, True), (1, "b", "a", None, False, 2, True), (1, "c", "b", None, False, None, False), (2, "c", "a", None, False, None, False)],
        "doc_id int, style_id string, based_on string, font string, font_declared boolean, size int, size_declared boolean")
    got = {(r.doc_id, r.style_id): (r.font, r.font_depth, r.size, r.size_depth) for r in content.inherit_styles(two, doc="doc_id", columns=["font", "size"]).collect()}
    assert got == {(1, "a"): ("x", 0, None, 0), (1, "b"): ("x", 1, 2, 0), (1, "c"): ("x", 2, 2, 1), (2, "c"): (None, None, None, None)}


def test_sums_around_a_cell_keep_small_numbers(spark):
    df = spark.createDataFrame([(1, r, 0, v) for r, v in enumerate((1e17, 0.1, 0.2))], "doc_id int, row int, col int, value double")
    got = {f: [x for x, in rows(tables.directional(df, f, "C").orderBy("row"), "result")] for f in ("SUM", "AVERAGE", "COUNT")}
    assert got["SUM"][0] == pytest.approx(0.3) and got["AVERAGE"][0] == pytest.approx(0.15) and got["COUNT"] == [2.0, 2.0, 2.0]


def test_spans_make_formulas_unsafe_in_rows_they_read(spark):
    cells = spark.createDataFrame([(1, r, c, r == 2 and c == 1) for r in range(1, 6) for c in (1, 2)], "doc_id int, row int, col int, has_span boolean")
    refs = [(1, 1, 3, None, None, None, None), (1, 2, 3, None, None, None, None), (1, 1, 3, 3, 1, 5, 2), (1, 1, 3, 5, 2, 1, 1), (1, 4, 3, 3, 1, 3, 1), (1, 4, 3, 2, 2, 2, 2), (1, 1, 3, 3, 1, 9, 1)]
    f = spark.createDataFrame(refs, "doc_id int, row int, col int, r1 int, c1 int, r2 int, c2 int")
    got = {tuple(r)[1:7]: r.safe for r in tables.spans_touched(f, cells).collect()}
    assert [got[x[1:]] for x in refs] == [True, False, True, False, True, False, False]


def test_repeats_of_korean_marks_are_bounded():
    from foliograph.functions import numbers

    assert numbers.cycled(15, numbers.GANADA) == "가가" and len(numbers.cycled(5_000_000, numbers.GANADA)) == 1024


def test_list_recall_of_long_lists(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(["a"] * 3 + [f"w{i}" for i in range(60_000)], ["a", "zz"] + [f"w{i}" for i in range(0, 60_000, 2)])], "r array<string>, c array<string>")
    assert df.select(reports.list_recall(F.col("r"), F.col("c"))).first()[0] == pytest.approx(30_003 / 60_003)


def test_sharing_pairs_meet_by_five_tokens_in_a_row(spark):
    c = spark.createDataFrame([(1, list("abcdefg")), (2, list("abcdxefg")), (3, list("abcdeabcde")), (4, list("abcd")), (5, None), (6, []), (1, list("abcdefg"))], "k long, c array<string>")
    r = spark.createDataFrame([(10, list("bcdef")), (11, list("abcde")), (12, list("abcd")), (13, None)], "o long, r array<string>")
    assert sorted(rows(reports.sharing(c, r, "k", "o", "c", "r"), "k", "o")) == [(1, 10), (1, 11), (3, 11)]
    assert rows(reports.sharing(c.limit(0), r, "k", "o", "c", "r"), "k", "o") == []


def test_gates_of_each_group(spark):
    s = spark.createDataFrame([(1, 0.5), (0, 0.9), (None, None)], "q int, a double")
    assert sorted(rows(reports.gates(s, {"a": 0.8}, ["q"]), "q", "passed"), key=str) == [(0, True), (1, False), (None, False)]
