"""Opening, evaluating, editing and writing packages built in memory."""

import io
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.operators import content, edits, reports
from foliograph.sources import binary, packages
from foliograph.sources import writer as w
from foliograph.sources.wml import open_docx


def of(rows, tag):
    return [r for r in rows if r["tag"] == tag]


def values(rows, tag, key):
    return [r["fields"].get(key) for r in of(rows, tag)]


def zipped(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return held.getvalue()


def png(width=3, height=2):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def small(xml, **parts):
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="{w.W}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{xml}</w:body></w:document>'} | parts)


def test_text_marks_and_breaks():
    rows = open_docx(w.Builder().text("a\tb\nc­d").add(w.paragraph(w.run("x\fy"))).page_break().save())
    blocks = [(r["fields"]["kind"], r["text"]) for r in of(rows, "block")]
    assert blocks == [("paragraph", "a\tb\nc­d"), ("paragraph", "x"), ("break", None), ("paragraph", "y"), ("break", None)]
    assert values(rows, "block", "page")[0] == "1"


def test_lists_restart_and_format():
    b = w.Builder()
    n = b.list([("decimal", "%1.", 1), ("lowerLetter", "%1.%2)", 3), ("lowerRoman", "%3", 1)])
    for level in (0, 1, 1, 0, 1, 2):
        b.item("x", n, level)
    assert values(open_docx(b.save()), "block", "list_label") == ["1.", "1.c)", "1.d)", "2.", "2.c)", "i"]


def test_style_inheritance_and_headings():
    b = w.Builder().style("Base", props="<w:b/><w:color w:val='FF0000'/>").style("Leaf", based_on="Base", props="<w:b w:val='0'/>").style("A", based_on="B").style("B", based_on="A").style("Sub", "heading 2")
    b.text("one", style="Leaf").text("two", style="A").text("three", style="Sub")
    rows = open_docx(b.save())
    assert values(rows, "run", "bold")[0] == "false" and values(rows, "run", "color")[0] == "FF0000"
    assert values(rows, "block", "heading_level") == [None, None, "2"]


def test_tables_merge_and_nest():
    inner = w.table([["in"]])
    b = w.Builder().add(w.table([[w.cell(w.paragraph(w.run("a")), merge="restart"), w.cell(w.paragraph(w.run("b")), span=2)], [w.cell("", merge="continue"), "c", w.cell(w.paragraph(w.run("d")) + inner)]], header_rows=1))
    rows = open_docx(b.save())
    outer = [r for r in of(rows, "cell") if r["fields"]["nested"] == "false"]
    assert [(r["text"], r["fields"]["grid_col"], r["fields"]["row_span"]) for r in outer] == [("a", "0", "2"), ("b", "1", "1"), ("c", "1", "1"), ("d in", "2", "1")]
    table = [r for r in of(rows, "block") if r["fields"]["kind"] == "table"]
    assert [t["fields"]["nested"] for t in table] == ["true", "false"] and table[1]["fields"]["header_rows"] == "1"


def test_references_and_notes():
    b = w.Builder()
    b.add(w.paragraph(w.simple_field("REF late", "?") + w.simple_field("PAGEREF late \\p", "?") + b.note("first") + b.note("own", custom="*") + b.bookmark("n2", b.note("second")))).page_break()
    b.add(w.paragraph(b.bookmark("late", w.run("1,234.5")) + w.simple_field("NOTEREF n2", "?") + w.simple_field('REF late \\# "#,##0.00"', "?") + w.simple_field("REF late \\* CardText", "?") + w.simple_field("REF nope", "?") + w.simple_field("PAGE", "?")))
    b.heading("Head one").add(w.paragraph(w.simple_field('STYLEREF "heading 1"', "?") + w.simple_field("SECTION", "?")))
    rows = open_docx(b.save())
    assert values(rows, "field", "computed_result") == ["1,234.5", "on page 2", "2", "1,234.50", "one thousand two hundred thirty-five", None, "2", "Head one", "1"]
    assert values(rows, "field", "unsupported_reason")[5] == "UnresolvedBookmark"
    assert [(r["text"], r["fields"]["kind"]) for r in of(rows, "note")] == [("first", "footnote"), ("own", "footnote"), ("second", "footnote")]


def test_sequences_and_assignments():
    f = lambda *x: w.Builder().add(w.paragraph("".join(w.simple_field(i, "?") for i in x)))
    got = lambda *x: values(open_docx(f(*x).save()), "field", "computed_result")
    assert got("SEQ a", "SEQ a", "SEQ b", "SEQ a \\c", "SEQ a \\r 7", "SEQ a", "SEQ a \\h", "SEQ c \\c") == ["1", "2", "1", "2", "7", "8", "", None]
    assert got("SET x 5", "REF x", '= x * 2 \\# "0.0"', "SET x 7", "IF x > 6 big small", "COMPARE x = 7") == ["", "5", "10.0", "", "big", "1"]
    assert got('QUOTE "two words" \\* Caps', 'FILLIN "p" \\d dflt', "AUTONUM", "AUTONUMLGL", "LISTNUM", "NEXT", "PRINT x", "SYMBOL 97 \\f Symbol", "EQ \\f(1,2)", "TC head") == ["Two Words", "dflt", "1", "2", "1", "", "", "α", "1/2", ""]


@pytest.mark.parametrize(("instruction", "want"), [
    ('IF "A=B"="A=B" "yes" "no"', "yes"), ('COMPARE "A>B"<>"A?B"', "0"), ('COMPARE "A*" = "AB"', "1"), ('IF 1 = 1 "ship" "hold" \\* Upper', "SHIP"), ('IF 1 = 1 "ship" \\*Lower', "ship"), ('COMPARE CustomerTier = "Gold"', None),
    ("IF 1 = 1 yes no", "yes"), ('IF 1 = 1 "yes no', None), ('IF 1 = 0 yes "no', None), ('QUOTE "literal text"', "literal text"), ("QUOTE plain words", "plain words"), ('QUOTE "literal text', None), ('QUOTE literal text"', None),
    ('= 10 / 4 \\# "0.00" \\* MERGEFORMAT', "2.50"), ('= 10 / 4 \\#"0.0" \\*CHARFORMAT', "2.5"), ('= 5 \\# "0 units" \\* Upper', "5 UNITS"), ("= 10.25 \\* DollarText", "ten and 25/100"), ("= 31 \\* Hex", "1F"),
    ("= 21 \\* OrdText", "twenty-first"), ("= 10.25 \\* Hex", None), ("COMPARE 1e309 > 0", None), ("EQ \\f(a,b) \\* Upper", "A/B"),
])
def test_contextless_fields(instruction, want):
    rows = open_docx(w.Builder().add(w.paragraph(w.simple_field(instruction, "cached"))).save())
    assert values(rows, "field", "computed_result") == [want]


def test_field_reasons():
    b = w.Builder().add(w.paragraph("".join(w.simple_field(i, "c") for i in ("CUSTOM v", "PAGE \\q", "REF gone", "FILENAME \\p", 'HYPERLINK "http://x"', "MERGEFIELD A", "INDEX"))))
    assert values(open_docx(b.save()), "field", "unsupported_reason") == ["UnknownField", "UnsupportedSwitch", "UnresolvedBookmark", None, None, "NoComputedResult", "NoComputedResult"]


def test_merge_context_and_properties():
    b = w.Builder(core={"title": "T", "created": "2024-03-05T06:07:08Z"}, custom={"Client Name": "ACME"})
    b.add(w.paragraph("".join(w.simple_field(i, "?") for i in ('MERGEFIELD Who \\b "Dear "', "TITLE \\* Upper", 'DOCPROPERTY "client_name"', 'CREATEDATE \\@ "d.M.yyyy"', 'DATE \\@ "yyyy"', "USERNAME"))))
    context = {"merge_values": {"Who": "Ann"}, "now": "2025-01-02T00:00:00", "user_name": "U"}
    assert values(open_docx(b.save(), None, context), "field", "computed_result") == ["Dear Ann", "T", "ACME", "5.3.2024", "2025", "U"]


def test_contents_and_nested_complex_field():
    b = w.Builder().heading("A").heading("B", 2).heading("D", 4).add(w.paragraph(w.simple_field('TOC \\o "1-3"', "?") + w.simple_field('TOC \\o "2-4"', "?") + w.simple_field("TOC \\b gone", "?")))
    assert values(open_docx(b.save()), "field", "computed_result") == ["A\n  B", "B\n    D", None]
    char = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    nested = char("begin") + "<w:r><w:instrText>IF 1 = 1 a b</w:instrText></w:r>" + char("separate") + w.run("x") + w.complex_field("PAGE", "9") + w.run("y") + char("end")
    rows = open_docx(w.Builder().add(w.paragraph(nested)).save())
    assert [(r["name"], r["fields"]["cached_result"]) for r in of(rows, "field")] == [("Dynamic", "x9y"), ("Page", "9")]


def test_table_formulas():
    cell = lambda i: w.cell(w.paragraph(w.simple_field(i, "?")))
    b = w.Builder().add(w.table([["1", "2", cell("=SUM(LEFT)")], ["x", "4", cell("=SUM(LEFT)")], [cell("=SUM(ABOVE)"), cell("=SUM(ABOVE)"), cell("=A1+B2*2")], [cell("=SUM(A1:B1)"), cell("=SUM(A9:B9)"), cell("=MAX(C1)")]]))
    assert values(open_docx(b.save()), "field", "computed_result") == ["3", None, None, "6", "9", "3", None, None]


def test_comments_threads_and_revisions():
    b = w.Builder()
    b.add(w.paragraph(b.comment(w.run("anchored "), "first", "Al", "2024-01-01T00:00:00Z") + b.comment(w.run("more"), "second", "Bo", parent=0)))
    b.add(w.paragraph(w.run("keep") + b.revision("ins", "new", 1, "Al") + b.revision("del", "old", 2) + b.revision("moveFrom", "away", 3) + b.revision("moveTo", "here", 4)))
    rows = open_docx(b.save())
    assert [(r["text"], r["fields"].get("anchor"), r["fields"].get("parent_id")) for r in of(rows, "comment")] == [("first", "anchored ", None), ("second", "more", "0")]
    assert [(r["fields"]["kind"], r["text"]) for r in of(rows, "revision")] == [("ins", "new"), ("del", "old"), ("moveFrom", "away"), ("moveTo", "here")]
    assert of(rows, "block")[1]["text"] == "keepnewhere"


def test_one_branch_of_alternate_content():
    text = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = open_docx(small(f'<mc:AlternateContent><mc:Choice>{text("one")}</mc:Choice><mc:Fallback>{text("two")}</mc:Fallback></mc:AlternateContent>'))
    assert [r["text"] for r in of(rows, "block")] == ["one"]


def test_sections_headers_images_and_charts():
    b = w.Builder()
    head, foot = b.story("header", "top"), b.story("footer", "end")
    b.add(w.paragraph(b.image("a.png", png()) + b.image("b.png", png(), anchor=True) + b.chart("barChart", {"s": {"x": 1.5, "y": -2}}), section=w.section(references=head + foot)))
    b.last_section = w.section(columns=2, start=5)
    rows = open_docx(b.text("second").save())
    assert values(rows, "section", "columns") == [None, "2"] and [r["name"] for r in of(rows, "section_part")] == ["word/footer1.xml", "word/header1.xml"] * 2
    assert [(r["fields"]["width"], r["fields"]["height"]) for r in of(rows, "image")] == [("3", "2")] * 2 and len(of(rows, "shape")) == 1
    assert [(r["fields"]["category"], r["text"]) for r in of(rows, "chart_point")] == [("x", "1.5"), ("y", "-2")]
    assert values(rows, "block", "section")[:2] == ["1", "2"]


BAD = {
    "empty": b"", "text": b"hello", "cut": w.Builder().text("x").save()[:200], "no_document": zipped({"a.xml": "<a/>"}), "bad_xml": small("<w:p>"), "doctype": zipped({"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}),
    "deep": zipped({"word/document.xml": "<a>" * 400 + "</a>" * 400}), "entries": b"PK\x03\x04" + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0, 0, 0),
    "ole": packages.OLE_MAGIC + bytes(600), "open_field": None,
}


def test_bad_files_are_error_rows(spark):
    open_field = w.Builder().add(w.paragraph('<w:r><w:fldChar w:fldCharType="begin"/></w:r>' + w.run("t"))).save()
    files = spark.createDataFrame([(k, open_field if k == "open_field" else v) for k, v in BAD.items()] + [("null", None)], "path string, content binary")
    rows = packages.open_documents(files, ["error", "block"]).collect()
    errors = {r.doc_id: r.name for r in rows if r.tag == "error"}
    assert set(errors) == set(BAD) - {"open_field"} | {"null"}
    assert errors["text"] == "NotOle2" and errors["no_document"] == "Docx" and errors["ole"] == "Cfb"


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 200))
def test_damaged_packages_only_refuse(noise, at):
    whole = w.Builder().text("hello").save()
    for data in (whole[:at] + noise + whole[at:], packages.OLE_MAGIC + noise):
        try:
            open_docx(data) if data[:4] == packages.ZIP_MAGIC else binary.open_doc(data)
        except packages.Refused:
            pass


def test_documents_as_tables(spark, tmp_path):
    b = w.Builder()
    (tmp_path / "a.docx").write_bytes(b.heading("T").text("body  ").add(w.paragraph(w.simple_field("PAGE", "1") + b.revision("ins", "i"))).save())
    (tmp_path / "b.txt").write_text("no document")
    files = packages.read_files(spark, str(tmp_path))
    assert {r.format for r in files.collect()} == {"docx", None}
    opened = packages.open_documents(files.where("format is not null")).cache()
    blocks = packages.records(opened, "block", {"kind": "string", "heading_level": "int"})
    assert content.stats(blocks).select("paragraphs", "text_chars").first()[:] == (3, 9)
    assert content.flatten(blocks).first().text == "T\nbody  \n1i\n"
    marks = packages.records(opened, "mark")
    found = reports.inventory(marks, {"tracked_insertions": F.col("name") == "ins", "fields": F.col("name") == "fldSimple"}).first()
    assert (found.tracked_insertions, found.fields) == (1, 1)


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# path\tcomments\twarnings\na\t1\t-\nb\t-2\t-\na\t3\t-\nc\t1\n")
    got = {(r.path, r.comments): r.problem for r in packages.read_manifest(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {("a", 1): "duplicate", ("b", -2): "count", ("a", 3): "duplicate", ("c", 1): "columns"}


def edited(data, op, **args):
    s = edits.EditSession(data)
    s.apply(op, **args)
    return s.commit()


def texts(data):
    return [r["text"] for r in of(open_docx(data), "block") if r["fields"]["kind"] == "paragraph"]


def test_edits_touch_only_their_parts():
    b = w.Builder(core={"title": "T"})
    data = b.text("Hello big world").add(w.paragraph(w.run("Hel", bold=True) + w.run("lo you"))).add(w.paragraph(b.image("a.png", png()))).save()
    out = edited(data, "replace_body_text", old="Hello", new="Bye")
    assert texts(out)[:2] == ["Bye big world", "Bye you"]
    before, after = packages.Package.read(data).parts, packages.Package.read(out).parts
    assert {k for k in before if before[k] != after[k]} == {"word/document.xml"}
    assert edits.EditSession(data).commit() == data


def test_edit_operations():
    b = w.Builder(core={"title": "T"})
    data = b.text("one").text("two").add(w.paragraph(b.control("c", "ctl") + w.simple_field("MERGEFIELD Name", "«Name»"))).add(w.table([[w.cell(w.paragraph(w.run("a")), span=2), "b"]])).add(
        w.paragraph(b.revision("ins", "new") + b.revision("del", "old"))).save()
    assert texts(edited(data, "move_body_block", source=0, target=1))[:2] == ["two", "one"]
    assert texts(edited(data, "remove_body_block", index=0))[0] == "two"
    assert texts(edited(data, "insert_body_paragraph", index=1, text="mid"))[:3] == ["one", "mid", "two"]
    assert "filled" in texts(edited(data, "fill_content_control_by_tag", tag="c", text="filled"))[2]
    assert "Ann" in texts(edited(data, "fill_template_fields", values={"name": "Ann"}))[2]
    assert texts(edited(data, "set_table_cell_text", table=0, row=0, column=2, text="B"))[4] == "B"
    assert texts(edited(data, "accept_all_revisions"))[-1] == "new" and texts(edited(data, "reject_all_revisions"))[-1] == "old"
    out = edited(data, "add_comment_on_text", text="wo", comment="why")
    assert [(r["text"], r["fields"]["anchor"]) for r in of(open_docx(out), "comment")] == [("why", "wo")]
    assert [r["text"] for r in of(open_docx(edited(data, "add_footnote_on_text", text="two", note="fn")), "note")] == ["fn"]
    assert len(of(open_docx(edited(data, "add_image", name="z.png", content=png(9, 9))), "image")) == 1
    assert [r["text"] for r in of(open_docx(edited(data, "set_core_property", name="title", value="N")), "prop")] == ["N"]
    assert values(open_docx(edited(data, "set_field_result", index=0, text="R")), "field", "cached_result") == ["R"]
    for op, args in (("remove_body_block", {"index": 99}), ("fill_template_fields", {"values": {"": "x"}}), ("fill_template_fields", {"values": {"gone": "x"}}), ("add_image", {"name": "x.png", "content": b"no"}), ("set_table_cell_text", {"table": 0, "row": 5, "column": 0, "text": ""}), ("save", {})):
        s = edits.EditSession(data)
        with pytest.raises(edits.EditError):
            s.apply(op, **args)
        assert s.commit() == data


def test_batch_edits_are_all_or_nothing(spark):
    data = w.Builder().text("one").save()
    files = spark.createDataFrame([("a", data), ("b", data), ("c", data)], "path string, content binary")
    todo = spark.createDataFrame([("a", 0, "replace_body_text", {"old": "one", "new": "1"}), ("b", 0, "replace_body_text", {"old": "one", "new": "1"}), ("b", 1, "remove_body_block", {"index": "9"})], "path string, ord int, op string, args map<string,string>")
    got = {r.path: r for r in edits.edit_documents(files, todo).collect()}
    assert texts(bytes(got["a"].content)) == ["1"] and got["a"].parts == ["word/document.xml"]
    assert bytes(got["b"].content) == data and got["b"].error and got["b"].applied == 0 and bytes(got["c"].content) == data


def test_written_documents_read_back(spark):
    rows = [("d", 0, "heading", 1, "T"), ("d", 1, "paragraph", 0, "a & <b>"), ("d", 2, "list", 1, "i"), ("d", 3, "break", 0, None), ("e", 0, "paragraph", 0, "x\x01y")]
    out = w.write_documents(spark.createDataFrame(rows, "doc_id string, ord int, kind string, level int, text string")).collect()
    assert {r.doc_id: texts(bytes(r.content)) for r in out} == {"d": ["T", "a & <b>", "i"], "e": ["xy"]}


def test_saving_refuses_missing_targets():
    p = w.Builder().text("x").package()
    del p.parts["word/styles.xml"]
    with pytest.raises(packages.Refused):
        p.save()


def legacy(text, *, encrypted=False, version=0xC1, footnote=""):
    """A compound file with one text piece in each encoding, its table stream and nothing else."""
    whole = text + footnote
    body = whole.encode("utf-16-le")
    word = bytearray(1024)
    struct.pack_into("<HH", word, 0, 0xA5EC, version)
    struct.pack_into("<HH", word, 6, 0x0409, 0)
    struct.pack_into("<H", word, 10, 0x0200 | (0x0100 if encrypted else 0))
    struct.pack_into("<H", word, 32, 14)
    struct.pack_into("<H", word, 62, 22)
    units = lambda x: len(x.encode("utf-16-le")) // 2
    struct.pack_into("<ii", word, 64 + 12, units(text), units(footnote))
    struct.pack_into("<H", word, 152, 93)
    plc = struct.pack("<ii", 0, units(whole)) + struct.pack("<HIH", 0, 1024, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", word, 154 + 8 * 33, 0, len(clx))
    streams = {"WordDocument": bytes(word) + body, "1Table": clx}
    streams = {k: v + bytes(max(0, 4096 - len(v))) for k, v in streams.items()}
    sectors, fat, entries = [], [], []
    for name, data in streams.items():
        data += bytes(-len(data) % 512)
        first = len(sectors)
        sectors += [data[i : i + 512] for i in range(0, len(data), 512)]
        fat += [*range(first + 1, len(sectors)), 0xFFFFFFFE]
        entries.append((name, 2, first, len(data)))
    directory = b""
    for name, kind, first, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        raw = (name + "\0").encode("utf-16-le")
        directory += raw + bytes(64 - len(raw)) + struct.pack("<H", len(raw)) + bytes([kind, 1]) + bytes(48) + struct.pack("<IQ", first, size)
    directory += bytes(-len(directory) % 512)
    dir_at = len(sectors)
    sectors.append(directory)
    fat += [0xFFFFFFFE, 0xFFFFFFFD]
    fat_at = len(sectors)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = packages.OLE_MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, dir_at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def test_legacy_documents():
    rows = binary.open_doc(legacy("Hello\rCell\x13 PAGE \x143\x15 end\x0cnext 😀\r", footnote="note\r"))
    assert [(r["story"], r["text"]) for r in of(rows, "block")] == [("body", "Hello"), ("body", "Cell3 end"), ("body", None), ("body", "next 😀"), ("footnote", "note")]
    assert [(r["name"], r["fields"]["cached_result"]) for r in of(rows, "field")] == [("Page", "3")]
    assert [r["text"] for r in of(rows, "region")][1] == "note\n"
    for data, kind in ((legacy("x", encrypted=True), "Encrypted"), (legacy("x", version=0x65), "UnsupportedVersion"), (legacy("\r\r"), "NoText")):
        with pytest.raises(packages.Refused) as e:
            binary.open_doc(data)
        assert e.value.kind == kind


def test_legacy_lists():
    level = lambda nfc, text, start=1, legal=0: struct.pack("<iBB", start, nfc, legal) + bytes(22) + struct.pack("<H", len(text)) + text.encode("utf-16-le")
    levels = [level(1, "\x00."), level(4, "\x00.\x01)"), level(0, "\x00.\x01.\x02", legal=4)] + [level(0, "")] * 6
    lists = binary.Lists(struct.pack("<h", 1) + struct.pack("<i", 77) + bytes(24) + b"".join(levels), struct.pack("<i", 1) + struct.pack("<i", 77) + bytes(12))
    assert [lists.label(1, k) for k in (0, 1, 1, 0, 2, 1)] == ["I.", "I.a)", "I.b)", "II.", "2.1.1", "II.b)"]
    assert lists.label(9, 0) is None


def test_image_sizes():
    assert packages.image_size(png(7, 5), "image/png") == (7, 5)
    assert packages.image_size(b"GIF89a" + struct.pack("<HH", 4, 3), "image/gif") == (4, 3)
    assert packages.image_size(b"BM" + bytes(16) + struct.pack("<ii", 8, -6), "image/bmp") == (8, 6)
    assert packages.image_size(b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 2, 9) + bytes(8), "image/jpeg") == (9, 2)
    assert packages.image_size(b"junk", "image/jpeg") is None


@pytest.fixture(scope="module")
def opened(spark):
    b = w.Builder(core={"title": "T"}, custom={"k": "v"})
    n = b.list([("decimal", "%1.", 1), ("bullet", "•", 1)])
    b.heading("Head *1*").add(w.paragraph(w.run("plain ") + w.run("bold", bold=True) + w.run(" both", bold=True, italic=True) + b.link("l", "http://x/a b") + w.run("gone", hidden=True)))
    b.item("one", n).item("sub", n, 1).item("two", n).add(w.table([["h", "i|j"], ["1", "2"]], header_rows=1)).add(w.table([[w.cell(w.paragraph(w.run("m")), span=2)], ["p", "q"]]))
    b.add(w.paragraph(w.run("a") + b.revision("ins", "new") + b.revision("del", "old") + b.note("foot") + w.simple_field("CUSTOM x", "c") + w.simple_field("PAGE", "1")))
    return packages.open_documents(spark.createDataFrame([("d", b.save())], "path string, content binary")).cache()


def test_markdown_of_documents(opened):
    from foliograph.plans import documents

    want = ["# Head \\*1\\*", "plain **bold*** both*".replace("**bold*** both*", "**bold***** both***") + "[l](http://x/a%20b)gone", "1. one", "  - sub", "1. two", "| h | i\\|j |\n| --- | --- |\n| 1 | 2 |",
            '<table><tbody><tr><td colspan="2">m</td></tr><tr><td>p</td><td>q</td></tr></tbody></table>', "anewc1"]
    assert documents.markdown(opened).first().markdown.split("\n\n") == want


def test_html_of_documents(opened):
    from foliograph.plans import documents

    got = documents.html(opened).first().html
    assert got.startswith("<h1>Head *1*</h1><p>plain <strong>bold</strong><strong><em> both</em></strong>l</p><ol><li>one</li><ul><li>sub</li></ul><li>two</li></ol><table><thead><tr><th>h</th><th>i|j</th></tr></thead>")


def test_text_views_and_report(opened):
    import json

    from foliograph.plans import documents

    assert documents.text(opened, "body").first().text.split("\n")[:3] == ["Head *1*", "plain bold bothlgone", "one"]
    assert documents.text(opened, "footnote").first().text == "foot" and documents.text(opened).first().text.endswith("foot")
    views = {v: documents.view(opened, v).first().text for v in content.VIEWS}
    assert views["annotated"].endswith("a [+new] [-old] c 1") and views["accepted"].endswith("a new c 1") and views["original"].endswith("a old c 1")
    r = json.loads(documents.report(opened).first().report)
    assert list(r) == ["format", "stats", "core_properties", "custom_properties", "edit", "edited_parts", "features", "warnings"]
    assert r["stats"]["tables"] == 2 and r["core_properties"]["title"] == "T" and r["core_properties"]["subject"] is None and r["custom_properties"] == {"k": "v"}
    assert r["features"]["field_kinds"] == [{"kind": "Unknown", "count": 1}, {"kind": "Page", "count": 1}] and r["features"]["footnotes"] == 1
    assert [x["kind"] for x in r["warnings"]] == ["UnsupportedFieldEvaluation", "TrackedChangesPresent"] and r["warnings"][1]["insertions"] == 1
    assert r["warnings"][0] == {"kind": "UnsupportedFieldEvaluation", "count": 1, "field_kinds": [{"kind": "Unknown", "count": 1}]}
    note = packages.records(opened, "note", {"anchor": "string"}).first()
    assert note.anchor == "anewc1"


def test_command_line(tmp_path, capfd):
    from foliograph.__main__ import main

    (tmp_path / "a.docx").write_bytes(w.Builder().text("hello").save())
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04junk")
    assert main([]) == 64 and main(["convert", "x", "pdf"]) == 64
    assert main(["extract", str(tmp_path / "a.docx")]) == 0 and "hello" in capfd.readouterr().out
    assert main(["extract", str(tmp_path / "b.docx")]) == 1


def test_barcodes_and_metafiles():
    b = w.Builder().add(w.paragraph("".join(w.simple_field(i, "c") for i in ("DISPLAYBARCODE 12 QR \\q 3 \\s 50", "DISPLAYBARCODE 12 NOPE", "DISPLAYBARCODE 12 QR \\s 5", "BARCODE 12", "MERGEBARCODE n EAN13 \\a \\f 0xFF00FF", "DISPLAYBARCODE 12"))))
    assert values(open_docx(b.save()), "field", "unsupported_reason") == ["NoComputedResult", "UnsupportedSwitch", "UnsupportedSwitch", "NoComputedResult", "NoComputedResult", "UnsupportedSwitch"]
    emf = struct.pack("<II4i4i", 1, 108, 0, 0, 99, 49, 0, 0, 0, 0) + b" EMF" + bytes(64)
    assert packages.metafile_size(emf, "emf") == (100, 50)
    wmf = struct.pack("<I2x4hH", 0x9AC6CDD7, 0, 0, 1440, 720, 1440) + bytes(8)
    assert packages.metafile_size(wmf, "wmf") == (96, 48) and packages.metafile_size(b"junk", "wmf") is None


def test_legacy_runs_and_comment_tables():
    rows = binary.open_doc(legacy("ab\x13 PAGE \x143\x15c\r"))
    assert [r["text"] for r in of(rows, "run")] == ["ab3c"]
    xst = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16-le")
    assert binary.owners(xst("Ann") + xst("Bo") + b"\x09") == ["Ann", "Bo"]
    mark = xst("AB").ljust(20, b"\0") + struct.pack("<H", 1) + bytes(8)
    assert binary.comment_marks(struct.pack("<ii", 5, 9) + mark) == [(5, "AB", 1)] and binary.ranges(struct.pack("<iii", 0, 4, 6)) == [(0, 4), (4, 6)]
    assert binary.character_properties(bytes.fromhex("350801" "434a1800" "3608ff")) == {"bold": True, "size": 24}
    assert binary.paragraph_properties(bytes.fromhex("03240116240106240a")) == {"align": "center", "in_table": True}


def test_legacy_table_grids():
    tc = lambda flags: struct.pack("<H", flags) + bytes(18)
    definition = lambda bounds, flags: (lambda arg: struct.pack("<HH", 0xD608, len(arg) + 1) + arg)(bytes([len(flags)]) + struct.pack(f"<{len(bounds)}h", *bounds) + b"".join(map(tc, flags)))
    bounds, merges = binary.row_definition(definition([0, 100, 300], [0x60, 0]))
    assert (bounds, merges) == ([0, 100, 300], ["restart", None])
    rows = [(["a", "b"], [0, 100, 300], ["restart", None]), (["", "c", "d"], [0, 100, 200, 300], ["continue", None, None]), (["x", "y"], [0, 200, 300], ["continue", None])]
    got = [(c["text"], c["grid_col"], c["col_span"], c["row_span"]) for c in binary.grid(rows)]
    assert got == [("a", 0, 1, 2), ("b", 1, 2, 1), ("c", 1, 1, 1), ("d", 2, 1, 1), ("x", 0, 2, 1), ("y", 2, 1, 1)]
    assert [(c["grid_col"], c["col_span"]) for c in binary.grid([(["p", "q"], [], [])])] == [(0, 1), (1, 1)]


def test_settings_and_custom_xml():
    b = w.Builder().text("x")
    b.parts["word/settings.xml"] = f'<w:settings xmlns:w="{w.W}"><w:docId w:val="ID"/><w:evenAndOddHeaders/><w:docVars><w:docVar w:name="v" w:val="1"/></w:docVars></w:settings>'.encode()
    b.parts["customXml/item1.xml"] = b'<a xmlns="urn:x"><b>t</b></a>'
    rows = open_docx(b.add(w.paragraph(w.simple_field("DOCVARIABLE V", "?"))).save())
    assert [(r["name"], r["text"]) for r in of(rows, "setting")] == [("docId", "ID"), ("evenAndOddHeaders", "true")]
    assert [(r["text"], r["fields"]["root"], r["fields"]["namespace"]) for r in of(rows, "custom_xml")] == [("t", "a", "urn:x")]
    assert values(rows, "field", "computed_result") == ["1"]


def test_texts_show_computed_results():
    f = w.simple_field
    b = w.Builder().heading("Part")
    b.add(w.paragraph(w.run("a ") + f("= 2*3", "stale") + w.run(" b ") + f("CUSTOM x", "kept") + b.bookmark("sum", f("= 1+1", "old")) + w.complex_field("REF sum", "older")))
    b.add(w.paragraph(f("REF late", "?") + b.note("n") + b.comment(f("= 4", "c"), "said"))).add(w.paragraph(b.bookmark("late", f("= 7", "x")))).add(w.paragraph(w.run("\ufdd09\ufdd1odd\ufdd2")))
    char = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    b.add(w.paragraph(char("begin") + "<w:r><w:instrText>TOC</w:instrText></w:r>" + char("separate") + w.run("one"))).add(w.paragraph(w.run("two") + char("end")))
    rows = open_docx(b.save())
    body = [r["text"] for r in of(rows, "block") if r["story"] == "body"]
    assert body == ["Part", "a 6 b kept22", "74", "7", "9odd", "one", "two"]
    assert [r["text"] for r in of(rows, "bookmark")] == ["2", "7"] and values(rows, "comment", "anchor") == ["4"] and values(rows, "note", "anchor") == ["74"]
    assert "".join(r["text"] for r in of(rows, "run") if r["story"] == "body").startswith("Parta 6 b kept2274")
    assert not any("\ufdd0" in (r["text"] or "") or "\ufdd2" in (r["text"] or "") for r in rows)


def test_contents_of_a_bookmark_captions_and_entries_in_order(spark):
    b = w.Builder().heading("Before").add('<w:bookmarkStart w:id="9" w:name="mark"/>').heading("Inside")
    b.add(w.paragraph(w.run("x") + w.simple_field('TC "entry" \\l 2')) + '<w:bookmarkEnd w:id="9"/>').heading("After")
    b.add(w.paragraph(w.run("Figure ") + w.simple_field("SEQ Figure", "1") + w.run(": A cat"))).add(w.paragraph(w.simple_field('TC "late"')))
    codes = ("TOC \\b mark", "TOC \\f \\o", "TOC \\c Figure", "TOC \\a Figure", "TOC \\f \\b mark")
    b.add(w.paragraph("".join(w.simple_field(c, "?") for c in codes)))
    opened = packages.open_documents(spark.createDataFrame([("a", b.save())], "path string, content binary"), ["field"])
    got = {r.text: r.computed_result for r in packages.records(opened, "field", {"computed_result": "string"}).collect()}
    assert [got[c] for c in codes] == ["Inside", "Before\nInside\n  entry\nAfter\nlate", "Figure 1: A cat", "A cat", "  entry"]


def test_report_of_known_packages(spark):
    from foliograph.plans import documents, queries

    opened = packages.open_documents(spark.createDataFrame([("a", queries.odd_objects(60))], "path string, content binary"))
    assert documents.report(opened).first().report == GOLDEN


GOLDEN = (
    '{"format":"docx","stats":{"paragraphs":1,"tables":0,"figures":0,"text_chars":60},"core_properties":{"title":null,"subject":null,"creator":null,"description":null,"keywords":null,"category":null,'
    '"content_status":null,"last_modified_by":null,"created":null,"modified":null,"last_printed":null,"revision":null,"version":null},"custom_properties":{},"edit":{"package_preserving":true,"read_only_reasons":[]},'
    '"edited_parts":[],"features":{"comments":0,"footnotes":0,"endnotes":0,"text_boxes":0,"tracked_insertions":0,"tracked_deletions":0,"tracked_moves":0,"tracked_property_changes":0,"fields":0,"field_kinds":[],'
    '"unsupported_field_kinds":[],"unsupported_field_reasons":[],"hyperlinks":0,"content_controls":0,"nested_tables":0,"floating_shapes":2,"charts":1,"unsupported_charts":1,"ole_objects":1,"unsupported_metafiles":2,'
    '"metafiles":[{"path":"word/media/vector1.emf","format":"EMF","bytes":30,"compressed":false,"width_px":null,"height_px":null},{"path":"word/media/vector2.wmf","format":"WMF","bytes":30,"compressed":false,'
    '"width_px":null,"height_px":null}]},"warnings":[{"kind":"FloatingShapePlaceholderOnly","count":2},{"kind":"ChartsPreservedButNotModeled","count":1},{"kind":"OleObjectsPreservedButNotModeled","count":1},'
    '{"kind":"UnsupportedMetafileImages","count":2}]}'
)


def test_text_holds_tables_and_controls_where_they_stand(spark):
    from foliograph.plans import documents

    held = f'<w:sdt><w:sdtPr><w:tag w:val="t"/></w:sdtPr><w:sdtContent>{w.paragraph(w.run("held"))}</w:sdtContent></w:sdt>'
    inner = w.table([["x", "y"]])
    table = w.table([["a", w.cell(w.paragraph(w.run("b")) + w.paragraph("") + inner + w.paragraph(w.run("e")))], ["c", "d"]])
    o = w.Builder().text("one").add(held).text("two").add(table).text("three")
    for i in range(10_050):
        o.text(f"line {i}")
    files = spark.createDataFrame([("p", o.save())], "path string, content binary")
    got = documents.text(packages.open_documents(files, ["block"]), "body").first().text.split("\n")
    assert got[:6] == ["one", "held", "two", "a\tb x\ty e", "c\td", "three"] and got[6:] == [f"line {i}" for i in range(10_050)]


def test_too_many_relationships_are_refused_cheaply_and_only_these():
    import time

    most, one, root = packages.MOST_RECORDS, b'<Relationship Id="r" Type="t" Target="x"/>', b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'

    def refused(body):
        try:
            return len(packages.relationships(body))
        except packages.Refused as x:
            return x.kind

    over = one * (most + 1)
    for head in (b"", b'<?xml version="1.0"?>\n'):
        assert refused(head + root + over + b"</Relationships>") == "Docx"
        assert refused(head + root + one * most + b"</Relationships>\n") == most
        assert refused(head + root + one * 2 + b"<!--" + over + b"--></Relationships>") == 2
        assert refused(head + root + one + b"<x>" + over + b"</x></Relationships>") == 1  # not the root's own
        assert refused(head + root + over.replace(b"<Relationship ", b"<Relationship\n") + b"</Relationships>") == "Docx"
    assert refused(root + one + b"<Relationship </Relationships>") == 0 and refused(b"<!DOCTYPE x>" + root + over + b"</Relationships>") == 0
    sound = w.Builder().text("x").package().parts
    crowded = zipped(sound | {"word/_rels/document.xml.rels": root + over + b"</Relationships>"})
    began = time.process_time()
    for _ in range(20):
        with pytest.raises(packages.Refused, match="too many relationships"):
            open_docx(crowded)
    assert time.process_time() - began < 5  # 15 s when each was built into a tree first


def test_small_documents_share_frames_and_large_ones_do_not_pile_up(spark, monkeypatch):
    import pandas as pd

    seen = {}

    class Files:  # catches the function that opens, as frames can't be told apart in a table
        columns = ["path", "content"]

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            seen["run"] = run

    packages.open_documents(Files(), ["block"])
    small, large = w.Builder().text("x").save(), w.Builder().text("y" * (3 << 20)).save()
    batch = lambda bodies: pd.DataFrame({"k": [str(i) for i in range(len(bodies))], "content": bodies, "length": [None] * len(bodies)})
    frames = list(seen["run"](iter([batch([small] * 300 + [b"none"])])))
    assert len(frames) == 1 and list(frames[0]["doc_id"]) == [str(i) for i in range(301)] and list(frames[0]["tag"]) == ["block"] * 300 + ["error"]
    assert [len(f) for f in seen["run"](iter([batch([large] * 5)]))] == [2, 2, 1]


@pytest.mark.parametrize("answer", ["markdown", "html", "report"])
def test_answers_of_many_documents_send_no_records_through_the_driver(spark, tmp_path, answer):
    from foliograph.plans import documents

    files = spark.createDataFrame([(str(i), w.Builder().heading("Table").add(w.table([["h", str(i)], ["a|b", "c"]], header_rows=1)).save()) for i in range(4)], "path string, content binary")
    packages.open_documents(files).write.parquet(str(tmp_path / "opened"))  # few bytes, as those of a million documents are
    got = getattr(documents, answer)(spark.read.schema(packages.RECORD).parquet(str(tmp_path / "opened")))
    rows = {r[0]: r[1] for r in got.collect()}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 4 and (answer != "markdown" or rows["3"] == "# Table\n\n| h | 3 |\n| --- | --- |\n| a\\|b | c |")
