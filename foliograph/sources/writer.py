"""Writing packages: a fluent builder, the same from rows of blocks, and a sink for many documents at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packages import Package, image_size, mime_of, spread

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
CT = "http://schemas.openxmlformats.org/package/2006/content-types"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
C = "http://schemas.openxmlformats.org/drawingml/2006/chart"
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
ROOT = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:a="{A}" xmlns:wp="{WP}" xmlns:c="{C}" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
TYPES = "application/vnd.openxmlformats-officedocument.wordprocessingml."


def esc(text: str, attribute: bool = False) -> str:
    """XML text without the characters that XML forbids."""
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text)
    return escape(clean, quote=attribute)


def run(text: str, *, bold=None, italic=None, underline=None, strike=None, hidden=None, color=None, size=None, font=None, style=None, vert_align=None, deleted: bool = False) -> str:
    """One run: tabs and line feeds become marks, toggles that are None are left to the style."""
    toggles = "".join(f"<w:{n}/>" if v else f'<w:{n} w:val="0"/>' for n, v in (("b", bold), ("i", italic), ("strike", strike), ("vanish", hidden)) if v is not None)
    props = (
        (f'<w:rStyle w:val="{esc(style, True)}"/>' if style else "") + (f'<w:rFonts w:ascii="{esc(font, True)}" w:hAnsi="{esc(font, True)}"/>' if font else "") + toggles
        + (f'<w:color w:val="{esc(color, True)}"/>' if color else "") + (f'<w:sz w:val="{int(size * 2)}"/>' if size else "")
        + ("" if underline is None else f'<w:u w:val="{"single" if underline else "none"}"/>') + (f'<w:vertAlign w:val="{esc(vert_align, True)}"/>' if vert_align else "")
    )
    tag = "delText" if deleted else "t"
    pieces = []
    for x in re.split("([\t\n\f­])", text):
        if x:
            pieces.append({"\t": "<w:tab/>", "\n": "<w:br/>", "\f": '<w:br w:type="page"/>', "­": "<w:softHyphen/>"}.get(x) or f'<w:{tag} xml:space="preserve">{esc(x)}</w:{tag}>')
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{''.join(pieces)}</w:r>"


def simple_field(instruction: str, result: str = "") -> str:
    return f'<w:fldSimple w:instr="{esc(instruction, True)}">{run(result) if result else ""}</w:fldSimple>'


def complex_field(instruction: str, result: str = "") -> str:
    char = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    return f'{char("begin")}<w:r><w:instrText xml:space="preserve">{esc(instruction)}</w:instrText></w:r>{char("separate")}{run(result) if result else ""}{char("end")}'


def paragraph(content: str = "", *, style: str | None = None, align: str | None = None, num_id: int | None = None, level: int = 0, section: str = "", page_break_before: bool = False, outline: int | None = None, para_id: str | None = None) -> str:
    props = (
        (f'<w:pStyle w:val="{esc(style, True)}"/>' if style else "") + ("<w:pageBreakBefore/>" if page_break_before else "")
        + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num_id}"/></w:numPr>' if num_id is not None else "") + (f'<w:jc w:val="{align}"/>' if align else "")
        + (f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else "") + section
    )
    mark = f' w14:paraId="{para_id}"' if para_id else ""
    return f"<w:p{mark}>{f'<w:pPr>{props}</w:pPr>' if props else ''}{content}</w:p>"


def cell(content: str, *, span: int = 1, merge: str | None = None, shading: str | None = None) -> str:
    props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + (f'<w:vMerge w:val="{merge}"/>' if merge == "restart" else "<w:vMerge/>" if merge else "") + (f'<w:shd w:val="clear" w:fill="{shading}"/>' if shading else "")
    return f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{content or '<w:p/>'}</w:tc>"


def table(rows: list[list[str]], header_rows: int = 0, widths: list[int] | None = None) -> str:
    """rows of cells as cell() makes them, or plain texts."""
    one = lambda c: c if c.startswith("<w:tc") else cell(paragraph(run(c)))
    grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in widths or [2000] * max(map(len, rows), default=0))
    body = "".join(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if i < header_rows else ''}{''.join(map(one, r))}</w:tr>" for i, r in enumerate(rows))
    return f"<w:tbl><w:tblGrid>{grid}</w:tblGrid>{body}</w:tbl>"


def section(kind: str = "nextPage", width: int = 11906, height: int = 16838, margin: int = 1440, references: str = "", title_page: bool = False, start: int | None = None, columns: int | None = None) -> str:
    return (
        f'<w:sectPr>{references}<w:type w:val="{kind}"/><w:pgSz w:w="{width}" w:h="{height}"/><w:pgMar w:top="{margin}" w:right="{margin}" w:bottom="{margin}" w:left="{margin}" w:header="708" w:footer="708" w:gutter="0"/>'
        + (f'<w:pgNumType w:start="{start}"/>' if start is not None else "") + (f'<w:cols w:num="{columns}"/>' if columns else "") + ("<w:titlePg/>" if title_page else "") + "</w:sectPr>"
    )


@dataclass
class Builder:
    """A document put together piece by piece; every method returns the builder."""

    body: list[str] = field(default_factory=list)
    parts: dict[str, bytes] = field(default_factory=dict)
    rels: list[tuple[str, str, str, bool]] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)
    notes: dict[str, list[str]] = field(default_factory=lambda: {"footnote": [], "endnote": []})
    numbering: list[list[tuple[str, str, int]]] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    core: dict[str, str] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)
    last_section: str = ""

    def add(self, xml: str) -> Builder:
        self.body.append(xml)
        return self

    def text(self, text: str, **props) -> Builder:
        style = {k: props.pop(k) for k in ("style", "align", "num_id", "level", "outline", "page_break_before") if k in props}
        return self.add(paragraph(run(text, **props), **style))

    def heading(self, text: str, level: int = 1) -> Builder:
        return self.text(text, style=f"Heading{level}")

    def page_break(self) -> Builder:
        return self.add(paragraph('<w:r><w:br w:type="page"/></w:r>'))

    def list(self, levels: list[tuple[str, str, int]]) -> int:
        """A list definition of (format, pattern, start) by level; returns the number for items."""
        self.numbering.append(levels)
        return len(self.numbering)

    def item(self, text: str, num_id: int, level: int = 0) -> Builder:
        return self.text(text, num_id=num_id, level=level)

    def rel(self, kind: str, target: str, external: bool = False) -> str:
        self.rels.append((f"rId{len(self.rels) + 100}", kind, target, external))
        return self.rels[-1][0]

    def link(self, text: str, url: str) -> str:
        return f'<w:hyperlink r:id="{self.rel("hyperlink", url, True)}">{run(text)}</w:hyperlink>'

    def bookmark(self, name: str, content: str) -> str:
        n = sum(x.count("<w:bookmarkStart") for x in self.body) + content.count("<w:bookmarkStart") + 1
        return f'<w:bookmarkStart w:id="{n}" w:name="{esc(name, True)}"/>{content}<w:bookmarkEnd w:id="{n}"/>'

    def comment(self, content: str, text: str, author: str = "", date: str = "", parent: int | None = None) -> str:
        n = len(self.comments)
        attrs = f' w:author="{esc(author, True)}" w:initials="{esc(author[:1], True)}"' + (f' w:date="{date}"' if date else "") + (f' w:parentId="{parent}"' if parent is not None else "")
        self.comments.append(f'<w:comment w:id="{n}"{attrs}>{paragraph(run(text), para_id=f"{n + 1:08X}")}</w:comment>')
        return f'<w:commentRangeStart w:id="{n}"/>{content}<w:commentRangeEnd w:id="{n}"/><w:r><w:commentReference w:id="{n}"/></w:r>'

    def note(self, text: str, kind: str = "footnote", custom: str | None = None) -> str:
        n = len(self.notes[kind]) + 1
        self.notes[kind].append(f'<w:{kind} w:id="{n}">{paragraph(run(text))}</w:{kind}>')
        mark = ' w:customMarkFollows="1"' if custom else ""
        return f'<w:r><w:{kind}Reference w:id="{n}"{mark}/></w:r>' + (run(custom) if custom else "")

    @staticmethod
    def revision(kind: str, text: str, id_: int = 1, author: str = "", date: str = "") -> str:
        return f'<w:{kind} w:id="{id_}" w:author="{esc(author, True)}"' + (f' w:date="{date}"' if date else "") + f">{run(text, deleted=kind == 'del')}</w:{kind}>"

    def control(self, tag: str, text: str) -> str:
        return f'<w:sdt><w:sdtPr><w:tag w:val="{esc(tag, True)}"/></w:sdtPr><w:sdtContent>{run(text)}</w:sdtContent></w:sdt>'

    def image(self, name: str, content: bytes, anchor: bool = False) -> str:
        """An inline or floating picture; the size comes from the image, at 9525 EMU a pixel."""
        self.parts[f"word/media/{name}"] = content
        rid = self.rel("image", f"media/{name}")
        w, h = image_size(content, mime_of(name)) or (100, 100)
        tag = "anchor" if anchor else "inline"
        return f'<w:r><w:drawing><wp:{tag}><wp:extent cx="{w * 9525}" cy="{h * 9525}"/><wp:docPr id="{len(self.parts)}" name="{esc(name, True)}"/><a:graphic><a:graphicData><a:blip r:embed="{rid}"/></a:graphicData></a:graphic></wp:{tag}></w:drawing></w:r>'

    def chart(self, kind: str, series: dict[str, dict[str, float]]) -> str:
        """A chart part of one plot; series name -> category -> value."""
        n = sum(k.startswith("word/charts/") for k in self.parts) + 1
        point = lambda i, v: f'<c:pt idx="{i}"><c:v>{esc(str(v))}</c:v></c:pt>'
        ser = "".join(
            f"<c:ser><c:tx><c:v>{esc(name)}</c:v></c:tx><c:cat><c:strLit>{''.join(point(i, k) for i, k in enumerate(values))}</c:strLit></c:cat>"
            f"<c:val><c:numLit>{''.join(point(i, v) for i, v in enumerate(values.values()))}</c:numLit></c:val></c:ser>"
            for name, values in series.items()
        )
        self.parts[f"word/charts/chart{n}.xml"] = f'{DECLARATION}<c:chartSpace xmlns:c="{C}"><c:chart><c:plotArea><c:{kind}>{ser}</c:{kind}></c:plotArea></c:chart></c:chartSpace>'.encode()
        self.overrides[f"word/charts/chart{n}.xml"] = "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"
        return f'<w:r><w:drawing><wp:inline><a:graphic><a:graphicData><c:chart r:id="{self.rel("chart", f"charts/chart{n}.xml")}"/></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'

    def story(self, kind: str, text: str, which: str = "default") -> str:
        """A header or footer part; returns the section's reference to it."""
        n = sum(k.startswith(f"word/{kind}") for k in self.parts) + 1
        tag = "hdr" if kind == "header" else "ftr"
        self.parts[f"word/{kind}{n}.xml"] = f"{DECLARATION}<w:{tag} {ROOT}>{paragraph(run(text))}</w:{tag}>".encode()
        self.overrides[f"word/{kind}{n}.xml"] = f"{TYPES}{kind}+xml"
        return f'<w:{kind}Reference w:type="{which}" r:id="{self.rel(kind, f"{kind}{n}.xml")}"/>'

    def style(self, id_: str, name: str | None = None, based_on: str | None = None, props: str = "", para: str = "", kind: str = "paragraph") -> Builder:
        self.styles.append(
            f'<w:style w:type="{kind}" w:styleId="{esc(id_, True)}"><w:name w:val="{esc(name or id_, True)}"/>' + (f'<w:basedOn w:val="{esc(based_on, True)}"/>' if based_on else "")
            + (f"<w:pPr>{para}</w:pPr>" if para else "") + (f"<w:rPr>{props}</w:rPr>" if props else "") + "</w:style>"
        )
        return self

    def package(self) -> Package:
        rels, overrides = list(self.rels), {"word/document.xml": f"{TYPES}document.main+xml"} | self.overrides
        parts: dict[str, bytes] = {}

        def part(name: str, kind: str, xml: str) -> None:
            parts[f"word/{name}.xml"] = (DECLARATION + xml).encode()
            rels.append((f"rIdP{len(rels)}", kind, f"{name}.xml", False))
            overrides[f"word/{name}.xml"] = f"{TYPES}{kind}+xml"

        headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
        part("styles", "styles", f"<w:styles {ROOT}>{headings}{''.join(self.styles)}</w:styles>")
        if self.numbering:
            level = lambda i, v: f'<w:lvl w:ilvl="{i}"><w:start w:val="{v[2]}"/><w:numFmt w:val="{v[0]}"/><w:lvlText w:val="{esc(v[1], True)}"/></w:lvl>'
            defs = "".join(f'<w:abstractNum w:abstractNumId="{n}">{"".join(level(i, v) for i, v in enumerate(levels))}</w:abstractNum>' for n, levels in enumerate(self.numbering, 1))
            part("numbering", "numbering", f"<w:numbering {ROOT}>{defs}{''.join(f'<w:num w:numId={chr(34)}{n}{chr(34)}><w:abstractNumId w:val={chr(34)}{n}{chr(34)}/></w:num>' for n in range(1, len(self.numbering) + 1))}</w:numbering>")
        if self.comments:
            part("comments", "comments", f"<w:comments {ROOT}>{''.join(self.comments)}</w:comments>")
        for kind, notes in self.notes.items():
            if notes:
                part(f"{kind}s", f"{kind}s", f"<w:{kind}s {ROOT}>{''.join(notes)}</w:{kind}s>")
        document = f"{DECLARATION}<w:document {ROOT}><w:body>{''.join(self.body)}{self.last_section}</w:body></w:document>"
        top = [("rId1", "officeDocument", "word/document.xml", False)]
        if self.core:
            names = {"title": "dc", "subject": "dc", "creator": "dc", "description": "dc"}
            values = "".join(f"<{names.get(k, 'cp')}:{k}>{esc(v)}</{names.get(k, 'cp')}:{k}>" for k, v in self.core.items())
            parts["docProps/core.xml"] = f'{DECLARATION}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{values}</cp:coreProperties>'.encode()
            top.append(("rId2", "metadata/core-properties", "docProps/core.xml", False))
        if self.custom:
            values = "".join(f'<property fmtid="{{D5CDD505-2E9C-101B-9397-08002B2CF9AE}}" pid="{i}" name="{esc(k, True)}"><vt:lpwstr>{esc(v)}</vt:lpwstr></property>' for i, (k, v) in enumerate(self.custom.items(), 2))
            parts["docProps/custom.xml"] = f'{DECLARATION}<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes">{values}</Properties>'.encode()
            top.append(("rId3", "custom-properties", "docProps/custom.xml", False))
        defaults = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"} | {k.rpartition(".")[2]: mime_of(k) for k in self.parts if "/media/" in k}
        types = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items()) + "".join(f'<Override PartName="/{k}" ContentType="{v}"/>' for k, v in overrides.items())
        relation = lambda rows: f'{DECLARATION}<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{k}" Target="{esc(t, True)}"{" TargetMode=" + chr(34) + "External" + chr(34) if x else ""}/>' for i, k, t, x in rows) + "</Relationships>"
        return Package({
            "[Content_Types].xml": f'{DECLARATION}<Types xmlns="{CT}">{types}</Types>'.encode(), "_rels/.rels": relation(top).encode(), "word/document.xml": document.encode(),
            "word/_rels/document.xml.rels": relation(rels).encode(), **parts, **self.parts,
        })

    def save(self) -> bytes:
        return self.package().save()


def write_documents(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, content: a package for each document from its blocks (ord, kind, level, text; kinds heading, paragraph, list,
    break), in order. Documents are made a batch at a time; each must fit in a task."""
    rows = spread(blocks, doc).groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", "kind", F.col("level").cast("int").alias("level"), "text"))).alias("blocks"))
    kind = rows.schema[doc].dataType.simpleString()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, blocks in zip(b[doc], b["blocks"]):
                d = Builder()
                bullets = None
                for x in blocks:
                    level, text = int(x["level"] or 0), x["text"] or ""
                    if x["kind"] == "heading":
                        d.heading(text, min(max(level, 1), 6))
                    elif x["kind"] == "break":
                        d.page_break()
                    elif x["kind"] == "list":
                        bullets = bullets or d.list([("bullet", "•", 1)] * 9)
                        d.item(text, bullets, min(level, 8))
                    else:
                        d.text(text)
                out.append((key, d.save()))
            yield pd.DataFrame(out, columns=[doc, "content"])

    return rows.mapInPandas(make, f"`{doc}` {kind}, content binary")


def save_files(documents: DataFrame, folder: str, name: str = "doc_id") -> None:
    """Writes each row's content as <folder>/<name>.docx, through the cluster's file systems only on local and mounted
    paths: from the executors, one file a row, each first under another name so that a retried task leaves none half done."""
    import os

    def put(rows) -> None:
        for r in rows:
            path = os.path.join(folder, f"{r[name]}.docx")
            os.makedirs(folder, exist_ok=True)
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(f"{path}.{os.getpid()}.part", path)

    documents.select(name, "content").foreachPartition(put)
