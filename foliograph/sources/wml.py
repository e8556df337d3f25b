"""WordprocessingML packages as records: one walk over each part, no second scan for each kind of reference."""

from __future__ import annotations

import re
from xml.etree.ElementTree import Element

from ..functions import fields as grammar
from .packages import Package, Refused, attr, content_types, image_size, local, metafile_size, mime_of, parse_xml, resolve

MOST_TABLES_DEEP, MOST_GRID = 128, 1024
#: Run marks that are text of their own. Fixed values.
MARKS = {"tab": "\t", "cr": "\n", "noBreakHyphen": "-", "softHyphen": "­"}
REVISIONS = {"ins": "ins", "del": "del", "moveFrom": "moveFrom", "moveTo": "moveTo"}
PROPERTY_CHANGES = {"pPrChange", "rPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "tblGridChange", "numberingChange"}
CORE = (
    "title", "subject", "creator", "description", "keywords", "category", "contentStatus", "lastModifiedBy", "created", "modified", "lastPrinted", "revision", "version",
)


RUN_PROPERTIES = ("bold", "italic", "strike", "hidden", "caps", "small_caps", "rtl", "underline", "color", "size", "vert_align", "highlight", "font")


def on(e: Element | None) -> bool | None:
    """A toggle: null if absent, else true unless its value says no."""
    return None if e is None else attr(e, "val", "true") not in ("0", "false", "off", "none")


def child(e: Element | None, *names: str) -> Element | None:
    for n in names:
        if e is None:
            return None
        for c in e:
            if local(c) == n:
                e = c
                break
        else:
            return None
    return e


def value(e: Element | None, *names: str) -> str | None:
    c = child(e, *names)
    return attr(c, "val") if c is not None else None


def chosen(e: Element) -> list[Element]:
    """An AlternateContent's one branch that counts: the first choice, or the fallback if there is none."""
    branches = [c for c in e if local(c) in ("Choice", "Fallback")]
    return list(branches[0]) if branches else []


def inner(e: Element):
    """All elements below, alternate content reduced to its branch."""
    for c in e:
        if local(c) == "AlternateContent":
            for x in chosen(c):
                yield x
                yield from inner(x)
        else:
            yield c
            yield from inner(c)


def plain_text(e: Element, deleted: bool = False) -> str:
    """Text below an element; what is deleted or moved away is left out unless asked for."""
    out = []

    def walk(x: Element) -> None:
        n = local(x)
        if n == "AlternateContent":
            for c in chosen(x):
                walk(c)
            return
        if n in ("del", "moveFrom") and not deleted or n in ("instrText", "delInstrText", "pict", "txbxContent", "drawing"):
            return
        if n == "t" or (n == "delText" and deleted):
            out.append(x.text or "")
        elif n in MARKS:
            out.append(MARKS[n])
        elif n == "br":
            out.append("\f" if attr(x, "type") == "page" else "\n")
        elif n == "sym":
            out.append(symbol(x))
        for c in x:
            walk(c)
        if n == "p":
            out.append("\n")

    walk(e)
    return "".join(out).strip("\n")


def symbol(e: Element) -> str:
    from ..functions.text import SYMBOLS

    try:
        code = int(attr(e, "char") or "", 16)
    except ValueError:
        return ""
    return SYMBOLS.get((attr(e, "font") or "").strip().lower(), {}).get(code & 0xFF if code >= 0xF000 else code, chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "")


#: The noncharacters that mark fields in gathered texts; a document's own go.
NO_MARKS = {0xFDD0: None, 0xFDD1: None, 0xFDD2: None}


class Styles:
    def __init__(self, root: Element | None):
        self.by_id: dict[str, dict] = {}
        self.got: dict[tuple[str, str], object] = {}
        for s in root if root is not None else ():
            if local(s) != "style" or not attr(s, "styleId"):
                continue
            ppr, rpr = child(s, "pPr"), child(s, "rPr")
            self.by_id[attr(s, "styleId")] = {
                "name": value(s, "name") or "", "type": attr(s, "type") or "paragraph", "based_on": value(s, "basedOn"), "outline": value(ppr, "outlineLvl"),
                "num_id": value(ppr, "numPr", "numId"), "ilvl": value(ppr, "numPr", "ilvl"), "align": value(ppr, "jc"), **run_properties(rpr),
            }

    def chain(self, style_id: str | None, limit: int = 32):
        seen = set()
        while style_id and style_id in self.by_id and style_id not in seen and len(seen) <= limit:
            seen.add(style_id)
            yield self.by_id[style_id]
            style_id = self.by_id[style_id]["based_on"]

    def get(self, style_id: str | None, name: str):
        if style_id not in self.by_id:
            return None
        if (style_id, name) not in self.got:
            self.got[style_id, name] = next((s[name] for s in self.chain(style_id) if s.get(name) is not None), None)
        return self.got[style_id, name]

    def heading(self, style_id: str | None) -> int | None:
        for s in self.chain(style_id):
            for label in (s["name"], style_id or ""):
                if m := re.fullmatch(r"(?i)\s*(?:heading|제목)\s*([1-9])\s*", label):
                    return int(m[1])
        level = self.get(style_id, "outline")
        return int(level) + 1 if level and level.isdigit() and int(level) < 9 else None


def run_properties(rpr: Element | None) -> dict:
    if rpr is None:
        return dict.fromkeys(RUN_PROPERTIES)
    out = {k: on(child(rpr, n)) for k, n in (("bold", "b"), ("italic", "i"), ("strike", "strike"), ("hidden", "vanish"), ("caps", "caps"), ("small_caps", "smallCaps"), ("rtl", "rtl"))}
    u = value(rpr, "u")
    font = child(rpr, "rFonts")
    return out | {
        "underline": None if u is None else u != "none", "color": value(rpr, "color"), "size": value(rpr, "sz"), "vert_align": value(rpr, "vertAlign"), "highlight": value(rpr, "highlight"),
        "font": (attr(font, "ascii") or attr(font, "hAnsi")) if font is not None else None,
    }


class Numbering:
    """Levels of each list instance: format, pattern, start. Counters are kept by instance, as items come."""

    def __init__(self, root: Element | None):
        abstract, self.levels = {}, {}
        for a in root if root is not None else ():
            if local(a) == "abstractNum":
                abstract[attr(a, "abstractNumId")] = {attr(v, "ilvl"): self.level(v) for v in a if local(v) == "lvl"}
            elif local(a) == "num":
                levels = {k: dict(v) for k, v in abstract.get(value(a, "abstractNumId"), {}).items()}
                for o in a:
                    if local(o) == "lvlOverride":
                        k = attr(o, "ilvl")
                        if (v := child(o, "lvl")) is not None:
                            levels[k] = self.level(v)
                        if (start := value(o, "startOverride")) is not None and start.isdigit():
                            levels.setdefault(k, {"fmt": "decimal", "text": "", "start": 1})["start"] = int(start)
                self.levels[attr(a, "numId")] = levels
        self.counters: dict[str, list[int]] = {}

    @staticmethod
    def level(v: Element) -> dict:
        start = value(v, "start") or "1"
        return {"fmt": value(v, "numFmt") or "decimal", "text": value(v, "lvlText") or "", "start": int(start) if start.isdigit() else 1}

    def label(self, num_id: str, ilvl: int) -> tuple[str | None, bool, str | None]:
        """(label, ordered, full-context number) of the next item; the item's own level advances, deeper ones are zeroed."""
        levels = self.levels.get(num_id)
        if not levels or str(ilvl) not in levels or not 0 <= ilvl < 9:
            return None, False, None
        c = self.counters.setdefault(num_id, [0] * 9)
        own = levels[str(ilvl)]
        c[ilvl] = c[ilvl] + 1 if c[ilvl] else max(own["start"], 1)
        c[ilvl + 1 :] = [0] * (8 - ilvl)
        if own["fmt"] in ("bullet", "none"):
            return (own["text"] or None) if own["fmt"] == "bullet" else None, False, None
        text = re.sub(r"%([1-9])", lambda m: self.number(levels, int(m[1]) - 1, c), own["text"])
        whole = [self.number(levels, i, c) for i in range(ilvl + 1)] if all(c[i] and levels.get(str(i), own)["fmt"] not in ("bullet", "none") for i in range(ilvl + 1)) else None
        return text or None, True, ".".join(whole) if whole else None

    @staticmethod
    def number(levels: dict, i: int, c: list[int]) -> str:
        from ..functions.numbers import _letters, _roman, style_text

        fmt = levels.get(str(i), {"fmt": "decimal"})["fmt"]
        n = c[i]
        letter = lambda x: _letters(x) or "A"
        table = {
            "upperRoman": _roman, "lowerRoman": lambda x: _roman(x).lower(), "upperLetter": letter, "lowerLetter": lambda x: letter(x).lower(), "ordinal": lambda x: style_text(x, 5),
            "decimalZero": lambda x: f"{x:02d}", "cardinalText": lambda x: style_text(x, 6), "ordinalText": lambda x: style_text(x, 7), "ganada": lambda x: style_text(x, 0x18),
            "chosung": lambda x: style_text(x, 0x19), "koreanDigital2": lambda x: style_text(x, 0x29), "koreanCounting": lambda x: style_text(x, 0x2A), "decimalEnclosedCircle": lambda x: style_text(x, 0x12),
        }
        return table.get(fmt, str)(n)


class Reader:
    """One document's walk. Ordinals run over all paragraphs' contents in source order."""

    def __init__(self, package: Package, wanted: set[str] | None, context: dict | None):
        self.p, self.wanted, self.context = package, wanted, context or {}
        self.rows: list[dict] = []
        self.ord = 0
        self.pending: list[Element] = []  # bookmarks that begin between paragraphs
        main = next((resolve("", r["target"]) for r in package.rels("") if r["type"].endswith("/officeDocument")), "word/document.xml")
        if main not in package.parts:
            raise Refused("Docx", "missing word/document.xml")
        self.main = main
        rels = {r["rid"]: r for r in package.rels(main)}
        self.by_type = lambda kind: [resolve(main, r["target"]) for r in rels.values() if r["type"].rpartition("/")[2] == kind and not r["external"]]
        part = lambda kind, name: next((x for x in self.by_type(kind) if x in package.parts), name)
        self.styles = Styles(package.xml(part("styles", "word/styles.xml")))
        self.numbering = Numbering(package.xml(part("numbering", "word/numbering.xml")))
        self.settings = package.xml(part("settings", "word/settings.xml"))
        self.names = {k: part(k, f"word/{k}.xml") for k in ("comments", "commentsExtended", "footnotes", "endnotes")}
        self.page, self.section, self.note_numbers = 1, 1, {"footnote": 0, "endnote": 0}
        self.doc = grammar.Document(self.properties(), self.context)

    def emit(self, tag: str, ord: int | None = None, story: str | None = None, path: str | None = None, name: str | None = None, text: str | None = None, **more) -> None:
        if self.wanted is None or tag in self.wanted:
            fields = {k: ("true" if v is True else "false" if v is False else str(v)) for k, v in more.items() if v is not None}
            self.rows.append({"tag": tag, "ord": self.ord if ord is None else ord, "story": story, "path": path, "name": name, "text": text, "fields": fields})

    # properties and packages

    def properties(self) -> dict[str, dict[str, str]]:
        core, custom, extended, variables = {}, {}, {}, {}
        root = self.p.xml("docProps/core.xml")
        for e in root if root is not None else ():
            if local(e) in CORE:
                core[local(e)] = "".join(e.itertext())
        root = self.p.xml("docProps/custom.xml")
        for e in root if root is not None else ():
            if attr(e, "name") is not None:
                custom[attr(e, "name")] = "".join(e.itertext())
        root = self.p.xml("docProps/app.xml")
        for e in root if root is not None else ():
            extended[local(e)] = "".join(e.itertext())
        for e in inner(self.settings) if self.settings is not None else ():
            if local(e) == "docVar" and attr(e, "name") is not None:
                variables[attr(e, "name")] = attr(e, "val") or ""
        return {"core": core, "custom": custom, "extended": extended, "variables": variables}

    def package_records(self) -> None:
        defaults, overrides = content_types(self.p)
        for i, (name, body) in enumerate(self.p.parts.items()):
            kind = overrides.get(name) or defaults.get(name.rpartition(".")[2].lower())
            self.emit("part", i, name=name, size=len(body), content_type=kind, is_xml=name.endswith((".xml", ".rels")))
            if "/media/" in name and not name.lower().endswith((".emf", ".wmf", ".emz", ".wmz")):
                mime = mime_of(name)
                size = image_size(body, mime) or (None, None)
                self.emit("image", i, name=name, mime=mime, size=len(body), width=size[0], height=size[1])
            elif name.lower().endswith((".emf", ".wmf", ".emz", ".wmz")):
                size = metafile_size(body, name[-3:]) or (None, None)
                self.emit("metafile", i, name=name, format=name[-3:].upper().replace("Z", "F"), size=len(body), compressed=body[:2] == b"\x1f\x8b", width=size[0], height=size[1])
            if name.startswith("word/charts/") and name.endswith(".xml"):
                self.chart(name, i)
        n = 0
        for source in ["", *self.p.parts]:
            for r in self.p.rels(source) if not source.endswith(".rels") else ():
                self.emit("rel", n, name=r["rid"], source_part=source, type=r["type"], target=r["target"], resolved=None if r["external"] else resolve(source, r["target"]), external=r["external"])
                n += 1
        for group, values in self.doc.properties.items():
            for i, (k, v) in enumerate(values.items()):
                self.emit("prop", i, name=k, text=v, group=group)
        for i, e in enumerate(x for x in (inner(self.settings) if self.settings is not None else ()) if local(x) in ("docId", "evenAndOddHeaders", "trackRevisions", "documentProtection", "defaultTabStop")):
            self.emit("setting", i, name=local(e), text=attr(e, "val") or attr(e, "edit") or "true")
        for i, name in enumerate(n for n in self.p.parts if re.fullmatch(r"customXml/item\d+\.xml", n)):
            try:
                root = parse_xml(self.p.parts[name])
            except Refused:
                continue
            self.emit("custom_xml", i, name=name, text="".join(root.itertext()), root=local(root), namespace=root.tag[1:].partition("}")[0] if root.tag.startswith("{") else None)
        for i, (k, s) in enumerate(self.styles.by_id.items()):
            self.emit("style", i, name=k, **{("style_name" if a == "name" else a): b for a, b in s.items()}, heading_level=self.styles.heading(k))
        n = 0
        for num, levels in self.numbering.levels.items():
            for k, v in levels.items():
                self.emit("numbering_level", n, name=num, text=v["text"], ilvl=k, fmt=v["fmt"], start=v["start"])
                n += 1

    def chart(self, name: str, i: int) -> None:
        try:
            root = parse_xml(self.p.parts[name])
        except Refused:
            self.emit("chart", i, name=name, kind="malformed")
            return
        plot = next((e for e in inner(root) if local(e) == "plotArea"), None)
        kind = next((local(e) for e in plot if local(e).endswith("Chart")), "unknown") if plot is not None else "unknown"
        self.emit("chart", i, name=name, kind=kind)
        n = 0
        for s, ser in enumerate(e for e in inner(root) if local(e) == "ser"):
            points = {k: {attr(pt, "idx"): "".join(pt.itertext()) for c in ser if local(c) == k for pt in inner(c) if local(pt) == "pt"} for k in ("cat", "xVal", "val", "yVal", "bubbleSize")}
            label = next(("".join(v.itertext()) for c in ser if local(c) == "tx" for v in inner(c) if local(v) == "v"), None)
            for idx, v in (points["val"] or points["yVal"]).items():
                self.emit("chart_point", n, name=name, text=v, series=s, series_name=label, idx=idx, category=(points["cat"] or points["xVal"]).get(idx), size=points["bubbleSize"].get(idx))
                n += 1

    # stories

    def body(self) -> None:
        root = parse_xml(self.p.parts[self.main])
        body = child(root, "body")
        if body is None:
            raise Refused("Docx", "no body")
        self.rels = {r["rid"]: r for r in self.p.rels(self.main)}
        self.blocks(body, "body", "")
        self.sections(body)

    def other_stories(self) -> None:
        for kind in ("footnote", "endnote"):
            name = self.names[kind + "s"]
            root = self.p.xml(name)
            if root is None:
                continue
            self.rels = {r["rid"]: r for r in self.p.rels(name)}
            notes = [e for e in root if local(e) == kind and attr(e, "type") in (None, "normal")]
            for i, e in enumerate(notes):
                said = "\n".join(self.blocks(e, kind, f"{i:06d}."))
                self.emit("note", i, story=kind, name=attr(e, "id"), text=said.strip("\n"), kind=kind, note_kind=kind)
        root = self.p.xml(self.names["comments"])
        if root is not None:
            self.rels = {r["rid"]: r for r in self.p.rels(self.names["comments"])}
            extended = self.p.xml(self.names["commentsExtended"])
            ex = {attr(e, "paraId"): e for e in (extended if extended is not None else ())}
            comments = [e for e in root if local(e) == "comment"]
            last = {attr(c, "id"): next((attr(p, "paraId") for p in reversed(list(inner(c))) if local(p) == "p"), None) for c in comments}
            owner = {v: k for k, v in last.items() if v}
            for i, c in enumerate(comments):
                x = ex.get(last[attr(c, "id")])
                parent = attr(c, "parentId") or (owner.get(attr(x, "paraIdParent")) if x is not None else None)
                self.emit(
                    "comment", i, story="comment", name=attr(c, "id"), text=plain_text(c), author=attr(c, "author"), initials=attr(c, "initials"), date=attr(c, "date"), para_id=last[attr(c, "id")],
                    parent_id=parent, resolved=None if x is None else attr(x, "done") in ("1", "true"), anchor=self.doc.comment_anchor(attr(c, "id")),
                )
        seen = set()
        for kind in ("header", "footer"):
            for name in self.by_type(kind):
                if name in seen or name not in self.p.parts:
                    continue
                seen.add(name)
                root = self.p.xml(name)
                self.rels = {r["rid"]: r for r in self.p.rels(name)}
                said = "\n".join(self.blocks(root, f"{kind}:{name}", ""))
                self.emit("header_footer", len(seen) - 1, story=f"{kind}:{name}", name=name, text=said.strip("\n"), kind=kind)

    def sections(self, body: Element) -> None:
        every = [e for e in inner(body) if local(e) == "sectPr"]
        last: dict[tuple[str, str], str | None] = {}
        for i, s in enumerate(every):
            size, margin, columns, number = (child(s, n) for n in ("pgSz", "pgMar", "cols", "pgNumType"))
            get = lambda e, k: attr(e, k) if e is not None else None
            self.emit(
                "section", i, kind=value(s, "type") or "nextPage", width=get(size, "w"), height=get(size, "h"), landscape=get(size, "orient") == "landscape", **{f"margin_{k}": get(margin, k) for k in ("top", "right", "bottom", "left", "header", "footer")},
                columns=get(columns, "num"), text_direction=value(s, "textDirection"), doc_grid=get(child(s, "docGrid"), "type"), title_page=on(child(s, "titlePg")), number_start=get(number, "start"), number_format=get(number, "fmt"),
            )
            for e in s:
                if local(e) in ("headerReference", "footerReference"):
                    kind = attr(e, "type")
                    last[local(e)[:6], kind if kind in ("first", "even") else "default"] = attr(e, "id")
            rels = {r["rid"]: r for r in self.p.rels(self.main)}
            for (part, kind), rid in sorted(last.items()):  # what a section leaves out it has from the one before
                if rid in rels:
                    self.emit("section_part", i, story=part, name=resolve(self.main, rels[rid]["target"]), kind=kind + part.capitalize())

    def blocks(self, parent: Element, story: str, path: str, depth: int = 0, cell: str | None = None) -> list[str]:
        """Emits the blocks below parent; returns their texts. Paths sort as the blocks stand in the document."""
        if depth > MOST_TABLES_DEEP:
            raise Refused("Docx", "nested too deep")
        texts, n = [], 0
        for e in parent:
            kind = local(e)
            if kind == "AlternateContent":
                for i, x in enumerate(chosen(e)):
                    texts += self.blocks([x], story, f"{path}{n:06d}.a{i:06d}.", depth + 1, cell)
                n += 1
            elif kind in ("sdt", "customXml", "smartTag", "ins", "moveTo"):
                if kind == "sdt":
                    self.content_control(e, story)
                inside = child(e, "sdtContent") if kind == "sdt" else e
                if inside is not None:
                    texts += self.blocks(inside, story, f"{path}{n:06d}.s.", depth + 1, cell)
                n += 1
            elif kind == "bookmarkStart":
                self.pending.append(e)  # it begins with the paragraph that comes next
            elif kind == "bookmarkEnd":
                self.begin_bookmarks()
                self.doc.bookmark_end(attr(e, "id"), self.ord)
            elif kind == "p":
                texts.append(self.paragraph(e, story, f"{path}{n:06d}", cell))
                n += 1
            elif kind == "tbl":
                texts.append(self.table(e, story, f"{path}{n:06d}", depth, cell))
                n += 1
        return texts

    def begin_bookmarks(self) -> None:
        for e in self.pending:
            self.doc.bookmark_start(attr(e, "id"), attr(e, "name"), self.ord, self.page)
        self.pending.clear()

    def content_control(self, e: Element, story: str) -> None:
        pr = child(e, "sdtPr")
        binding = child(pr, "dataBinding")
        self.emit("content_control", story=story, name=value(pr, "tag"), text=plain_text(child(e, "sdtContent")) if child(e, "sdtContent") is not None else "", alias=value(pr, "alias"), xpath=attr(binding, "xpath") if binding is not None else None)

    def table(self, e: Element, story: str, path: str, depth: int, cell: str | None) -> str:
        start = self.ord
        self.ord += 1
        grid = [attr(c, "w") for c in (child(e, "tblGrid") if child(e, "tblGrid") is not None else ()) if local(c) == "gridCol"][:MOST_GRID]
        rows, out = [r for r in e if local(r) == "tr"], []
        open_: dict[int, dict] = {}
        lines, header_run, headers = [], True, 0
        for ri, r in enumerate(rows):
            pr = child(r, "trPr")
            header = bool(on(child(pr, "tblHeader")))
            header_run = header_run and header
            headers += header_run
            before = value(pr, "gridBefore") or "0"
            at = int(before) if before.isdigit() else 0
            cells = [c for x in r for c in ([x] if local(x) == "tc" else list(child(x, "sdtContent")) if local(x) == "sdt" and child(x, "sdtContent") is not None else ()) if local(c) == "tc"]
            texts = []
            for ci, c in enumerate(cells):
                tp = child(c, "tcPr")
                span = value(tp, "gridSpan") or "1"
                span = max(1, int(span)) if span.isdigit() else 1
                merge = child(tp, "vMerge")
                state = None if merge is None else attr(merge, "val") or "continue"
                text = " ".join(t.replace("\n", " ") for t in self.blocks(c, story, f"{path}.r{ri:06d}.c{ci:06d}.", depth + 1, path) if t.strip())
                texts.append(text)
                if state == "continue" and at in open_:
                    open_[at]["row_span"] += 1
                else:
                    row = {"row": ri, "cell": ci, "grid_col": at, "col_span": span, "row_span": 1, "is_header": header, "vmerge": state, "text": text, "width": value_attr(tp, "tcW", "w"), "shading": value_attr(tp, "shd", "fill"), "valign": value(tp, "vAlign")}
                    out.append(row)
                    open_.pop(at, None)
                    if state:
                        open_[at] = row
                at += span
            lines.append("\t".join(texts))
        columns = max((c["grid_col"] + c["col_span"] for c in out), default=0)
        simple = all(c["col_span"] == 1 and c["row_span"] == 1 for c in out)
        self.emit("block", start, story, path, kind="table", rows=len(rows), columns=columns, simple=simple, header_rows=headers, nested=cell is not None, in_table=cell, widths=",".join(w or "" for w in grid) or None, lines="\n".join(lines))
        for c in out:
            self.emit("cell", start, story, path, text=c["text"], nested=cell is not None, **{k: v for k, v in c.items() if k != "text"})
        self.doc.table(f"{story}:{path}", out)
        return "\n".join(lines)

    def paragraph(self, e: Element, story: str, path: str, cell: str | None) -> str:
        ppr = child(e, "pPr")
        style = value(ppr, "pStyle")
        num, level = value(ppr, "numPr", "numId") or self.styles.get(style, "num_id"), value(ppr, "numPr", "ilvl") or self.styles.get(style, "ilvl") or "0"
        label, ordered, full = self.numbering.label(num, int(level)) if num and num != "0" and level.isdigit() else (None, False, None)
        outline = value(ppr, "outlineLvl")
        heading = self.styles.heading(style) or (int(outline) + 1 if outline and outline.isdigit() and int(outline) < 9 else None)
        start, pos = self.ord, self.doc.paragraph_start(story, heading, style, (self.styles.by_id.get(style or "") or {}).get("name"), label, full)
        self.ord += 1
        self.begin_bookmarks()
        if on(child(ppr, "pageBreakBefore")) and start:
            self.page_break()
        out: list[str] = []
        self.doc.path = path
        run = Runs(self, story, path, style, out)
        run.walk(e)
        text = "".join(out)
        self.doc.paragraph_end(pos, text)
        pieces = [text.replace("\f", "\n")] if cell or "\f" not in text else text.split("\f")
        for i, piece in enumerate(pieces):  # a paragraph with page breaks is several, blank ones left out
            if i:
                self.emit("block", start, story, f"{path}.b{i:06d}", kind="break", page=self.page)
            if len(pieces) > 1 and not piece.strip():
                continue
            self.block(ppr, e, start, story, f"{path}.b{i:06d}p" if i else path, piece, style, heading, level, label, ordered, num, cell)
        if (s := child(ppr, "sectPr")) is not None:
            self.section_break(value(s, "type") or "nextPage")
        return text

    def block(self, ppr, e, start, story, path, text, style, heading, level, label, ordered, num, cell) -> None:
        self.emit(
            "block", start, story, path, text=text, kind="paragraph", style_id=style, style_name=(self.styles.by_id.get(style or "") or {}).get("name"), heading_level=heading, align=value(ppr, "jc") or self.styles.get(style, "align"),
            list_level=level if label or ordered else None, list_ordered=ordered if num else None, list_label=label, num_id=num, in_table=cell, page=self.page, section=self.section, bidi=on(child(ppr, "bidi")), para_id=attr(e, "paraId"),
        )

    def page_break(self) -> None:
        self.page += 1
        self.doc.at(self.page, self.section)

    def section_break(self, kind: str) -> None:
        self.section += 1
        if kind != "continuous":
            self.page += 1
            if (kind == "evenPage" and self.page % 2) or (kind == "oddPage" and not self.page % 2):
                self.page += 1
        self.doc.at(self.page, self.section)


def value_attr(e: Element | None, name: str, key: str) -> str | None:
    c = child(e, name)
    return attr(c, key) if c is not None else None


class Runs:
    """A paragraph's content in order: runs, links, fields, bookmarks, comments, notes, revisions, drawings."""

    def __init__(self, reader: Reader, story: str, path: str, style: str | None, out: list[str]):
        self.r, self.story, self.path, self.style, self.out = reader, story, path, style, out
        self.n, self.url, self.revision = 0, None, None

    def walk(self, e: Element) -> None:
        for c in e:
            kind = local(c)
            handler = getattr(self, f"on_{kind}", None)
            if handler:
                handler(c)
            elif kind == "AlternateContent":
                self.alternate(c)
                for x in chosen(c):
                    self.walk([x])
            elif kind in ("smartTag", "customXml", "dir", "bdo"):
                self.walk(c)

    def alternate(self, e: Element) -> None:
        """A shape without an anchor of its own."""
        names = {local(x) for x in inner(e)}
        if names & {"drawing", "pict"} and "anchor" not in names:
            self.r.emit("mark", story=self.story, name="alternate_drawing")

    def on_r(self, e: Element) -> None:
        rpr = child(e, "rPr")
        props = run_properties(rpr)
        char_style = value(rpr, "rStyle")
        full = {k: v if v is not None else self.r.styles.get(char_style, k) if self.r.styles.get(char_style, k) is not None else self.r.styles.get(self.style, k) for k, v in props.items()}
        text: list[str] = []
        for c in e:
            self.piece(c, text)
        self.flush("".join(text), full)

    def piece(self, c: Element, text: list[str]) -> None:
        kind, doc = local(c), self.r.doc
        if kind == "AlternateContent":
            self.alternate(c)
            for x in chosen(c):
                self.piece(x, text)
        elif kind in ("t", "delText"):
            text.append((c.text or "").translate(NO_MARKS))
        elif kind in MARKS:
            text.append(MARKS[kind])
        elif kind == "br":
            if attr(c, "type") == "page":
                text.append("\f")
                self.r.page_break()
            else:
                text.append("\n")
        elif kind == "lastRenderedPageBreak":
            doc.rendered_breaks += 1
        elif kind == "sym":
            text.append(symbol(c))
        elif kind == "fldChar":
            self.flush("".join(text), {})
            text.clear()
            self.out.append(doc.field_char(attr(c, "fldCharType") or "", self.story, c))
        elif kind in ("instrText", "delInstrText"):
            doc.instruction(c.text or "")
        elif kind in ("footnoteReference", "endnoteReference"):
            note = kind.removesuffix("Reference")
            custom = attr(c, "customMarkFollows") in ("1", "true", "on")
            doc.note_reference(note, attr(c, "id"), custom)
            self.r.emit("note_reference", story=self.story, path=self.path, name=attr(c, "id"), kind=note, custom=custom, number=doc.last_note_number(note) if not custom else None)
            self.r.ord += 1
        elif kind == "commentReference":
            pass
        elif kind in ("drawing", "pict", "object"):
            self.drawing(c, kind)
        elif kind in ("ruby",):
            self.walk(c)

    def flush(self, text: str, props: dict) -> None:
        if not text:
            return
        doc, gone = self.r.doc, self.revision in ("del", "moveFrom")
        instruction = doc.in_instruction()
        if not instruction:
            self.r.emit("run", story=self.story, path=self.path, text=text, run=self.n, url=self.url or doc.field_url(), revision=self.revision, field_role="result" if doc.open_fields else None, field_order=doc.open_fields[0].order if doc.open_fields else None, **props)
            if not gone:
                self.out.append(text)
                doc.text(text)
        self.n += 1
        self.r.ord += 1

    def on_hyperlink(self, e: Element) -> None:
        rel = self.r.rels.get(attr(e, "id") or "")
        anchor = attr(e, "anchor")
        before, self.url = self.url, (rel["target"] if rel else "") + (f"#{anchor}" if anchor else "") or None
        self.r.emit("hyperlink", story=self.story, path=self.path, name=attr(e, "id"), text=plain_text(e), url=self.url, anchor=anchor)
        self.walk(e)
        self.url = before

    def on_fldSimple(self, e: Element) -> None:
        doc = self.r.doc
        doc.field_char("begin", self.story, e)
        doc.instruction(attr(e, "instr") or "")
        self.out.append(doc.field_char("separate", self.story, e))
        self.walk(e)
        self.out.append(doc.field_char("end", self.story, e))

    def on_sdt(self, e: Element) -> None:
        self.r.content_control(e, self.story)
        inside = child(e, "sdtContent")
        if inside is not None:
            self.walk(inside)

    def on_bookmarkStart(self, e: Element) -> None:
        self.r.doc.bookmark_start(attr(e, "id"), attr(e, "name"), self.r.ord, self.r.page)

    def on_bookmarkEnd(self, e: Element) -> None:
        self.r.doc.bookmark_end(attr(e, "id"), self.r.ord)

    def on_commentRangeStart(self, e: Element) -> None:
        self.r.doc.comment_start(attr(e, "id"))

    def on_commentRangeEnd(self, e: Element) -> None:
        self.r.doc.comment_end(attr(e, "id"))

    def revised(self, e: Element, kind: str) -> None:
        self.r.emit("revision", story=self.story, path=self.path, name=attr(e, "id"), text=plain_text(e, deleted=True), kind=kind, author=attr(e, "author"), date=attr(e, "date"))
        before, self.revision = self.revision, kind
        self.walk(e)
        self.revision = before

    def on_ins(self, e: Element) -> None:
        self.revised(e, "ins")

    def on_del(self, e: Element) -> None:
        self.revised(e, "del")

    def on_moveFrom(self, e: Element) -> None:
        self.revised(e, "moveFrom")

    def on_moveTo(self, e: Element) -> None:
        self.revised(e, "moveTo")

    def drawing(self, e: Element, kind: str) -> None:
        every = list(inner(e))
        if kind == "object" or any(local(x) == "OLEObject" for x in every):
            self.r.emit("ole_object", story=self.story, path=self.path, name=next((attr(x, "id") for x in every if local(x) == "OLEObject"), None))
        for x in [e, *every]:
            if local(x) == "anchor" or (local(x) in ("shape", "rect", "roundrect", "oval", "group") and kind == "pict" and "position:absolute" in (attr(x, "style") or "")):
                ext, wrap = child(x, "extent"), next((local(c)[4:].lower() for c in x if local(c).startswith("wrap")), None)
                props = child(x, "docPr")
                place = lambda n: next((v for c in x if local(c) == n for v in [next((d.text for d in c if local(d) == "posOffset"), None)]), None)  # noqa: B023, E731
                self.r.emit(
                    "shape", story=self.story, path=self.path, name=attr(props, "name") if props is not None else attr(x, "id"), text="", width=attr(ext, "cx") if ext is not None else None, height=attr(ext, "cy") if ext is not None else None,
                    x=place("positionH"), y=place("positionV"), wrap=wrap, behind=attr(x, "behindDoc") == "1", z=attr(x, "relativeHeight"), anchored=local(x) == "anchor",
                )
            if local(x) == "txbxContent":
                text = "\n".join(t for t in (plain_text(p) for p in x if local(p) == "p") if t)
                self.r.emit("text_box", story=self.story, path=self.path, text=text)
                self.r.ord += 1


def open_docx(data: bytes, wanted: set[str] | None = None, context: dict | None = None) -> list[dict]:
    """All records of a package. Fields are evaluated at the end, when every bookmark, page and style is known."""
    package = Package.read(data)
    r = Reader(package, wanted, context)
    r.doc.file_size = len(data)
    r.package_records()
    r.body()
    r.other_stories()
    evaluated = r.doc.evaluate()
    shown: set[int] = set()
    for row in r.rows:  # texts were gathered with marks around fields; now the computed results are known
        if row["tag"] == "run" and (n := row["fields"].pop("field_order", None)) is not None and evaluated[int(n)].computed is not None:
            f, first = evaluated[int(n)], int(n) not in shown
            shown.add(int(n))
            row["text"] = f.computed if first else ""
        row["text"] = r.doc.resolve(row["text"])
        if row["tag"] == "comment" and (anchor := r.doc.comment_anchor(row["name"])) is not None:
            row["fields"]["anchor"] = anchor
        if row["tag"] == "note":
            if (anchor := r.doc.note_anchor(row["fields"].pop("note_kind"), row["name"])) is not None:
                row["fields"]["anchor"] = anchor
    for i, (name, b) in enumerate(r.doc.bookmarks.items()):
        r.emit("bookmark", i, name=name, text=r.doc.resolve(b["text"]), start=b["start"], end=b["end"], page=b["page"], number=b["number"], full_number=b["full"])
    for i, f in enumerate(evaluated):
        r.emit("field", i, story=f.story, name=f.kind, text=f.instruction, token=f.token, cached_result=f.cached, computed_result=f.computed, unsupported_reason=f.reason, url=f.url)
    if wanted is None or "mark" in wanted:
        for name in (r.main, r.names["footnotes"], r.names["endnotes"]):
            for e in inner(package.xml(name)) if name in package.parts else ():
                n = local(e)
                if n in REVISIONS or n in PROPERTY_CHANGES or n in ("sdt", "hyperlink", "fldSimple"):
                    r.emit("mark", story=name, name="property_change" if n in PROPERTY_CHANGES else n)
    return r.rows
