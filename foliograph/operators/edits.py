"""Edits of packages: each touches the parts it must, the others keep their bytes; a document's edits are all or nothing.

In a table of edits, a row is one operation on one document. They are applied in order within the document, in the task
that holds it; a refused operation leaves the document as it was, with the reason in `error`.
"""

from __future__ import annotations

import copy
import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packages import Package, Refused, attr, image_size, local, mime_of, resolve
from ..sources.wml import child, chosen, plain_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
NOTES = {"footnote": "word/footnotes.xml", "endnote": "word/endnotes.xml"}


class EditError(Exception):
    pass


def _descendants(e: ET.Element, skip: tuple[str, ...] = ("del", "moveFrom")):
    """Elements below in order, one branch of alternate content, without deleted content."""
    for c in e:
        if local(c) == "AlternateContent":
            for x in chosen(c):
                yield x
                yield from _descendants(x, skip)
        elif local(c) not in skip:
            yield c
            yield from _descendants(c, skip)


class Edit:
    """A package being edited. Part trees are made when they are first touched."""

    def __init__(self, data: bytes):
        self.package = Package.read(data)
        self.trees: dict[str, ET.Element] = {}
        self.spaces: dict[str, list[tuple[str, str]]] = {}
        main = next((resolve("", r["target"]) for r in self.package.rels("") if r["type"].endswith("/officeDocument")), "word/document.xml")
        if main not in self.package.parts:
            raise Refused("Docx", "missing word/document.xml")
        self.main = main

    def tree(self, part: str) -> ET.Element:
        if part not in self.package.parts:
            raise EditError(f"no part {part}")
        if part not in self.trees:
            body = self.package.parts[part]
            spaces = [x for _, x in ET.iterparse(io.BytesIO(body), events=("start-ns",))]
            self.spaces[part] = list(dict.fromkeys(spaces))
            self.trees[part] = self.package.xml(part)
        return self.trees[part]

    def touch(self, part: str) -> None:
        self.package.touched.add(part)

    def edited_parts(self) -> list[str]:
        return [p for p in self.package.parts if p in self.package.touched]

    def snapshot(self):
        return dict(self.package.parts), set(self.package.touched), copy.deepcopy(self.trees)

    def restore(self, held) -> None:
        self.package.parts, self.package.touched, self.trees = held

    def save(self) -> bytes:
        for part in self.package.touched & set(self.trees):
            for prefix, uri in self.spaces[part]:
                if prefix and not re.fullmatch(r"ns\d+", prefix):
                    ET.register_namespace(prefix, uri)
            out = ET.tostring(self.trees[part], encoding="unicode")
            head = out[: out.index(">")]
            more = "".join(f' xmlns:{p}="{u}"' for p, u in self.spaces[part] if p and f"xmlns:{p}=" not in head)  # Ignorable may name prefixes that no element uses
            at = len(re.match(r"<[^\s/>]+", out)[0])
            self.package.parts[part] = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + out[:at] + more + out[at:]).encode()
        return self.package.save()

    @property
    def body(self) -> ET.Element:
        b = child(self.tree(self.main), "body")
        if b is None:
            raise EditError("no body")
        return b

    # text

    @staticmethod
    def set_text(t: ET.Element, text: str) -> None:
        t.text = text
        if text != text.strip() or "  " in text:
            t.set(XML_SPACE, "preserve")

    def _replace(self, part: str, root: ET.Element, old: str, new: str) -> int:
        """Replaces in paragraphs; a match across runs goes into the run where it begins, with that run's format."""
        if not old:
            raise EditError("nothing to replace")
        n = 0
        for p in [root] if local(root) == "p" else [x for x in _descendants(root) if local(x) == "p"]:
            ts = [x for x in _descendants(p) if local(x) == "t"]
            whole = "".join(t.text or "" for t in ts)
            at, spots = 0, []
            while (at := whole.find(old, at)) >= 0:
                spots.append(at)
                at += len(old)
            if not spots:
                continue
            bounds, pos = [], 0
            for t in ts:
                bounds.append((pos, pos + len(t.text or "")))
                pos = bounds[-1][1]
            pieces = [""] * len(ts)
            at = 0
            marks = spots + [None]
            owner = lambda x: next(i for i, (a, b) in enumerate(bounds) if a <= x < b)  # noqa: B023, E731
            for spot in marks:
                stop = len(whole) if spot is None else spot
                for i, (a, b) in enumerate(bounds):
                    pieces[i] += whole[max(a, at) : min(b, stop)] if max(a, at) < min(b, stop) else ""
                if spot is not None:
                    pieces[owner(spot)] += new
                    at = spot + len(old)
            for t, x in zip(ts, pieces):
                self.set_text(t, x)
            n += len(spots)
        if n:
            self.touch(part)
        return n

    def replace_body_text(self, old: str, new: str) -> int:
        return self._replace(self.main, self.body, old, new)

    def replace_header_footer_text(self, old: str, new: str) -> int:
        parts = [resolve(self.main, r["target"]) for r in self.package.rels(self.main) if r["type"].rpartition("/")[2] in ("header", "footer")]
        return sum(self._replace(p, self.tree(p), old, new) for p in dict.fromkeys(parts) if p in self.package.parts)

    def replace_note_text(self, kind: str, old: str, new: str) -> int:
        if kind not in NOTES:
            raise EditError(f"unknown note kind {kind}")
        part = NOTES[kind]
        if part not in self.package.parts:
            return 0
        return sum(self._replace(part, n, old, new) for n in self.tree(part) if local(n) == kind and attr(n, "type") in (None, "normal"))

    def replace_text_in_part(self, part: str, old: str, new: str) -> int:
        return self._replace(part, self.tree(part), old, new)

    # fields

    def fields_in_part(self, part: str | None = None) -> list[dict]:
        """(instruction, result, text elements of the result) of each field, in order."""
        part = part or self.main
        out, stack = [], []
        for e in _descendants(self.tree(part)):
            n = local(e)
            if n == "fldSimple":
                ts = [t for t in _descendants(e) if local(t) == "t"]
                out.append({"instruction": attr(e, "instr") or "", "texts": ts})
            elif n == "fldChar":
                kind = attr(e, "fldCharType")
                if kind == "begin":
                    stack.append({"instruction": "", "texts": [], "open": False})
                    out.append(stack[-1])
                elif kind == "separate" and stack:
                    stack[-1]["open"] = True
                elif kind == "end" and stack:
                    stack.pop()
            elif n == "instrText" and stack and not stack[-1]["open"]:
                stack[-1]["instruction"] += e.text or ""
            elif n == "t":
                for f in stack:
                    if f["open"]:
                        f["texts"].append(e)
        return [f | {"result": "".join(t.text or "" for t in f["texts"])} for f in out]

    def set_field_result(self, index: int, text: str, part: str | None = None) -> int:
        part = part or self.main
        fields = self.fields_in_part(part)
        if not 0 <= index < len(fields):
            raise EditError("no such field")
        ts = fields[index]["texts"]
        if not ts:
            raise EditError("the field has no result to set")
        self.set_text(ts[0], text)
        for t in ts[1:]:
            self.set_text(t, "")
        self.touch(part)
        return 1

    # blocks

    def body_blocks(self) -> list[ET.Element]:
        return [e for e in self.body if local(e) in ("p", "tbl", "sdt")]

    def _block(self, i: int) -> ET.Element:
        blocks = self.body_blocks()
        if not 0 <= i < len(blocks):
            raise EditError("block index out of range")
        return blocks[i]

    @staticmethod
    def _ends_section(e: ET.Element) -> bool:
        return any(local(x) == "sectPr" for x in _descendants(e))

    def move_body_block(self, source: int, target: int) -> int:
        e, to = self._block(source), self._block(target)
        low, high = sorted((source, target))
        if any(map(self._ends_section, self.body_blocks()[low : high + 1])):
            raise EditError("a section ends between the blocks")
        if source != target:
            self.body.remove(e)
            at = list(self.body).index(to)
            self.body.insert(at + (source < target), e)
            self.touch(self.main)
        return 1

    def remove_body_block(self, index: int) -> int:
        e = self._block(index)
        if self._ends_section(e):
            raise EditError("the block ends a section")
        self.body.remove(e)
        if not self.body_blocks():
            self.body.insert(0, ET.Element(W + "p"))
        self.touch(self.main)
        return 1

    def insert_body_paragraph(self, index: int, text: str) -> int:
        blocks = self.body_blocks()
        if not 0 <= index <= len(blocks):
            raise EditError("block index out of range")
        p = self._paragraph(text)
        at = list(self.body).index(blocks[index]) if index < len(blocks) else list(self.body).index(blocks[-1]) + 1 if blocks else 0
        self.body.insert(at, p)
        self.touch(self.main)
        return 1

    def _paragraph(self, text: str) -> ET.Element:
        p = ET.Element(W + "p")
        t = ET.SubElement(ET.SubElement(p, W + "r"), W + "t")
        self.set_text(t, text)
        return p

    # controls, tables, revisions

    def fill_content_controls_by_tag(self, tag: str, text: str, only_one: bool = False) -> int:
        found = [e for e in _descendants(self.body) if local(e) == "sdt" and (c := child(e, "sdtPr", "tag")) is not None and attr(c, "val") == tag]
        if not found or (only_one and len(found) > 1):
            raise EditError(f"{len(found)} content controls have the tag {tag}")
        for e in found:
            content = child(e, "sdtContent")
            ts = [t for t in _descendants(content) if local(t) == "t"] if content is not None else []
            if not ts:
                raise EditError("the control holds no text")
            if any(local(x) == "sdt" for x in _descendants(content)):
                raise EditError("controls overlap")
            self.set_text(ts[0], text)
            for t in ts[1:]:
                self.set_text(t, "")
        self.touch(self.main)
        return len(found)

    def fill_content_control_by_tag(self, tag: str, text: str) -> int:
        return self.fill_content_controls_by_tag(tag, text, True)

    def fill_template_fields(self, values: dict[str, str]) -> int:
        """Fills merge fields by name, all or none; a name that is empty or that no field has is refused."""
        from ..functions.fields import kind_of, parse, parts_of, unquote

        if not values or any(not k.strip() for k in values):
            raise EditError("empty name")
        folded = [k.strip().lower() for k in values]
        if len(set(folded)) != len(folded):
            raise EditError("duplicate name")
        todo, seen = [], set()
        for i, f in enumerate(self.fields_in_part()):
            if kind_of(f["instruction"])[0] == "MergeField":
                p = parse(parts_of(f["instruction"])[1:], flags="mv", values="bf")
                name = " ".join(map(unquote, p.operands)).lower()
                for k, v in values.items():
                    if k.strip().lower() == name:
                        todo.append((i, (p.switches.get("b", "") + v + p.switches.get("f", "")) if v else ""))
                        seen.add(k)
        if missing := set(values) - seen:
            raise EditError(f"no field for {sorted(missing)[0]}")
        for i, v in todo:
            self.set_field_result(i, v)
        return len(todo)

    def accept_all_revisions(self) -> int:
        return sum(self._revise(p, True) for p in self._story_parts())

    def reject_all_revisions(self) -> int:
        return sum(self._revise(p, False) for p in self._story_parts())

    def _story_parts(self) -> list[str]:
        more = [resolve(self.main, r["target"]) for r in self.package.rels(self.main) if r["type"].rpartition("/")[2] in ("header", "footer", "footnotes", "endnotes")]
        return [p for p in dict.fromkeys([self.main, *more]) if p in self.package.parts]

    def _revise(self, part: str, accept: bool) -> int:
        keep = {"ins", "moveTo"} if accept else {"del", "moveFrom"}
        gone = {"del", "moveFrom"} if accept else {"ins", "moveTo"}
        n = 0

        def walk(e: ET.Element) -> None:
            nonlocal n
            i = 0
            while i < len(e):
                c, name = e[i], local(e[i])
                if name in gone and local(e) not in ("rPr", "trPr"):
                    e.remove(c)
                    n += 1
                elif name in keep and local(e) not in ("rPr", "trPr"):
                    e.remove(c)
                    for j, x in enumerate(list(c)):
                        e.insert(i + j, x)
                    n += 1
                elif name.endswith("Change") and name[:3] in ("pPr", "rPr", "sec", "tbl", "trP", "tcP"):
                    if not accept and len(c):  # the properties before the change come back
                        old = list(c[0])
                        for x in list(e):
                            e.remove(x)
                        e.extend(old)
                        n += 1
                        return
                    e.remove(c)
                    n += 1
                elif name in ("moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd") or (name in ("ins", "del") and local(e) in ("rPr", "trPr")):
                    e.remove(c)
                else:
                    if not accept and name == "delText":
                        c.tag = W + "t"
                    walk(c)
                    i += 1

        walk(self.tree(part))
        if n:
            self.touch(part)
        return n

    def set_table_cell_text(self, table: int, row: int, column: int, text: str) -> int:
        """Sets the cell that holds a logical column; within a vertical merge, the cell that owns it."""
        tables = [e for e in self.body_blocks() if local(e) == "tbl"]
        if not 0 <= table < len(tables):
            raise EditError("no such table")
        rows = [r for r in tables[table] if local(r) == "tr"]
        if not 0 <= row < len(rows):
            raise EditError("no such row")

        def find(r: ET.Element):
            at = 0
            for c in (x for x in r if local(x) == "tc"):
                span = child(c, "tcPr", "gridSpan")
                n = int(attr(span, "val") or 1) if span is not None else 1
                if at <= column < at + n:
                    return c
                at += n
            return None

        i = row
        cell = find(rows[i])
        while cell is not None and (m := child(cell, "tcPr", "vMerge")) is not None and (attr(m, "val") or "continue") == "continue" and i:
            i -= 1
            cell = find(rows[i])
        if cell is None:
            raise EditError("no such column")
        if any(local(x) == "tbl" for x in cell):
            raise EditError("the cell holds a table")
        ps = [p for p in cell if local(p) == "p"]
        ts = [t for t in _descendants(cell) if local(t) == "t"]
        if ts:
            self.set_text(ts[0], text)
            for t in ts[1:]:
                self.set_text(t, "")
        elif ps:
            ps[0].append(self._paragraph(text)[0])
        else:
            cell.append(self._paragraph(text))
        self.touch(self.main)
        return 1

    # links, comments, notes, images, properties

    def _rels_part(self, source: str) -> str:
        folder, _, leaf = source.rpartition("/")
        return f"{folder}/_rels/{leaf}.rels"

    def set_hyperlink_target(self, rid: str, url: str) -> int:
        part = self._rels_part(self.main)
        for r in self.tree(part) if part in self.package.parts else ():
            if attr(r, "Id") == rid and (attr(r, "Type") or "").endswith("/hyperlink"):
                if attr(r, "TargetMode") != "External":
                    raise EditError("the link is internal")
                r.set("Target", url)
                self.touch(part)
                return 1
        raise EditError(f"no hyperlink {rid}")

    def _add_rel(self, kind: str, target: str) -> str:
        part = self._rels_part(self.main)
        if part not in self.package.parts:
            self.package.parts[part] = b'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>'
        root = self.tree(part)
        ids = {attr(r, "Id") for r in root}
        rid = next(f"rIdE{i}" for i in range(1, len(ids) + 2) if f"rIdE{i}" not in ids)
        ns = root.tag.partition("}")[0] + "}"
        ET.SubElement(root, ns + "Relationship", {"Id": rid, "Type": f"http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}", "Target": target})
        self.touch(part)
        return rid

    def _add_type(self, part: str | None, suffix: str | None, kind: str) -> None:
        root = self.tree("[Content_Types].xml")
        ns = root.tag.partition("}")[0] + "}"
        if part and not any(attr(e, "PartName") == "/" + part for e in root):
            ET.SubElement(root, ns + "Override", {"PartName": "/" + part, "ContentType": kind})
        elif suffix and not any((attr(e, "Extension") or "").lower() == suffix for e in root):
            root.insert(0, ET.Element(ns + "Default", {"Extension": suffix, "ContentType": kind}))
        else:
            return
        self.touch("[Content_Types].xml")

    def _side_part(self, kind: str) -> str:
        """The comments, footnotes or endnotes part, made if there is none."""
        part = next((resolve(self.main, r["target"]) for r in self.package.rels(self.main) if r["type"].endswith("/" + kind)), None)
        if part is None or part not in self.package.parts:
            part = f"word/{kind}.xml"
            self.package.parts[part] = f'<?xml version="1.0"?><w:{kind} xmlns:w="{W[1:-1]}"/>'.encode()
            self._add_rel(kind, f"{kind}.xml")
            self._add_type(part, None, f"application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml")
        return part

    def set_comment_text(self, comment: str, text: str) -> int:
        part = self._side_part("comments")
        c = next((c for c in self.tree(part) if local(c) == "comment" and attr(c, "id") == comment), None)
        if c is None:
            raise EditError(f"no comment {comment}")
        ts = [t for t in _descendants(c) if local(t) == "t"]
        if ts:
            self.set_text(ts[0], text)
            for t in ts[1:]:
                self.set_text(t, "")
        else:
            c.append(self._paragraph(text))
        self.touch(part)
        return 1

    def _split_at(self, text: str) -> tuple[ET.Element, list[ET.Element]]:
        """The paragraph and the runs that hold exactly the first occurrence of text; runs are split at its ends."""
        for p in [x for x in _descendants(self.body) if local(x) == "p"]:
            runs = [r for r in p if local(r) == "r"]
            whole = "".join(plain_text(r) for r in runs)
            at = whole.find(text)
            if at < 0 or not text:
                continue
            pos, inside = 0, []
            for r in runs:
                own = "".join(t.text or "" for t in r if local(t) == "t")
                ts = [t for t in r if local(t) == "t"]
                a, b = max(at - pos, 0), min(at + len(text) - pos, len(own))
                pos += len(own)
                if a >= b or not ts:
                    continue
                if len(ts) > 1 or len(plain_text(r)) != len(own):
                    raise EditError("the text runs over marks")
                i = list(p).index(r)
                for k, piece in enumerate((own[:a], own[a:b], own[b:])):
                    if piece or k == 1:
                        x = copy.deepcopy(r)
                        self.set_text(next(t for t in x if local(t) == "t"), piece)
                        p.insert(i, x)
                        i += 1
                        if k == 1:
                            inside.append(x)
                p.remove(r)
            if inside:
                return p, inside
        raise EditError("text not found")

    def add_comment_on_text(self, text: str, comment: str, author: str = "") -> int:
        p, runs = self._split_at(text)
        part = self._side_part("comments")
        root = self.tree(part)
        n = str(1 + max((int(attr(c, "id")) for c in root if (attr(c, "id") or "").isdigit()), default=-1))
        c = ET.SubElement(root, W + "comment", {W + "id": n, W + "author": author})
        c.append(self._paragraph(comment))
        at = list(p).index(runs[0])
        p.insert(at, ET.Element(W + "commentRangeStart", {W + "id": n}))
        at = list(p).index(runs[-1]) + 1
        p.insert(at, ET.Element(W + "commentRangeEnd", {W + "id": n}))
        r = ET.Element(W + "r")
        ET.SubElement(r, W + "commentReference", {W + "id": n})
        p.insert(at + 1, r)
        self.touch(part)
        self.touch(self.main)
        return 1

    def _add_note(self, kind: str, text: str, note: str) -> int:
        p, runs = self._split_at(text)
        part = self._side_part(f"{kind}s")
        root = self.tree(part)
        n = str(1 + max([0, *(int(attr(c, "id")) for c in root if (attr(c, "id") or "").lstrip("-").isdigit())]))
        ET.SubElement(root, W + kind, {W + "id": n}).append(self._paragraph(note))
        r = ET.Element(W + "r")
        ET.SubElement(r, W + f"{kind}Reference", {W + "id": n})
        p.insert(list(p).index(runs[-1]) + 1, r)
        self.touch(part)
        self.touch(self.main)
        return 1

    def add_footnote_on_text(self, text: str, note: str) -> int:
        return self._add_note("footnote", text, note)

    def add_endnote_on_text(self, text: str, note: str) -> int:
        return self._add_note("endnote", text, note)

    def _checked(self, name: str, content: bytes) -> tuple[int, int]:
        size = image_size(content, mime_of(name))
        if size is None or not all(0 < x < 1 << 16 for x in size):
            raise EditError("not an image of its kind")
        return size

    def add_image(self, name: str, content: bytes, alt: str = "") -> int:
        from ..sources.writer import Builder

        self._checked(name, content)
        leaf = name.rpartition("/")[2]
        part = f"word/media/{leaf}"
        if part in self.package.parts:
            raise EditError(f"{part} exists")
        self.package.parts[part] = content
        self.touch(part)
        suffix = leaf.rpartition(".")[2].lower()
        self._add_type(None, suffix, mime_of(leaf))
        rid = self._add_rel("image", f"media/{leaf}")
        b = Builder()
        xml = b.image(leaf, content).replace(b.rels[0][0], rid)
        from ..sources.writer import ROOT

        r = ET.fromstring(f"<x {ROOT}>{xml}</x>")[0]
        p = ET.Element(W + "p")
        p.append(r)
        last = list(self.body)
        self.body.insert(len(last) - 1 if last and local(last[-1]) == "sectPr" else len(last), p)
        self.touch(self.main)
        return 1

    def replace_image(self, part: str, content: bytes) -> int:
        if part not in self.package.parts or "/media/" not in part:
            raise EditError(f"no image {part}")
        self._checked(part, content)
        self.package.parts[part] = content
        self.touch(part)
        return 1

    def set_core_property(self, name: str, value: str) -> int:
        part = "docProps/core.xml"
        if part not in self.package.parts:
            raise EditError("no core properties")
        root = self.tree(part)
        e = next((x for x in root if local(x) == name), None)
        if e is None:
            ns = "http://purl.org/dc/elements/1.1/" if name in ("title", "subject", "creator", "description") else root.tag[1:].partition("}")[0]
            e = ET.SubElement(root, f"{{{ns}}}{name}")
        e.text = value
        self.touch(part)
        return 1


#: Operations that a table of edits may name.
OPERATIONS = {n for n in vars(Edit) if not n.startswith("_")} - {"tree", "touch", "snapshot", "restore", "save", "body", "set_text", "fields_in_part", "body_blocks", "edited_parts"}


class EditSession:
    """Edits that are committed together. An operation that fails changes nothing and doesn't end the session."""

    def __init__(self, data: bytes):
        self.data, self.edit = data, Edit(data)

    def apply(self, op: str, **args) -> int:
        if op not in OPERATIONS:
            raise EditError(f"unknown operation {op}")
        held = self.edit.snapshot()
        try:
            return getattr(self.edit, op)(**args)
        except Exception as x:
            self.edit.restore(held)
            raise x if isinstance(x, EditError) else EditError(f"{type(x).__name__}: {x}") from None

    def commit(self) -> bytes:
        """The package with all edits, checked by opening it again."""
        if not self.edit.package.touched:
            return self.data
        from ..sources.wml import open_docx

        out = self.edit.save()
        open_docx(out, {"block"})
        self.data = out
        return out

    def rollback(self) -> None:
        self.edit = Edit(self.data)


NUMBERS = {"index", "source", "target", "table", "row", "column"}


def edit_documents(files: DataFrame, edits: DataFrame, key: str = "path") -> DataFrame:
    """files (key, content) with the edits (key, ord, op, args: map of strings) applied: key, content, applied, parts, error.

    A document without edits passes as it is. Values of an argument named content are base64; fill_template_fields takes
    its whole map. The join is on the key; a document and its edits meet in one task.
    """
    import base64

    todo = edits.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct("ord", "op", F.to_json("args").alias("args")))).alias("ops"))
    rows = files.select(F.col(key).cast("string").alias("k"), "content").join(todo.withColumn("__k", F.col("__k").cast("string")), F.col("k") == F.col("__k"), "left").select("k", "content", "ops")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for k, content, ops in zip(b["k"], b["content"], b["ops"]):
                data, done, error, parts = bytes(content) if content is not None else None, 0, None, []
                if ops is not None and len(ops):
                    try:
                        s = EditSession(data)
                        for o in ops:
                            args = json.loads(o["args"] or "{}")
                            args = {"values": args} if o["op"] == "fill_template_fields" else {a: int(v) if a in NUMBERS else base64.b64decode(v) if a == "content" else v for a, v in args.items()}
                            s.apply(o["op"], **args)
                            done += 1
                        parts = s.edit.edited_parts()
                        data = s.commit()
                    except (EditError, Refused, ValueError, TypeError) as x:
                        error, done, parts = str(x), 0, []
                out.append((k, data, done, parts, error))
            yield pd.DataFrame(out, columns=["k", "content", "applied", "parts", "error"])

    done = rows.mapInPandas(run, "k string, content binary, applied int, parts array<string>, error string")
    return done.withColumnRenamed("k", key)


def dangling(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships to parts that aren't there, over opened documents: an anti join; none may be left before saving."""
    p = parts.select("doc_id", F.col("name").alias("resolved"))
    return rels.where("NOT external AND resolved IS NOT NULL").join(p, ["doc_id", "resolved"], "left_anti")
