"""Fields: classification, switch grammar, and evaluation against a document's context.

Whatever isn't certain has no computed value, so that the cached result stays.
"""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formula, numbers, pictures
from .text import ColumnOrName, col, instruction_parts

# Kinds of fields and the tokens that they begin with. Fixed values.
KINDS = {
    "Hyperlink": "HYPERLINK", "Page": "PAGE", "Toc": "TOC", "Filename": "FILENAME", "MergeField": "MERGEFIELD", "Ref": "REF", "PageRef": "PAGEREF", "NoteRef": "NOTEREF FTNREF", "TocEntry": "TC",
    "Sequence": "SEQ",
    "DocumentInfo": "APPLICATION APPVERSION AUTHOR CATEGORY CHARACTERS CHARACTERSWITHSPACES COMMENT COMMENTS COMPANY CONTENTSTATUS CREATOR CREATEDATE DATE DESCRIPTION DOCPROPERTY DOCVARIABLE DOCSECURITY "
    "EDITTIME FILESIZE HIDDENSLIDES HYPERLINKBASE HYPERLINKSCHANGED INFO KEYWORD KEYWORDS LASTMODIFIEDBY LASTSAVEDBY LINES LINKSUPTODATE MANAGER MMCLIPS NOTES NUMCHARS NUMPAGES NUMWORDS PAGES "
    "PARAGRAPHS PRINTDATE PRESENTATIONFORMAT SCALECROP SAVEDATE SHAREDDOC SLIDES SUBJECT TEMPLATE TIME TITLE TOTALTIME USERADDRESS USERINITIALS USERNAME VERSION WORDS",
    "Dynamic": "= ASK COMPARE FILLIN IF NEXT NEXTIF QUOTE SET SKIPIF",
    "InsertedContent": "AUTOTEXT AUTOTEXTLIST DATABASE DDE DDEAUTO EMBED IMPORT INCLUDE INCLUDEPICTURE INCLUDETEXT LINK",
    "MailMerge": "ADDRESSBLOCK GREETINGLINE MERGEREC MERGESEQ", "ReferenceIndex": "BIBLIOGRAPHY CITATION INDEX RD TA TOA XE", "Numbering": "AUTONUM AUTONUMLGL AUTONUMOUT BIDIOUTLINE LISTNUM",
    "DocumentStructure": "REVNUM SECTION SECTIONPAGES STYLEREF", "Display": "ADVANCE EQ SYMBOL", "Action": "GOTOBUTTON MACROBUTTON PRINT", "Compatibility": "ADDIN DATA GLOSSARY HTMLACTIVEX PRIVATE",
    "Barcode": "BARCODE DISPLAYBARCODE MERGEBARCODE", "FormField": "FORMTEXT FORMCHECKBOX FORMDROPDOWN",
}
OF_TOKEN = {t: k for k, ts in KINDS.items() for t in ts.split()}

# Aliases of document information and where it is kept. Fixed values.
CORE_NAMES = {
    "AUTHOR": "creator", "CREATOR": "creator", "TITLE": "title", "SUBJECT": "subject", "KEYWORD": "keywords", "KEYWORDS": "keywords", "COMMENT": "description", "COMMENTS": "description",
    "DESCRIPTION": "description", "CATEGORY": "category", "CONTENTSTATUS": "contentStatus", "LASTSAVEDBY": "lastModifiedBy", "LASTMODIFIEDBY": "lastModifiedBy", "LASTAUTHOR": "lastModifiedBy",
    "CREATEDATE": "created", "SAVEDATE": "modified", "PRINTDATE": "lastPrinted", "VERSION": "version", "REVNUM": "revision",
}
EXTENDED_NAMES = {
    "NUMPAGES": "Pages", "PAGES": "Pages", "NUMWORDS": "Words", "WORDS": "Words", "NUMCHARS": "Characters", "CHARACTERS": "Characters", "CHARACTERSWITHSPACES": "CharactersWithSpaces", "LINES": "Lines",
    "PARAGRAPHS": "Paragraphs", "EDITTIME": "TotalTime", "TOTALTIME": "TotalTime", "TEMPLATE": "Template", "COMPANY": "Company", "MANAGER": "Manager", "APPLICATION": "Application", "APPVERSION": "AppVersion",
    "DOCSECURITY": "DocSecurity", "HYPERLINKBASE": "HyperlinkBase", "SLIDES": "Slides", "NOTES": "Notes", "HIDDENSLIDES": "HiddenSlides", "MMCLIPS": "MMClips", "PRESENTATIONFORMAT": "PresentationFormat",
    "SCALECROP": "ScaleCrop", "SHAREDDOC": "SharedDoc", "LINKSUPTODATE": "LinksUpToDate", "HYPERLINKSCHANGED": "HyperlinksChanged",
}
TEXT_FORMATS, NEUTRAL = {"upper", "lower", "caps", "firstcap"}, {"mergeformat", "mergeformatinet", "charformat"}
NUMBER_FORMATS = {"arabic", "arabicdash", "alphabetic", "roman", "ordinal", "cardtext", "ordtext", "hex", "dollartext"}


def kind_of(instruction: str) -> tuple[str, str]:
    words = instruction.split()
    token = words[0].strip('"').upper() if words else ""
    if token.startswith("="):
        token = "="
    return OF_TOKEN.get(token, "Unknown"), token


def classify(instruction: ColumnOrName) -> Column:
    """(kind, token) of a field instruction, as an expression over a literal map."""
    first = F.regexp_replace(F.regexp_extract(col(instruction), r"^\s*(\S*)", 1), '^"+|"+$', "")
    token = F.upper(F.when(first.startswith("="), "=").otherwise(first))
    table = F.create_map(*(F.lit(x) for kv in OF_TOKEN.items() for x in kv))
    return F.struct(F.coalesce(F.try_element_at(table, token), F.lit("Unknown")).alias("kind"), token.alias("token"))


def retype_bookmark_fields(fields: DataFrame, bookmarks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A field of unknown kind whose token names a bookmark is a reference: a semi join, then the kind anew."""
    known = bookmarks.select(doc, F.upper("name").alias("token"), F.lit(True).alias("__is")).distinct()
    out = fields.join(known, [doc, "token"], "left")
    return out.withColumn("kind", F.when((F.col("kind") == "Unknown") & F.col("__is"), "Ref").otherwise(F.col("kind"))).drop("__is")


# Barcode types, and what their switches take. Fixed values.
BARCODES = set("UPCA UPCE JAN13 JAN8 EAN13 EAN8 CASE ITF14 NW7 CODE39 CODE128 JPPOST QR".split())


def _number_within(low: int, high: int, base: int = 10):
    def ok(v: str) -> bool:
        v = v.removeprefix("0X") if base == 16 else v
        return bool(re.fullmatch("[0-9A-F]+" if base == 16 else "[0-9]+", v)) and low <= int(v, base) <= high

    return ok


BARCODE_VALUES = {
    "h": _number_within(0, 1 << 62), "s": _number_within(10, 1000), "q": lambda v: v in ("L", "M", "Q", "H", "0", "1", "2", "3"), "p": lambda v: v in ("STD", "SUP2", "SUP5", "CASE"),
    "c": lambda v: v in ("STD", "EXT", "ADD"), "r": _number_within(0, 3), "f": _number_within(0, 0xFFFFFF, 16), "b": _number_within(0, 0xFFFFFF, 16),
}


class Invalid(Exception):
    pass


def parts_of(instruction: str) -> list[str]:
    return re.findall(r'(?:"[^"]*"?|[^"\s])+', instruction)


def unquote(s: str) -> str:
    """A token without the quotes around it; a quote elsewhere, or without its partner, is invalid."""
    if len(s) > 1 and s[0] == s[-1] == '"':
        s = s[1:-1]
    if '"' in s:
        raise Invalid
    return s


@dataclass
class Parsed:
    operands: list[str] = field(default_factory=list)
    switches: dict[str, str | bool] = field(default_factory=dict)
    text_format: str | None = None
    number_format: str | None = None
    picture: str | None = None
    date: str | None = None


def parse(parts: list[str], flags: str = "", values: str = "", optional: str = "", numeric: bool = False, pictures_too: bool = False, dates: bool = False) -> Parsed:
    """Operands and switches after the token. flags stand alone, values take the next token or what is written right
    behind the letter, optional ones may take one. A switch twice, an unknown one or a missing value is invalid."""
    out, i = Parsed(), 0
    parts = [p for t in parts for p in (re.findall(r"\\[a-zA-Z!]", t) if re.fullmatch(r"(\\[a-zA-Z!]){2,}", t) and all(x in flags for x in t.lower()[1::2]) else [t])]
    while i < len(parts):
        p = parts[i]
        i += 1
        if not p.startswith("\\") or len(p) < 2:
            out.operands.append(p)
            continue
        letter, rest = p[1].lower(), p[2:]
        if letter in "*#@":
            arg = rest or (parts[i] if i < len(parts) else "")
            i += not rest
            arg = unquote(arg)
            if letter == "*":
                low = arg.lower()
                if low in NEUTRAL:
                    continue
                if low in TEXT_FORMATS and out.text_format is None:
                    out.text_format = low
                elif numeric and low in NUMBER_FORMATS and out.number_format is None:
                    out.number_format = arg
                else:
                    raise Invalid
            elif letter == "#" and pictures_too and out.picture is None:
                out.picture = arg
            elif letter == "@" and dates and out.date is None:
                out.date = arg
            else:
                raise Invalid
            continue
        if letter in out.switches:
            raise Invalid
        if letter in flags and not rest:
            out.switches[letter] = True
        elif letter in values:
            if not rest and (i >= len(parts) or (parts[i].startswith("\\") and len(parts[i]) == 2)):
                raise Invalid
            out.switches[letter] = unquote(rest or parts[i])
            i += not rest
        elif letter in optional:
            if not rest and i < len(parts) and not parts[i].startswith("\\"):
                rest, i = parts[i], i + 1
            out.switches[letter] = unquote(rest) if rest else True
        else:
            raise Invalid
    return out


def shaped(text: str | None, how: str | None) -> str | None:
    if text is None or how is None:
        return text
    if how == "upper":
        return text.upper()
    if how == "lower":
        return text.lower()
    if how == "firstcap":
        return re.sub(r"[^\W\d_]", lambda m: m[0].upper(), text, count=1)
    return re.sub(r"(?<![^\W_])[^\W\d_]", lambda m: m[0].upper(), text)


def matches(text: str, pattern: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def compared(a: str, op: str, b: str) -> bool | None:
    """Numbers with numbers, text with text by = and <> and wildcards; a mix has no answer."""
    values = []
    for x in (a, b):
        try:
            values.append(formula.number(x))
        except formula.Failed:
            values.append(None)
    x, y = values
    if x is not None and y is not None:
        near = abs(x - y) < formula.EPSILON
        return {"=": near, "<>": not near, "<": x < y and not near, "<=": x < y or near, ">": x > y and not near, ">=": x > y or near}[op]
    if x is not None or y is not None or op not in ("=", "<>"):
        return None
    wild = lambda s: "*" in s or "?" in s
    same = matches(a, b) if wild(b) else matches(b, a) if wild(a) else a == b
    return same == (op == "=")


OPERATOR = re.compile(r"<>|<=|>=|=|<|>")

#: Around the cached result of an outermost field, in texts that are gathered before fields are evaluated: noncharacters,
#: which no text should hold, with the field's number.
MARKED = re.compile("\ufdd0(\\d+)\ufdd1([^\ufdd0\ufdd2]*)\ufdd2")
STRAY = re.compile("\ufdd0\\d+\ufdd1|\ufdd2")


@dataclass
class Found:
    """One field of a document."""

    story: str
    order: int
    para: int
    page: int
    section: int
    instruction: str = ""
    cached: str = ""
    computed: str | None = None
    reason: str | None = None
    kind: str = "Unknown"
    token: str = ""
    url: str | None = None
    phase: str = "instruction"
    form: dict | None = None
    notes: tuple = ()
    path: str = ""
    done: bool = False


class Document:
    """What fields refer to, gathered while a document is read, and their evaluation in source order."""

    def __init__(self, properties: dict[str, dict[str, str]], context: dict | None = None):
        self.properties, self.context = properties, context or {}
        self.paragraphs: list[dict] = []
        self.bookmarks: dict[str, dict] = {}
        self.active: dict[str, str] = {}
        self.comments: dict[str, list[str]] = {}
        self.commenting: set[str] = set()
        self.fields: list[Found] = []
        self.open_fields: list[Found] = []
        self.page, self.section, self.rendered_breaks, self.file_size = 1, 1, 0, 0
        self.notes: dict[tuple[str, str], dict] = {}
        self.note_counts: dict[str, int] = {}
        self.section_pages: dict[int, list[int]] = {1: [1, 1]}
        self.grids: dict[str, list[dict]] = {}
        self.path = ""
        self.trying: list[Found] = []
        self.local: dict[str, str] = {}

    # gathering

    def paragraph_start(self, story, heading, style_id, style_name, label, full) -> int:
        self.paragraphs.append({"story": story, "heading": heading, "style_id": style_id, "style": style_name, "label": label, "full": full, "text": "", "page": self.page, "section": self.section})
        for name in self.active.values():
            if self.bookmarks[name]["text"]:
                self.bookmarks[name]["text"] += "\n"
        return len(self.paragraphs) - 1

    def paragraph_end(self, at: int, text: str) -> None:
        self.paragraphs[at]["text"] = text

    def at(self, page: int, section: int) -> None:
        self.page, self.section = page, section
        pages = self.section_pages.setdefault(section, [page, page])
        pages[1] = page

    def table(self, path: str, cells: list[dict]) -> None:
        self.grids[path] = cells

    def text(self, text: str) -> None:
        for f in self.open_fields:
            if f.phase == "result":
                f.cached += text
        for name in self.active.values():
            self.bookmarks[name]["text"] += text.replace("\f", "")
        for c in self.commenting:
            self.comments[c].append(text)

    def mark(self, mark: str) -> str:
        for name in self.active.values():
            self.bookmarks[name]["text"] += mark
        for c in self.commenting:
            self.comments[c].append(mark)
        return mark

    def resolve(self, text: str | None) -> str | None:
        """A gathered text with fields' computed results, or the cached ones where there are none."""
        if text is None or not STRAY.search(text):
            return text

        def result(m: re.Match) -> str:
            f = self.fields[int(m[1])]
            value = f.computed if f.done else self.early(f)
            return m[2] if value is None else value

        return STRAY.sub("", MARKED.sub(result, text))

    def early(self, f: Found) -> str | None:
        """The value of a field that comes later, if it depends on no counter; guarded against references in a circle."""
        if f in self.trying or kind_of(f.instruction)[1] not in ("=", "IF", "COMPARE", "QUOTE", "REF"):
            return None
        self.trying.append(f)
        try:
            f.kind, f.token = kind_of(f.instruction)
            return self.value(f)
        except (Invalid, KeyError):
            return None
        finally:
            self.trying.pop()

    def field_char(self, kind: str, story: str, element=None) -> str:
        """Follows a field's characters; returns the mark that belongs into the text there, for an outermost field."""
        if kind == "begin":
            f = Found(story, len(self.fields) + len(self.open_fields), len(self.paragraphs) - 1, self.page, self.section, form=form_data(element), path=self.path)
            f.order = len(self.fields)
            self.open_fields.append(f)
            self.fields.append(f)
        elif self.open_fields and kind == "separate":
            self.open_fields[-1].phase = "result"
            f = self.open_fields[-1]
            if kind_of(f.instruction)[0] == "Hyperlink":
                f.url = hyperlink_target(f.instruction)
            if len(self.open_fields) == 1:
                return self.mark(f"\ufdd0{f.order}\ufdd1")
        elif self.open_fields and kind == "end":
            f = self.open_fields.pop()
            if not self.open_fields and f.phase == "result":
                return self.mark("\ufdd2")
        return ""

    def instruction(self, text: str) -> None:
        if self.open_fields and self.open_fields[-1].phase == "instruction":
            self.open_fields[-1].instruction += text

    def in_instruction(self) -> bool:
        return bool(self.open_fields) and self.open_fields[-1].phase == "instruction"

    def field_url(self) -> str | None:
        return next((f.url for f in reversed(self.open_fields) if f.url), None)

    def bookmark_start(self, id_, name, order, page) -> None:
        if name and name not in self.bookmarks:
            p = self.paragraphs[-1] if self.paragraphs else {}
            self.bookmarks[name] = {"start": order, "end": None, "text": "", "page": self.page, "number": p.get("label"), "full": p.get("full"), "para": len(self.paragraphs) - 1, "fields": len(self.fields), "fields_end": None, "para_end": None, "note": None}
            self.active[id_] = name

    def bookmark_end(self, id_, order) -> None:
        if (name := self.active.pop(id_, None)) is not None:
            self.bookmarks[name]["end"] = order
            self.bookmarks[name]["fields_end"] = len(self.fields)
            self.bookmarks[name]["para_end"] = len(self.paragraphs) - 1

    def comment_start(self, id_) -> None:
        self.commenting.add(id_)
        self.comments.setdefault(id_, [])

    def comment_end(self, id_) -> None:
        self.commenting.discard(id_)

    def comment_anchor(self, id_) -> str | None:
        return self.resolve("".join(self.comments[id_])) if id_ in self.comments else None

    def note_reference(self, kind, id_, custom) -> None:
        if not custom:
            self.note_counts[kind] = self.note_counts.get(kind, 0) + 1
        n = None if custom else self.note_counts[kind]
        self.notes[kind, id_] = {"number": n, "custom": custom, "para": len(self.paragraphs) - 1}
        for name in self.active.values():
            self.bookmarks[name]["note"] = {"kind": kind, "number": n, "custom": custom}

    def note_anchor(self, kind, id_) -> str | None:
        """The text of the paragraph that refers to a note."""
        note = self.notes.get((kind, id_))
        return self.resolve(self.paragraphs[note["para"]]["text"]) if note and note["para"] >= 0 else None

    def last_note_number(self, kind) -> int:
        return self.note_counts.get(kind, 0)

    # evaluation

    def evaluate(self) -> list[Found]:
        self.sequences: dict[str, int] = {}
        self.sequence_heads: dict[str, int] = {}
        self.auto, self.listnum, self.local = 0, 0, {}
        for f in self.fields:
            f.kind, f.token = kind_of(f.instruction)
            if f.kind == "Unknown" and f.token and (name := next((b for b in self.bookmarks if b.upper() == f.token), None)):
                f.kind, f.instruction = "Ref", f.instruction.replace(f.instruction.split()[0], "REF " + name, 1)
            try:
                f.computed, missing = self.value(f), None
            except Invalid:
                missing = "UnsupportedSwitch"
            except KeyError:
                missing = "UnresolvedBookmark"
            f.done = True
            if f.computed is None and f.kind != "Hyperlink" and not (f.kind == "Filename" and missing is None):
                f.reason = "UnknownField" if f.kind == "Unknown" else missing or "NoComputedResult"
            elif f.kind == "Hyperlink" and hyperlink_target(f.instruction) is None:
                f.reason = "UnsupportedSwitch"
        return self.fields

    def value(self, f: Found) -> str | None:
        words = parts_of(f.instruction)
        token, rest = f.token, words[1:]
        if token == "=":
            return self.formula(f)
        method = getattr(self, "field_" + {"FTNREF": "noteref"}.get(token, token.lower()), None)
        if f.kind == "Ref":
            return self.field_ref(f, rest)
        if method:
            return method(f, rest)
        if f.kind == "DocumentInfo":
            return self.information(f, token, rest)
        if token in ("AUTONUM", "AUTONUMLGL", "AUTONUMOUT", "BIDIOUTLINE"):
            p = parse(rest, values="s" if token == "AUTONUM" else "", numeric=True)
            if p.operands:
                raise Invalid
            self.auto += 1
            return self.number(self.auto, p)
        return None

    def number(self, n: float, p: Parsed) -> str | None:
        text = numbers.field_number(n, p.number_format) if p.number_format else formula.number_text(n)
        return shaped(text, p.text_format)

    def known(self, name: str) -> str | None:
        if name in self.local:
            return self.local[name]
        if name in self.bookmarks:
            return self.resolve(self.bookmarks[name]["text"])
        return None

    def formula(self, f: Found) -> str | None:
        body = f.instruction.strip()[1:]
        m = re.search(r"\\[#*@]", body)
        p = parse(parts_of(body[m.start() :]) if m else [], numeric=True, pictures_too=True)
        names = {k: self.resolve(v["text"]) for k, v in self.bookmarks.items()} | self.local
        value = formula.evaluate(body[: m.start()] if m else body, names, self.cells(f))
        if value is None:
            return None
        if p.picture is not None:
            return shaped(pictures.numeric_picture(value, p.picture), p.text_format)
        return self.number(value, p)

    def cells(self, f: Found):
        """Table arguments of a formula in a cell: LEFT, ABOVE, ... and A1 or RnCn references and ranges."""
        m = re.fullmatch(r"(.*)\.r(\d+)\.c(\d+)\..*", f.path)
        cells = self.grids.get(f"{f.story}:{m[1]}", []) if m else []
        own = next((c for c in cells if (c["row"], c["cell"]) == (int(m[2]), int(m[3]))), None) if m else None
        wide = lambda c: c["col_span"] > 1 or c["row_span"] > 1
        if own is None or wide(own):
            return None
        at = {(c["row"], c["grid_col"]): c for c in cells}
        inside = [re.fullmatch(r"(.*)\.r(\d+)\.c(\d+)\..*", g.path) for g in self.fields if g.story == f.story and g.instruction.strip().startswith("=")]
        formulas = {(int(x[2]), int(x[3])) for x in inside if x and x[1] == m[1]}
        headers = next((i for i in range(len(cells)) if not any(c["row"] == i and c["is_header"] for c in cells)), 0)
        r0, c0 = own["row"], own["grid_col"]

        def gather(keys, skip: bool) -> list[float]:
            out = []
            for k in keys:
                if k in at and k != (r0, c0) and not (skip and k[0] < headers):
                    if wide(at[k]) or (k[0], at[k]["cell"]) in formulas:  # positions beside a cell that spans several are unsure
                        raise formula.Failed
                    out.append(formula.number(at[k]["text"]))  # an empty or other text fails the whole
            return out

        def ref(s: str) -> tuple[int, int] | None:
            if m := re.fullmatch(r"R(\d+)C(\d+)", s, re.I):
                return int(m[1]) - 1, int(m[2]) - 1
            if m := re.fullmatch(r"([A-Z]{1,2})(\d+)", s, re.I):
                c = 0
                for x in m[1].upper():
                    c = c * 26 + ord(x) - 64
                return int(m[2]) - 1, c - 1
            return None

        rows, cols = 1 + max(r for r, _ in at), 1 + max(c for _, c in at)
        stop = min((r for r, _ in formulas if r > r0), default=rows)
        sides = {
            "LEFT": [(r0, c) for c in range(c0)], "RIGHT": [(r0, c) for c in range(c0 + 1, cols)], "ABOVE": [(r, c0) for r in range(r0)], "BELOW": [(r, c0) for r in range(r0 + 1, stop)],
            "R": [(r0, c) for c in range(cols)], "C": [(r, c0) for r in range(rows)],
        }

        def extra(function: str, text: str) -> list[float] | None:
            s = text.strip().upper()
            if s in sides:
                if not (got := gather(sides[s], True)):
                    raise formula.Failed
                return got
            a, _, b = s.partition(":")
            if b and (x := ref(a)) and (y := ref(b)):
                if max(x[0], y[0]) >= rows:
                    raise formula.Failed
                return gather([(r, c) for r in range(min(x[0], y[0]), max(x[0], y[0]) + 1) for c in range(min(x[1], y[1]), max(x[1], y[1]) + 1)], False)
            if not b and (x := ref(a)) and a not in self.bookmarks:
                if x == (r0, c0) or x not in at or wide(at[x]) or (x[0], at[x]["cell"]) in formulas:
                    raise formula.Failed
                return [formula.number(at[x]["text"])]
            return None

        return extra

    def operand(self, s: str) -> str | None:
        """A quoted text, a number, or the value of a bookmark; other words are data that isn't known."""
        if s.startswith("\\") or not s:
            raise Invalid
        if s.startswith('"'):
            return unquote(s)
        if self.known(s) is not None:
            return self.known(s)
        try:
            if not math.isfinite(formula.number(s)):
                raise Invalid
            return s
        except formula.Failed:
            return None

    def comparison(self, rest: list[str]) -> tuple[bool | None, list[str]]:
        """The truth of "a op b" at the start of the tokens, in three or one, and what is left."""
        if len(rest) >= 3 and OPERATOR.fullmatch(rest[1]):
            a, op, b, left = rest[0], rest[1], rest[2], rest[3:]
        elif rest and (m := OPERATOR.search(re.sub(r'"[^"]*"', lambda q: "_" * len(q[0]), rest[0]))) and m.start():
            a, op, b, left = rest[0][: m.start()], m[0], rest[0][m.end() :], rest[1:]
        else:
            raise Invalid
        a, b = self.operand(a), self.operand(b)
        return (None if a is None or b is None else compared(a, op, b)), left

    def field_if(self, f, rest):
        truth, left = self.comparison(rest)
        p = parse(left)
        if not 1 <= len(p.operands) <= 2:
            raise Invalid
        results = [*map(unquote, p.operands), ""]
        return None if truth is None else shaped(results[0 if truth else 1], p.text_format)

    def field_compare(self, f, rest):
        truth, left = self.comparison(rest)
        if parse(left).operands:
            raise Invalid
        return None if truth is None else str(int(truth))

    def field_nextif(self, f, rest):
        _, left = self.comparison(rest)
        if parse(left).operands:
            raise Invalid
        return ""

    field_skipif = field_nextif

    def field_next(self, f, rest):
        if parse(rest).operands:
            raise Invalid
        return ""

    def field_quote(self, f, rest):
        p = parse(rest)
        text = " ".join(map(unquote, p.operands))
        if not text:
            raise Invalid
        return shaped(text, p.text_format)

    def field_set(self, f, rest):
        p = parse(rest)
        if len(p.operands) < 2 or not name_ok(p.operands[0]):
            raise Invalid
        self.local[p.operands[0]] = shaped(" ".join(map(unquote, p.operands[1:])), p.text_format)
        return ""

    def field_ask(self, f, rest):
        p = parse(rest, flags="o", values="d")
        if len(p.operands) < 2 or not name_ok(p.operands[0]):
            raise Invalid
        if "d" not in p.switches:
            return None
        self.local[p.operands[0]] = shaped(p.switches["d"], p.text_format)
        return ""

    def field_fillin(self, f, rest):
        p = parse(rest, flags="o", values="d")
        return shaped(p.switches.get("d"), p.text_format)

    def field_ref(self, f, rest):
        p = parse(rest, flags="h!nrwtpf", values="d", numeric=True, pictures_too=True)
        if len(p.operands) != 1 or not name_ok(p.operands[0]):
            raise Invalid
        numbered = [x for x in "nrw" if x in p.switches]
        if len(numbered) > 1 or ("t" in p.switches and not numbered) or (p.picture and set(p.switches) - {"h", "!"}):
            raise Invalid
        name = p.operands[0]
        if name not in self.local and name not in self.bookmarks:
            raise KeyError(name)
        mark = self.bookmarks.get(name)
        if numbered and mark:
            number = mark["full"] if numbered[0] == "w" else mark["number"]
            if number is None:
                return None
            number = number.rstrip(".")
            if "r" in p.switches and 0 <= f.para < len(self.paragraphs) and self.paragraphs[f.para]["full"] and mark["full"]:
                number = relative(mark["full"], self.paragraphs[f.para]["full"])
            if "t" in p.switches:
                number = re.sub(r"[^0-9.]", "", number)
            return shaped(number, p.text_format)
        if "p" in p.switches and mark:
            if mark["fields_end"] is None or (mark["fields"] <= f.order < mark["fields_end"] and mark["para"] == f.para):
                return None
            return "above" if f.order >= mark["fields_end"] and f.para >= mark["para"] else "below"
        if "f" in p.switches:
            note = mark and mark["note"]
            return None if not note or note["custom"] else self.number(note["number"], p)
        text = self.known(name)
        if p.picture is not None or p.number_format:
            try:
                value = formula.number(text)
            except formula.Failed:
                return None
            return pictures.numeric_picture(value, p.picture) if p.picture is not None else self.number(value, p)
        return shaped(text, p.text_format)

    def field_page(self, f, rest):
        p = parse(rest, numeric=True)
        if p.operands:
            raise Invalid
        return self.number(f.page, p) if f.story == "body" else None

    def field_section(self, f, rest):
        p = parse(rest, numeric=True)
        if p.operands:
            raise Invalid
        return self.number(f.section, p) if f.story == "body" else None

    def field_sectionpages(self, f, rest):
        p = parse(rest, numeric=True)
        if p.operands:
            raise Invalid
        first, last = self.section_pages.get(f.section, (1, 1))
        return self.number(last - first + 1, p) if f.story == "body" else None

    def field_pageref(self, f, rest):
        p = parse(rest, flags="hp", numeric=True)
        if len(p.operands) != 1 or not name_ok(p.operands[0]):
            raise Invalid
        mark = self.bookmarks[p.operands[0]]
        if "p" in p.switches:
            if mark["page"] != f.page:
                return f"on page {mark['page']}"
            return None if mark["para"] == f.para else "above" if mark["para"] < f.para else "below"
        return self.number(mark["page"], p)

    def field_noteref(self, f, rest):
        p = parse(rest, flags="hfp", numeric=True)
        if len(p.operands) != 1 or not name_ok(p.operands[0]) or ("p" in p.switches and p.number_format):
            raise Invalid
        mark = self.bookmarks[p.operands[0]]
        if not mark["note"] or mark["note"]["custom"]:
            return None
        if "p" in p.switches:
            return "above" if mark["para"] < f.para else "below" if mark["para"] > f.para else None
        return self.number(mark["note"]["number"], p)

    def field_styleref(self, f, rest):
        p = parse(rest, flags="nrwtp")
        flags = [x for x in "nrwp" if x in p.switches]
        if not p.operands or len(flags) > 1 or ("t" in p.switches and flags not in (["n"], ["r"], ["w"])):
            raise Invalid
        name = " ".join(map(unquote, p.operands)).lower()
        hit = lambda i: name in ((self.paragraphs[i]["style"] or "").lower(), (self.paragraphs[i]["style_id"] or "").lower()) and self.paragraphs[i]["story"] == "body"
        at = next((i for i in range(min(f.para, len(self.paragraphs) - 1), -1, -1) if hit(i) and i != f.para), None)
        if at is None:
            at = next((i for i in range(f.para + 1, len(self.paragraphs)) if hit(i)), None)
        if at is None:
            raise KeyError(name)
        target = self.paragraphs[at]
        if flags == ["p"]:
            return "above" if at < f.para else "below"
        if flags:
            return target["full" if flags == ["w"] else "label"]
        return shaped(self.resolve(target["text"]), p.text_format)

    def field_seq(self, f, rest):
        p = parse(rest, flags="nch", values="rs", numeric=True)
        if not p.operands or not name_ok(p.operands[0]) or len(p.operands) > 2 or len([x for x in "ncr" if x in p.switches]) > 1:
            raise Invalid
        name = p.operands[0].lower()
        if "s" in p.switches:
            if not re.fullmatch("[1-9]", str(p.switches["s"])):
                raise Invalid
            head = max((i for i in range(max(f.para, 0)) if (self.paragraphs[i]["heading"] or 99) <= int(p.switches["s"])), default=-1)
            if self.sequence_heads.get(name, head) != head:
                self.sequences.pop(name, None)
            self.sequence_heads[name] = head
        if "r" in p.switches:
            if not str(p.switches["r"]).isdigit():
                raise Invalid
            self.sequences[name] = int(p.switches["r"])
        elif "c" in p.switches:
            if name not in self.sequences:
                return None
        else:
            self.sequences[name] = self.sequences.get(name, 0) + 1
        return "" if "h" in p.switches else self.number(self.sequences[name], p)

    def field_listnum(self, f, rest):
        p = parse(rest, values="ls", numeric=True)
        if len(p.operands) > 1 or (p.operands and unquote(p.operands[0]).lower() not in ("numberdefault", "legaldefault")) or p.switches.get("l", "1") != "1" or not str(p.switches.get("s", "0")).isdigit():
            raise Invalid
        self.listnum = int(p.switches["s"]) if "s" in p.switches else self.listnum + 1
        return self.number(self.listnum, p)

    def barcode(self, f, rest, values: int, merge: bool = False):
        """Checks a barcode's operands and switches; bars are never drawn, so there is no value."""
        p = parse(rest, flags="xdt" + ("a" if merge else ""), values="hsqpcrfb")
        if len(p.operands) < values or (values > 1 and unquote(p.operands[1]).upper() not in BARCODES):
            raise Invalid
        for k, v in p.switches.items():
            if k in BARCODE_VALUES and not BARCODE_VALUES[k](str(v).upper()):
                raise Invalid

    def field_barcode(self, f, rest):
        return self.barcode(f, rest, 1)

    def field_displaybarcode(self, f, rest):
        return self.barcode(f, rest, 2)

    def field_mergebarcode(self, f, rest):
        return self.barcode(f, rest, 2, True)

    def field_toc(self, f, rest):
        p = parse(rest, flags="uhzwx", values="tcabpds", optional="ofln")
        bounds = lambda s: tuple(map(int, m.groups())) if isinstance(s, str) and (m := re.fullmatch(r"([1-9])-([1-9])", s)) else None
        if p.operands or ("l" in p.switches and not bounds(p.switches["l"])) or (isinstance(p.switches.get("o"), str) and not bounds(p.switches["o"])):
            raise Invalid
        only = set(p.switches) & set("outflca")
        low, high = bounds(p.switches.get("o")) or ((1, 9) if only and ("u" in only or "o" in only or "t" in only) else (1, 3))
        standard = "o" in only or not only or only <= {"u", "o"}
        custom = {}
        if "t" in p.switches:
            names = re.split("[,;]", p.switches["t"])
            custom = {a.strip().lower(): int(b) for a, b in zip(names[::2], names[1::2]) if b.strip().isdigit()}
        scope = None
        if "b" in p.switches:
            if p.switches["b"] not in self.bookmarks:
                raise KeyError(p.switches["b"])
            scope = self.bookmarks[p.switches["b"]]
        fields: dict[int, list[Found]] = {}
        for g in self.fields:
            fields.setdefault(g.para, []).append(g)
        entries = "f" in only or "l" in only
        a, z = bounds(p.switches.get("l")) or (1, 9)
        label = p.switches.get("c", p.switches.get("a"))
        lines = []
        for i, para in enumerate(self.paragraphs):  # in the document's order, whatever an entry comes from
            if scope and not scope["para"] <= i <= (len(self.paragraphs) if scope["para_end"] is None else scope["para_end"]):
                continue
            own = [g for g in fields.get(i, ()) if not scope or scope["fields"] <= g.order < (len(self.fields) if scope["fields_end"] is None else scope["fields_end"])]
            body = para["story"] == "body" and para["text"].strip()
            level = para["heading"] if standard and para["heading"] and low <= para["heading"] <= high else custom.get((para["style"] or "").lower())
            if body and level:
                lines.append("  " * (level - low) + self.resolve(para["text"]).strip())
            elif body and isinstance(label, str) and any(kind_of(g.instruction)[0] == "Sequence" and label.lower() in [x.lower() for x in parts_of(g.instruction)[1:2]] for g in own):
                text = self.resolve(para["text"]).strip()
                lines.append(text if "c" in p.switches else re.sub(rf"(?i)^{re.escape(label)}\s+\S+?[\s.:)\-–—]+", "", text))
            for g in own if entries else ():
                if kind_of(g.instruction)[0] != "TocEntry":
                    continue
                q = parse(parts_of(g.instruction)[1:], flags="n", values="fl")
                if isinstance(p.switches.get("f"), str) and str(q.switches.get("f", "c")).lower() != p.switches["f"].lower():
                    continue
                if a <= (level := int(q.switches.get("l", 1))) <= z:
                    lines.append("  " * (level - 1) + " ".join(map(unquote, q.operands)))
        return "\n".join(lines) or ("" if scope else None)

    def field_tc(self, f, rest):
        if not parse(rest, flags="n", values="fl").operands:
            raise Invalid
        return ""

    def field_xe(self, f, rest):
        if not parse(rest, flags="bi", values="frty").operands:
            raise Invalid
        return ""

    def field_ta(self, f, rest):
        if not parse(rest, flags="bi", values="clrs").switches:
            raise Invalid
        return ""

    def field_rd(self, f, rest):
        if len(parse(rest, flags="f").operands) != 1:
            raise Invalid
        return ""

    def field_filename(self, f, rest):
        if parse(rest, flags="p").operands:
            raise Invalid
        return None

    def field_revnum(self, f, rest):
        p = parse(rest)
        return shaped(self.properties["core"].get("revision"), p.text_format)

    def field_advance(self, f, rest):
        if parse(rest, values="dulrxy").operands:
            raise Invalid
        return ""

    def field_eq(self, f, rest):
        m = re.search(r"\s*\\\*\s*(\w+)\s*$", f.instruction)
        text = pictures.eq_text(f.instruction[: m.start()] if m else f.instruction)
        if text is None:
            raise Invalid
        return shaped(text, parse(["\\*", m[1]]).text_format if m else None)

    def field_symbol(self, f, rest):
        p = parse(rest, flags="auhj", values="fs")
        if len(p.operands) != 1:
            raise Invalid
        s = unquote(p.operands[0])
        try:
            code = int(s, 16) if s.lower().startswith("0x") else int(s) if s.isdigit() else ord(s) if len(s) == 1 else -1
        except ValueError:
            raise Invalid from None
        if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
            raise Invalid
        from .text import SYMBOLS

        table = SYMBOLS.get(str(p.switches.get("f", "")).lower(), {})
        if code in table:
            return table[code]
        return bytes([code]).decode("cp1252", "replace") if "a" in p.switches and code < 256 else chr(code)

    def field_gotobutton(self, f, rest):
        p = parse(rest)
        if not p.operands:
            raise Invalid
        return shaped(" ".join(map(unquote, p.operands[1:])), p.text_format) if len(p.operands) > 1 else None

    field_macrobutton = field_gotobutton

    def field_print(self, f, rest):
        if not rest:
            raise Invalid
        return ""

    def field_mergefield(self, f, rest):
        p = parse(rest, flags="mv", values="bf")
        if not p.operands:
            raise Invalid
        name = " ".join(map(unquote, p.operands))
        value = self.context.get("merge_values", {}).get(name)
        if value is None:
            return None
        return shaped((p.switches.get("b", "") + value + p.switches.get("f", "")) if value else "", p.text_format)

    def field_includetext(self, f, rest):
        p = parse(rest, flags="!", values="cntx")
        if not p.operands:
            raise Invalid
        return shaped(self.context.get("include_text", {}).get(unquote(p.operands[0])), p.text_format)

    def field_formcheckbox(self, f, rest):
        return None if not f.form or f.form.get("checked") is None else "☒" if f.form["checked"] else "☐"

    def field_formdropdown(self, f, rest):
        if not f.form or not f.form.get("entries"):
            return None
        i = f.form.get("result") or 0
        return f.form["entries"][i] if i < len(f.form["entries"]) else None

    def field_formtext(self, f, rest):
        return f.cached or (f.form or {}).get("default")

    def information(self, f: Found, token: str, rest: list[str]) -> str | None:
        p = parse(rest, flags="km", numeric=True, dates=True)
        name = token
        if token in ("DOCPROPERTY", "DOCVARIABLE", "INFO"):
            if not p.operands:
                raise Invalid
            name = " ".join(map(unquote, p.operands))
        key = re.sub(r"[_\-\s]", "", name).upper()
        fold = lambda group: {re.sub(r"[_\-\s]", "", k).upper(): v for k, v in reversed(self.properties[group].items())}
        if token == "DOCVARIABLE":
            value = fold("variables").get(key)
        elif token in ("DATE", "TIME"):
            now = self.context.get("now")
            return pictures_date(now, p.date) if now and p.date else None
        elif token.startswith("USER"):
            value = unquote(p.operands[0]) if p.operands else self.context.get({"USERNAME": "user_name", "USERINITIALS": "user_initials", "USERADDRESS": "user_address"}[token])
        elif key == "FILESIZE":
            n = self.file_size
            value = str((n + 500) // 1000 if "k" in p.switches else (n + 500_000) // 1_000_000 if "m" in p.switches else n)
        else:
            value = self.properties["core"].get(CORE_NAMES.get(key, "")) or self.properties["extended"].get(EXTENDED_NAMES.get(key, ""))
            if value is None and token == "DOCPROPERTY":
                value = fold("custom").get(key)
        if value is None:
            return None
        if key in ("CREATEDATE", "SAVEDATE", "PRINTDATE") or (p.date is not None):
            return pictures_date(value, p.date) if p.date else value
        if p.number_format:
            try:
                return shaped(numbers.field_number(formula.number(value), p.number_format), p.text_format)
            except formula.Failed:
                return None
        return shaped(value, p.text_format)


def name_ok(s: str) -> bool:
    return bool(s) and not s.startswith("\\") and '"' not in s and not re.search(r"\s", s)


def relative(target: str, own: str) -> str:
    a, b = target.split("."), own.split(".")
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return ".".join(a[n:]) or target


def hyperlink_target(instruction: str) -> str | None:
    try:
        p = parse(parts_of(instruction)[1:], flags="mn", values="lot")
    except Invalid:
        return None
    if len(p.operands) > 1:
        return None
    try:
        url = unquote(p.operands[0]).strip() if p.operands else ""
    except Invalid:
        return None
    anchor = p.switches.get("l")
    return (url + (f"#{anchor}" if anchor else "")) or None


STRFTIME = {
    "EEEE": "%A", "EEE": "%a", "dd": "%d", "d": "%-d", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%-m", "yyyy": "%Y", "yy": "%y", "HH": "%H", "H": "%-H", "hh": "%I", "h": "%-I", "mm": "%M", "m": "%-M",
    "ss": "%S", "s": "%-S", "a": "%p",
}


def pictures_date(value: str, picture: str | None) -> str | None:
    pattern = pictures.date_pattern(picture or "")
    m = re.match(r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})", value or "")
    if not pattern or not m:
        return None
    try:
        when = datetime.datetime(*map(int, m.groups()))
    except ValueError:
        return None
    out = re.sub(r"'([^']*)'|([A-Za-z])\2*", lambda x: x[1] if x[1] is not None else when.strftime(STRFTIME.get(x[0], x[0])), pattern)
    return out


def form_data(e) -> dict | None:
    """A legacy form field's state, from the field character that begins it."""
    if e is None:
        return None
    local = lambda x: x.tag.rpartition("}")[2]
    val = lambda x: next((v for k, v in x.attrib.items() if k.endswith("val")), None)
    data = next((x for x in e if local(x) == "ffData"), None)
    if data is None:
        return None
    out: dict = {}
    for x in data.iter():
        name = local(x)
        if name in ("checked", "default") and val(x) in (None, "0", "1", "true", "false") and "checked" not in out:
            out["checked"] = val(x) in (None, "1", "true")
        if name == "default" and val(x) is not None:
            out["default"] = val(x)
        if name == "listEntry":
            out.setdefault("entries", []).append(val(x) or "")
        if name == "result" and (val(x) or "").isdigit():
            out["result"] = int(val(x))
    return out


def field_tokens(instruction: ColumnOrName) -> Column:
    return instruction_parts(instruction)
