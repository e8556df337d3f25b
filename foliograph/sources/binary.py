"""Legacy binary documents: compound files, the file information block, the piece table, and their text and structure."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .packages import OLE_MAGIC, Refused

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MOST_SECTORS, MOST_PIECES, MOST_PRCS = 1 << 20, 1 << 20, 1 << 15

# Code pages of single-byte pieces, and languages that decide them -> Python codecs. Fixed values.
CODEPAGES = {
    874: "cp874", 932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1250: "cp1250", 1251: "cp1251", 1252: "cp1252", 1253: "cp1253", 1254: "cp1254", 1255: "cp1255", 1256: "cp1256", 1257: "cp1257", 1258: "cp1258",
}
LANGUAGES = {
    0x0412: 949, 0x0411: 932, 0x0804: 936, 0x0404: 950, 0x0419: 1251, 0x0422: 1251, 0x0402: 1251, 0x0415: 1250, 0x0405: 1250, 0x040E: 1250, 0x041B: 1250, 0x0408: 1253, 0x041F: 1254, 0x040D: 1255, 0x0401: 1256,
    0x0425: 1257, 0x0426: 1257, 0x0427: 1257, 0x042A: 1258, 0x041E: 874,
}


class Compound:
    """A compound file's streams by name. Chains are followed with a budget, and a loop is an error."""

    def __init__(self, data: bytes):
        if data[:8] != OLE_MAGIC:
            raise Refused("NotOle2", "not a compound file")
        try:
            self.open(data)
        except (struct.error, IndexError) as x:
            raise Refused("Cfb", f"truncated: {x}") from None

    def open(self, data: bytes) -> None:
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise Refused("Cfb", "bad sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        self.cutoff = cutoff
        difat = list(struct.unpack_from("<109I", data, 76))
        at, seen = first_difat, 0
        while at not in (END, FREE) and seen < max(n_difat, 1) and seen < MOST_SECTORS:
            block = self.sector(at)
            entries = struct.unpack(f"<{self.size // 4}I", block)
            difat += entries[:-1]
            at, seen = entries[-1], seen + 1
        self.fat: list[int] = []
        for s in [x for x in difat if x < END][:n_fat]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(s))
        self.minifat = struct.unpack(f"<{len(x) // 4}I", x) if (x := self.chain(first_mini)) else ()
        directory = self.chain(first_dir)
        self.entries: dict[str, tuple[int, int]] = {}
        self.ministream = b""
        for i in range(0, len(directory) - 127, 128):
            e = directory[i : i + 128]
            n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            start, size = struct.unpack_from("<IQ", e, 116)
            name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.ministream = self.chain(start)[: size & 0xFFFFFFFF]
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF if self.size == 512 else size))

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        block = self.data[at : at + self.size]
        if len(block) < self.size:
            block = block + bytes(self.size - len(block))
        if at >= len(self.data):
            raise Refused("Cfb", "sector beyond the file")
        return block

    def chain(self, at: int) -> bytes:
        out, seen = [], 0
        while at < END:
            out.append(self.sector(at))
            seen += 1
            if seen > MOST_SECTORS or at >= len(self.fat) or seen > len(self.fat):
                raise Refused("Cfb", "sector chain loops")
            at = self.fat[at]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        at, size = self.entries[name]
        if size >= self.cutoff:
            return self.chain(at)[:size]
        out, seen = [], 0
        while at < END and len(out) * self.mini < size:
            out.append(self.ministream[at * self.mini : (at + 1) * self.mini])
            seen += 1
            if at >= len(self.minifat) or seen > len(self.minifat):
                raise Refused("Cfb", "mini sector chain loops")
            at = self.minifat[at]
        return b"".join(out)[:size]

    def required(self, name: str) -> bytes:
        if (s := self.stream(name)) is None:
            raise Refused("MissingStream", name)
        return s


@dataclass
class Fib:
    """What the file information block says: where tables lie and how many characters each story has."""

    table: str
    lid: int
    counts: dict[str, int]
    lists: list[tuple[int, int]]

    @classmethod
    def parse(cls, word: bytes) -> Fib:
        if len(word) < 34:
            raise Refused("Fib", "truncated")
        magic, version = struct.unpack_from("<HH", word, 0)
        if magic != 0xA5EC:
            raise Refused("Fib", "bad magic")
        if version < 0x00C1:
            raise Refused("UnsupportedVersion", f"nFib=0x{version:04X}")
        lid, flags = struct.unpack_from("<H", word, 6)[0], struct.unpack_from("<H", word, 10)[0]
        if flags & 0x0100:
            raise Refused("Encrypted", "obfuscated" if flags & 0x8000 else "encrypted")
        try:
            n16 = struct.unpack_from("<H", word, 32)[0]
            at = 34 + 2 * n16
            n32 = struct.unpack_from("<H", word, at)[0]
            longs = struct.unpack_from(f"<{n32}i", word, at + 2)
            at += 2 + 4 * n32
            pairs = struct.unpack_from("<H", word, at)[0]
            lists = [struct.unpack_from("<II", word, at + 2 + 8 * i) for i in range(pairs)]
        except struct.error:
            raise Refused("Fib", "truncated") from None
        names = ("body", "footnote", "header", None, "comment", "endnote", "textbox", "header_textbox")
        counts = {n: max(0, longs[3 + i]) for i, n in enumerate(names) if n and 3 + i < len(longs)}
        return cls("1Table" if flags & 0x0200 else "0Table", lid, counts, lists)

    def slice(self, table: bytes, i: int) -> bytes:
        if i >= len(self.lists):
            return b""
        at, n = self.lists[i]
        return table[at : at + n] if at + n <= len(table) else b""


@dataclass
class Piece:
    start: int
    end: int
    offset: int
    wide: bool
    prm: int = 0


def pieces(clx: bytes) -> list[Piece]:
    """The piece table: runs of characters and where their bytes lie."""
    at, prcs = 0, 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        prcs += 1
        if prcs > MOST_PRCS:
            raise Refused("PieceTable", "too many property runs")
    if at + 5 > len(clx) or clx[at] != 2:
        raise Refused("PieceTable", "no piece table")
    size = struct.unpack_from("<I", clx, at + 1)[0]
    body = clx[at + 5 : at + 5 + size]
    n = (len(body) - 4) // 12
    if n <= 0 or n > MOST_PIECES:
        raise Refused("PieceTable", "bad length")
    cps = struct.unpack_from(f"<{n + 1}i", body, 0)
    out = []
    for i in range(n):
        _, fc, prm = struct.unpack_from("<HIH", body, 4 * (n + 1) + 8 * i)
        wide = not fc & 0x40000000
        at = fc & 0x3FFFFFFF
        if cps[i + 1] < cps[i]:
            raise Refused("PieceTable", "positions run backwards")
        out.append(Piece(cps[i], cps[i + 1], at if wide else at // 2, wide, prm))
    return out


def codec(lid: int) -> str:
    return CODEPAGES.get(LANGUAGES.get(lid, 1252), "cp1252")


def decode(word: bytes, table: list[Piece], encoding: str) -> str:
    """The characters of all pieces in order, one to a position; bytes beyond the stream are missing characters."""
    out = []
    for p in table:
        n = p.end - p.start
        raw = word[p.offset : p.offset + n * (2 if p.wide else 1)]
        if p.wide:
            units = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
            text = "".join(chr(u) if not 0xD800 <= u < 0xE000 else chr(u) for u in units)
        elif encoding in ("cp932", "gbk", "cp949", "cp950"):
            whole = raw.decode(encoding, "replace")
            text = whole + "\0" * (n - len(whole))  # double-byte characters take two positions
        else:
            text = raw.decode(encoding, "replace")
        out.append(text[:n] + "\0" * (n - len(text[:n])))
    return "".join(out)


def joined(text: str) -> str:
    """Surrogate pairs as characters; halves without a partner are replaced."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@dataclass
class Properties:
    """Paragraph and character properties by byte offset: sorted runs, each with its style and property bytes."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    values: list[tuple[int, bytes]] = field(default_factory=list)

    @classmethod
    def parse(cls, word: bytes, bins: bytes, paragraphs: bool) -> Properties:
        out, rows = cls(), []
        n = (len(bins) - 4) // 8
        if n > MOST_PIECES:
            raise Refused("Fib", "too many property pages")
        for i in range(max(0, n)):
            page = struct.unpack_from("<I", bins, 4 * (n + 1) + 4 * i)[0] & 0x3FFFFF
            fkp = word[page * 512 : page * 512 + 512]
            if len(fkp) < 512:
                continue
            runs = fkp[511]
            size = 13 if paragraphs else 1
            if 4 * (runs + 1) + size * runs > 511:
                continue
            fcs = struct.unpack_from(f"<{runs + 1}I", fkp, 0)
            for j in range(runs):
                at = fkp[4 * (runs + 1) + size * j] * 2
                value = (0, b"")
                if at and paragraphs and at < 511:
                    cw = fkp[at]
                    body = fkp[at + 1 : at + 2 * cw] if cw else fkp[at + 2 : at + 2 + 2 * fkp[at + 1]]
                    if len(body) >= 2:
                        value = (struct.unpack_from("<H", body)[0], body[2:])
                elif at and at < 511:
                    value = (0, fkp[at + 1 : at + 1 + fkp[at]])
                rows.append((fcs[j], fcs[j + 1], value))
        for a, b, v in sorted(rows, key=lambda r: r[0]):
            out.starts.append(a)
            out.ends.append(b)
            out.values.append(v)
        return out

    def at(self, fc: int) -> tuple[int, bytes]:
        """An as-of lookup: the run that the offset lies in."""
        from bisect import bisect_right

        i = bisect_right(self.starts, fc) - 1
        return self.values[i] if i >= 0 and fc < self.ends[i] else (0, b"")


def modifiers(body: bytes):
    """(code, operand bytes) of each property modifier; the operand's size is in the code."""
    at = 0
    while at + 2 <= len(body):
        code = struct.unpack_from("<H", body, at)[0]
        at += 2
        size = (1, 1, 2, 4, 2, 2, None, 3)[code >> 13]
        if size is None:
            if at >= len(body):
                return
            size, at = (struct.unpack_from("<H", body, at)[0] - 1, at + 2) if code == 0xD608 and at + 2 <= len(body) else (body[at], at + 1)
        yield code, body[at : at + size]
        at += size


def character_properties(body: bytes) -> dict:
    """Toggles and values of character modifiers; 0x80 and 0x81 leave a toggle to the style."""
    names = {0x0835: "bold", 0x0836: "italic", 0x0837: "strike", 0x083C: "hidden", 0x083A: "small_caps", 0x083B: "caps"}
    out: dict = {}
    for code, arg in modifiers(body):
        if code in names and arg and arg[0] < 2:
            out[names[code]] = bool(arg[0])
        elif code == 0x2A3E and arg:
            out["underline"] = arg[0] != 0
        elif code == 0x4A43 and len(arg) == 2:
            out["size"] = struct.unpack("<H", arg)[0]
        elif code == 0x6870 and len(arg) == 4 and arg[3] != 0xFF:
            out["color"] = arg[:3].hex().upper()
        elif code == 0x0800 and arg:
            out["deleted"] = arg[0] == 1
    return out


def paragraph_properties(body: bytes) -> dict:
    out: dict = {}
    for code, arg in modifiers(body):
        if code in (0x2403, 0x2461) and arg:
            out["align"] = ("left", "center", "right", "both")[arg[0]] if arg[0] < 4 else None
        elif code == 0x2416 and arg:
            out["in_table"] = bool(arg[0])
        elif code == 0x2417 and arg:
            out["row_end"] = bool(arg[0])
        elif code == 0x2407 and arg:
            out["page_break_before"] = bool(arg[0])
        elif code == 0x260A and arg:
            out["list_level"] = arg[0]
        elif code == 0x460B and len(arg) == 2:
            out["list"] = struct.unpack("<H", arg)[0]
        elif code == 0x2640 and arg and arg[0] < 9:
            out["outline"] = arg[0] + 1
    return out


def style_names(sheet: bytes) -> dict[int, str]:
    """Style index -> name, of a style sheet."""
    out: dict[int, str] = {}
    try:
        at = 2 + struct.unpack_from("<H", sheet, 0)[0]
        count, base = struct.unpack_from("<HH", sheet, 2)
        for i in range(count):
            size = struct.unpack_from("<H", sheet, at)[0]
            std = sheet[at + 2 : at + 2 + size]
            if size > base + 2:
                n = struct.unpack_from("<H", std, base)[0]
                out[i] = std[base + 2 : base + 2 + 2 * n].decode("utf-16-le", "replace")
            at += 2 + size
    except struct.error:
        pass
    return out


def font_names(table: bytes) -> list[str]:
    out = []
    try:
        n, at = struct.unpack_from("<H", table, 0)[0], 4
        for _ in range(n):
            size = table[at]
            name = table[at + 40 : at + 1 + size]
            out.append(name.decode("utf-16-le", "replace").partition("\0")[0])
            at += 1 + size
    except (struct.error, IndexError):
        pass
    return out


class Lists:
    """List definitions and overrides, and the counters that paragraphs advance. A list's counters are shared by all of
    its instances; an instance seen first may start anew; a level is restarted by a level below its limit."""

    def __init__(self, definitions: bytes, overrides: bytes):
        self.levels: dict[int, list[dict]] = {}
        self.instances: list[int] = []
        self.starts: dict[int, dict[int, int]] = {}  # instance -> level -> where it starts when first seen
        try:
            n = struct.unpack_from("<h", definitions, 0)[0]
            simple = [(struct.unpack_from("<i", definitions, 2 + 28 * i)[0], bool(definitions[2 + 28 * i + 26] & 1)) for i in range(max(0, n))]
            at = 2 + 28 * n
            for lsid, one in simple:
                levels = []
                for _ in range(1 if one else 9):
                    start, nfc, flags = struct.unpack_from("<iBB", definitions, at)
                    follow, chpx, papx, limit = definitions[at + 15], definitions[at + 24], definitions[at + 25], definitions[at + 26]
                    at += 28 + papx + chpx
                    size = struct.unpack_from("<H", definitions, at)[0]
                    levels.append({"start": start, "nfc": nfc, "legal": bool(flags & 4), "no_restart": bool(flags & 8), "limit": limit, "follow": follow, "text": definitions[at + 2 : at + 2 + 2 * size].decode("utf-16-le", "replace")})
                    at += 2 + 2 * size
                self.levels[lsid] = levels
        except (struct.error, IndexError):
            pass
        try:
            n = max(0, struct.unpack_from("<i", overrides, 0)[0])
            heads = [struct.unpack_from("<i8xB", overrides, 4 + 16 * i) for i in range(n)]
            self.instances = [lsid for lsid, _ in heads]
            at = 4 + 16 * n
            for i, (_, count) in enumerate(heads):
                at += 4
                for _ in range(count):
                    start, flags = struct.unpack_from("<iI", overrides, at)
                    at += 8
                    if flags & 0x20:  # a level of its own follows
                        chpx, papx = overrides[at + 24], overrides[at + 25]
                        if flags & 0x10:
                            start = struct.unpack_from("<i", overrides, at)[0]
                        at += 28 + chpx + papx
                        at += 2 + 2 * struct.unpack_from("<H", overrides, at)[0]
                    if flags & 0x10 and flags & 0xF < 9:
                        self.starts.setdefault(i + 1, {})[flags & 0xF] = start
        except (struct.error, IndexError):
            pass
        self.counters: dict[int, list[int | None]] = {}

    def label(self, instance: int, level: int) -> str | None:
        from ..functions.numbers import style_text

        if not 0 < instance <= len(self.instances) or self.instances[instance - 1] not in self.levels:
            return None
        lsid = self.instances[instance - 1]
        levels = self.levels[lsid]
        level = min(level, len(levels) - 1)
        c = self.counters.setdefault(lsid, [None] * 9)
        for i, start in self.starts.pop(instance, {}).items():
            c[i] = start - 1 if i == level else start
            c[i + 1 :] = [None] * (8 - i)
        c[level] = levels[level]["start"] if c[level] is None else c[level] + 1
        for i in range(level):
            c[i] = levels[i]["start"] if c[i] is None else c[i]
        for i in range(level + 1, 9):
            own = levels[i] if i < len(levels) else None
            if own is None or not own["no_restart"] or level < own["limit"]:
                c[i] = None
        own = levels[level]
        if own["nfc"] == 0x17:
            return own["text"] or None
        plain = lambda i: style_text(c[i], 0 if own["legal"] and levels[i]["nfc"] != 0x16 else levels[i]["nfc"])
        return "".join(plain(ord(x)) if ord(x) < 9 and ord(x) < len(levels) and c[ord(x)] is not None else x for x in own["text"]) or None


def owners(names: bytes) -> list[str]:
    """Comment authors: counted strings one after the other."""
    out, at = [], 0
    while at + 2 <= len(names):
        n = struct.unpack_from("<H", names, at)[0]
        if at + 2 + 2 * n > len(names):
            break
        out.append(names[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
        at += 2 + 2 * n
    return out


def comment_marks(plc: bytes) -> list[tuple[int, str, int]]:
    """(position, initials, author's number) of each comment's mark."""
    n = (len(plc) - 4) // 34
    out = []
    if n > MOST_PIECES:
        raise Refused("Fib", "too many comments")
    for i in range(max(0, n)):
        at = 4 * (n + 1) + 30 * i
        size = min(9, struct.unpack_from("<H", plc, at)[0])
        out.append((struct.unpack_from("<i", plc, 4 * i)[0], plc[at + 2 : at + 2 + 2 * size].decode("utf-16-le", "replace"), struct.unpack_from("<H", plc, at + 20)[0]))
    return out


def ranges(plc: bytes) -> list[tuple[int, int]]:
    """Consecutive positions of a table of positions alone."""
    at = struct.unpack(f"<{len(plc) // 4}i", plc[: len(plc) // 4 * 4])
    return list(zip(at, at[1:]))


def visible(text: str) -> list[int]:
    """Positions of characters that aren't field instructions or marks."""
    out, stack = [], []
    for i, c in enumerate(text):
        if c == "\x13":
            stack.append(False)
        elif c == "\x14" and stack:
            stack[-1] = True
        elif c == "\x15" and stack:
            stack.pop()
        elif all(stack):
            out.append(i)
    return out


def row_definition(body: bytes) -> tuple[list[int], list[str | None]]:
    """A row's cell boundaries and each cell's vertical merge (restart, continue or null), from its table definition."""
    for code, arg in modifiers(body):
        if code == 0xD608 and arg:
            n = arg[0]
            if len(arg) < 1 + 2 * (n + 1):
                break
            bounds = list(struct.unpack_from(f"<{n + 1}h", arg, 1))
            merges: list[str | None] = []
            for i in range(n):
                at = 1 + 2 * (n + 1) + 20 * i
                flags = struct.unpack_from("<H", arg, at)[0] if at + 2 <= len(arg) else 0
                merges.append("restart" if flags & 0x40 else "continue" if flags & 0x20 else None)
            return bounds, merges
    return [], []


def grid(rows: list[tuple[list[str], list[int], list[str | None]]]) -> list[dict]:
    """Cells of a table with their place on the grid of all rows' boundaries. A cell that continues the one above is that
    cell's; one with nothing above to continue stays as it is. Rows without boundaries have a column a cell."""
    lines = sorted({b for _, bounds, _ in rows for b in bounds})
    at = {b: i for i, b in enumerate(lines)}
    out: list[dict] = []
    open_: dict[int, dict] = {}
    for r, (texts, bounds, merges) in enumerate(rows):
        known = len(bounds) > len(texts) - 1 and len(bounds) >= len(texts) + 1
        seen = set()
        for c, text in enumerate(texts):
            col = at[bounds[c]] if known else c
            span = max(1, at[bounds[c + 1]] - col) if known else 1
            merge = merges[c] if c < len(merges) else None
            seen.add(col)
            if merge == "continue" and col in open_ and open_[col]["col_span"] == span:
                open_[col]["row_span"] += 1
                continue
            cell = {"row": r, "cell": c, "grid_col": col, "col_span": span, "row_span": 1, "text": text}
            out.append(cell)
            open_.pop(col, None)
            if merge == "restart":
                open_[col] = cell
        open_ = {k: v for k, v in open_.items() if k in seen}
    return out


STORIES = ("body", "footnote", "header", "comment", "endnote", "textbox", "header_textbox")


def open_doc(data: bytes, wanted: set[str] | None = None) -> list[dict]:
    """Records of a legacy document: blocks with their text, cells, regions, fields, notes and comments."""
    file = Compound(data)
    word = file.required("WordDocument")
    fib = Fib.parse(word)
    table = file.required(fib.table)
    parts = pieces(fib.slice(table, 33))
    text = decode(word, parts, codec(fib.lid))
    offsets: list[int] = []
    for p in parts:
        offsets += [p.offset + i * (2 if p.wide else 1) for i in range(p.end - p.start)]
    papx = Properties.parse(word, fib.slice(table, 13), True)
    chpx = Properties.parse(word, fib.slice(table, 12), False)
    styles = style_names(fib.slice(table, 1))
    lists = Lists(fib.slice(table, 73), fib.slice(table, 74))
    rows: list[dict] = []

    def emit(tag: str, ord: int, story: str | None = None, path: str | None = None, name: str | None = None, text: str | None = None, **more) -> None:
        if wanted is None or tag in wanted:
            rows.append({"tag": tag, "ord": ord, "story": story, "path": path, "name": name, "text": text, "fields": {k: ("true" if v is True else "false" if v is False else str(v)) for k, v in more.items() if v is not None}})

    from ..functions import fields as grammar
    from ..functions.numbers import style_text  # noqa: F401

    order, at, found = 0, 0, []
    for n, story in enumerate(STORIES):
        size = fib.counts.get(story, 0)
        chunk = text[at : at + size]
        if size:
            emit("region", n, story, name=story, text=clean(field_results(chunk)), cp_start=at, cp_end=at + size)
        block, cells, start = [], [], 0
        table_rows: list[tuple[list[str], list[int], list[str | None]]] = []
        section, page = 1, 1

        def close_table() -> None:
            nonlocal table_rows, order
            if table_rows:
                path = f"{order:06d}"
                placed = grid(table_rows)
                columns = max((c["grid_col"] + c["col_span"] for c in placed), default=0)
                emit("block", order, story, path, text="\n".join("\t".join(r[0]) for r in table_rows), kind="table", rows=len(table_rows), columns=columns, simple=all(c["col_span"] == c["row_span"] == 1 for c in placed))  # noqa: B023
                for c in placed:
                    emit("cell", order, story, path, nested=False, **c)  # noqa: B023
                table_rows, order = [], order + 1

        for i, c in enumerate(chunk):
            if c not in "\r\x07\x0c":
                block.append(c)
                continue
            fc = offsets[at + i] if at + i < len(offsets) else 0
            istd, body = papx.at(fc)
            props = paragraph_properties(body)
            raw = "".join(block)
            whole = clean(field_results(raw))
            block = []
            if c == "\x07":
                if props.get("row_end"):
                    if cells:
                        table_rows.append((cells, *row_definition(body)))
                    cells = []
                else:
                    cells.append(whole.replace("\n", " "))
                continue
            if props.get("in_table"):
                if whole:
                    cells.append(whole)
                continue
            close_table()
            name = styles.get(istd)
            label = lists.label(props["list"], props.get("list_level", 0)) if props.get("list") else None
            heading = istd if 1 <= istd <= 9 else props.get("outline")
            if whole or c != "\x0c":
                first = at + i - len(raw)
                made: list[list] = []
                for j in visible(raw):  # runs: neighbours with the same character properties
                    own = chpx.at(offsets[first + j])[1] if first + j < len(offsets) else b""
                    if made and made[-1][1] == own:
                        made[-1][0] += raw[j]
                    else:
                        made.append([raw[j], own])
                for j, (t, own) in enumerate(made):
                    if clean(t):
                        emit("run", order, story, f"{order:06d}", text=clean(t), run=j, **character_properties(own))
                emit("block", order, story, f"{order:06d}", text=whole, kind="paragraph", style_name=name, heading_level=heading, align=props.get("align"), list_label=label, list_level=props.get("list_level") if label else None, page=page, section=section)
                order += 1
            if c == "\x0c":
                emit("block", order, story, f"{order:06d}", kind="break")
                order, page = order + 1, page + 1
        if block and (rest := clean(field_results("".join(block)))):
            emit("block", order, story, f"{order:06d}", text=rest, kind="paragraph")
            order += 1
        if cells:
            table_rows.append((cells, [], []))
        close_table()
        found += [(story, *f) for f in field_spans(chunk)]
        at += size
    try:
        start = sum(fib.counts.get(x, 0) for x in STORIES[:3])
        names, marks = owners(fib.slice(table, 36)), comment_marks(fib.slice(table, 4))
        for i, ((cp, initials, who), (a, b)) in enumerate(zip(marks, ranges(fib.slice(table, 5)))):
            line = next(iter(clean(field_results(text[:cp])).split("\n")[-1:]), "")
            emit("comment", i, "comment", name=str(i), text=clean(text[start + a : start + b]).strip("\x05\n"), author=names[who] if who < len(names) else None, initials=initials, anchor=line or None)
    except struct.error:
        pass
    for i, (story, instruction, cached) in enumerate(found):
        kind, token = grammar.kind_of(instruction)
        emit("field", i, story, name=kind, text=instruction, token=token, cached_result=clean(cached), unsupported_reason=None if kind == "Hyperlink" else "UnknownField" if kind == "Unknown" else "NoComputedResult")
    if not any(r["tag"] == "block" and any(x.isalnum() for x in r["text"] or "") for r in rows) and (wanted is None or "block" in wanted):
        raise Refused("NoText", "no indexable text")
    return rows


def field_spans(text: str) -> list[tuple[str, str]]:
    """(instruction, result) of each field, from its begin, separator and end marks; a field left open has none."""
    out, stack = [], []
    for c in text:
        if c == "\x13":
            stack.append(["", None])
            out.append(stack[-1])
        elif c == "\x14" and stack:
            stack[-1][1] = stack[-1][1] or ""
        elif c == "\x15" and stack:
            done = stack.pop()
            done.append(True)
            if stack and stack[-1][1] is not None:
                stack[-1][1] += done[1] or ""
        elif stack:
            if stack[-1][1] is None:
                stack[-1][0] += c
            else:
                stack[-1][1] += c
    return [(f[0].strip(), f[1] or "") for f in out if len(f) == 3]


def field_results(text: str) -> str:
    """Text with fields reduced to their results."""
    out, stack = [], []
    for c in text:
        if c == "\x13":
            stack.append(False)
        elif c == "\x14" and stack:
            stack[-1] = True
        elif c == "\x15" and stack:
            stack.pop()
        elif all(stack):
            out.append(c)
    return "".join(out)


def clean(text: str) -> str:
    """Marks of footnotes, pictures and their like go; line and page breaks are line feeds, U+001E a hyphen."""
    table = {i: None for i in range(32) if i not in (9, 10)} | {0x0B: "\n", 0x0C: "\n", 0x0D: "\n", 0x0E: "\n", 0x1E: "-", 0xA0: " "}
    return joined(text.translate(table))
