"""Document packages: sniffing, guarded reading, relationships, and the scan that opens files into records."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MIME

MOST_ENTRIES, LONGEST_NAME, MOST_RECORDS = 65536, 4096, 65536
PART_BYTES, MEDIA_BYTES, PACKAGE_BYTES = 64 << 20, 256 << 20, 512 << 20
DEEPEST = 256
#: Opened records are handed on when so many, or so many characters of them, are held.
FRAME_ROWS, FRAME_CHARS = 5000, 4 << 20

ZIP_MAGIC, OLE_MAGIC = b"PK\x03\x04", bytes.fromhex("D0CF11E0A1B11AE1")


class Refused(Exception):
    """A file that can't be opened: kind is one word, said is for people."""

    def __init__(self, kind: str, said: str = ""):
        super().__init__(said or kind)
        self.kind, self.said = kind, said or kind


def sniff(content: Column) -> Column:
    """docx, doc or null, by the first bytes. An expression, so other files are never handed to Python."""
    return F.when(F.substring(content, 1, 4) == F.lit(bytearray(ZIP_MAGIC)), "docx").when(F.substring(content, 1, 8) == F.lit(bytearray(OLE_MAGIC)), "doc")


def entry_budget(data: bytes) -> int:
    """How many entries the end-of-directory record announces, read before the directory is; too many are refused."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if at < 0 or at + 22 > len(data):
        raise Refused("Docx", "no end of central directory")
    n = struct.unpack_from("<H", data, at + 10)[0]
    size = struct.unpack_from("<I", data, at + 12)[0]
    if n == 0xFFFF or size // 46 > MOST_ENTRIES:
        raise Refused("Docx", "too many entries")
    return n


@dataclass
class Package:
    """Parts by name, in order, as they are in the file; touched names have been changed."""

    parts: dict[str, bytes] = field(default_factory=dict)
    touched: set[str] = field(default_factory=set)
    complete: bool = True
    _rels: dict[str, tuple[bytes, list[dict]]] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def read(cls, data: bytes) -> Package:
        if data[:4] != ZIP_MAGIC:
            raise Refused("Docx", "not a ZIP package")
        entry_budget(data)
        out, total, media = cls(), 0, 0
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if len(z.infolist()) > MOST_ENTRIES:
                    raise Refused("Docx", "too many entries")
                for e in z.infolist():
                    if e.is_dir():
                        continue
                    if len(e.filename) > LONGEST_NAME:
                        raise Refused("Docx", "entry name too long")
                    with z.open(e) as f:
                        body = f.read(PART_BYTES + 1)
                    if len(body) > PART_BYTES:
                        raise Refused("Docx", f"part too large: {e.filename}")
                    total += len(body)
                    media += len(body) if "/media/" in e.filename else 0
                    if total > PACKAGE_BYTES or media > MEDIA_BYTES:
                        raise Refused("Docx", "package too large")
                    out.parts.setdefault(e.filename.lstrip("/"), body)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, struct.error) as x:
            raise Refused("Docx", f"malformed ZIP: {x}") from None
        except zipfile.zlib.error as x:
            raise Refused("Docx", f"malformed ZIP: {x}") from None
        return out

    def save(self) -> bytes:
        """The package as a ZIP; parts that weren't touched keep their bytes. Refused if what it refers to is missing."""
        if problems := self.problems():
            raise Refused("Docx", "; ".join(problems))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in self.parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
        return held.getvalue()

    def problems(self) -> list[str]:
        out = [] if self.complete else ["package is incomplete"]
        if "[Content_Types].xml" not in self.parts:
            out.append("no content types")
        for name in [n for n in self.parts if n.endswith(".rels")]:
            for r in relationships(self.parts[name]):
                target = resolve(rels_source(name), r["target"])
                if not r["external"] and target and target not in self.parts:
                    out.append(f"{name}: missing {target}")
        return out

    def xml(self, name: str) -> ElementTree.Element | None:
        return parse_xml(self.parts[name]) if name in self.parts else None

    def rels(self, source: str) -> list[dict]:
        folder, _, leaf = source.rpartition("/")
        name = f"{folder}/_rels/{leaf}.rels" if folder else f"_rels/{leaf}.rels"
        if name not in self.parts:
            return []
        if name not in self._rels or self._rels[name][0] is not self.parts[name]:  # parsed again when the part is another
            self._rels[name] = self.parts[name], relationships(self.parts[name])
        return self._rels[name][1]


class _Guard(ElementTree.TreeBuilder):
    def __init__(self):
        super().__init__()
        self.depth = 0

    def start(self, tag, attrs):
        self.depth += 1
        if self.depth > DEEPEST:
            raise Refused("Docx", "XML too deep")
        return super().start(tag, attrs)

    def end(self, tag):
        self.depth -= 1
        return super().end(tag)


def parse_xml(body: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in body[:2048] or b"<!ENTITY" in body[:65536]:
        raise Refused("Docx", "document type declarations are refused")
    try:
        if body.startswith(b"<") and body.count(b"<") <= DEEPEST:  # too few tags to be too deep
            return ElementTree.fromstring(body)
        return ElementTree.fromstring(body, ElementTree.XMLParser(target=_Guard()))
    except (ElementTree.ParseError, ValueError, LookupError) as x:
        raise Refused("Docx", f"malformed XML: {x}") from None


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def local(e: ElementTree.Element | str) -> str:
    return _local(e if isinstance(e, str) else e.tag)


def attr(e: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name, whatever its prefix."""
    for k, v in e.attrib.items():
        if _local(k) == name:
            return v
    return default


def _plainly_too_many(body: bytes) -> bool:
    """Whether a part holds nothing but its root and more relationships than may be, by its tags alone: without comments,
    sections and instructions every < begins a tag, and two of these are the root's. False says nothing."""
    n = body.count(b"<Relationship ")
    if n <= MOST_RECORDS or b"<!" in body or body.count(b"<?") != (head := body.startswith(b"<?xml ")):
        return False
    return body.count(b"<") == n + 2 + head and body.startswith(b"<Relationships", body.find(b"<", head)) and body.rstrip().endswith(b"</Relationships>")


def relationships(body: bytes) -> list[dict]:
    """The root's relationships; none of a malformed part. Too many are refused once they are seen, whatever follows."""
    if b"<!DOCTYPE" in body[:2048] or b"<!ENTITY" in body[:65536]:
        return []
    if _plainly_too_many(body):
        raise Refused("Docx", "too many relationships")
    out, depth = [], 0

    def start(tag: str, attrs: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        if depth > DEEPEST:
            raise ValueError("XML too deep")
        if depth == 2 and local(tag) == "Relationship":
            if len(out) == MOST_RECORDS:
                raise Refused("Docx", "too many relationships")
            named: dict[str, str] = {}
            for k, v in attrs.items():
                named.setdefault(k.rpartition("}")[2], v)
            out.append({"rid": named.get("Id"), "type": named.get("Type") or "", "target": named.get("Target") or "", "external": named.get("TargetMode") == "External"})

    def end(tag: str) -> None:
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(body, True)
    except (expat.ExpatError, ValueError, LookupError):
        return []
    return out


def rels_source(name: str) -> str:
    """The part that a relationships part belongs to."""
    folder, _, leaf = name.rpartition("/")
    return folder.removesuffix("_rels") + leaf.removesuffix(".rels")


def resolve(source: str, target: str) -> str:
    path = target if target.startswith("/") else source.rpartition("/")[0] + "/" + target
    out: list[str] = []
    for x in path.split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def content_types(package: Package) -> tuple[dict[str, str], dict[str, str]]:
    """(default types by suffix, types by part name)."""
    root = package.xml("[Content_Types].xml")
    defaults, overrides = {}, {}
    for e in root if root is not None else ():
        if local(e) == "Default":
            defaults[(attr(e, "Extension") or "").lower()] = attr(e, "ContentType") or ""
        elif local(e) == "Override":
            overrides[(attr(e, "PartName") or "").lstrip("/")] = attr(e, "ContentType") or ""
    return defaults, overrides


def image_size(body: bytes, mime: str) -> tuple[int, int] | None:
    """Width and height in pixels of a PNG, GIF, BMP, JPEG, TIFF or WebP image; null for others and broken ones."""
    try:
        if mime == "image/png" and body[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", body, 16)
        if mime == "image/gif" and body[:3] == b"GIF":
            return struct.unpack_from("<HH", body, 6)
        if mime == "image/bmp" and body[:2] == b"BM":
            w, h = struct.unpack_from("<ii", body, 18)
            return w, abs(h)
        if mime == "image/webp" and body[8:12] == b"WEBP":
            kind = body[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little")
            if kind == b"VP8L":
                n = int.from_bytes(body[21:25], "little")
                return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1
            if kind == b"VP8 ":
                w, h = struct.unpack_from("<HH", body, 26)
                return w & 0x3FFF, h & 0x3FFF
        if mime == "image/tiff":
            e = "<" if body[:2] == b"II" else ">"
            at, sizes = struct.unpack_from(e + "I", body, 4)[0], {}
            for i in range(struct.unpack_from(e + "H", body, at)[0]):
                tag, kind = struct.unpack_from(e + "HH", body, at + 2 + 12 * i)
                sizes[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), body, at + 10 + 12 * i)[0]
            return sizes[256], sizes[257]
        if mime == "image/jpeg":
            at = 2
            while at + 9 < len(body):
                if body[at] != 0xFF:
                    return None
                mark, n = body[at + 1], struct.unpack_from(">H", body, at + 2)[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", body, at + 5)
                    return w, h
                at += 2 + n
    except (struct.error, KeyError, IndexError):
        pass
    return None


def metafile_size(body: bytes, kind: str) -> tuple[int, int] | None:
    """Width and height in pixels of an EMF (its bounds) or placeable WMF (at 96 dots an inch), packed by gzip or not."""
    if body[:2] == b"\x1f\x8b":
        import gzip

        try:
            with gzip.open(io.BytesIO(body)) as f:
                body = f.read(PART_BYTES + 1)
        except (OSError, EOFError, zipfile.zlib.error):
            return None
        if len(body) > PART_BYTES:
            return None
    try:
        if kind.upper() in ("EMF", "EMZ"):
            if struct.unpack_from("<I", body)[0] != 1 or body[40:44] != b" EMF":
                return None
            a, b, c, d = struct.unpack_from("<4i", body, 8)
            size = c - a + 1, d - b + 1
        else:
            magic, a, b, c, d, inch = struct.unpack_from("<I2x4hH", body)
            if magic != 0x9AC6CDD7 or not inch:
                return None
            size = round((c - a) * 96 / inch), round((d - b) * 96 / inch)
    except struct.error:
        return None
    return size if min(size) > 0 else None


def mime_of(name: str) -> str:
    return MIME.get(name.rpartition(".")[2].lower(), "application/octet-stream")


#: One record of an opened document: what it is (tag), where it is (story, path, ord), and its own values.
RECORD = "doc_id string, tag string, ord int, story string, path string, name string, text string, fields map<string,string>"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content, format (docx, doc or null, by the first bytes) of the files.

    Files over PACKAGE_BYTES come without content, which isn't read, and are opened to an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    found = files.where(F.col("length") <= PACKAGE_BYTES).select("path", "length", "content").withColumn("format", sniff(F.col("content")))
    large = files.where(F.col("length") > PACKAGE_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("format"))
    return found.unionByName(large)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have, at least one a core. Rows that are few but dear, as packages to
    parse or make, would else be merged into a task or two by their size."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def open_documents(files: DataFrame, wanted: list[str] | None = None, key: str = "path", context: dict | None = None) -> DataFrame:
    """Records (RECORD) of every file, a batch of files at a time. wanted names the tags to make; others aren't parsed out.

    A file that can't be opened is one record with the tag "error"; it never fails the job. Null content is one, too, and
    so is a file whose `length` is over PACKAGE_BYTES. Errors of our own code have the name "Internal"; a task that runs
    out of memory fails, as the file may be sound.
    """
    wants = set(wanted) if wanted is not None else None
    length = F.col("length").cast("long") if "length" in files.columns else F.lit(None).cast("long")
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def opened(body, size) -> list[dict]:
        from .binary import open_doc
        from .wml import open_docx

        try:
            data = bytes(body) if body is not None else b""
            if max(len(data), size if size == size and size is not None else 0) > PACKAGE_BYTES:
                raise Refused("Docx", "file too large")
            if data[:4] == ZIP_MAGIC:
                rows = open_docx(data, wants, context)
            elif data[:8] == OLE_MAGIC:
                rows = open_doc(data, wants)
            else:
                raise Refused("NotOle2", "neither a ZIP package nor a compound file")
            if wants is None or "package" in wants:
                rows.insert(0, {"tag": "package", "ord": 0, "name": "docx" if data[:4] == ZIP_MAGIC else "doc"})
        except Refused as x:
            rows = [{"tag": "error", "ord": 0, "name": x.kind, "text": x.said}]
        except (RecursionError, ValueError, KeyError, IndexError, struct.error) as x:
            rows = [{"tag": "error", "ord": 0, "name": "Malformed", "text": f"{type(x).__name__}: {x}"[:500]}]
        except (TypeError, AttributeError) as x:
            rows = [{"tag": "error", "ord": 0, "name": "Internal", "text": f"{type(x).__name__}: {x}"[:500]}]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {c: [] for c in columns}
        chars = 0

        def frame() -> pd.DataFrame:
            nonlocal chars
            out = pd.DataFrame({c: pd.Series(v, dtype="int32" if c == "ord" else "object") for c, v in held.items()})
            for v in held.values():
                v.clear()
            chars = 0
            return out

        for b in batches:
            for doc, body, size in zip(b["k"], b["content"], b["length"]):
                for r in opened(body, size):
                    fields = r.get("fields") or {}
                    for c in columns[1:-1]:
                        held[c].append(r.get(c))
                    held["doc_id"].append(doc)
                    held["fields"].append(fields)
                    chars += len(r.get("text") or "") + sum(map(len, fields.values()))
                    if len(held["doc_id"]) >= FRAME_ROWS or chars >= FRAME_CHARS:  # small documents share a frame
                        yield frame()
            if held["doc_id"]:
                yield frame()

    return files.select(F.col(key).cast("string").alias("k"), "content", length.alias("length")).mapInPandas(run, RECORD)


def records(opened: DataFrame, tag: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One kind of record as a table: the common columns and the named values cast to their types."""
    return opened.where(F.col("tag") == tag).select("doc_id", "ord", "story", "path", "name", "text", *(F.col("fields")[c].try_cast(t).alias(c) for c, t in (columns or {}).items()))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A corpus manifest (tab-separated, # before the header): counts as long, with `problem` for duplicate paths and
    counts that are negative or not numbers."""
    from pyspark.sql import Window

    rows = spark.read.text(path).where(F.trim("value") != "")
    head = rows.where(F.col("value").startswith("# path")).first()
    names = head[0].lstrip("# ").split("\t")
    cells = rows.where(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("c"))
    numbers = [n for n in names if n not in ("path", "warnings")]
    out = cells.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)), F.size("c").alias("__n"))
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(F.col(n).try_cast("long") < 0, F.lit(True))
    twice = F.count(F.lit(1)).over(Window.partitionBy("path")) > 1
    problem = F.when(F.col("__n") != len(names), "columns").when(twice, "duplicate").when(bad, "count")
    return out.withColumn("problem", problem).withColumns({n: F.col(n).try_cast("long") for n in numbers}).drop("__n")
