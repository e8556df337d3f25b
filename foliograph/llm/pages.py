"""Main text of web pages: nearest-URL differencing over structured lines.

Pages of a host are ordered by URL path and each is paired with the neighbour that shares the longer path prefix. The
text lines of the pair are aligned by longest common subsequence, and lines that both share are deleted as the site's
own. Markup decides where it says more than a pair can: lines in menus, footers, adverts and their like are never main
text, and prose within an article element (paragraphs, headings, items, cells, quotations) is never deleted, as copies
and quoted passages are shared, too; bare lines there are, unless all of the article is shared. Where an article holds
only a small part of a page's text, differencing decides on the plain lines beside it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
}
NOISE = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "head", "fieldset", "map", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar", "status"}
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "sidebar", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "comment", "comments", "respond",
    "disqus", "reply", "replies", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pagination", "pager", "footer", "masthead", "toolbar", "login", "signup", "alert", "disclaimer", "copyright",
}
OUTSIDE = {"header"}  # noise outside an article; inside it holds the title

PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre"}

PLAIN, ARTICLE, SITE, BARE = 0, 1, 2, 3  # BARE: in an article, but not in prose
TEASER = 0.2  # an article with less of the text is not the page's main text alone


def opens(name: str, attributes: str, inside: bool) -> int:
    """What an element makes of its lines: SITE, ARTICLE, or PLAIN for what its parents say."""
    if name in NOISE or (name in OUTSIDE and not inside):
        return SITE
    if attributes.strip():
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
        role = found.get("role", "")
        if role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return SITE
        words = set(re.split(r"[^a-z0-9]+", found.get("class", "") + " " + found.get("id", "")))
        if words & WORDS and name not in ("body", "html", "article", "main") or ("header" in words and not inside and name in ("div", "section")):
            return SITE
        if role in ("main", "article") or found.get("itemprop") == "articlebody":
            return ARTICLE
    return ARTICLE if name in ("article", "main") else PLAIN


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The text lines (blocks) of a page in order, and what each is. Character references are decoded, white space
    within a block is one space, and blocks without text are left out. Markup need not be well formed."""
    texts, kinds, block = [], [], []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    page = page or ""

    def flush() -> None:
        if block:
            if text := " ".join("".join(block).split()):
                texts.append(text)
                kinds.append(BARE if stack[-1][1] == ARTICLE and not any(n in PROSE for n, _ in stack) else stack[-1][1])
            block.clear()

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            block.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                block.append(m[0][9:].removesuffix("]]>"))
            continue
        name, state = m[2].lower(), stack[-1][1]
        if not m[1] and name in RAW:
            flush()
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in INLINE and not (not m[1] and m[3].strip() and opens(name, m[3], state == ARTICLE) == SITE):
            if m[1] and any(n == name and s == SITE for n, s in stack[1:]) and stack[-1][0] == name:
                flush()
                stack.pop()
            continue
        flush()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                stack.pop()
                state = stack[-1][1]
            own = opens(name, m[3], state == ARTICLE)
            if name in ("article", "main") and own == ARTICLE and state == SITE and stack[-1][0] in ("p", "li"):
                state = PLAIN  # within what was never closed
            stack.append((name, SITE if SITE in (own, state) else own or state))
    block.append(html.unescape(page[at:]))
    flush()
    return texts, kinds


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    out, node = set(), last[-1] if last else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def main_text(texts: list[str], kinds: list[int], other: list[str] | None) -> str:
    """The lines of an article element if there is one, without bare ones that the paired page shares; else the plain lines
    that it doesn't share. All of them if none are left, as of a copy. An article that is small beside such plain lines is
    a teaser: they stay with it. Lines are joined by one line feed."""
    gone = shared(texts, other) if other else set()
    plain = [i for i, k in enumerate(kinds) if k == PLAIN]
    own = [i for i in plain if i not in gone]
    article = [i for i, k in enumerate(kinds) if k in (ARTICLE, BARE)]
    if article:
        article = [i for i in article if kinds[i] == ARTICLE or i not in gone] or article
        here, beside = (sum(len(texts[i]) for i in at) for at in (article, own))
        return "\n".join(texts[i] for i in (sorted(article + own) if other and here < TEASER * (here + beside) else article))
    return "\n".join(texts[i] for i in own or plain)


def placed(df: DataFrame) -> DataFrame:
    """df with __host and __path of its __url."""
    host = F.lower(F.regexp_extract(F.coalesce("__url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce("__url", F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return df.withColumns({"__host": host, "__path": path})


def rank(row: dict) -> tuple:
    """A page's place in the order by host, path and key, nulls first."""
    return row["__host"], row["__path"], row["__key"] is not None, row["__key"]


def ranges(df: DataFrame, key: str, most: int) -> tuple[list[tuple], list[tuple]]:
    """The first and the last place of each range of the table in the order by host, path and key, none of them empty.

    Only the URLs and keys are ordered. There are as many ranges as shuffle partitions; small ones that follow each other
    are joined to hold `most` pages at most.
    """
    urls = df.select("__host", "__path", F.col(key).alias("__key"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("__host", "__path", "__key")
    dealt = urls.repartitionByRange(n, *urls.columns).withColumn("__range", F.spark_partition_id())
    found = dealt.groupBy("__range").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).toArrow().to_pylist()
    firsts, lasts, held = [], [], 0
    for r in sorted(found, key=lambda r: rank(r["first"])):
        if firsts and held + r["n"] <= most:
            lasts[-1], held = rank(r["last"]), held + r["n"]
        else:
            firsts.append(rank(r["first"]))
            lasts.append(rank(r["last"]))
            held = r["n"]
    return firsts, lasts


def extract(df: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", into: str = "text", most: int = 128) -> DataFrame:
    """df without the html column and with the main text of the whole page, '' where there is none; `into` is replaced.

    Null pages are empty, pages with a null or relative URL are a host of their own, ties in path are ordered by key.
    A page without a neighbour on its host loses no lines by pairing. Repeated rows are each other's neighbours; as all
    their plain lines are shared, they keep them. An empty table gives an empty one. The whole table is cut into ranges
    in the order by host, path and key, and each gets the last page before it and the first one after it, if these are of
    the same host, so that a page has its true neighbours wherever its host is cut. Pages are parsed where they are read;
    then lines are exchanged once, and a task holds three pages at a time, however large a host is. Only rows that agree
    in host, path and key stay in one task.
    """
    rest = [c for c in df.columns if c not in (page, into)]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    named = {c: f"c{i}" for i, c in enumerate(rest)}
    start = df.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()), F.col(f"`{page}`").alias("__html"), F.col(f"`{url}`").alias("__url"))

    start = placed(start)
    firsts, lasts = ranges(start, named[key], most)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__html")
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                found = [lines(x.as_py()) for x in part.column(at)]
                cols = [part.column(j) for j in range(b.num_columns) if j != at]
                names = [n for j, n in enumerate(b.schema.names) if j != at]
                own = [rank({"__host": h, "__path": p, "__key": k}) for h, p, k in zip(*(part.column(c).to_pylist() for c in ("__host", "__path", named[key])), strict=True)]
                to = [bisect_right(firsts, x) - 1 for x in own]
                seen = [(j, r, False) for j, r in enumerate(to)]  # position, range, whether the page is there for its neighbour only
                seen += [(j, r + 1, True) for j, r in enumerate(to) if own[j] == lasts[r] and r + 1 < len(firsts) and firsts[r + 1][0] == own[j][0]]
                seen += [(j, r - 1, True) for j, r in enumerate(to) if own[j] == firsts[r] and r and lasts[r - 1][0] == own[j][0]]
                given = pa.RecordBatch.from_arrays(
                    [*cols, pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([k for _, k in found], pa.list_(pa.int8()))], names=[*names, "__texts", "__kinds"]
                ).take(pa.array([j for j, _, _ in seen], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*given.columns, pa.array([r for _, r, _ in seen], pa.int32()), pa.array([g for _, _, g in seen], pa.bool_())], names=[*given.schema.names, "__range", "__guest"]
                )

    inner = ", ".join(f"{n} {types[c]}" for c, n in named.items())
    parsed = start.mapInArrow(parse, f"{inner}, __url string, __host string, __path string, __texts array<string>, __kinds array<tinyint>, __range int, __guest boolean")
    dealt = parsed.repartitionById(max(1, len(firsts)), F.col("__range")).sortWithinPartitions("__range", "__host", "__path", named[key])

    def alike(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return n

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(0, b.num_rows, 200):
                    yield from b.slice(i, 200).to_pylist()

        out: list[dict] = []
        before = here = None
        for after in _with_end(rows()):
            if here is not None and not here["__guest"]:
                near = [x for x in (before, after) if x is not None and (x["__range"], x["__host"]) == (here["__range"], here["__host"])]
                other = max(near, key=lambda x: alike(x["__path"], here["__path"]))["__texts"] if near else None  # the first of equals
                out.append({n: here[n] for n in named.values()} | {"__text": main_text(here["__texts"], here["__kinds"], other)})
                if len(out) == 200:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            before, here = here, after
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    wanted = StructType([f for f in start.schema.fields if f.name in named.values()]).add("__text", StringType())
    schema = to_arrow_schema(wanted)
    done = dealt.mapInArrow(difference, wanted)
    return done.select(*(F.col(n).alias(c) for c, n in named.items()), F.col("__text").alias(into))


def _with_end(rows: Iterator[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None


def op10_nearest_url(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
