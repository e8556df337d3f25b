"""The engine's queries over the tables of a store, each with the same question in DuckDB SQL.

A query binds a table to an operator's input (bindings.py), applies the operator to whole tables and names its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import content, counters, lookups, reports, tables
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORMAL = r"""finals AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, chr(13) || chr(11) || chr(12) || chr(160), chr(10) || chr(10) || chr(10) || ' '), chr(10)),
    lambda x: CASE WHEN regexp_matches(x, '^\t+$') THEN x ELSE regexp_replace(regexp_replace(x, '\s+$', ''), '^ +', '') END), lambda x: x <> '') AS k FROM documents),
normal AS (SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN i = 1 OR k[i] <> k[i - 1] OR contains(k[i], chr(9))
    OR (regexp_matches(k[i], '^[0-9 \t\-‐‑/\\]+$') AND regexp_matches(k[i], '[0-9]')) THEN k[i] END), lambda x: x IS NOT NULL), chr(10)) AS text FROM finals)"""


@query(f"WITH {NORMAL} SELECT doc_id, text, len(string_split(text, chr(10)))::INT AS paragraphs, length(text)::INT AS text_chars FROM normal")
def text_normalize(spark, sf_dir):
    out = b.documents(spark, sf_dir).select("doc_id", text.finalize("text").alias("text"))
    return out.select("doc_id", "text", F.size(F.split("text", "\n")).alias("paragraphs"), F.char_length("text").alias("text_chars"))


@query(r"""SELECT doc_id, count(*) FILTER (line <> '') AS paragraphs, 0::BIGINT AS tables, 0::BIGINT AS figures, sum(length(line))::BIGINT AS text_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def text_stats(spark, sf_dir):
    lines = b.document_lines(spark, sf_dir)
    return content.stats(lines.select("doc_id", F.when(F.col("line") != "", "paragraph").alias("kind"), F.col("line").alias("text")))


@query(r"""SELECT doc_id, ord::INT AS ord, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents)
WHERE regexp_matches(line, '[\p{L}\p{N}]')""")
def indexable_filter(spark, sf_dir):
    return b.document_lines(spark, sf_dir).where(text.has_indexable("line"))


@query("SELECT doc_id, text || chr(10) AS text FROM documents")
def paragraphs_flatten(spark, sf_dir):
    return content.flatten(b.document_lines(spark, sf_dir).select("doc_id", "ord", F.lit("paragraph").alias("kind"), F.col("line").alias("text")))


@query(r"""WITH w AS (SELECT page_id, url, upper(substr(url, 1, 1)) || substr(url, 2) AS first_cap FROM pages)
SELECT page_id, first_cap, replace(replace(url, ' ', '%20'), ')', '%29') AS md_url, upper(regexp_replace(url, '[_\-\s]', '', 'g')) AS key,
    regexp_replace(url, '([\\`*_\[\]<>|])', '\\\1', 'g') AS md, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM w""")
def text_escapes(spark, sf_dir):
    u = b.read(spark, sf_dir, "pages").select("page_id", "url")
    return u.select("page_id", text.first_cap("url").alias("first_cap"), text.markdown_url("url").alias("md_url"), text.property_key("url").alias("key"), text.markdown_escape("url").alias("md"), text.html_escape("url", True).alias("html"))


@query(r"""SELECT p_partkey, p_name, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') AS caps FROM part""")
def text_caps(spark, sf_dir):
    return b.read(spark, sf_dir, "part").select("p_partkey", "p_name", text.caps("p_name").alias("caps"))


@query(r"""SELECT p_partkey, regexp_matches(p_name, '^.*1.$') AS one, p_name LIKE 'part%' OR p_name LIKE 'Part%' AS starts, (p_name = 'x') AS same,
    CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_text, CASE WHEN abs(p_size - 25) < 1e-12 THEN '1' ELSE '0' END AS compared FROM part""")
def if_compare_wildcard(spark, sf_dir):
    p = b.read(spark, sf_dir, "part")
    either = text.text_equal("p_name", F.lit("part*")) | text.text_equal("p_name", F.lit("Part*"))
    return p.select(
        "p_partkey", text.text_equal("p_name", F.lit("*1?")).alias("one"), either.alias("starts"), text.text_equal("p_name", F.lit("x")).alias("same"),
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("size_text"), F.when(F.abs(F.col("p_size") - 25) < 1e-12, "1").otherwise("0").alias("compared"),
    )


def _levels(spark, sf_dir):
    cells = b.line_cells(spark, sf_dir).select("doc_id", F.col("row").alias("ord"), ((F.col("l_partkey") + F.col("row")) % 3).cast("int").alias("level"))
    return counters.level_counters(cells, levels=3)


ROWS = """rows AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)::INT AS row, * FROM lineitem)"""
LEVELS = (
    ROWS + """, items AS (SELECT doc_id, row AS ord, ((l_partkey + row) % 3)::INT AS level FROM rows),
a AS (SELECT *, sum((level = 0)::INT) OVER w AS n0, sum((level = 1)::INT) OVER w AS n1, sum((level = 2)::INT) OVER w AS n2 FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT *, max(CASE WHEN level < 1 THEN n1 END) OVER w AS b1, max(CASE WHEN level < 2 THEN n2 END) OVER w AS b2 FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
counted AS (SELECT doc_id, ord, level, n0::INT AS c0, (CASE WHEN level < 1 THEN 0 ELSE n1 - coalesce(b1, 0) END)::INT AS c1, (CASE WHEN level < 2 THEN 0 ELSE n2 - coalesce(b2, 0) END)::INT AS c2 FROM c)"""
)


@query(f"""WITH {LEVELS} SELECT doc_id, ord, level, CASE level WHEN 0 THEN c0 || '.' WHEN 1 THEN c0 || '.' || c1 ELSE c0 || '.' || c1 || '.' || c2 END AS label,
CASE level WHEN 0 THEN c0::VARCHAR WHEN 1 THEN CASE WHEN c0 > 0 THEN c0 || '.' || c1 END ELSE CASE WHEN c0 > 0 AND c1 > 0 THEN c0 || '.' || c1 || '.' || c2 END END AS full_label FROM counted""")
def list_labels_decimal(spark, sf_dir):
    out = counters.list_labels(_levels(spark, sf_dir), ["decimal"] * 3, ["%1.", "%1.%2", "%1.%2.%3"])
    return out.select("doc_id", "ord", "level", "label", "full_label")


DIGITS = "['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][{n} % 10 + 1]"
LOW_ROMAN = "['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][({n} // 10) % 10 + 1] || " + DIGITS


@query(f"""WITH {LEVELS}, t AS (SELECT *, CASE WHEN c0 = 0 THEN '0' ELSE upper({LOW_ROMAN.format(n='c0')}) END AS r0, CASE WHEN c1 = 0 THEN 'a' WHEN c1 <= 26 THEN chr(96 + c1) ELSE chr(96 + (c1 - 1) // 26) || chr(97 + (c1 - 1) % 26) END AS l1,
CASE WHEN c2 = 0 THEN '0' ELSE {LOW_ROMAN.format(n='c2')} END AS r2 FROM counted) SELECT doc_id, ord, level, CASE level WHEN 0 THEN r0 || ')' WHEN 1 THEN l1 || ')' ELSE '(' || r2 || ')' END AS label FROM t""")
def list_labels_roman_alpha(spark, sf_dir):
    out = counters.list_labels(_levels(spark, sf_dir), ["upperRoman", "lowerLetter", "lowerRoman"], ["%1)", "%2)", "(%3)"])
    return out.select("doc_id", "ord", "level", "label")


@query("""WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderstatus AS s FROM orders),
g AS (SELECT *, sum((s = 'F')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS seg FROM e),
n AS (SELECT *, sum((s = 'O')::INT) OVER (PARTITION BY doc_id, seg ORDER BY ord) AS c, max((s IN ('O', 'F'))::INT) OVER (PARTITION BY doc_id, seg ORDER BY ord) AS begun FROM g)
SELECT doc_id, ord, s AS status, CASE WHEN begun > 0 THEN c END::BIGINT AS number FROM n""")
def seq_counter_reset(spark, sf_dir):
    e = b.order_events(spark, sf_dir).select("doc_id", "ord", "status")
    act = F.when(F.col("status") == "O", "n").when(F.col("status") == "F", "r").otherwise("c")
    return counters.sequence_numbers(e.withColumns({"action": act, "value": F.lit(0).cast("long")})).select("doc_id", "ord", "status", "number")


@query("""SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderpriority <> '5-LOW' THEN sum((o_orderpriority <> '5-LOW')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END::BIGINT AS number FROM orders""")
def autonum(spark, sf_dir):
    e = b.order_events(spark, sf_dir).select("doc_id", "ord", "priority")
    return counters.auto_numbers(e, F.col("priority") != "5-LOW").select("doc_id", "ord", "number")


@query("""WITH k AS (SELECT min(event_type) AS t FROM events) SELECT user_id AS doc_id, event_id AS ord, CASE WHEN event_type <> t THEN sum((event_type <> t)::INT) OVER (PARTITION BY user_id ORDER BY event_id) + 2 END::BIGINT AS number FROM events, k""")
def note_ordinals(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), "event_type")
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("t"))))  # one row
    return counters.note_ordinals(e, F.col("event_type") == F.col("t"), start=3).select("doc_id", "ord", "number")


LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS ord, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {LINES}, p AS (SELECT doc_id, ord, (1 + sum((length(line) > 300)::INT) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS page, (1 + sum((length(line) > 600)::INT) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS section FROM lines)
SELECT doc_id, ord, page, section, max(page) OVER s - min(page) OVER s + 1 AS section_pages FROM p WINDOW s AS (PARTITION BY doc_id, section)""")
def page_numbers(spark, sf_dir):
    lines = b.document_lines(spark, sf_dir)
    p = counters.page_numbers(lines, F.length("line") > 300)
    p = counters.page_numbers(p.withColumnRenamed("page", "__page"), F.length("line") > 600).select("doc_id", "ord", F.col("__page").alias("page"), F.col("page").alias("section"))
    return counters.with_section_pages(p)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS doc_id, o_orderkey::BIGINT AS ord, CASE o_orderstatus WHEN 'F' THEN 'oddPage' WHEN 'O' THEN 'page' ELSE 'evenPage' END AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_custkey % 10 = 1),
r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS ord, 1 AS page, 1 AS section FROM (SELECT DISTINCT doc_id FROM e) UNION ALL
SELECT e.doc_id, e.i, e.ord, CASE kind WHEN 'page' THEN page + 1 WHEN 'evenPage' THEN page + 1 + (page + 1) % 2 ELSE page + 1 + page % 2 END, section + (kind <> 'page')::INT FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
SELECT doc_id, ord, page, section FROM r WHERE i > 0""".replace(" WHERE o_custkey % 10 = 1", ""))
def section_pages(spark, sf_dir):
    e = b.order_events(spark, sf_dir)
    kind = F.when(F.col("status") == "F", "oddPage").when(F.col("status") == "O", "page").otherwise("evenPage")
    return counters.section_pages(e.select("doc_id", "ord", kind.alias("kind")))


@query("""SELECT o_custkey AS doc_id, o_orderkey AS ord, coalesce(last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
first_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS styleref FROM orders""")
def styleref_asof(spark, sf_dir):
    e = b.order_events(spark, sf_dir).select("doc_id", "ord", "priority")
    return lookups.style_ref(e, F.col("priority") == "1-URGENT", "ord").select("doc_id", "ord", "styleref")


@query("""SELECT conv_id AS doc_id, turn AS ord, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations""")
def last_header_inherited(spark, sf_dir):
    c = b.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", "text")
    return lookups.inherited(c, F.when(F.col("role") == "system", F.col("text")), "header").select("doc_id", "ord", "header")


def _value_cells(spark, sf_dir):
    cells = b.line_cells(spark, sf_dir)
    return cells.select("doc_id", "row", F.lit(1).alias("col"), F.when(F.col("l_quantity") < 49, F.col("l_quantity")).alias("value"), (F.col("l_linestatus") == "F").alias("formula"))


VALUES = ROWS + ", v AS (SELECT doc_id, row, CASE WHEN l_quantity < 49 THEN l_quantity END AS value, l_linestatus = 'F' AS formula FROM rows)"


@query(f"""WITH {VALUES} SELECT doc_id, row, CASE WHEN count(*) FILTER (value IS NULL) OVER w = 0 AND count(*) OVER w > 0 THEN sum(value) OVER w END AS result FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def table_formula_above(spark, sf_dir):
    return tables.directional(_value_cells(spark, sf_dir), "SUM", "ABOVE").select("doc_id", "row", "result")


@query(f"""WITH {VALUES}, s AS (SELECT *, sum(formula::INT) OVER (PARTITION BY doc_id ORDER BY row) AS seg FROM v)
SELECT doc_id, row, CASE WHEN count(*) FILTER (value IS NULL) OVER w = 0 AND count(*) OVER w > 0 THEN max(value) OVER w END AS result FROM s WINDOW w AS (PARTITION BY doc_id, seg ORDER BY row ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def table_formula_below(spark, sf_dir):
    return tables.directional(_value_cells(spark, sf_dir), "MAX", "BELOW", formula=F.col("formula")).select("doc_id", "row", "result")


LONG = ROWS + """, cells AS (SELECT doc_id, row, col, [l_quantity, round(l_discount * 100), l_linenumber::DOUBLE][col] AS value FROM rows, (SELECT unnest([1, 2, 3]) AS col))"""


def _three_columns(spark, sf_dir):
    cells = b.line_cells(spark, sf_dir)
    cols = F.array(F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.col("l_linenumber").cast("double"))
    return cells.select("doc_id", "row", F.posexplode(cols).alias("col", "value")).withColumn("col", F.col("col") + 1)


@query(f"""WITH {LONG} SELECT doc_id, row, col, CASE WHEN count(*) OVER w > 0 THEN sum(value) OVER w END AS result FROM cells WINDOW w AS (PARTITION BY doc_id, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def table_formula_left(spark, sf_dir):
    return tables.directional(_three_columns(spark, sf_dir), "SUM", "LEFT").select("doc_id", "row", "col", "result")


@query(f"""WITH {LONG}, s AS (SELECT *, sum(value) OVER w AS t, count(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY doc_id, col)) SELECT doc_id, row, col, CASE WHEN n > 1 THEN (t - value) / (n - 1) END AS result FROM s""")
def table_formula_r_c(spark, sf_dir):
    return tables.directional(_three_columns(spark, sf_dir), "AVERAGE", "C").select("doc_id", "row", "col", "result")


@query(f"""WITH {LONG}, n AS (SELECT doc_id, max(row) AS n FROM cells GROUP BY doc_id), f AS (SELECT DISTINCT doc_id, row, 4 AS col FROM cells)
SELECT f.doc_id, f.row, CASE WHEN any_value(n) >= 3 THEN sum(value) END AS result FROM f JOIN n USING (doc_id) JOIN cells c ON c.doc_id = f.doc_id AND c.row BETWEEN least(f.row, 3) AND greatest(f.row, 3) AND c.col BETWEEN 1 AND 2 GROUP BY f.doc_id, f.row""")
def table_formula_range(spark, sf_dir):
    cells = _three_columns(spark, sf_dir)
    f = cells.where("col = 1").select("doc_id", "row", F.lit(4).alias("col"), F.lit(3).alias("r1"), F.lit(2).alias("c1"), F.col("row").alias("r2"), F.lit(1).alias("c2"))
    return tables.range_formula(f, cells, "SUM").select("doc_id", "row", "result")


@query(f"""WITH {LONG} SELECT f.doc_id, f.row, c.value AS result FROM (SELECT DISTINCT doc_id, row FROM cells) f LEFT JOIN cells c ON c.doc_id = f.doc_id AND c.row = f.row + 1 AND c.col = 2""")
def table_cell_reference(spark, sf_dir):
    cells = _three_columns(spark, sf_dir)
    f = cells.where("col = 1").select("doc_id", "row", F.lit(4).alias("col"), (F.col("row") + 1).alias("r"), F.lit(2).alias("c"))
    return tables.cell_reference(f, cells.withColumn("contains_formula", F.lit(False))).select("doc_id", "row", "result")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity - 7 * floor(l_quantity / 7) AS mod7, sign(l_discount * 100 - 5) * floor(abs((l_discount * 100 - 5) / 3 * 100) + 0.5::DOUBLE) / 100 AS rounded,
floor((l_quantity - 25) / 3) AS whole, CASE WHEN abs(l_tax - 0.04::DOUBLE) < 1e-12 THEN 0 WHEN l_tax > 0.04::DOUBLE THEN 1 ELSE -1 END AS sign, CASE WHEN l_quantity = 25 THEN NULL ELSE 100 / (l_quantity - 25) END AS quotient,
(CASE WHEN l_quantity > 25 AND l_tax > 0 THEN 1 ELSE 0 END)::DOUBLE AS both FROM lineitem""")
def formula_eval(spark, sf_dir):
    from ..functions import formula as f

    li = b.read(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", f.modulo(q, F.lit(7.0)).alias("mod7"), f.round_half_away((d * 100 - 5) / 3, 2).alias("rounded"), F.floor((q - 25) / 3).cast("double").alias("whole"),
        f.sign(t - 0.04).cast("int").alias("sign"), f.divide(F.lit(100.0), q - 25).alias("quotient"), f.all_of(q > 25, f.truthy(t)).alias("both"),
    )


@query("""SELECT p_partkey, p_size AS n, p_size::VARCHAR AS arabic, upper(to_hex(p_size)) AS hex, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
upper(""" + LOW_ROMAN.format(n="p_size") + """) AS roman, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE chr(64 + (p_size - 1) // 26) || chr(65 + (p_size - 1) % 26) END AS letters, lpad(p_size::VARCHAR, 2, '0') AS zero FROM part""")
def number_text_formats(spark, sf_dir):
    n = F.col("p_size")
    return b.read(spark, sf_dir, "part").select(
        "p_partkey", n.alias("n"), n.cast("string").alias("arabic"), F.hex(n).alias("hex"), numbers.ordinal(n).alias("ordinal"), numbers.roman(n).alias("roman"), numbers.letters(n).alias("letters"), F.lpad(n.cast("string"), 2, "0").alias("zero")
    )


def _words(n: str) -> str:
    return f"CASE WHEN {n} >= 1000 THEN (SELECT t FROM c WHERE c.n = {n} // 1000) || ' thousand' || CASE WHEN {n} % 1000 > 0 THEN ' ' || (SELECT t FROM c WHERE c.n = {n} % 1000) ELSE '' END ELSE (SELECT t FROM c WHERE c.n = {n}) END"


@query(f"""WITH a AS (SELECT unnest(range(100))::BIGINT AS n, {numbers.ONES} AS o, {numbers.TENS} AS e),
b AS (SELECT n, CASE WHEN n < 20 THEN o[n + 1] ELSE e[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN '-' || o[n % 10 + 1] ELSE '' END END AS t FROM a),
c AS (SELECT h.n * 100 + b.n AS n, CASE WHEN h.n = 0 THEN b.t ELSE h.t || ' hundred' || CASE WHEN b.n > 0 THEN ' ' || b.t ELSE '' END END AS t FROM b, (SELECT * FROM b WHERE n < 10) h),
x AS (SELECT o_orderkey, floor(abs(o_totalprice) + 0.5::DOUBLE)::BIGINT AS n, floor(abs(o_totalprice) * 100 + 0.5::DOUBLE)::BIGINT AS cents, o_orderkey % 100 AS k FROM orders),
y AS (SELECT *, cents // 100 AS whole FROM x)
SELECT o_orderkey, {_words("y.n")} AS card, ({_words("y.whole")}) || ' and ' || lpad((cents % 100)::VARCHAR, 2, '0') || '/100' AS dollars,
    CASE WHEN k = 0 THEN '영' ELSE {numbers.NATIVE_TENS}[k // 10 + 1] || {numbers.NATIVE_ONES}[k % 10 + 1] END AS korean FROM y""")
def number_words(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.select("o_orderkey", numbers.format_field_number("o_totalprice", F.lit("CardText")).alias("card"), numbers.format_field_number("o_totalprice", F.lit("DollarText")).alias("dollars"), numbers.format_style((F.col("o_orderkey") % 100).cast("int"), F.lit(0x2A)).alias("korean"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day, strftime(o_orderdate, '%A, %-d %B %Y') AS long_day, strftime(o_orderdate, '%-I:%M %p') AS clock, strftime(o_orderdate, '%y') || 'Q' AS quoted FROM orders""")
def date_picture(spark, sf_dir):
    from ..functions.pictures import date_format

    o = b.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return o.select("o_orderkey", date_format("o_orderdate", "dd.MM.yyyy").alias("day"), date_format("o_orderdate", "dddd, d MMMM yyyy").alias("long_day"), date_format("o_orderdate", "h:mm AM/PM").alias("clock"), date_format("o_orderdate", "yy'Q'").alias("quoted"))


@query("""SELECT c_custkey, 'Dear ' || c_name || ',' || CASE WHEN c_mktsegment <> 'BUILDING' THEN ' of ' || c_mktsegment || '.' ELSE '' END AS letter FROM customer""")
def merge_template(spark, sf_dir):
    c = b.read(spark, sf_dir, "customer")
    values = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("SEGMENT"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""))
    template = spark.createDataFrame([(0, None, None, None, "Dear "), (1, "NAME", None, ",", None), (2, "SEGMENT", " of ", ".", None)], "ord int, name string, before string, after string, literal string")
    rows = lookups.merge_fields(template, c.select("c_custkey", values.alias("values")))
    return rows.groupBy("c_custkey").agg(content.in_order("ord", "text", "").alias("letter"))


MARKS = LINES + ", marks AS (SELECT DISTINCT doc_id, 'b' || (ord % 3) AS name, (ord % 3) AS first, (ord % 3) + 2 AS last FROM lines WHERE ord < 3)"


@query(f"""WITH {MARKS} SELECT m.doc_id, m.name, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (line <> ''), '') AS text FROM marks m JOIN lines l ON l.doc_id = m.doc_id AND ord BETWEEN first AND last GROUP BY m.doc_id, m.name""")
def bookmark_interval_text(spark, sf_dir):
    lines = b.document_lines(spark, sf_dir)
    marks = lines.where("ord < 3").select("doc_id", F.concat(F.lit("b"), F.col("ord") % 3).alias("name"), F.col("ord").alias("start"), (F.col("ord") + 2).alias("end"))
    return lookups.bookmark_text(lines.select("doc_id", "ord", F.col("line").alias("text"), F.col("ord").alias("para")), marks)


@query(f"""WITH {MARKS}, f AS (SELECT doc_id, ord, 'b' || (ord % 4) AS name FROM lines),
t AS (SELECT m.doc_id, m.name, first, last, coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (line <> ''), '') AS text FROM marks m JOIN lines l ON l.doc_id = m.doc_id AND ord BETWEEN first AND last GROUP BY ALL),
s AS (SELECT doc_id, ord, 'b' || (ord % 4) AS name, 'set' || ord AS value FROM lines WHERE ord % 8 = 5)
SELECT f.doc_id, f.ord, f.name, coalesce((SELECT max_by(value, s.ord) FROM s WHERE s.doc_id = f.doc_id AND s.name = f.name AND s.ord < f.ord), text) AS text, CASE WHEN f.ord > last THEN 'above' WHEN f.ord < first THEN 'below' END AS position
FROM f LEFT JOIN t ON t.doc_id = f.doc_id AND t.name = f.name""")
def ref_lookup(spark, sf_dir):
    lines = b.document_lines(spark, sf_dir)
    marks = lines.where("ord < 3").select("doc_id", F.concat(F.lit("b"), F.col("ord") % 3).alias("name"), F.col("ord").alias("start"), (F.col("ord") + 2).alias("end"))
    texts = lookups.bookmark_text(lines.select("doc_id", "ord", F.col("line").alias("text"), F.col("ord").alias("para")), marks)
    fields = lines.select("doc_id", "ord", F.concat(F.lit("b"), F.col("ord") % 4).alias("name"))
    local = fields.where("ord % 8 = 5").withColumn("value", F.concat(F.lit("set"), "ord"))
    return lookups.ref_lookup(fields, marks.join(texts, ["doc_id", "name"]), local).select("doc_id", "ord", "name", "text", "position")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 3 <> l_partkey % 3 THEN (l_linenumber % 3) || '.' || (l_partkey % 4) || '.' || (l_suppkey % 5)
WHEN l_partkey % 4 <> l_partkey % 5 THEN (l_partkey % 4) || '.' || (l_suppkey % 5) ELSE (l_suppkey % 5)::VARCHAR END AS relative FROM lineitem""")
def ref_relative(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    dotted = lambda *x: F.concat_ws(".", *(F.col(c) % n for c, n in x))
    pairs = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", dotted(("l_linenumber", 3), ("l_partkey", 4), ("l_suppkey", 5)).alias("target"), F.concat_ws(".", F.col("l_partkey") % 3, F.col("l_partkey") % 5, F.lit("x")).alias("field"))
    return lookups.ref_relative(pairs).drop("target", "field")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, ord, (1 + sum((length(line) > 300)::INT) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS page FROM lines), t AS (SELECT * FROM p WHERE ord = 3)
SELECT p.doc_id, p.ord, t.page::VARCHAR AS result, CASE WHEN t.page <> p.page THEN 'on page ' || t.page WHEN t.ord < p.ord THEN 'above' WHEN t.ord > p.ord THEN 'below' END AS relative FROM p LEFT JOIN t ON t.doc_id = p.doc_id""")
def page_ref(spark, sf_dir):
    p = counters.page_numbers(b.document_lines(spark, sf_dir), F.length("line") > 300).select("doc_id", "ord", F.lit("t").alias("name"), "page")
    return lookups.page_ref(p, p.where("ord = 3")).select("doc_id", "ord", "result", "relative")


@query(r"""WITH h AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<h[1-6][^>]*>.*?</h[1-6]>', 0, 's') AS hs FROM pages), e AS (SELECT doc_id, unnest(range(len(hs))) AS ord, unnest(hs) AS h FROM hs_) SELECT 1""".replace("FROM hs_", "FROM h").replace("SELECT 1", r"""
SELECT doc_id, string_agg(repeat('  ', h[3]::INT - 1) || regexp_replace(h, '<[^>]*>', '', 'g'), chr(10) ORDER BY ord) AS toc FROM e WHERE h[3]::INT BETWEEN 1 AND 3 GROUP BY doc_id"""))
def toc(spark, sf_dir):
    h = b.page_headings(spark, sf_dir).withColumns({"source": F.lit("heading"), "style": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    return content.toc_text(content.toc_entries(h))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, ord, 'Figure ' || (ord + 1) || ': ' || line AS t FROM lines WHERE line <> '') SELECT doc_id, ord, trim(substr(t, position(':' IN t) + 1)) AS caption FROM c""")
def caption_text(spark, sf_dir):
    lines = b.document_lines(spark, sf_dir).where("line <> ''")
    t = F.concat(F.lit("Figure "), F.col("ord") + 1, F.lit(": "), "line")
    return lines.select("doc_id", "ord", content.caption_text(t, "Figure").alias("caption"))


REVISIONS = """s AS (SELECT conv_id AS doc_id, turn AS ord, replace(text, chr(10), ' ') AS t, CASE role WHEN 'user' THEN 'ins' WHEN 'system' THEN 'del' END AS k FROM conversations)"""


@query(f"""WITH {REVISIONS} SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (k IS NULL OR k = 'ins'), '') AS accepted, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (k IS NULL OR k = 'del'), '') AS original,
string_agg(CASE k WHEN 'ins' THEN '[+' || t || ']' WHEN 'del' THEN '[-' || t || ']' ELSE t END, ' ' ORDER BY ord) AS annotated FROM s GROUP BY doc_id""")
def revision_views(spark, sf_dir):
    c = b.read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "ins").when(F.col("role") == "system", "del")
    return content.revision_views(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), kind.alias("kind"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))


@query("SELECT conv_id AS doc_id, turn AS id, 0::BIGINT AS root, turn::INT AS depth FROM conversations")
def comment_threads(spark, sf_dir):
    return lookups.threads(b.comments(spark, sf_dir))


@query("""WITH s AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS up, true AS d, r_regionkey::DOUBLE AS v FROM region UNION ALL
SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 3 = 0, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE END FROM nation UNION ALL
SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 5 = 0, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal END FROM customer)
SELECT a.id AS style_id, CASE WHEN a.d THEN a.v WHEN p.d THEN p.v WHEN q.d THEN q.v END AS value, CASE WHEN a.d THEN 0 WHEN p.d THEN 1 WHEN q.d THEN 2 END AS depth FROM s a LEFT JOIN s p ON p.id = a.up LEFT JOIN s q ON q.id = p.up""")
def style_inheritance(spark, sf_dir):
    return content.inherit_styles(b.customer_chain(spark, sf_dir).select("style_id", "based_on", "declared", "value"))


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row, o_orderstatus AS s FROM orders),
m AS (SELECT *, CASE WHEN s = 'O' THEN 'continue' WHEN s = 'F' THEN 'restart' END AS v FROM o),
j AS (SELECT *, CASE WHEN v = 'continue' AND lag(v) OVER w IN ('restart', 'continue') THEN 0 ELSE 1 END AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY row) AS island FROM j)
SELECT doc_id, min(row) AS row, count(*) AS row_span FROM i GROUP BY doc_id, island""")
def vmerge_rowspan(spark, sf_dir):
    from pyspark.sql import Window

    o = b.order_events(spark, sf_dir).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    merge = F.when(F.col("status") == "O", "continue").when(F.col("status") == "F", "restart")
    return tables.row_spans(o.select("doc_id", "row", F.lit(0).alias("grid_col"), merge.alias("vmerge"))).select("doc_id", "row", "row_span")


@query(f"""WITH {ROWS}, c AS (SELECT *, sum(1 + l_linenumber % 2) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g, l_quantity / sum(l_quantity) OVER (PARTITION BY doc_id) AS p FROM rows)
SELECT doc_id, row, coalesce(g, 0)::BIGINT AS grid_col, round(p, 9) AS width_pct FROM c""")
def table_grid_widths(spark, sf_dir):
    cells = b.line_cells(spark, sf_dir).select("doc_id", F.col("row"), (1 + F.col("l_linenumber") % 2).alias("col_span"), F.col("l_quantity").alias("width"))
    out = tables.width_shares(tables.grid_columns(cells.withColumn("one", F.lit(1)), row="one", cell="row"))
    return out.select("doc_id", "row", F.col("grid_col").cast("long").alias("grid_col"), F.round("width_pct", 9).alias("width_pct"))


@query(f"""WITH {ROWS}, h AS (SELECT doc_id, row, min((l_returnflag <> 'N')::INT) OVER (PARTITION BY doc_id ORDER BY row) AS a FROM rows) SELECT doc_id, sum(a)::BIGINT AS header_rows FROM h GROUP BY doc_id""")
def table_header_rows(spark, sf_dir):
    return tables.header_rows(b.line_cells(spark, sf_dir).select("doc_id", "row", (F.col("l_returnflag") != "N").alias("is_header")))


@query(r"""SELECT page_id AS doc_id, len(regexp_extract_all(html, '<a '))::BIGINT AS hyperlinks, len(regexp_extract_all(html, '<li>'))::BIGINT AS list_items, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<table'))::BIGINT AS tables FROM pages""")
def feature_inventory(spark, sf_dir):
    tags = F.explode_outer(F.regexp_extract_all("html", F.lit(r"<(a |li>|p>|table)"), F.lit(1)))
    marks = b.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tags.alias("tag"))
    t = F.col("tag")
    return reports.inventory(marks, {"hyperlinks": t == "a ", "list_items": t == "li>", "paragraphs": t == "p>", "tables": t == "table"})


@query("""WITH k AS (SELECT user_id AS doc_id, event_type AS kind, count(*) AS n, min(event_id) AS first_ord FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_ord, kind)::INT AS position FROM k""")
def field_kind_counts_first_seen(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), "event_id")
    return reports.kinds_first_seen(e, "doc_id", "kind", "event_id")


@query(r"""WITH f AS (SELECT page_id AS doc_id, contains(html, 'class="ad"') AS c, NOT contains(html, '</html>') AS m, contains(html, '<b>') AS t FROM pages)
SELECT doc_id, array_to_string(list_filter([CASE WHEN t THEN 'TrackedChangesPresent' END, CASE WHEN c THEN 'ChartsPreservedButNotModeled' END, CASE WHEN m THEN 'PackageReadOnly' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f""")
def warnings(spark, sf_dir):
    p = b.read(spark, sf_dir, "pages")
    has = lambda s: F.contains("html", F.lit(s)).cast("int")
    f = p.select(F.col("page_id").alias("doc_id"), has('class="ad"').alias("unsupported_charts"), (1 - has("</html>")).alias("read_only"), has("<b>").alias("tracked_changes"))
    return f.select("doc_id", F.array_join(reports.warnings(["unsupported_charts", "tracked_changes", "read_only"]), ",").alias("warnings"))


TOKENS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS c FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS r FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(c, j, j + 4), ' ') AS g FROM (SELECT doc_id, c, unnest(range(1, len(c) - 3)) AS j FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(r, j, j + 4), ' ') AS g FROM (SELECT item_id, r, unnest(range(1, len(r) - 3)) AS j FROM i)),
p AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)),
x AS (SELECT doc_id, item_id, len(list_distinct(r)) AS nr, len(list_distinct(c)) AS nc, len(list_intersect(list_distinct(r), list_distinct(c)))::DOUBLE AS common, r, c FROM p JOIN d USING (doc_id) JOIN i USING (item_id)),
s AS (SELECT doc_id, item_id, CASE WHEN nr > 0 THEN common / nr ELSE 1 END AS recall, CASE WHEN nc > 0 THEN common / nc WHEN nr = 0 THEN 1 ELSE 0 END AS precision,
CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda t: list_contains(c, t))) / len(r)::DOUBLE ELSE 1 END AS list_recall FROM x),
scores AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM s)"""


def _scores(spark, sf_dir):
    """Whole documents scored against each benchmark passage of which they hold five tokens in a row."""
    d = b.read(spark, sf_dir, "documents").select("doc_id", reports.tokens(F.col("text")).alias("c"))
    i = b.read(spark, sf_dir, "benchmark").select("item_id", reports.tokens(F.col("text")).alias("r"))
    pairs = reports.sharing(d, i, "doc_id", "item_id", "c", "r").join(reports.small(i, F.octet_length(F.array_join("r", " "))), "item_id").join(d, "doc_id")
    scored = pairs.select("doc_id", "item_id", reports.prf(F.col("r"), F.col("c")).alias("s"), reports.list_recall(F.col("r"), F.col("c")).alias("list_recall"))
    return scored.select("doc_id", "item_id", "s.*", "list_recall")


@query(f"WITH {TOKENS} SELECT doc_id, item_id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1, round(list_recall, 9) AS list_recall FROM scores")
def token_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "item_id", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "f1", "list_recall")))


@query(f"""WITH {TOKENS}, m AS (SELECT quality, avg(recall) AS mean_recall, median(recall) AS median_recall, avg(f1) AS mean_f1 FROM scores LEFT JOIN labels USING (doc_id) GROUP BY quality), g AS (SELECT quality, unnest(['mean_recall', 'median_recall', 'mean_f1']) AS gate, unnest([mean_recall, median_recall, mean_f1]) AS value, unnest([0.5, 0.4, 0.9]::DOUBLE[]) AS least FROM m)
SELECT quality, gate, round(value, 6) AS value, least, value >= least AS passed FROM g""")
def quality_gates(spark, sf_dir):
    scores = _scores(spark, sf_dir).join(b.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    summary = reports.score_summary(scores, ["quality"])
    return reports.gates(summary, {"mean_recall": 0.5, "median_recall": 0.4, "mean_f1": 0.9}, ["quality"]).withColumn("value", F.round("value", 6))


# The patterns that look around, said without.
_PLAIN = {
    "mac_home_path": r"(?:^|[^:]|(?:^|[^A-Za-z]):)/Users/[A-Za-z0-9._-]+/",
    "windows_drive_path": r"(?i)(?:^|[^a-z])[a-z]:[/\\](?:$|[^u]|u(?:$|[^s]|s(?:$|[^e]|e(?:$|[^r]|r(?:$|[^s]|s(?:$|[^/\\]))))))",
    "windows_unc_path": r"(?:^|[^\\])\\\\[A-Za-z0-9._-]{2,}\\[^\\\s]{2,}\\",
}
HYGIENE_SQL = " UNION ALL ".join(f"SELECT doc_id, ord, '{k}' AS kind FROM lines WHERE regexp_matches(line, '{_PLAIN.get(k, p)}')" for k, p in reports.HYGIENE.items())


@query(f"WITH {LINES} {HYGIENE_SQL}")
def hygiene_findings(spark, sf_dir):
    return reports.hygiene(b.document_lines(spark, sf_dir))


@query("""SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS low, quantile_cont(l_extendedprice, 0.25::DOUBLE) AS q1, quantile_cont(l_extendedprice, 0.5::DOUBLE) AS median, quantile_cont(l_extendedprice, 0.75::DOUBLE) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY ALL""")
def chart_quartiles(spark, sf_dir):
    return reports.quartiles(b.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value")), ["l_returnflag", "l_linestatus"])


@query("""WITH v AS (SELECT l_returnflag, l_shipmode, l_quantity - 20 AS value FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem)), p AS (SELECT l_returnflag, l_shipmode, min(value) AS a, max(value) AS b, sum(value) FILTER (value > 0) AS s FROM v GROUP BY ALL)
SELECT l_returnflag, least(min(a), 0)::DOUBLE AS low, greatest(max(b), 0)::DOUBLE AS high, greatest(max(s), 1)::DOUBLE AS stacked_max FROM p GROUP BY ALL""")
def chart_ranges(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("category"), (F.col("l_quantity") - 20).alias("value"))
    return reports.chart_ranges(li, ["l_returnflag"])


@query("""WITH t AS (SELECT user_id, event_id, value, sum(value) OVER w AS total, lag(1) OVER w IS NULL OR lead(1) OVER w IS NULL AS whole FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(CASE WHEN whole THEN 0 ELSE total - value END, 6) AS start, round(CASE WHEN whole THEN value ELSE total END, 6) AS "end" FROM t""")
def waterfall(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return reports.waterfall(e, ["user_id"], ["event_id"]).select("user_id", "event_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


BLOCKS = r"""h AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<(?:h1|p|li)>.*?</(?:h1|p|li)>', 0, 's') AS hs FROM pages), e AS (SELECT doc_id, unnest(range(len(hs)))::INT AS ord, unnest(hs) AS h FROM h),
b AS (SELECT doc_id, ord, regexp_extract(h, '^<(h1|p|li)>', 1) AS kind, regexp_replace(h, '<[^>]*>', '', 'g') AS t FROM e)"""


@query(f"""WITH {BLOCKS}, m AS (SELECT *, regexp_replace(t, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') AS x FROM b) SELECT doc_id, string_agg(CASE kind WHEN 'h1' THEN '# ' || x WHEN 'li' THEN '- ' || x ELSE x END, chr(10) || chr(10) ORDER BY ord) AS markdown FROM m WHERE t <> '' GROUP BY doc_id""")
def markdown_blocks(spark, sf_dir):
    from ..operators import export

    k = F.col("kind")
    rows = b.page_blocks(spark, sf_dir).select("doc_id", "ord", F.when(k == "h1", "heading").when(k == "li", "list").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"), F.lit(False).alias("ordered"), text.markdown_escape("text").alias("text"), F.lit(None).cast("string").alias("label"))
    return export.markdown(rows.withColumn("level", F.when(F.col("kind") == "list", 0).otherwise(1)))


@query(f"""WITH {BLOCKS}, m AS (SELECT *, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, (kind = 'li') AS li FROM b), l AS (SELECT *, coalesce(lag(li) OVER w, false) AS p, coalesce(lead(li) OVER w, false) AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, string_agg(CASE kind WHEN 'h1' THEN '<h1>' || x || '</h1>' WHEN 'li' THEN CASE WHEN NOT p THEN '<ul>' ELSE '' END || '<li>' || x || '</li>' || CASE WHEN NOT n THEN '</ul>' ELSE '' END ELSE '<p>' || x || '</p>' END, '' ORDER BY ord) AS html FROM l GROUP BY doc_id""")
def html_blocks(spark, sf_dir):
    from ..operators import export

    k = F.col("kind")
    rows = b.page_blocks(spark, sf_dir).select("doc_id", "ord", F.when(k == "h1", "heading").when(k == "li", "list").otherwise("paragraph").alias("kind"), F.when(k == "li", 0).otherwise(1).alias("level"), F.lit(False).alias("ordered"), text.html_escape("text").alias("text"))
    return export.html(rows)


@query(r"""SELECT page_id AS doc_id, '{"schema":1,"page":' || page_id || ',"url":' || to_json(url) || ',"links":' || len(regexp_extract_all(html, '<a ')) || ',"note":null}' AS report FROM pages""")
def report_json(spark, sf_dir):
    from ..operators import export

    p = b.read(spark, sf_dir, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0)))
    return p.select(F.col("page_id").alias("doc_id"), export.json_report(schema=F.lit(1), page=F.col("page_id"), url=F.col("url"), links=links, note=F.lit(None).cast("string")).alias("report"))


@query(r"""WITH u AS (SELECT page_id, 'word/media/' || page_id || ['.png', '.emf', '.JPG', '.xml'][page_id % 4 + 1] AS name FROM pages)
SELECT page_id, name, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/x-emf' WHEN 2 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, CASE page_id % 4 WHEN 1 THEN 'metafile' ELSE 'media' END AS class,
'word/media/' || page_id || '.bin' AS target FROM u""")
def part_name_classify(spark, sf_dir):
    p = b.read(spark, sf_dir, "pages").select("page_id")
    name = F.concat(F.lit("word/media/"), "page_id", F.element_at(F.array(*map(F.lit, (".png", ".emf", ".JPG", ".xml"))), (F.col("page_id") % 4 + 1).cast("int")))
    p = p.withColumn("name", name)
    return p.select("page_id", "name", text.mime_of("name").alias("mime"), reports.part_class(F.col("name")).alias("class"), text.resolve_target(F.lit("word/x/document.xml"), F.concat(F.lit("../media/./"), "page_id", F.lit(".bin"))).alias("target"))


@query("""SELECT o_custkey AS doc_id, o_orderpriority AS priority, min(o_orderkey) AS ord FROM orders GROUP BY ALL""")
def first_duplicates(spark, sf_dir):
    return lookups.first_of_each(b.order_events(spark, sf_dir).select("doc_id", "priority", "ord"), ["doc_id", "priority"], "ord")


@query("""SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)""")
def corpus_totals(spark, sf_dir):
    d = b.read(spark, sf_dir, "documents")
    out = d.rollup("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.char_length("text")).cast("long").alias("chars"))
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "docs", "chars")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN abs(x - trunc(x)) < 0.001::DOUBLE THEN round(x)::BIGINT::VARCHAR ELSE printf('%.1f', x) END AS tick FROM (SELECT *, l_quantity / 4 AS x FROM lineitem)""")
def chart_ticks(spark, sf_dir):
    li = b.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", reports.tick_label(F.col("l_quantity") / 4).alias("tick"))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(value / sum(value) OVER (PARTITION BY l_returnflag), 9) AS share, round(value / max(value) OVER (PARTITION BY l_returnflag), 9) AS of_max FROM p""")
def chart_shares(spark, sf_dir):
    p = b.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("value"))
    return reports.shares(p, ["l_returnflag"]).select("l_returnflag", "l_linestatus", F.round("share", 9).alias("share"), F.round("of_max", 9).alias("of_max"))


KINDS_OF = ["REF bm", " page ", "= 1 + 2", 'HYPERLINK "u"', "NOSUCH x", "ftnref n", "docproperty Title", "MACROBUTTON m d"]


@query("""WITH f AS (SELECT event_id, [%s][event_id %% 8 + 1] AS i FROM events),
t AS (SELECT event_id, i, upper(regexp_extract(i, '^\\s*(\\S*)', 1)) AS token FROM f)
SELECT event_id, CASE WHEN token IN ('REF') THEN 'Ref' WHEN token = 'PAGE' THEN 'Page' WHEN token = '=' THEN 'Dynamic' WHEN token = 'HYPERLINK' THEN 'Hyperlink' WHEN token = 'FTNREF' THEN 'NoteRef'
WHEN token = 'DOCPROPERTY' THEN 'DocumentInfo' WHEN token = 'MACROBUTTON' THEN 'Action' ELSE 'Unknown' END AS kind, token, len(regexp_extract_all(i, '[^\\s]+'))::INT AS parts FROM t""" % ", ".join(f"'{k}'" for k in KINDS_OF))
def field_classification(spark, sf_dir):
    from ..functions import fields

    e = b.read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, KINDS_OF)), (F.col("event_id") % 8 + 1).cast("int")).alias("i"))
    return e.select("event_id", fields.classify("i").alias("c"), F.size(text.instruction_parts("i")).alias("parts")).select("event_id", "c.kind", "c.token", "parts")


@query("""WITH e AS (SELECT user_id AS doc_id, event_type AS kind, event_id AS ord, value > 50 AS generated FROM events)
SELECT doc_id, ord, CASE WHEN generated THEN count(*) OVER (PARTITION BY doc_id, kind ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 END AS number FROM e""")
def note_marks(spark, sf_dir):
    e = b.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("ord"), (F.col("value") > 50).alias("generated"))
    return lookups.note_marks(e).select("doc_id", "ord", "number")


@query("""WITH p AS (SELECT p_partkey, p_size, 'Part_Size-' || (p_size % 5) AS name FROM part), v AS (SELECT 'PARTSIZE' || i AS k, 'v' || i AS value FROM (SELECT unnest(range(4)) AS i))
SELECT p_partkey, name, value FROM p LEFT JOIN v ON k = upper(regexp_replace(name, '[_\\-\\s]', '', 'g'))""")
def property_lookup(spark, sf_dir):
    p = b.read(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("doc_id"), F.concat(F.lit("Part_Size-"), F.col("p_size") % 5).alias("name"))
    props = spark.range(4).select(F.lit(1).alias("doc_id"), F.concat(F.lit("part size"), "id").alias("name"), F.concat(F.lit("v"), "id").alias("value"))
    return lookups.property_lookup(p, props).select("p_partkey", "name", "value")


@query("""SELECT p_page.page_id, CASE WHEN page_id % 3 = 0 THEN 'firstHeader' WHEN page_id % 3 = 1 THEN 'evenFooter' ELSE 'defaultFooter' END AS kind FROM pages p_page""")
def header_footer_kinds(spark, sf_dir):
    n = F.col("page_id") % 3
    part, kind = F.when(n == 0, "header").otherwise("footer"), F.when(n == 0, "first").when(n == 1, "even").otherwise("odd")
    return b.read(spark, sf_dir, "pages").select("page_id", lookups.header_footer_kind(part, kind).alias("kind"))


@query(f"""WITH {NORMAL} SELECT n.doc_id, n.text, len(string_split(d.text, chr(10)))::BIGINT AS paragraphs, (length(d.text) - len(string_split(d.text, chr(10))) + 1)::BIGINT AS text_chars
FROM normal n JOIN documents d USING (doc_id)""")
def package_round_trip(spark, sf_dir):
    """Every document written as a package, opened again, and asked for its text and statistics."""
    from ..sources.packages import open_documents
    from ..sources.writer import write_documents
    from . import documents

    lines = b.document_lines(spark, sf_dir).select("doc_id", "ord", F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("line").alias("text"))
    opened = open_documents(write_documents(lines), ["block"], "doc_id")
    blocks = documents.blocks(opened)
    answer = F.struct("story_ord", "story", "path")
    line = F.when(F.col("kind") == "break", "").otherwise(F.col("text"))
    got = blocks.groupBy("doc_id").agg(
        text.finalize(content.in_order(answer, line, "\n")).alias("text"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.sum(F.char_length("text")).cast("long").alias("text_chars")
    )
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n FROM part)
SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS ord, unnest(['Dynamic', 'Dynamic', 'Dynamic', 'Sequence', 'Sequence', 'Dynamic', 'Unknown']) AS kind,
    unnest([printf('%.1f', n * 1.5::DOUBLE), CASE WHEN n > 25 THEN 'large' ELSE 'small' END, (n % 7)::VARCHAR, '1', '2', upper('part ' || n), NULL]) AS computed_result FROM p""")
def field_evaluation(spark, sf_dir):
    """Fields written into a package for every part, read back and evaluated."""
    from collections.abc import Iterator

    import pandas as pd

    from ..sources.packages import open_documents, records, spread

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources import writer as w

        for batch in batches:
            out = []
            for key, n in zip(batch["p_partkey"], batch["p_size"]):
                codes = (f'= {n} * 1.5 \\# "0.0"', f'IF {n} > 25 "large" "small"', f"= MOD({n}, 7)", "SEQ Part", "SEQ Part", f'QUOTE "part {n}" \\* Upper', "NOSUCH x")
                out.append((key, w.Builder().add(w.paragraph("".join(w.simple_field(c, "cached") for c in codes))).save()))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    parts = b.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    opened = open_documents(spread(parts, "p_partkey").mapInPandas(make, "doc_id long, content binary"), ["field"], "doc_id")
    return records(opened, "field", {"computed_result": "string"}).select(F.col("doc_id").cast("long").alias("doc_id"), "ord", F.col("name").alias("kind"), "computed_result")


def _page_packages(spark, sf_dir):
    from ..sources.packages import open_documents
    from ..kept import written
    from ..sources.writer import write_documents

    k = F.col("kind")
    kind = F.when(k == "h1", "heading").when(k == "li", "list").otherwise("paragraph")
    blocks = b.page_blocks(spark, sf_dir).select("doc_id", "ord", kind.alias("kind"), F.when(k == "li", 0).otherwise(1).alias("level"), "text")
    return written(open_documents(write_documents(blocks), ["block", "run", "cell"], "doc_id"))  # parsed once, read for each kind of record


@query(SQL["markdown_blocks"])
def package_markdown(spark, sf_dir):
    """The blocks of every page written as a package, opened again and exported: the same Markdown as from the blocks."""
    from . import documents

    return documents.markdown(_page_packages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), "markdown")


@query(SQL["html_blocks"])
def package_html(spark, sf_dir):
    from . import documents

    return documents.html(_page_packages(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), "html")


@query(f"""WITH {REVISIONS} SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (k IS NULL OR k = 'ins'), '') AS accepted, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (k IS NULL OR k = 'del'), '') AS original,
string_agg(CASE k WHEN 'ins' THEN '[+' || t || ']' WHEN 'del' THEN '[-' || t || ']' ELSE t END, ' ' ORDER BY ord) AS annotated, count(*) FILTER (k = 'ins') AS insertions, count(*) FILTER (k = 'del') AS deletions FROM s GROUP BY doc_id""")
def package_revisions(spark, sf_dir):
    """Turns written as tracked insertions and deletions, opened again, and shown in each view."""
    from collections.abc import Iterator

    import pandas as pd

    from ..sources.packages import open_documents, spread
    from . import documents

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources import writer as w

        for batch in batches:
            out = []
            for key, turns in zip(batch["doc_id"], batch["turns"]):
                xml = "".join(w.Builder.revision(t["kind"], t["text"], i) if t["kind"] else w.run(t["text"]) for i, t in enumerate(turns))
                out.append((key, w.Builder().add(w.paragraph(xml)).save()))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    c = b.read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "ins").when(F.col("role") == "system", "del")
    rows = spread(c, "conv_id").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", kind.alias("kind"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))).alias("turns"))
    opened = open_documents(rows.mapInPandas(make, "doc_id long, content binary"), ["run", "mark"], "doc_id")
    r = documents.runs(opened)
    one = lambda v: text.finalize(content.in_order(F.struct("path", "run"), content.revision_text(v, F.col("revision"), F.col("text")), " ")).alias(v)
    return r.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*map(one, content.VIEWS), F.count_if(F.col("revision") == "ins").alias("insertions"), F.count_if(F.col("revision") == "del").alias("deletions"))


@query(f"""WITH {REVISIONS} SELECT doc_id, trim(coalesce(string_agg(replace(t, ' the ', ' THE '), '' ORDER BY ord) FILTER (k IS NULL OR k = 'ins'), '')) AS text, 2 AS applied FROM s GROUP BY doc_id""")
def package_edits(spark, sf_dir):
    """A batch of edits on every package: all revisions accepted, then a word replaced throughout."""
    from collections.abc import Iterator

    import pandas as pd

    from ..kept import written
    from ..operators.edits import edit_documents
    from ..sources.packages import open_documents, spread
    from . import documents

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources import writer as w

        for batch in batches:
            out = []
            for key, turns in zip(batch["doc_id"], batch["turns"]):
                xml = "".join(w.Builder.revision(t["kind"], t["text"], i) if t["kind"] else w.run(t["text"]) for i, t in enumerate(turns))
                out.append((key, w.Builder().add(w.paragraph(xml)).save()))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    c = b.read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "ins").when(F.col("role") == "system", "del")
    turns = F.sort_array(F.collect_list(F.struct("turn", kind.alias("kind"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))))
    files = spread(c, "conv_id").groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("turns")).mapInPandas(make, "doc_id long, content binary")
    steps = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("accept_all_revisions").alias("op"), F.create_map().cast("map<string,string>").alias("args")),
        F.struct(F.lit(1).alias("ord"), F.lit("replace_body_text").alias("op"), F.create_map(F.lit("old"), F.lit(" the "), F.lit("new"), F.lit(" THE ")).alias("args")),
    )
    edits = c.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.explode(steps).alias("e")).select("doc_id", "e.*")
    done = written(edit_documents(files, edits, "doc_id"))
    said = documents.text(written(open_documents(done, ["block"], "doc_id")), "body")
    return said.join(done.select("doc_id", "applied"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "applied")


def odd_objects(chars: int) -> bytes:
    """A package with a chart and an object that nothing models, a shape, two metafiles, and a text of that many characters."""
    from ..sources import writer as w

    o = w.Builder()
    rels = [o.rel(*r) for r in (("chart", "charts/chart1.xml"), ("oleObject", "embeddings/oleObject1.bin"), ("image", "media/vector1.emf"), ("image", "media/vector2.wmf"))]
    o.add(
        '<w:p><w:r><w:drawing><wp:anchor distT="0" distB="0" distL="0" distR="0"><wp:extent cx="1000000" cy="500000"/><wp:docPr id="1" name="Chart"/><a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">'
        '<a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" '
        f'r:id="{rels[0]}"/></a:graphicData></a:graphic></wp:anchor></w:drawing></w:r></w:p>'
    )
    o.add('<w:p><w:r><mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><mc:Choice Requires="v"><w:pict><v:shape xmlns:v="urn:schemas-microsoft-com:vml" id="s1"/></w:pict></mc:Choice><mc:Fallback/></mc:AlternateContent></w:r></w:p>')
    o.add(f'<w:p><w:r><w:object><o:OLEObject xmlns:o="urn:schemas-microsoft-com:office:office" r:id="{rels[1]}"/></w:object></w:r></w:p>').text("x" * chars)
    o.parts |= {"word/charts/chart1.xml": b'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart/></c:chartSpace>', "word/embeddings/oleObject1.bin": b"object"}
    o.parts |= {"word/media/vector1.emf": b"e" * 30, "word/media/vector2.wmf": b"w" * 30}
    return o.save()


def _made(rows, key: str, make):
    """doc_id, content: make(row) for each row, packages made by batches."""
    from collections.abc import Iterator

    import pandas as pd

    from ..sources.packages import spread

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(r[key], make(r)) for r in batch.to_dict("records")], columns=["doc_id", "content"])

    return spread(rows, key).mapInPandas(run, "doc_id long, content binary")


@query("""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 4 = 0 THEN 'one ' || s_suppkey || chr(10) || 'two' || chr(10) || 'Dear you' || chr(10) || 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(9) || 'd'
ELSE 'zero ' || s_nationkey || chr(10) || 'two' || chr(10) || 'Dear ' || s_name || chr(10) || 'a' || chr(9) || 'b' || chr(10) || 'cell ' || s_suppkey || chr(9) || 'd' END AS text,
CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 5 END AS applied, s_suppkey % 4 = 0 AS refused FROM supplier""")
def edits_of_blocks(spark, sf_dir):
    """Blocks moved, put in and taken out, a template filled and a table cell set; every fourth batch ends in an edit that
    fails, and leaves its document as it was."""
    from ..kept import written
    from ..operators.edits import edit_documents
    from ..sources.packages import open_documents
    from . import documents

    def make(row):
        from ..sources import writer as w

        o = w.Builder().add(w.paragraph(w.run(f"one {row['s_suppkey']}"))).add(w.paragraph(w.run("two")))
        return o.add(w.paragraph(w.run("Dear ") + w.simple_field("MERGEFIELD Name", "you"))).add(w.table([["a", "b"], ["c", "d"]])).save()

    s = b.read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    files = _made(s, "s_suppkey", make)

    def step(ord: int, op: str, **args):
        given = F.create_map(*(x for k, v in args.items() for x in (F.lit(k), v if hasattr(v, "cast") else F.lit(v)))).cast("map<string,string>")
        return F.struct(F.lit(ord).alias("ord"), F.lit(op).alias("op"), given.alias("args"))

    steps = [
        step(0, "move_body_block", source="0", target="1"), step(1, "insert_body_paragraph", index="0", text=F.concat(F.lit("zero "), "s_nationkey")), step(2, "fill_template_fields", Name=F.col("s_name")),
        step(3, "set_table_cell_text", table="0", row="1", column="0", text=F.concat(F.lit("cell "), "s_suppkey")), step(4, "remove_body_block", index="2"),
    ]
    steps = F.array_compact(F.array(*steps, F.when(F.col("s_suppkey") % 4 == 0, step(5, "remove_body_block", index="99"))))
    edits = s.select(F.col("s_suppkey").alias("doc_id"), F.explode(steps).alias("e")).select("doc_id", "e.*")
    done = written(edit_documents(files, edits, "doc_id"))
    said = documents.text(written(open_documents(done, ["block"], "doc_id")), "body")
    return said.join(done.select("doc_id", "applied", F.col("error").isNotNull().alias("refused")), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "applied", "refused")


@query("""SELECT p_partkey AS doc_id, [NULL, 'Docx', 'Docx', 'NotOle2', 'Docx', 'Cfb', NULL][p_partkey % 7 + 1] AS error FROM part""")
def package_errors(spark, sf_dir):
    """Packages that are sound, cut off, without a main part, no document at all, with too many relationships, or legacy ones
    cut off: each is one row, and what can't be opened says why."""
    from ..sources.packages import MOST_RECORDS, open_documents

    crowded: list[bytes] = []  # of each task: the parts that all packages with too many relationships share

    def make(r: dict) -> bytes:
        import io
        import zipfile

        from ..sources import writer as w

        n = r["p_partkey"] % 7
        if n in (3, 5):
            return b"plain text" if n == 3 else bytes.fromhex("D0CF11E0A1B11AE1") + b"short"
        package = w.Builder().text(f"part {r['p_partkey']}").package()
        if n == 4:
            main = package.parts.pop("word/document.xml")
            if not crowded:
                package.parts["word/_rels/document.xml.rels"] = b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + b'<Relationship Id="r" Type="t" Target="x"/>' * (MOST_RECORDS + 1) + b"</Relationships>"
                crowded.append(zipped(package.parts))
            out = io.BytesIO(crowded[0])
            with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", main)
            return out.getvalue()
        if n == 2:
            del package.parts["word/document.xml"]
            return zipped(package.parts)
        sound = package.save()
        return sound[: len(sound) // 2] if n == 1 else sound

    def zipped(parts: dict[str, bytes]) -> bytes:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    opened = open_documents(_made(b.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", make), ["block", "package"], "doc_id")
    got = opened.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("tag") == "error", F.col("name"))).alias("error"))
    return got


@query("""SELECT p_partkey AS doc_id, '{"format":"docx","stats":{"paragraphs":1,"tables":0,"figures":0,"text_chars":' || p_size || '},"core_properties":{"title":null,"subject":null,"creator":null,"description":null,"keywords":null,"category":null,"content_status":null,"last_modified_by":null,"created":null,"modified":null,"last_printed":null,"revision":null,"version":null},"custom_properties":{},"edit":{"package_preserving":true,"read_only_reasons":[]},"edited_parts":[],"features":{"comments":0,"footnotes":0,"endnotes":0,"text_boxes":0,"tracked_insertions":0,"tracked_deletions":0,"tracked_moves":0,"tracked_property_changes":0,"fields":0,"field_kinds":[],"unsupported_field_kinds":[],"unsupported_field_reasons":[],"hyperlinks":0,"content_controls":0,"nested_tables":0,"floating_shapes":2,"charts":1,"unsupported_charts":1,"ole_objects":1,"unsupported_metafiles":2,"metafiles":[{"path":"word/media/vector1.emf","format":"EMF","bytes":30,"compressed":false,"width_px":null,"height_px":null},{"path":"word/media/vector2.wmf","format":"WMF","bytes":30,"compressed":false,"width_px":null,"height_px":null}]},"warnings":[{"kind":"FloatingShapePlaceholderOnly","count":2},{"kind":"ChartsPreservedButNotModeled","count":1},{"kind":"OleObjectsPreservedButNotModeled","count":1},{"kind":"UnsupportedMetafileImages","count":2}]}' AS report FROM part""")
def package_report(spark, sf_dir):
    """The report, byte for byte, of a package for every part."""
    from ..kept import written
    from ..sources.packages import open_documents
    from . import documents

    files = _made(b.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", lambda r: odd_objects(r["p_size"]))
    return documents.report(written(open_documents(files, key="doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "report")


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n FROM part) SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS ord,
unnest([greatest(n, 7)::VARCHAR, least(n, 7)::VARCHAR, printf('%.1f', (n + 7) / 2), CASE WHEN n > 25 THEN '1' ELSE '2' END, '0', '1', '0', (n % 10)::VARCHAR]) AS computed_result FROM p""".replace("printf('%.1f', (n + 7) / 2)", "regexp_replace(((n + 7) / 2::DOUBLE)::VARCHAR, '[.]0$', '')"))
def formula_grammar(spark, sf_dir):
    """Functions over argument lists, the lazy IF, DEFINED and the truth values, written as fields, read back and evaluated."""
    from ..sources import writer as w
    from ..sources.packages import open_documents, records

    def make(r: dict) -> bytes:
        n = r["p_size"]
        codes = (f"= MAX({n}, 7)", f"= MIN({n}, 7)", f"= AVERAGE({n}, 7)", f"= IF({n} > 25, 1, 2)", "= DEFINED(nosuch)", "= TRUE", "= FALSE", f"= MOD({n}, 10)")
        return w.Builder().add(w.paragraph("".join(w.simple_field(c, "cached") for c in codes))).save()

    opened = open_documents(_made(b.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", make), ["field"], "doc_id")
    return records(opened, "field", {"computed_result": "string"}).select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "computed_result")


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_nationkey AS k FROM customer)
SELECT doc_id, unnest(range(21))::INT AS ord, unnest(['', 'c' || doc_id, '', k::VARCHAR, 'none ' || doc_id, CASE WHEN k >= 12 THEN '1' ELSE '0' END, 'Nr ' || doc_id, chr(65 + k), '', 'go ' || doc_id, '', '', '', '', '', '', '', '', NULL, NULL, NULL]) AS computed_result FROM c""")
def field_families(spark, sf_dir):
    """Fields that keep, ask, compare, say, mark or move, written into a package for every customer, read back and evaluated."""

    def make(row):
        from ..sources import writer as w

        n, k = row["c_custkey"], row["c_nationkey"]
        codes = (
            f'SET Who "c{n}"', "REF Who", f'ASK Reply "How many?" \\d "{k}"', "REF Reply", f'FILLIN "Name?" \\d "none {n}"', f"COMPARE {k} >= 12", f'QUOTE "Nr" "{n}"', f"SYMBOL {65 + k}",
            "ADVANCE \\d 4", f'GOTOBUTTON Who "go {n}"', 'PRINT "job"', f'XE "entry {n}"', f'TC "title {n}" \\l 1', 'TA \\l "case"', 'RD "other"', f"NEXTIF {k} = 3", f"SKIPIF {k} = 4", "NEXT",
            'ASK Reply "No default"', 'FILLIN "No default"', "SYMBOL",
        )
        return w.Builder().add(w.paragraph("".join(w.simple_field(c, "cached") for c in codes))).save()

    from ..sources.packages import open_documents, records

    made = _made(b.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", make)
    opened = open_documents(made, ["field"], "doc_id")
    return records(opened, "field", {"computed_result": "string"}).select(F.col("doc_id").cast("long").alias("doc_id"), "ord", "computed_result")


@query("""SELECT p_partkey AS doc_id, string_agg(t, chr(10) ORDER BY i) AS toc FROM (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest([NULL, 'Inside ' || p_size, '  entry ' || p_size]) AS t FROM part) WHERE t IS NOT NULL GROUP BY p_partkey""")
def contents_of_bookmark(spark, sf_dir):
    """A contents field over a bookmark: headings and entries inside it, in the document's order, none before or behind."""
    from ..sources import writer as w
    from ..sources.packages import open_documents, records

    def make(r: dict) -> bytes:
        n = r["p_size"]
        o = w.Builder().heading("Before").add('<w:bookmarkStart w:id="9" w:name="mark"/>').heading(f"Inside {n}")
        o.add(w.paragraph(w.run("x") + w.simple_field(f'TC "entry {n}" \\l 2')) + '<w:bookmarkEnd w:id="9"/>').heading("After").add(w.paragraph(w.simple_field('TC "late"')))
        return o.add(w.paragraph(w.simple_field("TOC \\o \\f \\b mark", "?"))).save()

    opened = open_documents(_made(b.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", make), ["field"], "doc_id")
    found = records(opened, "field", {"computed_result": "string"}).where("name = 'Toc'")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("computed_result").alias("toc"))


@query(f"""WITH {ROWS}, f AS (SELECT doc_id, row, max(row) OVER (PARTITION BY doc_id) AS n FROM rows), w AS (SELECT doc_id, row, l_linestatus = 'F' AS wide FROM rows)
SELECT f.doc_id, f.row, NOT bool_or(wide AND (w.row = f.row OR w.row BETWEEN least(2, f.row) AND greatest(2, f.row))) AND any_value(n) >= 2 AS safe FROM f JOIN w USING (doc_id) GROUP BY f.doc_id, f.row""")
def table_formula_spans(spark, sf_dir):
    """Which formulas over the rows between the second and their own touch no row with a spanned cell."""
    cells = b.line_cells(spark, sf_dir).select("doc_id", "row", F.lit(1).alias("col"), (F.col("l_linestatus") == "F").alias("has_span"))
    f = cells.select("doc_id", "row", "col", F.lit(2).alias("r1"), F.lit(1).alias("c1"), F.col("row").alias("r2"), F.lit(1).alias("c2"))
    return tables.spans_touched(f, cells).select("doc_id", "row", "safe")


@query("""SELECT event_id, user_id AS doc_id, CASE WHEN event_type <> 'click' THEN n END AS result FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""")
def note_ref(spark, sf_dir):
    """NOTEREF to every event's note; clicks have a mark of their own."""
    e = b.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("name"), (F.col("event_type") == "click").alias("custom"))
    notes = counters.note_ordinals(e, F.lit(False), order="event_id")
    return lookups.note_ref(e.select("event_id", "doc_id", "name"), notes.select("doc_id", "name", "custom", "number")).select("event_id", "doc_id", F.col("result").cast("long").alias("result"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE n_nationkey * 1.5::DOUBLE END AS size, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE n_name END AS font FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def overlay(spark, sf_dir):
    """Direct properties over a style's: a declared null hides the style's value."""
    c = b.read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("style"), F.col("c_acctbal").alias("size"), (F.col("c_custkey") % 3 == 0).alias("size_declared"), F.lit(None).cast("string").alias("font"), (F.col("c_custkey") % 2 == 0).alias("font_declared")
    )
    styles = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("style"), (F.col("n_nationkey") * 1.5).alias("size"), F.col("n_name").alias("font"))
    return content.overlay(c, styles, ["size", "font"], ["style"]).select("c_custkey", "size", "font")


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size AS n FROM part) SELECT doc_id, '# Table' || chr(10) || chr(10) || '| h | ' || n || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b | ' || (n + 1) || ' |' AS markdown FROM p""")
def tables_markdown(spark, sf_dir):
    """A table written into a package for every part, opened again and exported."""
    from ..kept import written
    from ..sources import writer as w
    from ..sources.packages import open_documents
    from . import documents

    def make(r: dict) -> bytes:
        n = r["p_size"]
        rows = [[w.cell(w.paragraph(w.run(t))) for t in row] for row in (("h", str(n)), ("a|b", str(n + 1)))]
        return w.Builder().heading("Table").add(w.table(rows, header_rows=1)).save()

    files = _made(b.read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", make)
    return documents.markdown(written(open_documents(files, ["block", "run", "cell"], "doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "markdown")
