import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import fields, formula, numbers, pictures, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f("v")).collect()]


def test_normalize_lines(spark):
    cases = {
        "X\tY\nX\tY\n": "X\tY\nX\tY", "2\n2\n": "2\n2", "hi\nhi\n": "hi", "\tB\t\n": "\tB", "\t\n-\n": "\t\n-", "   hello  \n": "hello", "": "", "a\r\nb\rc": "a\nb\nc", "a\n\n\na": "a",
        "x　\n y": "x\ny",
    }
    assert column(spark, list(cases), text.normalize_lines) == list(cases.values())


def test_normalizing_twice_changes_nothing(spark):
    cases = ["a \n a\n\tb\n\n", "1\n1\n--\n", " \t \nq\nq\nq", "\x13x\x14y\x15\x1ez"]
    once = column(spark, cases, text.finalize)
    assert column(spark, once, text.finalize) == once


def test_controls(spark):
    assert column(spark, ["a\x13b\x14c\x15\x00d\x0be\x1ef\xa0g\th"], text.strip_controls) == ["abcd\ne-f g\th"]


def test_case_and_wildcards(spark):
    assert column(spark, ["heLLo o'neil x1y 2nd", "ÉCOLE élan"], text.caps) == ["HeLLo O'Neil X1y 2nd", "ÉCOLE Élan"]
    assert column(spark, ["(heLLo)", "12", ""], text.first_cap) == ["(HeLLo)", "12", ""]
    rows = spark.createDataFrame([("abc", "a*"), ("abc", "a?c"), ("abc", "A*"), ("a.c", "a.c"), ("abc", "a.c"), ("a*", "abc"), ("x", "")], "a string, b string")
    assert [r[0] for r in rows.select(text.text_equal("a", "b")).collect()] == [True, True, False, True, False, True, False]


def test_targets_and_numbers(spark):
    rows = spark.createDataFrame([("word/document.xml", "media/a.png"), ("word/document.xml", "/docProps/x.xml"), ("word/a/b.xml", "../../../c.xml")], "s string, t string")
    assert [r[0] for r in rows.select(text.resolve_target("s", "t")).collect()] == ["word/media/a.png", "docProps/x.xml", "c.xml"]
    rows = spark.createDataFrame([("1.2.3", "1.2.9"), ("1.2", "1.2"), ("2.1", "1.1"), ("1", "1.5")], "t string, f string")
    assert [r[0] for r in rows.select(text.relative_number("t", "f")).collect()] == ["3", "1.2", "2.1", "1"]


def test_heading_levels_and_types(spark):
    assert column(spark, ["Heading 2", "heading9", "제목 3", "Heading 10", "Title", None], text.heading_level) == [2, 9, 3, None, None, None]
    assert column(spark, ["a.PNG", "b.jpeg", "c"], text.mime_of) == ["image/png", "image/jpeg", "application/octet-stream"]


def test_instruction_parts_agree(spark):
    cases = [' REF bm \\h ', 'IF "a b" = x "y"', '= 2+"', 'SEQ\tFig \\* ARABIC', ""]
    assert column(spark, cases, text.instruction_parts) == [fields.parts_of(c) for c in cases]


@pytest.mark.parametrize(("n", "code", "want"), [(27, 3, "AA"), (4, 1, "IV"), (9, 2, "ix"), (11, 5, "11th"), (15, 0x18, "가가"), (23, 0x29, "이십삼"), (21, 0x2A, "스물하나"), (3, 0x16, "03"), (12, 0x1A, "⒓"), (5, 0x17, ""), (0, 1, "0"), (4000, 1, "4000")])
def test_list_styles(n, code, want):
    assert numbers.style_text(n, code) == want


def test_number_expressions_agree_with_python(spark):
    n = F.col("id").cast("int")
    rows = spark.range(0, 4100, 37).select(n.alias("n"), numbers.roman(n).alias("r"), numbers.letters(n).alias("l"), numbers.ordinal(n).alias("o"), numbers.roman(n, "null").alias("p")).collect()
    for r in rows:
        assert (r.r, r.l, r.o) == (numbers._roman(r.n), numbers._letters(r.n), numbers.STYLES[5](r.n))
        assert r.p == (numbers._roman(r.n) if 0 < r.n < 4000 else None)


@pytest.mark.parametrize(("value", "name", "want"), [
    (123, "CardText", "one hundred twenty-three"), (21, "OrdText", "twenty-first"), (112, "OrdText", "one hundred twelfth"), (9.5, "DollarText", "nine and 50/100"), (255, "Hex", "FF"), (4, "roman", "iv"),
    (4, "ROMAN", "IV"), (28, "alphabetic", "ab"), (0, "Roman", None), (3, "ArabicDash", "- 3 -"), (1000000, "CardText", "one million"), (12, "Ordinal", "12th"),
])
def test_field_numbers(value, name, want):
    assert numbers.field_number(value, name) == want


@pytest.mark.parametrize(("expression", "want"), [
    ("2+3*4", 14), ("-2^2", 4), ("2^3^2", 512), ("(1+2)*3", 9), ("10/4", 2.5), ("1/0", None), ("7 MOD 3", None), ("MOD(7,-3)", -2), ("MOD(7;3)", 1), ("ROUND(1.005,2)", 1.0), ("ROUND(-2.5,0)", -3),
    ("INT(-1.5)", -2), ("SIGN(-3)", -1), ("ABS(-3)", 3), ("AND(1,0)", 0), ("OR(0,2)", 1), ("NOT(0)", 1), ("SUM(1,2,3)", 6), ("SUM(1,2;3)", None), ("AVERAGE(1,2)", 1.5), ("COUNT(1,2,9)", 3), ("MAX(1,5,2)", 5),
    ("MIN(4,2)", 2), ("PRODUCT(2,3)", 6), ("IF(1>2,1/0,7)", 7), ("IF(1<2,5,1/0)", 5), ("DEFINED(x)", 1), ("DEFINED(nope)", 0), ("DEFINED(1+1)", 1), ("DEFINED(1/0)", 0), ("x*2", 84), ("1=1", 1), ("1<>1", 0),
    ("1<2<3", None), ("", None), ("2+", None), ("TRUE", 1), ("FALSE()", 0), ("1e3", 1000), ("SUM()", None), ("0^-1", None),
])
def test_formulas(expression, want):
    got = formula.evaluate(expression, {"x": "42"})
    assert got == want if want is None else got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789+-*/^()<>=,; SUMIFx.", max_size=25))
def test_formulas_never_raise(expression):
    formula.evaluate(expression, {"x": "1"})


@settings(max_examples=60, deadline=None)
@given(st.integers(-999, 999), st.integers(-999, 999), st.integers(1, 99))
def test_formula_arithmetic(a, b, c):
    assert formula.evaluate(f"({a})+({b})*{c}") == a + b * c


def test_formula_number_text():
    assert [formula.number_text(x) for x in (3.0, 2.5, 1 / 3, -0.0)] == ["3", "2.5", "0.333333333333", "0"]


@pytest.mark.parametrize(("value", "picture", "want"), [
    (1234.5, "#,##0.00", "1,234.50"), (-3, "0;(0)", "(3)"), (0, "0;0;zero", "zero"), (5, "000", "005"), (2.5, "$0.0", "$2.5"), (-2.5, "0.0", "-2.5"), (3, "+0", "+3"), (-3, "+0", "-3"), (7, "0 'units'", "7 units"),
    (1.25, "0.0#", "1.25"), (1.2, "0.0#", "1.2"), (1, "0." + "0" * 13, None), (12, "0 and 0", None), (None, "0", None),
])
def test_numeric_pictures(value, picture, want):
    assert pictures.numeric_picture(value, picture) == want


def test_date_pictures():
    assert pictures.date_pattern("dddd, d MMMM yyyy") == "EEEE, d MMMM yyyy"
    assert pictures.date_pattern("yyy") is None and pictures.date_pattern("d 'open") is None
    assert fields.pictures_date("2024-03-05T06:07:08Z", "yy/M/d HH:mm 'h'") == "24/3/5 06:07 h"
    assert fields.pictures_date("2024-13-05T06:07:08Z", "yyyy") is None


def test_timestamps(spark):
    got = column(spark, ["2024-03-05T06:07:08+09:00", "2024-03-05 06:07:08", "x", "2024-02-31T00:00:00"], pictures.timestamp)
    assert [str(x) if x else None for x in got] == ["2024-03-05 06:07:08", "2024-03-05 06:07:08", None, None]


@pytest.mark.parametrize(("eq", "want"), [
    ("EQ \\f(1,2)", "1/2"), ("EQ \\r(3,x)", "3√x"), ("EQ \\r(2)", "√2"), ("EQ \\b(a)", "(a)"), ("EQ \\b\\bc\\[(a)", "[a]"), ("EQ \\b \\lc\\< \\rc\\| (a)", "<a|"), ("EQ \\x \\to(b)", "b"), ("EQ \\i(0,1,x)", "∫_0^1 x"),
    ("EQ \\i \\su(n=1,10,x)", "Σ_{n=1}^{10} x"), ("EQ \\f(1,\\r(2))", "1/(√2)"), ("EQ \\q(1)", None), ("EQ \\f(1", None), ("EQ \\f(1)", None), ("EQ \\a \\co2(a,b,c,d)", "a\tb\nc\td"), ("EQ \\a \\co0(a)", None),
    ("EQ \\s\\up8(UB)\\ai4()\\do8(2)\\di3()", "^{UB}_2"), ('EQ \\b("Chapter One")', "(Chapter One)"), ('EQ \\b("A"B")', None), ('EQ \\b("Chapter One)', None), ("EQ \\f(A\\),B)", "A)/B"), ("EQ \\f(A\\;B;C)", "A;B/C"),
    ("EQ \\d \\fo10(A)", "A"), ("EQ \\d \\ba2(\\f(1,2))", "(1/2)"), ("EQ \\d(A)", None), ("EQ \\l(A,B)", "A,B"), ("EQ \\o \\ac(A,/)", "A/"), ("EQ \\l()", None),
])
def test_equations(eq, want):
    assert pictures.eq_text(eq) == want


def test_classification_agrees(spark):
    cases = [" REF x", 'hyperlink "u"', "=1+2", "= 1", "nonsense", "", '"PAGE"', "FtnRef a", "docproperty Title"]
    got = column(spark, cases, fields.classify)
    assert [(r["kind"], r["token"]) for r in got] == [fields.kind_of(c) for c in cases]


def test_symbols(spark):
    rows = spark.createDataFrame([("Symbol", "abg"), ("Wingdings", "l"), ("Arial", "abg")], "f string, t string")
    assert [r[0] for r in rows.select(text.symbol_text("f", "t")).collect()] == ["αβγ", "●✓", "abg"]


def test_comparisons():
    assert fields.compared("3", "<", "10") and fields.compared("abc", "=", "a*") and not fields.compared("a", "<>", "a")
    assert fields.compared("1", "=", "x") is None and fields.compared("a", "<", "b") is None


def test_switches():
    p = fields.parse(["bm", "\\n\\h", "\\*", "Upper"], flags="nh")
    assert p.switches == {"n": True, "h": True} and p.text_format == "upper" and p.operands == ["bm"]
    for bad in (["\\h", "\\h"], ["\\z"], ["\\*", "Nope"], ["\\d"]):
        with pytest.raises(fields.Invalid):
            fields.parse(bad, flags="h", values="d")
    assert re.fullmatch(r"\S+", "x")
