"""Tables: grid reconstruction, and formulas as positional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_columns(cells: DataFrame, table: list[str] = ["doc_id"], row: str = "row", cell: str = "cell", span: str = "col_span") -> DataFrame:  # noqa: B006
    """cells with grid_col: the spans of the cells before it in the row."""
    w = Window.partitionBy(*table, row).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("grid_col", F.coalesce(F.sum(F.greatest(F.col(span), F.lit(1))).over(w), F.lit(0)))


def row_spans(cells: DataFrame, table: list[str] = ["doc_id"], row: str = "row", col: str = "grid_col", merge: str = "vmerge", promote: bool = True) -> DataFrame:  # noqa: B006
    """Vertical merges: a "restart" opens, a "continue" extends the open cell above it and goes, anything else closes.

    A "continue" with nothing open is a cell of its own that opens (promote), or stays as it is. Gaps and islands: a new
    island begins at each cell that doesn't continue, or where a row in between lacks the column.
    """
    w = Window.partitionBy(*table, col).orderBy(row)
    prev, before = F.lag(merge).over(w), F.lag(row).over(w)
    goes_on = (F.col(merge) == "continue") & (before == F.col(row) - 1)
    joined = goes_on & prev.isin("restart", "continue")
    out = cells.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    out = out.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*table, col, "__island")
    orphan = F.max(F.when((F.col("__new") == 1) & (F.col(merge) == "continue"), 1).otherwise(0)).over(group) == 1
    out = out.withColumn("row_span", F.count(F.lit(1)).over(group)).withColumn("__orphan", orphan)
    if not promote:
        out = out.withColumn("row_span", F.when(F.col("__orphan"), 1).otherwise(F.col("row_span"))).withColumn("__new", F.when(F.col("__orphan"), 1).otherwise(F.col("__new")))
    return out.where("__new = 1").drop("__new", "__island", "__orphan")


def header_rows(rows: DataFrame, table: list[str] = ["doc_id"], row: str = "row", header: str = "is_header") -> DataFrame:  # noqa: B006
    """How many rows at the top of each table are header rows without a gap."""
    w = Window.partitionBy(*table).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    lead = rows.withColumn("__all", F.min(F.coalesce(F.col(header), F.lit(False)).cast("int")).over(w))
    return lead.groupBy(*table).agg(F.sum("__all").alias("header_rows"))


def width_shares(columns: DataFrame, table: list[str] = ["doc_id"], width: str = "width") -> DataFrame:  # noqa: B006
    """columns with width_pct, the width over the table's; equal shares where no width is known."""
    w = Window.partitionBy(*table)
    total, n = F.sum(width).over(w), F.count(F.lit(1)).over(w)
    return columns.withColumn("width_pct", F.when(total > 0, F.col(width) / total).otherwise(F.lit(1.0) / n))


def number_of(text: Column) -> Column:
    """A cell's number: white space and thousands separators aside; null for anything else."""
    t = F.regexp_replace(F.trim(text), ",", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.cast("double"))


#: The functions over gathered values. Nulls have made the result null before.
AGGREGATES = {
    "SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "MAX": F.max, "MIN": F.min, "PRODUCT": F.product,
}


def directional(cells: DataFrame, function: str, side: str, value: str = "value", table: list[str] = ["doc_id"], row: str = "row", col: str = "col", formula: Column | None = None, header: Column | None = None) -> DataFrame:  # noqa: B006
    """cells with result: the function over all cells to that side (LEFT, RIGHT, ABOVE, BELOW, R, C), the cell itself
    left out and header rows skipped. An empty, non-numeric or formula cell among them makes the result null, as does none.

    R and C are a partition's aggregate around the row; BELOW ends at the first row that holds a formula.
    """
    by_row = side in ("LEFT", "RIGHT", "R")
    keys, order = ([*table, row], col) if by_row else ([*table, col], row)
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    skip = header if header is not None else F.lit(False)
    bad = ~skip & (F.col(value).isNull() | (formula if formula is not None else F.lit(False)))
    v, n, poison = F.when(~skip, F.col(value)), F.when(~skip, 1), F.when(bad, 1)
    out = cells
    if side == "BELOW" and formula is not None:  # rows down to the next formula row have seen as many formulas as this row
        seen = Window.partitionBy(*table).orderBy(row).rangeBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("__seg", F.count(F.when(formula, 1)).over(seen))
        after = Window.partitionBy(*keys, "__seg").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    if side in ("R", "C"):
        pair = lambda f, x: [f(x).over(before), f(x).over(after)]
        none = lambda xs: [F.coalesce(x, F.lit(0)) for x in xs]
        b, poisoned = (sum(none(pair(F.count, x))) for x in (n, poison))
        a = sum(none(pair(F.sum, v)))  # never all less the cell's own, which would cancel digits
        result = {"SUM": a, "COUNT": b.cast("double"), "AVERAGE": a / b}.get(function)
        if result is None:
            both = pair(AGGREGATES[function], v)
            result = {"MAX": F.greatest(*both), "MIN": F.least(*both)}.get(function, F.coalesce(both[0], F.lit(1.0)) * F.coalesce(both[1], F.lit(1.0)))
        return out.withColumn("result", F.when((poisoned == 0) & (b > 0), result))
    frame = before if side in ("LEFT", "ABOVE") else after
    result = AGGREGATES[function](v).over(frame)
    return out.withColumn("result", F.when((F.coalesce(F.count(poison).over(frame), F.lit(0)) == 0) & (F.count(n).over(frame) > 0), result)).drop("__seg")


def range_formula(formulas: DataFrame, cells: DataFrame, function: str, table: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """formulas (table, row, col, r1, c1, r2, c2) with result over the cells of the range, corners in any order, without
    the formula's own cell; headers aren't skipped. Null where a cell is bad, no cell is left, or a row is out of bounds;
    missing columns are skipped. Joined on the table with a range condition."""
    c = cells.select(*(F.col(t).alias(f"__{t}") for t in table), F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias("__v"))
    same = F.lit(True)
    for t in table:
        same = same & (F.col(t) == F.col(f"__{t}"))
    inside = F.col("__r").between(F.least("r1", "r2"), F.greatest("r1", "r2")) & F.col("__c").between(F.least("c1", "c2"), F.greatest("c1", "c2"))
    own = (F.col("__r") == F.col("row")) & (F.col("__c") == F.col("col"))
    rows = cells.groupBy(*table).agg(F.max("row").alias("__rows"))
    keys = [*table, "row", "col", "r1", "c1", "r2", "c2"]
    got = formulas.join(c, same & inside & ~own, "left").groupBy(*keys).agg(
        AGGREGATES[function]("__v").alias("__x"), F.count(F.when(F.col("__r").isNotNull() & F.col("__v").isNull(), 1)).alias("__bad"), F.count("__r").alias("__n")
    )
    ok = (F.col("__bad") == 0) & (F.col("__n") > 0) & (F.greatest("r1", "r2") <= F.col("__rows")) & (F.least("r1", "r2") >= 1)
    return got.join(rows, table).select(*keys, F.when(ok, F.col("__x")).alias("result"))


def cell_reference(formulas: DataFrame, cells: DataFrame, table: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """formulas (table, row, col, r, c) with result, the number in the cell at (r, c); null for the formula's own cell and
    for cells with formulas of their own."""
    c = cells.select(*table, F.col("row").alias("r"), F.col("col").alias("c"), F.when(~F.col("contains_formula"), F.col("value")).alias("__v"))
    own = (F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))
    return formulas.join(c, [*table, "r", "c"], "left").withColumn("result", F.when(~own, F.col("__v"))).drop("__v")


def spans_touched(formulas: DataFrame, cells: DataFrame, table: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """formulas (table, row, col and the cells they refer to: r1, c1, r2, c2, null for none) with safe: false where a cell of
    the formula's own row, or of a row that the reference reaches, spans several, as positions are unsure there; and for a
    reference to rows that don't exist.

    Rows with spans are numbered per table by a running count, so a reference is two lookups of counts, not a range join.
    """
    last = F.max(F.col("row")).alias("__last")
    rows = cells.groupBy(*table, "row").agg(F.max(F.col("has_span").cast("int")).alias("__wide"))
    w = Window.partitionBy(*table).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum("__wide").over(w))
    own = rows.select(*table, "row", F.col("__wide").alias("__own"))
    low = rows.select(*table, F.col("row").alias("__low"), (F.col("__upto") - F.col("__wide")).alias("__before"))
    high = rows.select(*table, F.col("row").alias("__high"), F.col("__upto").alias("__through"))
    sizes = cells.groupBy(*table).agg(last)
    at = formulas.withColumns({"__low": F.least("r1", "r2"), "__high": F.greatest("r1", "r2")})
    out = at.join(own, [*table, "row"], "left").join(low, [*table, "__low"], "left").join(high, [*table, "__high"], "left").join(sizes, table, "left")
    inside = F.col("__low").isNull() | ((F.col("__high") <= F.col("__last")) & (F.col("__through") == F.col("__before")))
    return out.withColumn("safe", F.coalesce((F.coalesce("__own", F.lit(0)) == 0) & inside, F.lit(False))).select(*formulas.columns, "safe")
