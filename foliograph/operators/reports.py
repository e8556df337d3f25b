"""Inventories, diagnostics, scores, hygiene and chart statistics: aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature counts -> the warning that they raise, in the order in which warnings are reported. Fixed values.
WARNINGS = (
    ("unsupported_fields", "UnsupportedFieldEvaluation"), ("tracked_changes", "TrackedChangesPresent"), ("incomplete_revision_view", "IncompleteRevisionView"), ("floating_shapes", "FloatingShapePlaceholderOnly"),
    ("unsupported_charts", "ChartsPreservedButNotModeled"), ("ole_objects", "OleObjectsPreservedButNotModeled"), ("unsupported_metafiles", "UnsupportedMetafileImages"), ("read_only", "PackageReadOnly"),
    ("flattened_subdocuments", "LegacyDocFlattenedSubdocuments"),
)


def inventory(marks: DataFrame, features: dict[str, Column], doc: str = "doc_id", parsed: DataFrame | None = None) -> DataFrame:
    """One row a document with a count for each feature, a condition on mark rows, in a single aggregation.

    parsed, with counts of parsed records by the same names, is joined, and the greater count stands.
    """
    out = marks.groupBy(doc).agg(*(F.count_if(c).alias(n) for n, c in features.items()))
    if parsed is None:
        return out
    names = [n for n in features if n in parsed.columns]
    p = parsed.select(doc, *(F.col(n).alias(f"__{n}") for n in names))
    joined = out.join(p, doc, "full")
    return joined.select(doc, *(F.coalesce(F.greatest(n, f"__{n}") if n in names else F.col(n), F.lit(0)).alias(n) for n in features))


def kinds_first_seen(rows: DataFrame, doc: str | list[str], kind: str, order: str) -> DataFrame:
    """Counts of each kind, first_ord its first position, and position its rank by that: kinds in the order first seen."""
    keys = [doc] if isinstance(doc, str) else doc
    g = rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("first_ord", kind)))


def warnings(features: list[str]) -> Column:
    """The warnings that non-zero counts raise, in their fixed order."""
    return F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(w)) for c, w in WARNINGS if c in features)))


def unsupported_reason(kind: Column, computed: Column, syntax_ok: Column, target_exists: Column) -> Column:
    """Why a field has no computed value; null if it has one."""
    return (
        F.when(computed.isNotNull(), F.lit(None).cast("string")).when(kind == "Unknown", "UnknownField").when(~syntax_ok, "UnsupportedSwitch")
        .when(~F.coalesce(target_exists, F.lit(True)), "UnresolvedBookmark").otherwise("NoComputedResult")
    )


def edit_reasons(format_: Column, complete: Column, lossy: Column) -> Column:
    """What stands against editing: the legacy format, an incomplete package, lossy metadata."""
    return F.array_compact(F.array(F.when(format_ != "docx", F.lit("legacy_doc")), F.when(~complete, F.lit("incomplete_package")), F.when(lossy, F.lit("lossy_opc_metadata"))))


def warning_details(kinds: Column, reasons: Column) -> Column:
    """The warnings that counts (columns) raise, in their fixed order, each as JSON with its counts."""
    said = lambda name, **more: F.to_json(F.struct(F.lit(name).alias("kind"), *(c.alias(k) for k, c in more.items())))
    n = F.col
    counted = {
        "unsupported_fields": {"count": n("unsupported_fields"), "field_kinds": kinds}, "tracked_changes": {"insertions": n("tracked_insertions"), "deletions": n("tracked_deletions"), "moves": n("tracked_moves")},
        "incomplete_revision_view": {"property_changes": n("tracked_property_changes")}, "read_only": {"reasons": reasons},
    }
    raised = {"tracked_changes": n("tracked_insertions") + n("tracked_deletions") + n("tracked_moves"), "incomplete_revision_view": n("tracked_property_changes"), "read_only": F.size(reasons)}
    names = [(c, w) for c, w in WARNINGS if c != "flattened_subdocuments"]
    return F.array_compact(F.array(*(F.when((raised[c] if c in raised else n(c)) > 0, said(w, **counted.get(c, {"count": n(c)}))) for c, w in names)))


def part_class(name: Column) -> Column:
    """What a package part holds, by its name."""
    return (
        F.when(name.rlike(r"(?i)^word/charts/chartEx[^/]*\.xml$"), "chartex").when(name.rlike(r"(?i)^word/charts/chart[^/]*\.xml$"), "chart").when(name.rlike(r"(?i)^word/media/.*\.(emf|wmf)$"), "metafile")
        .when(name.rlike(r"(?i)^word/media/"), "media").when(name.rlike(r"(?i)^word/embeddings/"), "embedding").when(name.rlike(r"(?i)\.rels$"), "rels").otherwise("other")
    )


def tokens(text: Column) -> Column:
    """Tokens of scoring: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def prf(reference: Column, candidate: Column) -> Column:
    """Recall, precision and F1 of token sets; an empty reference is recalled in full, an empty candidate precise only then."""
    r, c = F.array_distinct(reference), F.array_distinct(candidate)
    both = F.size(F.array_intersect(r, c)).cast("double")
    recall = F.when(F.size(r) > 0, both / F.size(r)).otherwise(1.0)
    precision = F.when(F.size(c) > 0, both / F.size(c)).otherwise(F.when(F.size(r) == 0, 1.0).otherwise(0.0))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def list_recall(reference: Column, candidate: Column) -> Column:
    """The share of the reference's tokens, repeats and all, that the candidate holds: one pass over both lists, sorted."""
    tagged = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("t"), F.lit(side).alias("side")))
    both = F.array_sort(F.concat(tagged(F.array_distinct(candidate), 0), tagged(reference, 1)))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        held = F.coalesce((x["side"] == 1) & (x["t"] == s["last"]), F.lit(False))
        return F.struct(F.when(x["side"] == 0, x["t"]).otherwise(s["last"]).alias("last"), (s["n"] + F.when(held, 1).otherwise(0)).alias("n"))

    return F.when(F.size(reference) > 0, F.aggregate(both, start, step, lambda s: s["n"]) / F.size(reference)).otherwise(1.0)


def small(df: DataFrame, size: Column, most: int = 64 << 20) -> DataFrame:
    """df, to be broadcast if its rows, of `size` bytes and some more each, add up to little."""
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= most else df


def sharing(candidates: DataFrame, references: DataFrame, key: str, other: str, tokens: str, their: str, n: int = 5) -> DataFrame:
    """Pairs (key, other) of rows whose token lists share n tokens in a row, each pair once.

    Runs of few references are broadcast, so that the candidates' runs are looked up where they are read and only pairs
    move; runs of many references meet by an exchange. Lists of fewer tokens, and nulls, share nothing.
    """

    def runs(df: DataFrame, name: str, xs: str) -> DataFrame:
        run = F.transform(F.sequence(F.lit(1), F.size(xs) - (n - 1)), lambda i: F.array_join(F.slice(xs, i, n), " "))
        return df.select(name, F.explode(F.array_distinct(F.when(F.size(xs) >= n, run))).alias("run"))

    wanted = small(runs(references, other, their), F.octet_length("run"))
    return runs(candidates, key, tokens).join(wanted, "run").select(key, other).distinct()


def score_summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    every = [f(F.col(c)).alias(f"{n}_{c}") for c in ("recall", "precision", "f1") for n, f in (("mean", F.avg), ("median", F.median))]
    return scores.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("files"), *every)


def gates(summary: DataFrame, least: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row a gate (and key): gate, value, least and passed; a missing value doesn't pass."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("least")) for c, x in least.items())))
    return summary.select(*(keys or []), rows.alias("g")).select(*(keys or []), "g.*").withColumn("passed", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


# Patterns of the hygiene scan: kind -> regular expression. Fixed values; a table of one's own can be passed instead.
HYGIENE = {
    "openai_api_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{30,}\b", "github_pat": r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b", "private_key": r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "kr_bid_trace": r"(?i)\bkr[-_\s]?bid\b", "korean_bid_trace": r"(케이알\s*비드|입찰|나라장터|조달청)",
    "mac_home_path": r"(?<![A-Za-z]:)/Users/[A-Za-z0-9._-]+/", "linux_home_path": r"/home/[A-Za-z0-9._-]+/", "shell_home_path": r"\$(?:HOME|\{HOME\})[/\\]",
    "windows_home_path": r"[A-Za-z]:[/\\]Users[/\\][^/\\\s]+[/\\]", "windows_drive_path": r"(?i)(?<![A-Za-z])[A-Za-z]:[/\\](?!Users[/\\])", "windows_unc_path": r"(?<!\\)\\\\[A-Za-z0-9._-]{2,}\\[^\\\s]{2,}\\",
    "windows_profile_env_path": r"(?i)%(?:USERPROFILE|APPDATA|LOCALAPPDATA)%[/\\]", "powershell_profile_env_path": r"(?i)\$env:(?:USERPROFILE|APPDATA|LOCALAPPDATA)[/\\]",
}


def hygiene(lines: DataFrame, patterns: dict[str, str] | None = None, path: str = "doc_id", number: str = "ord", line: str = "line") -> DataFrame:
    """Findings (path, line number, kind): a line is one finding for each pattern that it holds.

    The few patterns are expressions over each line, so lines are scanned where they are; nothing is joined or exchanged.
    One alternation of all of them finds the lines that are looked at pattern by pattern.
    """
    lines = lines.where(F.col(line).rlike("|".join(f"(?:{p})" for p in (patterns or HYGIENE).values())))
    kinds = F.array_compact(F.array(*(F.when(F.col(line).rlike(p), F.lit(k)) for k, p in (patterns or HYGIENE).items())))
    return lines.select(path, number, F.explode(kinds).alias("kind"))


def chart_ranges(points: DataFrame, keys: list[str], value: str = "value", category: str = "category", size: str | None = None) -> DataFrame:
    """Axis ranges: low and high of the finite values, with 0 included; an empty range is widened by one. stacked_max is
    the largest sum of positive values of a category, 1 at least."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    per = points.groupBy(*keys, category).agg(F.min(F.when(finite, v)).alias("a"), F.max(F.when(finite, v)).alias("b"), F.sum(F.when(finite & (v > 0), v)).alias("s"))
    out = per.groupBy(*keys).agg(F.least(F.coalesce(F.min("a"), F.lit(0.0)), F.lit(0.0)).alias("low"), F.greatest(F.coalesce(F.max("b"), F.lit(0.0)), F.lit(0.0)).alias("high"), F.greatest(F.coalesce(F.max("s"), F.lit(0.0)), F.lit(1.0)).alias("stacked_max"))
    return out.withColumn("high", F.when(F.col("high") - F.col("low") < 1e-12, F.col("low") + 1).otherwise(F.col("high")))


def quartiles(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Box-and-whisker figures, quartiles by linear interpolation at (n - 1) p."""
    p = F.percentile(value, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    got = points.groupBy(*keys).agg(p.alias("p"))
    return got.select(*keys, *(F.col("p")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


def waterfall(points: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """points with start and end of each bar: the running total before and after it. The first bar and the last are
    totals of their own, from zero. Values that aren't finite count as 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    v = F.when(finite, F.col(value)).otherwise(0.0)
    total = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()
    out = points.withColumns({"end": F.when(whole, v).otherwise(total), "__v": v, "__whole": whole})
    return out.withColumn("start", F.when(F.col("__whole"), 0.0).otherwise(F.col("end") - F.col("__v"))).drop("__v", "__whole")


def tick_label(value: Column) -> Column:
    """An axis label: whole numbers without decimals, others with one; 0 for what isn't finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    part = F.abs(value - F.signum(value) * F.floor(F.abs(value)))
    return F.when(~finite, "0").when(part < 0.001, F.round(value).cast("long").cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1)))


def shares(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """points with share: of the positive values for pies, treemaps and sunbursts; of the largest for funnels (of_max)."""
    w = Window.partitionBy(*keys)
    v = F.when(F.col(value) > 0, F.col(value)).otherwise(0.0)
    return points.withColumn("share", F.when(F.sum(v).over(w) > 0, v / F.sum(v).over(w)).otherwise(0.0)).withColumn("of_max", F.when(F.max(v).over(w) > 0, v / F.max(v).over(w)).otherwise(0.0))
