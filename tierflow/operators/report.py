"""Aggregates and texts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.paths import escaped_html
from tierflow.plans.ruleset import TYPES


def by_type(violations: DataFrame) -> DataFrame:
    """``type, n`` of all types, 0 where there are none."""
    types = violations.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    return types.join(violations.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_severity(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count("*").alias("n"))


def summary(violations: DataFrame) -> DataFrame:
    """Counts by type, by severity and in all, in one pass."""
    return violations.groupingSets([["type"], ["severity"], []], "type", "severity").agg(F.count("*").alias("n"))


def by_layer(violations: DataFrame) -> DataFrame:
    """``layer, n, pct``: shares are of all violations, which are read once."""
    found = violations.groupBy(F.col("source_layer").alias("layer")).agg(F.count("*").alias("n"))
    shares = found.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a layer
    return shares.where("layer is not null").select("layer", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


def hot_files(violations: DataFrame, k: int = 10) -> DataFrame:
    return violations.groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file").limit(k)


def annotation(level: Column | None = None, with_message: bool = True) -> Column:
    """A line of a CI log for each violation; up to its title if ``with_message`` is false."""
    level = level if level is not None else F.when(F.col("severity") == "error", "error").otherwise("warning")
    parts = [F.lit("::"), level, F.lit(" file="), F.coalesce("source_file", F.lit("")), F.lit(",line="), F.coalesce(F.col("line"), F.lit(1)).cast("string"), F.lit(",title="), F.col("type")]
    return F.concat(*parts, F.lit("::"), F.col("message")) if with_message else F.concat(*parts)


def title() -> Column:
    """A short title for each violation in a CI log."""
    kind = F.col("type")
    return (
        F.when(kind == "flow", F.concat(F.lit("Layer violation: "), F.coalesce("source_layer", F.lit("")), F.lit(" → "), F.coalesce("target_layer", F.lit("")))).when(kind == "isolation", "Feature isolation violation")
        .when(kind == "circular", "Circular dependency").when(kind == "unmapped", "Unmapped file").otherwise("Architecture violation")
    )


def ci_lines(violations: DataFrame) -> DataFrame:
    """``line``: an annotation for each violation and, with ``kind`` notice, one of how many there are."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    each = F.concat(F.lit("::"), level, F.lit(" file="), F.coalesce("source_file", F.lit("")), F.lit(",line="), F.coalesce(F.col("line"), F.lit(1)).cast("string"), F.lit(",title="), title(), F.lit("::"), F.coalesce("message", F.lit("")))
    counts = violations.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warn").alias("w"))
    summary = F.when(F.col("n") > 0, F.format_string("::notice::Found %d violation(s): %d error(s), %d warning(s)", "n", "e", "w")).otherwise("::notice::No architectural violations found")
    return violations.select(F.lit("annotation").alias("kind"), each.alias("line")).union(counts.select(F.lit("notice"), summary))


#: Types of the chart with their labels; orphans are not shown (fixed values).
LABELS = {"flow": "Flow", "isolation": "Isolation", "circular": "Circular", "unlayered": "Unlayered", "depth": "Depth", "publicApi": "Public API", "dependentBudget": "Dependents", "importCount": "Import Count", "unmapped": "Unmapped"}


def type_chart(violations: DataFrame) -> DataFrame:
    """``label, n, pct``: types that there are with their share of all violations."""
    counts = violations.groupBy("type").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    labels = violations.sparkSession.createDataFrame(list(LABELS.items()), "type string, label string")
    return counts.join(F.broadcast(labels), "type").crossJoin(total).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))  # ten labels, one row


def json_of(violations: DataFrame) -> DataFrame:
    """``json``: an object for each violation, in camel case, without empty values; features only for isolation and the path only for cycles."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    only = lambda kind, value: F.when(F.col("type") == kind, value)
    fields = [
        F.col("type"), F.col("severity"), F.col("source_file").alias("sourceFile"), F.col("message"), given("target_file").alias("targetFile"), given("source_layer").alias("sourceLayer"), given("target_layer").alias("targetLayer"),
        given("source_sublayer").alias("sourceSublayer"), given("target_sublayer").alias("targetSublayer"), given("import_specifier").alias("importSpecifier"), F.col("line"),
        only("isolation", given("source_feature")).alias("sourceFeature"), only("isolation", given("target_feature")).alias("targetFeature"), only("circular", F.split("message", " -> ")).alias("cyclePath"),
    ]
    return violations.select(F.to_json(F.struct(*fields)).alias("json"))


def as_json(violations: DataFrame) -> DataFrame:
    """A JSON object for each violation; absent values are left out."""
    return violations.select(F.to_json(F.struct(*violations.columns)).alias("json"))


def html_rows(violations: DataFrame, limit: int = 100) -> str:
    """The first rows of a report as an HTML table."""
    cells = ["type", "severity", "source_file", "target_file", "message"]
    rows = violations.orderBy("source_file", "line", "target_file", "type").limit(limit).select(*(escaped_html(F.coalesce(c, F.lit(""))).alias(c) for c in cells)).collect()
    head = "".join(f"<th>{c}</th>" for c in cells)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{v}</td>" for v in row) + "</tr>" for row in rows) + "</table>"


def markdown(violations: DataFrame, limit: int = 5) -> str:
    """Counts and the first rows as Markdown."""
    counts = [f"| {r.type} | {r.n} |" for r in by_type(violations).where("n > 0").orderBy("type").collect()]
    rows = [f"- {r.message} (`{r.source_file}`)" for r in violations.orderBy("source_file", "line", "target_file", "type").limit(limit).collect()]
    return "\n".join(["| type | count |", "|---|---|", *counts, "", *rows])


def passed(violations: DataFrame) -> bool:
    return not violations.where("severity = 'error'").limit(1).count()


def last_points(history: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` points of a history (ts, total)."""
    return history.orderBy(F.desc("ts")).limit(n)


def trend(history: DataFrame) -> DataFrame:
    """Each point with its change against the one before; a history has one point a run."""
    return history.withColumn("change", F.col("total") - F.lag("total").over(Window.orderBy("ts")))


def layer_order(layers: DataFrame, pairs: DataFrame) -> DataFrame:
    """``layer, n``: how many allowed pairs (from_layer) start at each layer (layer)."""
    return layers.join(pairs.groupBy(F.col("from_layer").alias("layer")).agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
