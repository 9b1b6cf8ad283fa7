"""Points of a project's history from JSON texts, and what a new one makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that are kept.
KEPT = 100
_COUNTS = "map<string,long>"
_POINT = f"timestamp string, date string, counts {_COUNTS}, report struct<counts:{_COUNTS}>, fileCount long, importCount long, commitSha string, branch string"


def history_of(texts: DataFrame) -> DataFrame:
    """``timestamp, date, counts, files, imports, commit, branch`` of JSON texts (content).

    A text is an array of points, an object with an array called ``history``, or one point; anything else has none. The date is
    what precedes ``T`` in the timestamp if there is none, counts may stand in a ``report``, and missing numbers are 0. A point
    without a timestamp has the time of the query.
    """
    as_list = F.from_json("content", f"array<struct<{_POINT}>>")
    inner = F.from_json(F.get_json_object("content", "$.history"), f"array<struct<{_POINT}>>")
    one = F.array(F.from_json("content", _POINT))
    kind = F.when(F.trim("content").startswith("["), as_list).when(F.get_json_object("content", "$.history").isNotNull(), inner).when(F.trim("content").startswith("{") & F.get_json_object("content", "$").isNotNull(), one)
    rows = texts.select(F.explode(kind).alias("p")).where("p is not null").select("p.*")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    stamp = F.coalesce(given("timestamp"), now)
    return rows.select(
        stamp.alias("timestamp"), F.coalesce(given("date"), F.split_part(stamp, F.lit("T"), F.lit(1))).alias("date"), F.coalesce("counts", "report.counts", F.create_map().cast(_COUNTS)).alias("counts"),
        F.coalesce("fileCount", F.lit(0)).alias("files"), F.coalesce("importCount", F.lit(0)).alias("imports"), given("commitSha").alias("commit"), given("branch").alias("branch"),
    )


def appended(history: DataFrame, point: DataFrame, kept: int = KEPT) -> DataFrame:
    """``history`` with a new ``point``; only the last ``kept`` points by time stay."""
    return history.unionByName(point).orderBy(F.to_timestamp("timestamp").desc(), F.desc("timestamp")).limit(kept)


def point_of(violations: DataFrame, files: DataFrame, edges: DataFrame, timestamp: str, commit: str | None = None, branch: str | None = None) -> DataFrame:
    """One point: the counts of violations by type and in all, of files and imports."""
    counts = violations.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sizes = files.agg(F.count("*").alias("files")).crossJoin(edges.agg(F.count("*").alias("imports")))  # one row each
    return counts.crossJoin(sizes).select(
        F.lit(timestamp).alias("timestamp"), F.split_part(F.lit(timestamp), F.lit("T"), F.lit(1)).alias("date"), F.map_concat("c", F.create_map(F.lit("total"), "total")).alias("counts"), "files", "imports", F.lit(commit).cast("string").alias("commit"), F.lit(branch).cast("string").alias("branch")
    )
