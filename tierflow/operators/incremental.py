"""Incremental builds: which files changed, and the graph after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status`` of two states (path, stamp): new, deleted, changed or same."""
    both = old.select("path", F.col("stamp").alias("a"), F.lit(1).alias("in_old")).join(new.select("path", F.col("stamp").alias("b"), F.lit(1).alias("in_new")), "path", "full_outer")
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def merged(edges: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after a change: those of changed, new and deleted files go, ``fresh`` ones come; edges into deleted files go as well."""
    touched = changed.where("status <> 'same'").select(F.col("path").alias("source"))
    gone = changed.where("status = 'deleted'").select(F.col("path").alias("target"))
    return edges.join(touched, "source", "left_anti").select(edges.columns).unionByName(fresh).join(gone, "target", "left_anti").select(edges.columns)
