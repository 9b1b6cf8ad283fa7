"""A dependency graph that is kept up to date from a log of file changes.

The state has the files with the version that counts, their imports, what each import
resolved to, and a reverse index of all files that imports were tried for. So a new file
finds the imports that it now answers, also those that were unresolved or found a later
candidate, and a deleted one those that must look again; nothing else is resolved anew.

A change counts only if its version is larger than the one that the state has for the
file. Replayed batches and changes that come late therefore alter nothing, and any order of
the same changes ends in the graph of a full build over the last version of each file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.operators.resolve import resolved, tried
from tierflow.shared import dropped, stored
from tierflow.sources.code import imports
from tierflow.sources.store import Store

FILES = "path string, version long, deleted boolean"
IMPORTS = "source string, specifier string, kind string, is_type_only boolean, line int, column int, names array<struct<name:string,as:string>>"
RESOLVED = "source string, specifier string, status string, target string"
TRIED = "path string, source string, specifier string, n int"
_KEYS = {"files": "path", "imports": "source", "resolved": "source", "tried": "path"}


def build_store(spark: SparkSession, root: str, config: str = "", buckets: int = 64) -> Store:
    """The state below ``root``; another ``config`` (see :func:`tierflow.sources.store.fingerprint`) starts anew."""
    return Store(spark, root, _KEYS, config, buckets)


def apply_changes(store: Store, changes: DataFrame, mappings: DataFrame | None = None) -> int:
    """Bring the state up to date with ``changes`` (path, version, deleted, content); the number of files that counted.

    Several changes of a file count by their version; of equal versions the first one
    that the state meets stays, and inside a batch the larger one by order of its columns. Null
    paths and versions are left out. Only touched buckets are read and written.
    """
    now = store.current()
    newest = changes.where("path is not null and version is not null").groupBy("path").agg(F.max(F.struct("version", F.coalesce("deleted", F.lit(False)).alias("deleted"), "content")).alias("c")).select("path", "c.*")
    newest = stored(newest, "changes")
    buckets = store.touched(newest, "path")
    old_files = store.read("files", FILES, buckets, now)
    both = newest.join(old_files.select("path", F.col("version").alias("was"), F.col("deleted").alias("gone")), "path", "left").where("was is null or version > was")
    applied = stored(both.withColumn("existed", F.col("was").isNotNull() & ~F.coalesce("gone", F.lit(True))), "applied")
    n = applied.count()
    if not n:
        dropped(newest)
        return 0
    sources = applied.select(F.col("path").alias("source"))
    buckets = store.touched(applied, "path")
    old_files, old_imports = store.read("files", FILES, buckets, now), store.read("imports", IMPORTS, buckets, now)
    files = stored(old_files.join(applied.select("path"), "path", "left_anti").union(applied.select("path", "version", "deleted")), "files")
    fresh = stored(imports(applied.where(~F.col("deleted")).select("path", "content")), "imports")
    # the reverse index: what touched sources tried goes, what they try now comes
    lost = tried(old_imports.join(sources, "source", "left_semi"), mappings).select("path", "source", "specifier").distinct()
    come = stored(tried(fresh, mappings).groupBy("path", "source", "specifier").agg(F.min("n").cast("int").alias("n")), "tried")
    index_buckets = sorted({*store.touched(lost, "path"), *store.touched(come, "path")})
    kept = store.read("tried", TRIED, index_buckets, now).join(sources, "source", "left_anti").select("path", "source", "specifier", "n")
    index = stored(kept.union(come), "tried")
    # imports that must be resolved: fresh ones, and those that tried a file which came or went
    moved = applied.where(F.col("existed") == F.col("deleted")).select("path")
    hit = store.read("tried", TRIED, store.touched(moved, "path"), now).join(moved, "path", "left_semi").select("source", "specifier").join(sources, "source", "left_anti")
    again = stored(fresh.select("source", "specifier").union(hit).distinct(), "again")
    candidates = tried(again, mappings).select("path").distinct()
    known = store.read("files", FILES, store.touched(candidates, "path"), now).join(applied.select("path"), "path", "left_anti").where(~F.col("deleted")).select("path")
    known = known.union(applied.where(~F.col("deleted")).select("path"))
    found = stored(resolved(again, known, mappings), "resolved")
    result_buckets = sorted({*buckets, *store.touched(again, "source")})
    old = store.read("resolved", RESOLVED, result_buckets, now).join(sources, "source", "left_anti").join(again, ["source", "specifier"], "left_anti")
    store.commit({
        "files": (files, buckets),
        "imports": (old_imports.join(sources, "source", "left_anti").select(fresh.columns).union(fresh), buckets),
        "tried": (index, index_buckets),
        "resolved": (old.select(found.columns).union(found), result_buckets),
    })
    for table in (newest, applied, files, fresh, come, index, again, found):
        dropped(table)
    return n


def files_of(store: Store) -> DataFrame:
    """``path`` of the files that there are."""
    return store.read("files", FILES).where(~F.col("deleted")).select("path")


def statuses_of(store: Store) -> DataFrame:
    """``source, specifier, status, target`` of all imports."""
    return store.read("resolved", RESOLVED)


def edges_of(store: Store) -> DataFrame:
    """``source, target, specifier, is_type_only, kind, line`` of the graph. The buckets of both tables have the same key."""
    found = store.read("resolved", RESOLVED).where("status = 'resolved'").select("source", "specifier", "target")
    return store.read("imports", IMPORTS).join(found, ["source", "specifier"]).select("source", "target", "specifier", "is_type_only", "kind", "line")


def watch_files(log: DataFrame, store: Store, report: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, once: bool = False, interval: str = "300 milliseconds", mappings: DataFrame | None = None):
    """Start a streaming query over a log of changes (path, version, deleted, content) that keeps the state and gives ``report`` the graph's edges after each batch.

    Changes within the interval are one batch. ``once`` ends the query when the log is read. A restarted
    query may run its last batch again, which changes nothing.
    """

    def batch(changes: DataFrame, number: int) -> None:
        applied = apply_changes(store, changes, mappings)
        if report and applied:
            report(edges_of(store), number)

    writer = log.writeStream.foreachBatch(batch).trigger(**({"availableNow": True} if once else {"processingTime": interval}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
