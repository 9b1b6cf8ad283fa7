"""Watching a change log: each micro-batch re-evaluates the files that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.rules import edge_violations
from tierflow.plans.ruleset import RuleSet


def watch(log: DataFrame, rules: RuleSet, report: Callable[[DataFrame, int], None], interval: str = "300 milliseconds", checkpoint: str | None = None):
    """Start a query over a stream of edges (the imports of files as they change); ``report`` gets each batch's violations.

    Changes that arrive within the interval are one batch, so bursts of events are
    evaluated once. A restarted query goes on from its checkpoint. Versions count inside
    a batch only; :func:`tierflow.streaming.build.watch_files` remembers them across batches.
    """
    def batch(edges: DataFrame, n: int) -> None:
        # the last state of a file within the batch counts
        last = edges.groupBy("source").agg(F.max("version").alias("version"))
        report(edge_violations(edges.join(last, ["source", "version"]), rules), n)

    writer = log.writeStream.foreachBatch(batch).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
