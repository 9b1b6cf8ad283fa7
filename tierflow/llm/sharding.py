"""Sharding by minimax contiguous partition of atomic groups.

Groups (equal texts) stand in the order of their digests. The smallest capacity
for which a greedy pass needs no more shards than there are is found by binary
search, and the order is cut there.

The driver never sees all groups. It holds landmarks: a bounded number of group
ends with the knowledge whether other ends lie between two of them. A greedy pass
over landmarks alone gives a capacity that suffices; a pass that may also stop
between landmarks gives one that no partition beats. While the two differ, more
landmarks are read from just those places where cuts can fall.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.shared import stored

#: Landmarks that the first round reads.
LANDMARKS = 40_000


def _running(rows: DataFrame, key: list[str], sums: list[str]) -> tuple[DataFrame, dict[int, list[int]]]:
    """``rows`` in the order of ``key`` over range partitions, with running sums inside each.

    Returns the written table, with ``_part`` and ``_to_<sum>``, and what precedes each partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), [0] * len(sums)
        for batch in batches:
            more = []
            for k, name in enumerate(sums):
                to = np.cumsum(batch.column(names.index(name)).to_numpy(zero_copy_only=False).astype(np.int64)) + before[k]
                before[k] = int(to[-1]) if len(to) else before[k]
                more.append(pa.array(to, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *more], names=[*names, "_part", *(f"_to_{s}" for s in sums)])

    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int", *(f"_to_{s} long" for s in sums)])
    placed = stored(ordered.mapInArrow(run, schema), "ordered")
    totals = placed.groupBy("_part").agg(*(F.max(f"_to_{s}").alias(s) for s in sums)).orderBy("_part").collect()  # a row for each partition
    before, offsets = [0] * len(sums), {}
    for row in totals:
        offsets[row["_part"]] = list(before)
        before = [b + row[s] for b, s in zip(before, sums)]
    return placed, offsets


def _with_offsets(placed: DataFrame, offsets: dict[int, list[int]], sums: list[str]) -> DataFrame:
    """Running sums over all partitions, as ``_end_<sum>``."""
    spark = placed.sparkSession
    small = spark.createDataFrame([(p, *b) for p, b in offsets.items()], ", ".join(["_part int", *(f"_b_{s} long" for s in sums)]))
    joined = placed.join(F.broadcast(small), "_part")  # a row for each partition of the shuffle
    return joined.select(*(c for c in placed.columns if c != "_part" and not c.startswith("_to_")), *((F.col(f"_to_{s}") + F.col(f"_b_{s}")).alias(f"_end_{s}") for s in sums))


class Landmarks:
    """Known group ends; ``whole[i]`` says that no other end lies between end i - 1 and end i."""

    def __init__(self, ends: np.ndarray, whole: np.ndarray):
        self.ends, self.whole = ends, whole

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Cuts of a greedy pass; a hopeful one may stop wherever an unknown end could be."""
        cuts, at, total = [], 0, int(self.ends[-1])
        while at < total and len(cuts) < shards:
            k = int(np.searchsorted(self.ends, at + capacity, "right"))
            to = int(self.ends[k - 1]) if k else 0
            if hopeful and k < len(self.ends) and not self.whole[k]:
                to = at + capacity
            if to <= at:
                break
            cuts.append(to)
            at = to
        return cuts

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity from low to high (which suffices) that needs at most ``shards`` shards."""
        while low < high:
            mid = (low + high) // 2
            cuts = self.greedy(mid, shards, hopeful)
            low, high = (low, mid) if cuts and cuts[-1] >= self.ends[-1] else (mid + 1, high)
        return low


def _read_landmarks(groups: DataFrame, spans: list[tuple[int, int]], width: int) -> list[tuple[int, bool, int, bytes]]:
    """(end, no other end before it in its bucket, rows up to it, digest) of the last group in each bucket of ``width`` bytes; spans do not overlap."""
    inside = reduce(lambda x, y: x | y, [(F.col("_end_bytes") > a) & (F.col("_end_bytes") <= b) for a, b in spans])
    bucket = F.coalesce(*(F.when((F.col("_end_bytes") > a) & (F.col("_end_bytes") <= b), F.struct(F.lit(k).alias("s"), F.expr(f"(_end_bytes - {a} - 1) div {width}").alias("b"))) for k, (a, b) in enumerate(spans)))
    found = groups.where(inside).groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("n"), F.max(F.struct("_end_bytes", "_end_rows", "digest")).alias("m"))
    return [(r.m["_end_bytes"], r.n == 1, r.m["_end_rows"], bytes(r.m["digest"])) for r in found.collect()]  # a row for each bucket


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def smallest_capacity(groups: DataFrame, total: int, largest: int, shards: int, limit: int = LANDMARKS) -> tuple[int, Landmarks, dict[int, tuple[int, bytes]]]:
    """The smallest feasible shard capacity, exactly, with the landmarks that show it.

    ``groups`` has ``_end_bytes``, ``_end_rows`` and ``digest`` in order. Landmarks
    are mapped to the rows up to them and to the digest of their group.
    """
    known: dict[int, tuple[int, bytes]] = {}
    whole_between: dict[int, bool] = {}
    spans, width = [(0, total)], max(1, -(-total // limit))
    while True:
        for end, alone, rows, digest in _read_landmarks(groups, spans, width):
            known[end] = (rows, digest)
            whole_between[end] = alone or whole_between.get(end, False)
        ends = np.array(sorted(known), np.int64)
        marks = Landmarks(ends, np.array([whole_between[e] for e in ends.tolist()]))
        low = max(largest, -(-total // shards))
        gaps = np.diff(np.concatenate([[0], ends]))
        high = max(low + int(gaps.max()), low)
        enough = marks.least(low, high, shards, hopeful=False)
        bound = marks.least(low, enough, shards, hopeful=True)
        if bound == enough:
            return enough, marks, known
        first, last = marks.greedy(bound, shards, hopeful=False), marks.greedy(enough, shards, hopeful=True)
        last += [total] * (shards - len(last))
        first += [first[-1] if first else 0] * (len(last) - len(first))
        # the gaps of landmarks that hold the possible places of each cut
        lower = [int(ends[k - 1]) if (k := int(np.searchsorted(ends, a, "right"))) else 0 for a in first]
        upper = [int(ends[min(len(ends) - 1, int(np.searchsorted(ends, b, "left")))]) for b in last]
        spans = _joined(list(zip(lower, upper)))
        # the spans shrink by more than this, so that a round reads fewer landmarks than the one before
        width = max(1, min(width // 8, -(-sum(b - a for a, b in spans) // limit)))


def even_cuts(marks: Landmarks, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near as can be to an equal share of what is left.

    The greedy pass backwards gives the earliest place from which the remaining
    shards suffice; the capacity itself gives the latest.
    """
    ends, total = marks.ends, int(marks.ends[-1])
    positions = np.concatenate([[0], ends])
    earliest, at = [], total
    for _ in range(shards - 1):
        at = int(positions[np.searchsorted(positions, at - capacity, "left")]) if at > 0 else 0
        earliest.append(at)
    earliest.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        aim = at + (total - at) / (shards - k)
        low, high = max(earliest[k], at), at + capacity
        a, b = np.searchsorted(positions, low, "left"), np.searchsorted(positions, high, "right")
        place = int(np.searchsorted(positions[a:b], aim))
        near = [p for p in (place - 1, place) if 0 <= p < b - a]
        at = int(positions[a:b][min(near, key=lambda p: abs(positions[a:b][p] - aim))])
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", limit: int = LANDMARKS) -> DataFrame:
    """Put rows into shards of nearly equal bytes; equal texts stay together.

    Returns ``id_col, size, text_crc32, shard, slot``. Size is the text's UTF-8
    bytes plus 8; a null text counts as empty and is grouped with empty ones.
    Slots count from 0 in each shard without gaps. With fewer groups than shards
    some shards stay empty; an empty table gives no rows; repeated rows are rows of
    their own; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")),
        "sizes",
    )
    groups, before = _running(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), ["digest"], ["bytes", "rows"])
    groups = _with_offsets(groups, before, ["bytes", "rows"])
    top = groups.agg(F.max("bytes").alias("largest"), F.max("_end_bytes").alias("total")).first()
    cuts: list[tuple[int, bytes]] = [(0, b"")] * (shards - 1)
    if top.total:
        capacity, marks, known = smallest_capacity(groups, top.total, top.largest, shards, limit)
        cuts = [known.get(at, (0, b"")) for at in even_cuts(marks, capacity, shards)]
    placed, before = _running(rows.withColumn("one", F.lit(1)), ["digest", id_col], ["one"])
    numbered = _with_offsets(placed, before, ["one"])
    shard = reduce(lambda a, b: a + b, [(F.col("digest") > F.lit(bytearray(digest))).cast("int") for _, digest in cuts], F.lit(0))
    starts = F.array(*(F.lit(rows).cast("long") for rows, _ in [(0, b""), *cuts]))
    numbered = numbered.withColumn("shard", shard)
    return numbered.select(id_col, "size", "text_crc32", "shard", (F.col("_end_one") - 1 - F.element_at(starts, F.col("shard") + 1)).alias("slot"))
