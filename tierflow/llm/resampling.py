"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Runs of words are hashed into buckets. A block of documents becomes inverted postings:
for each partition of the buckets one row with (bucket, document, count) in columns.
They are shuffled to their buckets' partition, where the counts of both corpora meet
them: these give each bucket's gain there, and the postings that follow turn into
contributions. Contributions are reduced by document. A partition of many postings is
dealt to several tasks by blocks, each with the counts of its buckets, so a bucket of
which every document has a posting lies in no single task.

Documents are drawn without replacement by adding Gumbel noise of their id to their
weight and taking the highest.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, slices
from tierflow.shared import dropped, stored

#: Partitions of the buckets, and rows of postings that one copy of a partition turns into contributions on average.
PARTS, BLOCKS = 64, 256
#: Documents of a block, at most (numbers inside a block have 16 bits).
BLOCK_DOCUMENTS = 10_000
#: Runs whose bucket a task remembers.
REMEMBERED = 1 << 20
#: Words are made of other bytes than these; A-Z are lower-cased first (fixed values).
_WORDS = bytes(k + 32 if 65 <= k <= 90 else 32 if k < 48 or 58 <= k <= 96 or 123 <= k <= 127 else k for k in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all that is not ASCII, A-Z lower-cased; none for null."""
    return (text or b"").translate(_WORDS).split()


def features_of(words: list[bytes], most: int) -> Iterator[bytes]:
    """All runs of 1 to ``most`` words, joined by one space."""
    yield from words
    for n in range(2, most + 1):
        yield from map(b" ".join, zip(*(words[k:] for k in range(n))))


class _Buckets(dict):
    """Bucket of each run, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = bucket = zlib.crc32(run) % self.n
        return bucket


def bucket_counts(texts: DataFrame, buckets: int, most: int) -> DataFrame:
    """``bucket, n`` over all texts: at most ``buckets`` rows from a task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found += np.bincount(np.fromiter(map(known.__getitem__, features_of(words_of(text), most)), np.int64), minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, buckets: int, most: int) -> DataFrame:
    """Blocks of inverted postings, a row for each part of the buckets, and a row with part -1 for the block's documents.

    ``block, part, bucket, doc, count`` hold 16-bit buckets and numbers of documents and 32-bit counts, in the
    order of the buckets; ``ids, words, features`` the documents of a block in order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = TaskContext.get().partitionId() << 32, _Buckets(buckets)
        for batch in slices(batches, rows=BLOCK_DOCUMENTS):
            texts = [words_of(text) for text in batch.column(1).to_pylist()]
            found = [Counter(map(known.__getitem__, features_of(words, most))) for words in texts]
            size = np.array([len(c) for c in found], np.int64)
            bucket = np.concatenate([np.fromiter(c.keys(), np.int64, len(c)) for c in found])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in found])
            doc = np.repeat(np.arange(len(found)), size)
            order = np.lexsort((doc, bucket))
            bucket, count, doc = bucket[order], count[order], doc[order]
            cuts = np.searchsorted(bucket * PARTS // buckets, np.arange(PARTS + 1)).tolist()
            parts = [k for k in range(PARTS) if cuts[k] < cuts[k + 1]]
            packed = [[a[cuts[k] : cuts[k + 1]].astype(t).tobytes() for k in parts] + [None] for a, t in ((bucket, np.uint16), (doc, np.uint16), (count, np.uint32))]
            none = [None] * len(parts)
            features = np.array([sum(c.values()) for c in found], np.int64)
            columns = [
                pa.array([block] * (len(parts) + 1), pa.int64()), pa.array([*parts, -1], pa.int32()), *(pa.array(p, pa.binary()) for p in packed),
                pa.array([*none, batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), *(pa.array([*none, values], pa.list_(pa.int64())) for values in ([len(w) for w in texts], features.tolist())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "bucket", "doc", "count", "ids", "words", "features"])
            block += 1

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"block long, part int, bucket binary, doc binary, count binary, ids array<{kind}>, words array<long>, features array<long>")


def _posted_counts(posted: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` of stored postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bucket, count = np.frombuffer(bucket, np.uint16), np.frombuffer(count, np.uint32)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                found[bucket[first]] += np.add.reduceat(count, first, dtype=np.int64)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["bucket", "n"])

    return posted.where("part >= 0").select("bucket", "count").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def weigh_documents(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs`` (doc_id, text) against the texts of ``target``.

    With S features in ``docs``, s of them in a bucket, and T and t in the target, the
    bucket's gain is ``floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``;
    a document's weight is the sum over its features, 0 without any. Null and empty
    texts have no features. Repeated rows are weighed one by one; any further columns
    are not read; ids of any type will do. There are at most 65,536 buckets.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets is not between 1 and 65536")
    spark = docs.sparkSession
    bounded(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = stored(postings(docs, buckets, most), "postings")
    both = _posted_counts(posted, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
    both = both.union(bucket_counts(target, buckets, most).select("bucket", F.lit(0), "n")).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = stored(both, "bucket-counts")  # at most ``buckets`` rows
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    gain = F.expr(f"cast(floor(1000 * ln(cast(t + 1 as double) * ({totals.s} + {buckets}) / (cast(s + 1 as double) * ({totals.t} + {buckets})))) as long)")
    copies = max(-(-2 * partitions // PARTS), -(-posted.where("part = 0").count() // BLOCKS))
    # the counts of a part's buckets come before its postings, once for each copy of the part
    counts = both.select(F.expr(f"cast(bucket * {PARTS} div {buckets} as int)").alias("part"), F.struct("bucket", gain.alias("gain")).alias("g")).groupBy("part").agg(F.collect_list("g").alias("gains"))
    counts = counts.select("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), *(F.lit(None).cast("binary").alias(n) for n in ("bucket", "doc", "count")), "gains")
    rows = posted.where("part >= 0").select("part", F.expr(f"cast(pmod(xxhash64(block), {copies}) as int)").alias("copy"), F.lit(1).alias("kind"), "block", "bucket", "doc", "count", F.lit(None).cast("array<struct<bucket:int,gain:long>>").alias("gains"))
    dealt = counts.union(rows).repartition(max(partitions, 1), "part", "copy").sortWithinPartitions("part", "copy", "kind")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.zeros(buckets, np.int64)
        for batch in batches:
            blocks, docs_of, weights = [], [], []
            kinds, block, bucket, doc, count, own = (batch.column(k).to_pylist() for k in range(2, 8))
            for k, kind in enumerate(kinds):
                if kind == 0:
                    for g in own[k]:
                        gains[g["bucket"]] = g["gain"]
                    continue
                at = np.frombuffer(doc[k], np.uint16)
                worth = gains[np.frombuffer(bucket[k], np.uint16)] * np.frombuffer(count[k], np.uint32)
                order = np.argsort(at, kind="stable")
                at, worth = at[order], worth[order]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                blocks.append(block[k])
                docs_of.append(at[first].tobytes())
                weights.append(np.add.reduceat(worth, first).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(docs_of, pa.binary()), pa.array(weights, pa.binary())], names=["block", "doc", "weight"])

    given = dealt.mapInArrow(contribute, "block long, doc binary, weight binary")
    home = posted.where("part < 0")
    kind = home.schema["ids"].dataType.simpleString()
    every = given.select("block", "doc", "weight", *(F.lit(None).cast(t).alias(n) for n, t in (("ids", kind), ("words", "array<long>"), ("features", "array<long>"))))
    every = every.union(home.select("block", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "ids", "words", "features"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def reduce(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own = np.zeros(BLOCK_DOCUMENTS, np.int64), None
        for batch in batches:
            for doc, weight in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if doc is not None:
                    weights[np.frombuffer(doc, np.uint16)] += np.frombuffer(weight, np.int64)
            some = batch.column(3).is_valid()
            if some.true_count:
                own = batch.filter(some)
        ids, words, features = (own.column(k).flatten() for k in (3, 4, 5))
        yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(weights[: len(ids)])], names=["doc_id", "n_words", "n_features", "weight"])

    return every.groupBy("block").applyInArrow(reduce, out)


def scored(weighed: DataFrame, seed: int = 2024) -> DataFrame:
    """``weighed`` with ``score``: weight plus ``floor(-1000 * ln(-ln(u)))``, u from the first 32 bits of sha256 of seed and id. A null id counts as an empty text."""
    h = F.expr(f"cast(conv(substr(sha2(cast(concat('{seed}:', coalesce(cast(doc_id as string), '')) as binary), 256), 1, 8), 16, 10) as double)")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def drawn(rows: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``rows`` (doc_id, n_words, score) with ``rank``: 1, 2 .. of the drawn ones by falling score, ties by id; null for the others.

    Of the documents with at least ``least_words`` words ``percent`` of a hundred are
    drawn, rounded down. Ranks come from a range partition by score with the
    sizes of the partitions before it, so no task holds all rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at + 1, at + batch.num_rows + 1))], names=[*names, "_part", "_nth"])
            at += batch.num_rows

    order = [F.desc("score"), F.asc("doc_id")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int", "_nth long"])
    fit = stored(rows.where(F.col("n_words") >= least_words).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "by-score")
    sizes = fit.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each partition
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["n"]
    small = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    rank = F.col("_nth") + F.col("_before")
    ranked = fit.join(F.broadcast(small), "_part").select(*names, F.when(rank <= percent * before // 100, rank).alias("rank"))
    return ranked.union(rows.where(F.coalesce(F.col("n_words") < least_words, F.lit(True))).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, most: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``: its weight for ``target`` and its rank among the drawn ones."""
    rows = stored(scored(weigh_documents(docs, target, buckets, most), seed), "weights")
    return drawn(rows, percent, least_words)
