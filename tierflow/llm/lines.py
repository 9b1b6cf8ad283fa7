"""Line deduplication with a sharded minimal perfect hash.

Every text gives its distinct line keys as 128-bit digests. Their document counts are
added up, and the distinct digests are dealt to shards by their leading bits. Each
shard gets a minimal perfect hash: levels of bits, where a digest stands on the first
level on which no other one of the shard falls on its bit; the rank of that bit is
its place in an array of 32-bit fingerprints and one of 16-bit counts. Documents then
probe the arrays; no line is joined.

An index of up to ``BROADCAST`` bytes goes to every worker whole. A larger one stays in
its shards: probes are dealt to the shards (a shard with many probes is copied for
several tasks), stream past its arrays, and only the numbers of dropped lines come back.

Digests of the corpus itself are all in the index, so the fingerprints matter only for
texts that the index has not seen; of those, one line in 2 ** 32 passes for a known one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, fresh, slices
from tierflow.llm.words import mixed
from tierflow.shared import dropped, stored

#: What is stripped from both ends of a line (fixed values).
SPACES = b" \t\n\x0b\x0c\r"
#: Distinct lines of a shard on average, at most.
SHARD_LINES = 1 << 17
#: Bytes up to which the index is broadcast.
BROADCAST = 64 << 20
#: Probes that one copy of a shard answers on average, at most.
SHARD_PROBES = 1 << 20
#: Distinct lines that a task adds up before it sends them on.
PENDING = 1 << 20
#: Counts stop here.
MOST = 65_535
_STEP = 0xD1B54A32D192ED03


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines of a text; null and empty texts have one empty line."""
    return (text or b"").split(b"\n")


def key_of(line: bytes) -> bytes:
    """What makes lines equal: no white space at the ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether the key has at least ``least`` code points."""
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8")) >= least)


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit digests of keys, two 64-bit numbers each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (((high >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _at(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    return mixed(high * np.uint64(2 * level + 1) + mixed(low + np.uint64(level * _STEP % 2**64)))


def perfect_hash(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and bits of the levels for distinct digests, and their fingerprints and counts in the order of the bits."""
    sizes, levels, order, open_ = [], [], [], np.arange(len(high))
    while len(open_):
        size = (len(open_) * 3 // 2 // 64 + 1) * 64
        at = (_at(high[open_], low[open_], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        order.append(open_[placed][np.argsort(at[placed])])
        sizes.append(size)
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        open_ = open_[~placed]
    own = np.concatenate(order) if order else open_
    bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    return sizes, bits, low[own].astype(np.uint32), np.minimum(counts[own], MOST).astype(np.uint16)


class Shards:
    """Arrays of one or more shards, ready to be probed."""

    def __init__(self, shards: list[int], sizes: list[list[int]], bits: list[bytes], marks: list[bytes], counts: list[bytes], of: int):
        self.of = of
        self.row = np.full(of, -1, np.int64)
        self.row[shards] = np.arange(len(shards))
        depth = max(map(len, sizes), default=0)
        self.size = np.zeros((len(shards), depth), np.uint64)
        for k, own in enumerate(sizes):
            self.size[k, : len(own)] = own
        ends = np.cumsum(self.size.reshape(-1), dtype=np.uint64).reshape(self.size.shape)
        self.start = ends - self.size
        self.bits = np.frombuffer(b"".join(bits), np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        self.marks = np.frombuffer(b"".join(marks), np.uint32)
        self.counts = np.frombuffer(b"".join(counts), np.uint16)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each digest, 0 for those that the arrays do not know."""
        out = np.zeros(len(high), np.uint16)
        row = self.row[shard_of(high, self.of)]
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.size.shape[1]):
            size = self.size[row[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = self.start[row[open_], level] + _at(high[open_], low[open_], level) % size
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            place = self.rank[word[hit]] + np.bitwise_count(self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            known = self.marks[place] == low[open_[hit]].astype(np.uint32)
            out[open_[hit][known]] = self.counts[place[known]]
            open_ = open_[~hit]
        return out


class Index:
    """The stored arrays (shard, sizes, bits, marks, counts), the number of shards and the bytes of all."""

    def __init__(self, arrays: DataFrame, shards: int, size: int):
        self.arrays, self.shards, self.size = arrays, shards, size

    def whole(self) -> Shards:
        """All shards together; only for an index of up to ``BROADCAST`` bytes."""
        rows = self.arrays.toArrow()
        return Shards(*(rows.column(name).to_pylist() for name in ("shard", "sizes", "bits", "marks", "counts")), of=self.shards)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``high, low, n``: how many texts hold each distinct line key of at least ``min_chars`` code points. Tasks add up before the shuffle."""

    def added(pending: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(pending)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(1)])) if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(every)]]))
        return pa.RecordBatch.from_arrays([pa.array(every[first, 0].view(np.int64)), pa.array(every[first, 1].view(np.int64)), pa.array(n)], names=["high", "low", "n"])

    most = PENDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in slices(batches):
            keys: list[bytes] = []
            for text in batch.column(0).to_pylist():
                keys += {k for k in map(key_of, lines_of(text)) if long_enough(k, min_chars)}
            pending.append(digests(keys))
            size += len(keys)
            if size >= most:
                yield added(pending)
                pending, size = [], 0
        if pending:
            yield added(pending)

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "high long, low long, n long")
    return rows.groupBy("high", "low").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, min_chars: int = 1) -> Index:
    """The index of all distinct lines of ``docs`` (text). An empty table gives an empty index."""
    bounded(docs.sparkSession)
    counts = stored(line_counts(docs, min_chars), "line-counts")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * partitions, -(-counts.count() // SHARD_LINES))

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches))  # about SHARD_LINES rows
        high, low = (own.column(name).to_numpy().view(np.uint64) for name in ("high", "low"))
        sizes, bits, marks, n = perfect_hash(high, low, own.column("n").to_numpy())
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in (bits, marks, n))]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "sizes", "bits", "marks", "counts"])

    shard = F.expr(f"cast(shiftright(shiftrightunsigned(high, 32) * {shards}, 32) as int)")
    built = counts.select(shard.alias("shard"), "high", "low", "n").groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, marks binary, counts binary")
    arrays = stored(built, "line-index")
    dropped(counts)
    size = arrays.agg(F.coalesce(F.sum(F.expr("length(bits) + length(marks) + length(counts)")), F.lit(0))).first()[0]
    return Index(arrays, shards, size)


def without_common_lines(docs: DataFrame, index: Index, min_documents: int = 10, min_chars: int = 1, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with the lines gone that stand in at least ``min_documents`` texts of the index, and with ``n_lines`` and ``n_dropped``.

    ``text`` holds the other lines, joined by line breaks; it is empty where none is
    left, and for null. Columns of ``docs`` stay as they are; where one is called
    ``n_lines`` or ``n_dropped`` the new one gets a number behind its name. Repeated
    rows stay repeated and count as texts of their own. ``min_documents`` is at most ``MOST``.
    """
    if not 1 <= min_documents <= MOST:
        raise ValueError(f"min_documents is not between 1 and {MOST}")
    bounded(docs.sparkSession)
    return _probed_here(docs, index, min_documents, min_chars) if index.size <= broadcast else _probed_by_shard(docs, index, min_documents, min_chars)


def _schema(docs: DataFrame) -> str:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return ", ".join([*columns, f"`{fresh('n_lines', docs.columns)}` long", f"`{fresh('n_dropped', docs.columns)}` long"])


def _cut(batch: pa.RecordBatch, place: int, texts: list[list[bytes]], gone: list[set[int]], names: list[str]) -> pa.RecordBatch:
    """A batch with its texts cut and the two counts."""
    kept = [b"\n".join(line for k, line in enumerate(lines) if k not in out) if out else b"\n".join(lines) for lines, out in zip(texts, gone)]
    columns = list(batch.columns[: len(names) - 2])
    columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
    columns += [pa.array([len(lines) for lines in texts], pa.int64()), pa.array([len(out) for out in gone], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _texts(batch: pa.RecordBatch, place: int) -> list[bytes | None]:
    return batch.column(place).cast(pa.binary()).to_pylist()


def _probed_here(docs: DataFrame, index: Index, min_documents: int, min_chars: int) -> DataFrame:
    """Every task probes the whole index."""
    shared = docs.sparkSession.sparkContext.broadcast(index.whole())  # up to BROADCAST bytes
    place, schema = docs.columns.index("text"), _schema(docs)
    names = [*docs.columns, fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [lines_of(text) for text in _texts(batch, place)]
            keys = [key_of(line) for lines in texts for line in lines]
            found = digests(keys)
            often = shared.value.find(found[:, 0], found[:, 1]) >= min_documents
            gone: list[set[int]] = [set() for _ in texts]
            of = np.repeat(np.arange(len(texts)), [len(lines) for lines in texts])
            first = np.concatenate([[0], np.cumsum([len(lines) for lines in texts])])
            for k in np.flatnonzero(often).tolist():
                if long_enough(keys[k], min_chars):
                    gone[of[k]].add(k - int(first[of[k]]))
            yield _cut(batch, place, texts, gone, names)

    return docs.mapInArrow(run, schema)


def _probed_by_shard(docs: DataFrame, index: Index, min_documents: int, min_chars: int) -> DataFrame:
    """Probes travel to the shards; numbers of dropped lines travel back to equal texts."""
    spark, shards = docs.sparkSession, index.shards
    probe = "shard int, salt int, high long, low long, text_high long, text_low long, nth int"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = 0
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            own = digests([text or b"" for text in texts])
            keys, of, nth = [], [], []
            for k, text in enumerate(texts):
                for n, line in enumerate(lines_of(text)):
                    key = key_of(line)
                    if long_enough(key, min_chars):
                        keys.append(key)
                        of.append(k)
                        nth.append(n)
            found, of = digests(keys), np.array(of, np.int64)
            columns = [shard_of(found[:, 0], shards).astype(np.int32), np.arange(asked, asked + len(keys)).astype(np.int32) & 0x7FFFFFFF, *(a.view(np.int64) for a in (found[:, 0].copy(), found[:, 1].copy(), own[of, 0], own[of, 1])), np.array(nth, np.int32)]
            asked += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in probe.split(", ")])

    probes = stored(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(ask, probe), "line-probes")
    copies = probes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_PROBES).cast("int").alias("copies"))
    arrays = index.arrays.join(copies, "shard")
    nothing = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    one = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), *nothing("high", "low", "text_high", "text_low"), F.lit(None).cast("int").alias("nth"), "sizes", "bits", "marks", "counts")
    two = probes.join(F.broadcast(copies), "shard") if shards <= 100_000 else probes.join(copies, "shard")  # a row for each shard
    two = two.select("shard", (F.col("salt") % F.col("copies")).alias("salt"), F.lit(1).alias("kind"), "high", "low", "text_high", "text_low", "nth", *(F.lit(None).cast(t).alias(n) for n, t in (("sizes", "array<long>"), ("bits", "binary"), ("marks", "binary"), ("counts", "binary"))))
    dealt = one.union(two).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Shards | None = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            cuts = np.flatnonzero(kind == 0).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(kind)]):
                if b > a and kind[a] == 0:
                    row = batch.slice(a, 1)
                    at = Shards([row.column(0)[0].as_py()], *(row.column(c).to_pylist() for c in (8, 9, 10, 11)), of=shards)
                    a += 1
                if b > a and at is not None:  # probes of an empty shard find another one's arrays or none
                    part = batch.slice(a, b - a)
                    high, low = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (3, 4))
                    often = pa.array(at.find(high, low) >= min_documents)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(often) for c in (5, 6, 7)], names=["text_high", "text_low", "nth"])

    gone = dealt.mapInArrow(answer, "text_high long, text_low long, nth int").groupBy("text_high", "text_low").agg(F.collect_set("nth").alias("gone"))
    names = [*docs.columns, fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)]
    high, low, lost = (fresh(n, docs.columns) for n in ("text_high", "text_low", "gone"))
    place, schema, own_names = docs.columns.index("text"), _schema(docs), [*docs.columns, high, low]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = digests([text or b"" for text in _texts(batch, place)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(own[:, k].copy().view(np.int64)) for k in (0, 1))], names=own_names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [lines_of(text) for text in _texts(batch, place)]
            yield _cut(batch, place, texts, [set(g or ()) for g in batch.column(batch.num_columns - 1).to_pylist()], names)

    marked = docs.mapInArrow(mark, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{high}` long", f"`{low}` long"]))
    gone = gone.select(F.col("text_high").alias(high), F.col("text_low").alias(low), F.col("gone").alias(lost))
    return marked.join(gone, [high, low], "left").select(*docs.columns, lost).mapInArrow(cut, schema)


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines that at least ``min_documents`` of its own texts hold; see :func:`without_common_lines`."""
    return without_common_lines(docs, build_index(docs, min_chars), min_documents, min_chars)
