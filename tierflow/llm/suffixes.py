"""Repeated substrings by a partitioned array of sampled suffixes.

A start of a 400-byte string belongs to the anchor that the string itself names:
the place of the smallest hash among its first ``SPAN`` places. Equal strings name
anchors at the same distance, so only suffixes that begin at anchors are sorted,
about one in ``SPAN`` / 2. Those whose first bytes are nowhere else drop out by
hash; sampled splitters range-partition the others by their leading bytes, each
bucket is sorted by multikey quicksort, and neighbours' common prefixes, together
with the common context to the left, tell which starts occur again. Groups that
reach over a bucket's border are compared across it by hashes of whole strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, slices
from tierflow.llm.membership import BITS, contained, filter_of, possible
from tierflow.llm.words import mixed
from tierflow.shared import stored

#: Bytes of a string that must not repeat, and places among which it names its anchor by the hash of 16 bytes.
LENGTH, SPAN = 400, 128


def anchors(data: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings of ``length`` bytes in ``data``, and the first and last start of each."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    gram = data.astype(np.uint64)
    for step in (1, 2, 4, 8):  # up to 16 bytes
        gram = mixed(gram[:-step] * np.uint64(0x9E3779B97F4A7C15) + gram[step:])
    gram = gram[: n + span - 1] >> np.uint64(24) << np.uint64(24)
    # sliding minimum by doubling; ties go to the leftmost place
    size, best, at = 1, gram, np.arange(len(gram))
    while size < span:
        step = min(size, span - size)
        left, right = best[:-step], best[step:]
        pick = right < left
        best, at = np.where(pick, right, left), np.where(pick, at[step:], at[:-step])
        size += step
    at = at[:n]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], n) - 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8"), np.uint8)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: multikey quicksort with eight bytes as a character.

    Each level sorts what is still tied by the next character, all groups at once.
    """
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order, group, live = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.arange(len(rows))
    for depth in range(words.shape[1]):
        if len(live) < 2:
            break
        rows_of = order[live]
        new = np.lexsort((words[rows_of, depth], group[live]))
        order[live] = rows_of = rows_of[new]
        word, old = words[rows_of, depth], group[live]
        border = np.concatenate([[True], (old[1:] != old[:-1]) | (word[1:] != word[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(border, np.arange(len(live)), 0))]
        tied = ~border
        tied[:-1] |= ~border[1:]
        live = live[tied]
    return order


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])])


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values])
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), sizes


def _bucket(rows: pa.Table, length: int, span: int) -> Iterator[tuple]:
    """(key, from, to) of starts that occur again within a bucket, and (hash, n, key, start) of strings in groups that touch its borders."""
    right, right_size = _padded(rows.column("suffix").to_pylist(), length)
    left, left_size = _padded([v[::-1] for v in rows.column("before").to_pylist()], span)
    keys, at = rows.column("key").to_pylist(), rows.column("at").to_numpy()
    low, high = at - rows.column("last").to_numpy(), at - rows.column("first").to_numpy()  # distances of the starts
    order = multikey_order(right)
    shared = common_prefixes(right[order])
    # a common prefix cannot reach past the end of a text
    shared[1:] = np.minimum(shared[1:], np.minimum(right_size[order][1:], right_size[order][:-1]))
    left_order = multikey_order(left)
    left_shared = common_prefixes(left[left_order])
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(shared < length - span + 1)
    border = (group == group[order[0]]) | (group == group[order[-1]])
    again = np.zeros((len(order), span), bool)
    crossing: list[tuple] = []
    for x in range(span):
        own = np.flatnonzero((low <= x) & (x <= high) & (left_size >= x))
        if not len(own):
            continue
        one, two = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        one[order] = np.cumsum(shared < length - x)
        two[left_order] = np.cumsum(left_shared < x)
        _, index, back, count = np.unique(one[own] * (len(order) + 1) + two[own], return_index=True, return_inverse=True, return_counts=True)
        again[own, x] = count[back] > 1
        for k in np.flatnonzero(border[own[index]]):
            row = own[index[k]]
            string = left[row, :x][::-1].tobytes() + right[row, : length - x].tobytes()
            crossing.append((xxhash.xxh3_128_digest(string), int(min(count[k], 2)), keys[row], int(at[row] - x)))
    for row in np.flatnonzero(again.any(1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], again[row].view(np.int8), [0]])))
        for x1, x2 in zip(edge[::2], edge[1::2]):
            yield None, None, keys[row], int(at[row] - x2 + 1), int(at[row] - x1 + length)
    for digest, n, key, start in crossing:
        yield digest, n, key, start, start + length


def repeated_spans(texts: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """``key, start, stop`` of bytes covered by strings of ``length`` bytes that start anywhere else.

    ``texts`` has ``key`` (the digest of the text), ``id`` and ``text``; equal texts
    have equal keys and count once here, as all that they hold of that length is repeated anyway.
    """
    sure = length - span + 1
    spark = texts.sparkSession

    def found(bits: np.ndarray | None) -> DataFrame:
        """Anchors with the 64-bit hash of their sure bytes (``h``) and the 128-bit one of all bytes of their strings (``w, v``); only those whose ``h`` may be in the filter."""
        shared = spark.sparkContext.broadcast(bits) if bits is not None else None

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, seen = xxhash.xxh64_intdigest, set()
            for batch in slices(batches):
                out: list[tuple] = []
                keys = batch.column(0).to_pylist()
                for key, text in zip(keys, batch.column(1).to_pylist()):
                    # copies of a text have the same anchors; one in a task is enough
                    data = _bytes(None if key in seen else text)
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(key)
                    at, first, last = anchors(data, length, span)
                    view = memoryview(data)
                    h = np.fromiter((raw(view[a : a + sure]) for a in at.tolist()), np.uint64, len(at))
                    if shared is not None:
                        keep = contained(shared.value, mixed(h) & np.uint64(BITS - 1))
                        at, first, last, h = at[keep], first[keep], last[keep], h[keep]
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64).reshape(-1, 2)
                    out.append((h, w[:, 0], w[:, 1], at << 16 | (at - first) << 8 | (at - last)))
                names = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), [len(o[0]) for o in out])))
                h, w, v, spot = (np.concatenate([o[k] for o in out]).astype(t) if out else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint64, np.uint64, np.int64)))
                bit = (mixed(h) & np.uint64(BITS - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (h, w, v)), pa.array(bit), names, pa.array(spot)], names=["h", "w", "v", "bit", "key", "spot"])

        return texts.select("key", "text").mapInArrow(find, "h long, w long, v long, bit long, key binary, spot long")

    # sure bytes that are in two places
    twice = found(None).groupBy("h", "bit").agg(F.min(F.struct("key", "spot")).alias("a"), F.max(F.struct("key", "spot")).alias("b")).where("a <> b").select("h", "bit")
    twice = stored(twice, "twice")
    # distinct comes first, so that nothing after the join needs its keys together and Spark may split a frequent one
    met = found(filter_of(twice, F.col("bit"))).drop("bit").distinct().join(twice.select("h"), "h")
    met = stored(met, "anchors")
    # where even all bytes of the strings are in two places, every start occurs again
    kinds = stored(met.groupBy("h", "w", "v").agg(F.count("*").alias("n"), F.min(F.struct("key", "spot")).alias("one")), "kinds")
    place = (F.shiftright("spot", 16).cast("int") - F.shiftright("spot", 8).bitwiseAND(255).cast("int")).alias("start"), (F.shiftright("spot", 16) - F.col("spot").bitwiseAND(255) + length).cast("int").alias("stop")
    again = met.join(kinds.where("n > 1").select("h", "w", "v"), ["h", "w", "v"]).select("key", *place)
    # the others are compared, with one of each kind that begins alike
    open_ = kinds.where("n = 1").select("h").distinct()
    ones = kinds.join(open_, "h", "left_semi").select("one.key", F.shiftright("one.spot", 16).cast("int").alias("at"))
    wanted = stored(ones.groupBy("key").agg(F.collect_list("at").alias("ats")), "wanted")  # the anchors of one text
    chosen = texts.groupBy("key").agg(F.min("id").alias("id"))
    wanted = wanted.join(chosen, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text, ats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = _bytes(text)
                at, first, last = anchors(data, length, span)
                keep = np.isin(at, np.array(ats))
                at, first, last = at[keep], first[keep], last[keep]
                raw = data.tobytes()
                columns = [pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                columns.append(pa.array([raw[a : a + length] for a in at.tolist()], pa.binary()))
                columns.append(pa.array([raw[max(0, a - span + 1) : a] for a in at.tolist()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "first", "last", "suffix", "before"])

    some = possible(texts.select("key", "id", "text"), "key", filter_of(wanted, F.xxhash64("key")))
    one_each = some.join(wanted.select(F.col("key").alias("k"), F.col("id").alias("i"), "ats"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    suffixes = one_each.select("key", "text", "ats").mapInArrow(cut, "key binary, at int, first int, last int, suffix binary, before binary")
    suffixes = stored(suffixes.dropDuplicates(["key", "at"]), "suffixes")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        rows = list(_bucket(pa.Table.from_batches(held), length, span)) if held else []
        out: list[tuple] = [(None, None, *row[2:]) for row in rows if row[0] is None]
        parts: dict[int, list[bytes]] = {}
        for digest, n, key, start, _ in rows:
            if digest is not None:
                parts.setdefault(int.from_bytes(digest[:4], "little") % buckets, []).append(digest + key + start.to_bytes(4, "little") + bytes([n]))
        out += [(part, b"".join(strings), None, None, None) for part, strings in parts.items()]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "strings", "key", "start", "stop"])

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings at the borders that several buckets have; a bucket sends each once."""
        strings = np.frombuffer(b"".join(v for b in batches for v in b.column(1).to_pylist()), [("digest", "V16"), ("key", "V16"), ("start", "<i4"), ("n", "u1")])
        _, back = np.unique(strings["digest"], return_inverse=True)
        hit = strings[np.bincount(back, strings["n"])[back] > 1]
        stops = hit["start"] + length
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in hit["key"]], pa.binary()), pa.array(hit["start"]), pa.array(stops, pa.int32())], names=["key", "start", "stop"])

    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # splitters are sampled from the suffixes; key and place split groups of equal suffixes
    ranged = suffixes.repartitionByRange(buckets, "suffix", "key", "at")
    marks = stored(ranged.mapInArrow(sort, "part int, strings binary, key binary, start int, stop int"), "marks")
    across = marks.where("part is not null").select("part", "strings").groupBy("part").applyInArrow(compare, "key binary, start int, stop int")
    return again.union(marks.where("part is null").select("key", "start", "stop")).union(across)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN, with_kept: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``with_kept``, ``kept`` (the
    remaining bytes). Strings are judged on the input; matches never cross texts.
    Null and empty texts have nothing to remove; a row that is repeated makes its
    text repeated; only the two named columns are read.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary")))).select("key", "id", "text")
    spans = repeated_spans(texts.where(F.octet_length("text") >= length), length, span)
    copies = texts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 and size >= {length}")
    whole = copies.select("key", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("stop"))).alias("spans"))
    parts = spans.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # the spans of one text
    every = stored(parts.unionByName(whole), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = _bytes(text)
                step = np.zeros(len(data) + 1, np.int64)
                if spans:
                    np.add.at(step, [s["start"] for s in spans], 1)
                    np.add.at(step, [s["stop"] for s in spans], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)[: 5 if with_kept else 4])
            columns = list(zip(*rows)) or [()] * (5 if with_kept else 4)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])

    bits = filter_of(every, F.xxhash64("key"))
    marked = possible(texts, "key", bits).join(every, "key", "left").select("id", "text", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts whose key is not in the filter; they have no spans."""
        yield from cut(
            pa.RecordBatch.from_arrays([*part.columns[:2], pa.nulls(part.num_rows)], names=["id", "text", "spans"])
            for part in (b.filter(pa.array(~contained(shared.value, b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)))) for b in batches)
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    clean = texts.select("id", "text", F.xxhash64("key").bitwiseAND(BITS - 1).alias("bit"))
    return marked.mapInArrow(cut, schema).union(clean.mapInArrow(keep, schema))
