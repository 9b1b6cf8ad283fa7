"""Exact Jaccard join of documents' word shingles in the metric space of Jaccard distance.

Unrelated documents all have distance 1 from each other, so cells of the whole space
would separate nothing. Regions are therefore first drawn where links are possible
at all: documents that have one of each other's rare shingles (prefix condition: of
two sets with similarity 0.8 or more, the rarest fifths share a shingle). Documents
with rare shingles of several regions are replicated to each of them, equal sets
and regions with the same members count once.

A region's first pivot meets all members. Documents within the radius are linked to
it and so to each other, so a group of n near copies costs n comparisons. A region
whose members are then in more than one component is divided: some members become
pivots, the exact distances of all members to them are computed, every member goes
to the Voronoi cell of its nearest pivot, and with it those of other cells that the
triangle inequality lets be linked over the border: d(x, p) <= d(x, own pivot) + twice
the radius, and d(x, p) <= the cell's reach + the radius. Cells are joined in the same
way until their members are in one component or few enough to meet each other.
Regions of up to ``CELL`` documents recurse inside a task, larger ones in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, released, slices
from tierflow.llm.membership import filter_of, possible
from tierflow.llm.words import mixed, shingles, words_of
from tierflow.shared import dropped, stored

#: Words of a shingle; documents link when 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 80
#: Counters of the sketch of shingle frequencies, a byte each. Fixed: 32 MB are broadcast whatever the corpus.
COUNTERS = 1 << 25
#: Members and shingles of a region that one task joins at most; larger ones are divided by Spark.
CELL, WEIGHT = 4096, 1 << 21
#: Pivots of a division at first, and members of a cell that are compared with each other.
PIVOTS, LEAF = 16, 16
#: Bands to the width of the radius, when regions are cut at gaps.
BANDS = 4
#: Parts in which the sketch is put together, and shingles that a task gathers before it sends them on.
_CHUNKS, _GATHERED = 64, 1 << 21


def _packed(places: np.ndarray) -> bytes:
    """Sorted places as gaps, byte by byte, compressed: little more than a byte for each."""
    gaps = np.diff(places, prepend=0).astype(np.uint32)
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view(np.uint32).reshape(-1).cumsum()


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """How many documents have each counter's shingles, in eighths of a power of two. Only decides which shingles count as rare, never which documents link.

    With few counters, shingles of a passage that some dozen documents share could
    not be told from unique ones, would be in the prefixes and draw regions of
    documents that have nothing else in common.
    """
    size = COUNTERS // _CHUNKS

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        places = np.sort(np.concatenate(held))
        cuts = np.searchsorted(places, np.arange(_CHUNKS + 1) * size)
        chunks = [_packed(places[i:j] - k * size) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
        return pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "places"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append((_set_of(text) & np.uint64(COUNTERS - 1)).astype(np.int64))
                n += len(held[-1])
            if n >= _GATHERED:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)
        held = []
        released()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(1):
                total += np.bincount(_unpacked(value.as_py()), minlength=size)
        levels = np.minimum(np.rint(8 * np.log2(total + 1)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["chunk", "levels"])

    # a chunk's sum has a fixed size
    rows = docs.select(text_col).mapInArrow(count, "chunk int, places binary").groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect()
    out = np.zeros((_CHUNKS, size), np.uint8)
    for row in rows:
        out[row.chunk] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles, in any order common to all, a linked document must share one of."""
    return n - -(-percent * n // 100) + 1


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, set_id, prefix``: size of the set, its digest and its rarest shingles. Copies met again in the same task have no prefix."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = counts.value, set()
        for batch in slices(batches):
            sizes, sets, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                found = _set_of(text)
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if not len(found) or sets[-1] in seen:
                    prefixes.append([])
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(sets[-1])
                order = np.lexsort((mixed(found), often[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                prefixes.append(found[order[: prefix_size(len(found))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_id", "prefix"])
        released()

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"id {picked.schema[id_col].dataType.simpleString()}, n_shingles long, set_id binary, prefix array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of some documents (id, set_id); a repeated row gives a repeated row. A filter of fixed size drops most others before the join.

    Texts are shipped and not their sets, which are larger and hardly compress.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set_of(text) for text in batch.column(1).to_pylist()]
            keep = pa.array([len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            yield batch.select([0, 1]).filter(keep)
        released()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    wanted = possible(picked, "id", filter_of(ids, F.xxhash64("id"))).join(ids, "id").select("id", "text", "set_id")
    return wanted.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string")


def _set_of(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingles."""
    return shingles(words_of(text), WORDS)


def _measured(docs: DataFrame, pairs: DataFrame, own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written distances of pairs (a, b). Only the texts of their documents, which ``own`` (id, set_id) names, are written again, and deleted afterwards."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stored(_texts_of(docs, stored(ids.join(own, "id"), "ids"), id_col, text_col), "texts")
    out = stored(_distances(pairs, texts), "distances")
    dropped(texts)
    return out


def _distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, common, total`` of each pair: sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in slices(batches):
            common, total = [], []
            for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                # rows of a pivot mostly follow each other
                if other != last:
                    last, y = other, _set_of(other)
                x = _set_of(text)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])
        released()

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, common long, total long").distinct()


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("total") * percent


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of all ends of ``links`` (a, b): the smallest id that links reach.

    Rounds of large and small stars: every node is tied to its smallest neighbour,
    until nothing changes. Nodes with many neighbours are aggregated map-side, and
    a round's edges are written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        new = stored(small, "edges")
        # finished when every node has one neighbour and none is both above and below another
        more = new.groupBy("u").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        dropped(edges)
        edges = new
        if not more:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _dropped_single(rest: DataFrame, found: DataFrame) -> DataFrame:
    """``h, id, n, m, d, c, size, weight`` of the regions of ``rest`` (h, id, n, m, d) whose members are in more than one component."""
    named = rest.join(found, "id", "left").select("h", "id", "n", "m", "d", F.coalesce("component", "id").alias("c"))
    measures = F.min("c").alias("_c"), F.max("c").alias("_d"), F.count("*").alias("size"), F.sum("n").alias("weight"), *_signature()
    many = named.groupBy("h").agg(*measures).where("_c <> _d").groupBy("size", "weight", "x", "y").agg(F.min("h").alias("h")).select("h", "size", "weight")
    return stored(named.join(many, "h"), "regions")


def _signature() -> list[Column]:
    """80 bits of the members of a region. Sums: a member that is there twice would cancel out of an exclusive or. 2^23 times the same member fit in."""
    return [F.sum(F.shiftright(F.xxhash64("id"), 24)).alias("x"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 24)).alias("y")]


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``h`` of one of all regions (h, id) that have the same members, two or more."""
    signed = rows.groupBy("h").agg(F.count("*").alias("size"), *_signature()).where("size > 1")
    return signed.groupBy("size", "x", "y").agg(F.min("h").alias("h")).select("h")


def _apart(rows: DataFrame, band: Column) -> DataFrame:
    """``rows`` with the regions ``h`` cut wherever more than ``BANDS`` bands in a row are empty; members on both sides cannot be linked.

    A region has a bounded number of bands, so what is gathered of it is small.
    """
    rows = rows.withColumn("band", band)
    bands = rows.groupBy("h").agg(F.sort_array(F.collect_set("band")).alias("bands")).where(f"exists(sequence(1, greatest(1, size(bands) - 1)), i -> get(bands, i) - get(bands, i - 1) > {BANDS + 1})")
    begins = F.expr(f"array_max(filter(bands, (x, i) -> x <= band and (i = 0 or x - bands[i - 1] > {BANDS + 1})))")
    return rows.join(bands, "h", "left").withColumn("h", F.when(F.col("bands").isNull(), F.col("h")).otherwise(F.xxhash64("h", begins))).drop("band", "bands")


def _pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the members of regions of up to ``LEAF`` that sizes, distances to the last pivot and components leave open."""
    other = regions.select("h", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "c", "d")))
    sizes = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    window = F.coalesce(F.abs(F.col("d") - F.col("d_b")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    return regions.join(other, "h").where("id > id_b and c <> c_b").where(sizes & window).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def _within(regions: DataFrame, docs: DataFrame, own: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Links (a, b) between the components of each of these regions, which are small enough for a task."""
    kind = regions.schema["id"].dataType.simpleString()
    texts = stored(_texts_of(docs, stored(regions.select("id").distinct().join(own, "id"), "ids"), id_col, text_col), "texts")

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, held = [], [], []
        for batch in batches:
            ids += batch.column(1).to_pylist()
            names += batch.column(2).to_pylist()
            held += [_set_of(x.as_py()) for x in batch.column(3)]
        links = list(Cells(held, names, percent).links())
        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], batch.schema.field(1).type), pa.array([ids[y] for _, y in links], batch.schema.field(1).type)], names=["a", "b"])

    rows = regions.select("h", "id", "c").join(texts, "id").select("h", "id", "c", "text")
    links = stored(rows.groupBy("h").applyInArrow(join, f"a {kind}, b {kind}").distinct(), "links")
    dropped(texts)
    return links


class Cells:
    """Exact join of one region in memory: pivots, cells of the nearest pivot, windows, recursion."""

    def __init__(self, sets: list[np.ndarray], components: list, percent: int):
        values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.mark = np.zeros(len(values), np.int32)
        self.percent, self.radius = percent, (100 - percent) / 100 + 1e-9
        self.of = np.unique(np.array(components), return_inverse=True)[1]
        self.known: dict[int, np.ndarray] = {}
        self.found: list[tuple[int, int]] = []

    def distances(self, pivot: int) -> np.ndarray:
        """Distance of every member to ``pivot``; whoever is within the radius is linked to it."""
        if pivot not in self.known:
            own = self.codes[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]
            self.mark[own] = 1
            common = np.add.reduceat(self.mark[self.codes], self.starts)
            self.mark[own] = 0
            total = self.sizes + self.sizes[pivot] - common
            self.known[pivot] = 1 - common / total
            for other in np.flatnonzero(common * 100 >= total * self.percent):
                if self.of[other] != self.of[pivot]:
                    self.of[self.of == self.of[other]] = self.of[pivot]
                    self.found.append((pivot, int(other)))
        return self.known[pivot]

    def compare(self, members: np.ndarray) -> None:
        """Members meet the others, but for those that a known pivot's window or a common component rules out."""
        rows = np.stack([self.known[p] for p in self.known], 1) if self.known else np.zeros((len(self.of), 1))
        for x in members:
            left = members[self.of[members] != self.of[x]]
            if x not in self.known and (np.abs(rows[left] - rows[x]).max(1, initial=0) <= self.radius).any():
                self.distances(int(x))

    def split(self, members: np.ndarray) -> None:
        if len(np.unique(self.of[members])) < 2:
            return
        if len(members) <= LEAF:
            return self.compare(members)
        # pivots as far from each other as can be
        pivots, least = [int(members[0])], self.distances(int(members[0]))[members]
        while len(pivots) < PIVOTS and least.max() > 0:
            pivots.append(int(members[least.argmax()]))
            least = np.minimum(least, self.distances(pivots[-1])[members])
        each = np.stack([self.known[p][members] for p in pivots], 1)
        home = each.argmin(1)
        for k in range(len(pivots)):
            if not (home == k).any():
                continue
            reach = each[home == k, k].max()
            inside = (home == k) | ((each[:, k] - least <= 2 * self.radius) & (each[:, k] <= reach + self.radius))
            # a cell that is hardly smaller than its region is compared as it is
            (self.split if inside.sum() <= 0.75 * len(members) else self.compare)(members[inside])

    def links(self) -> list[tuple[int, int]]:
        """Links between members of different components, as many as it takes to join those that are linked at all."""
        self.split(np.arange(len(self.of)))
        return self.found


def _divided(large: DataFrame, measured: DataFrame, docs: DataFrame, own: DataFrame, id_col: str, text_col: str, percent: int, step: int) -> tuple[DataFrame, DataFrame]:
    """One round of large regions: the new cells (h, id, n, m, d) and the distances of all members to the pivots.

    Pivots are taken from outside the region's largest component first. A member
    goes to the cell of its nearest pivot and, where the triangle inequality allows a
    link over the border, to others. A region that this would blow up stays whole
    and gets twice the pivots next time. Pivots have met all and leave.
    """
    main = large.groupBy("h", "c").count().groupBy("h").agg(F.max(F.struct("count", "c")).alias("main")).select("h", F.col("main.c").alias("main"))
    ranked = large.join(main, "h").withColumn("_n", F.row_number().over(Window.partitionBy("h").orderBy(F.col("c") == F.col("main"), F.xxhash64("id", F.lit(step)), "id")))
    pivots = stored(ranked.where((F.col("_n") <= PIVOTS << (step - 1)) & (F.col("_n") <= F.col("m"))).select("h", F.col("id").alias("pivot")), "pivots")
    met = stored(large.select("h", "id", "n", "m", "size").join(pivots, "h"), "met")
    pairs = met.where("id <> pivot").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
    more = _measured(docs, pairs.join(measured, ["a", "b"], "left_anti"), own, id_col, text_col)
    every = measured.unionByName(more).select("a", "b", (1 - F.col("common") / F.col("total")).alias("d"))
    near = met.select("*", F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).join(every, ["a", "b"], "left")
    near = stored(near.select("h", "id", "n", "m", "size", "pivot", F.coalesce("d", F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(1.0)).alias("d")), "near")
    homes = near.groupBy("h", "id").agg(F.min(F.struct("d", "pivot")).alias("home"))
    reach = homes.groupBy("h", F.col("home.pivot").alias("pivot")).agg(F.max("home.d").alias("reach"))
    radius = (100 - percent) / 100 + 1e-9
    placed = near.join(homes, ["h", "id"]).join(reach, ["h", "pivot"])
    inside = (F.col("pivot") == F.col("home.pivot")) | ((F.col("d") - F.col("home.d") <= 2 * radius) & (F.col("d") <= F.col("reach") + radius))
    placed = stored(placed.where(inside).select("h", "id", "n", "m", "size", "pivot"), "cells")
    whole = placed.groupBy("h", "size").count().where("count > 2 * size").select("h")
    rest = placed.join(pivots.select("h", F.col("pivot").alias("id")), ["h", "id"], "left_anti")
    cells = rest.join(whole, "h", "left_anti").select(F.xxhash64("h", "pivot").alias("h"), "id", "n", F.lit(PIVOTS).alias("m")).distinct()
    kept = rest.join(whole, "h", "left_semi").select("h", "id", "n", (F.col("m") * 2).alias("m")).distinct()
    out = stored(cells.unionByName(kept).withColumn("d", F.lit(None).cast("double")), "rest")
    for table in (met, near, placed):
        dropped(table)
    return out, more


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """The component of each document: ``id_col, n_shingles, component_id``.

    Null texts and texts without words have no shingles and stand alone. Rows with
    the same id are one document for links, by the set with the smallest digest if
    their texts differ, but each is returned. Rows with a null
    id link with nothing and have a null component. Only the two named columns are
    read; an empty table gives no rows.
    """
    bounded(docs.sparkSession)
    prefixed = stored(_described(docs, id_col, text_col), "prefixed")
    # all but the prefixes, which are most of it and are needed only until the regions are drawn
    described = stored(prefixed.drop("prefix"), "described")
    known = described.where("id is not null and n_shingles > 0")
    # equal sets: one link to the smallest id
    firsts = known.groupBy("set_id").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").select("set_id", "b")
    links = known.join(firsts, "set_id").where("id <> b").select(F.col("id").alias("a"), "b")

    # regions: documents that have the shingle among their rarest; of regions with the same members one is enough
    entries = prefixed.where("id is not null").select(F.explode("prefix").alias("h"), "id")
    shared = stored(entries.groupBy("h").agg(F.min("id").alias("_low"), F.max("id").alias("_top")).where("_low < _top").select("h"), "shared")
    # only shingles that may be in the filter are shuffled again
    several = _one_of_each(possible(entries, "h", filter_of(shared, F.xxhash64("h"))))
    several = stored(several, "several")
    dropped(shared)
    chosen = possible(entries, "h", filter_of(several, F.xxhash64("h"))).join(several, "h")
    sets = known.groupBy("id").agg(F.min(F.struct("set_id", F.col("n_shingles").alias("n"))).alias("s"))
    own = sets.select("id", "s.set_id")
    # equal sets are one member; where sizes leave a gap that no link spans, a region falls apart
    members = stored(chosen.join(sets, "id").groupBy("h", "s").agg(F.min("id").alias("id")).select("h", "id", "s.n"), "members")
    dropped(several)
    dropped(prefixed)
    sized = _apart(members, F.floor(F.log("n") / math.log(100 / percent) * BANDS).cast("int"))
    # the smallest id of a region is its first pivot, and regions with the same pivot become one
    pivots = sized.groupBy("h").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("h", "pivot")
    regions = stored(sized.join(pivots, "h").select(F.xxhash64("pivot").alias("h"), "id", "n", "pivot").distinct(), "first")
    dropped(members)

    # it meets all members
    pairs = regions.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    measured = _measured(docs, pairs, own, id_col, text_col)
    links = stored(links.union(measured.where(_linked(percent)).select("a", "b")), "links")
    found = components(links)

    # what is left: regions whose members are in more than one component, without their pivots. The distance to the
    # pivot divides them once more: where it leaves a gap wider than the radius, no link spans it
    away = measured.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d"))
    met = stored(regions.where("id <> pivot").join(away, ["id", "pivot"]).select("h", "id", "n", "d"), "met")
    rest = _apart(met, F.floor(F.col("d") * (100 * BANDS / (100 - percent))).cast("int")).select("h", "id", "n", "d", F.lit(PIVOTS).alias("m"))
    step = 0
    while True:
        step += 1
        rest = _dropped_single(rest, found)
        if not rest.limit(1).count():
            break
        more = _measured(docs, _pairs(rest.where(F.col("size") <= LEAF), percent).join(measured, ["a", "b"], "left_anti"), own, id_col, text_col)
        new = more.where(_linked(percent)).select("a", "b")
        some, fits = rest.where(F.col("size") > LEAF), (F.col("size") <= cell) & (F.col("weight") <= WEIGHT)
        if some.where(fits).limit(1).count():
            new = new.union(_within(some.where(fits), docs, own, id_col, text_col, percent))
        large = some.where(~fits)
        if large.limit(1).count():
            rest, more = _divided(large, measured, docs, own, id_col, text_col, percent, step)
            measured = measured.unionByName(more)
            new = new.union(more.where(_linked(percent)).select("a", "b"))
        else:
            rest = None
        if new.limit(1).count():
            links = stored(links.union(new), "links")
            found = components(links)
        if rest is None:
            break
    return (
        described.join(found, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. All columns stay; so do rows with a null id.

    Rows that a filter of fixed size finds to be no others' copies are not shuffled.
    """
    others = stored(jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    bits = filter_of(others, F.xxhash64("doc_id"))
    return possible(docs, "doc_id", bits, want=False).union(possible(docs, "doc_id", bits).join(others, "doc_id", "left_anti").select(docs.columns))
