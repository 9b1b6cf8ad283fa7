"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of words are gathered over the whole training part,
quantised to logarithmic classes and put into Bloom filters: an n-gram of class q
is inserted with 1, 2 .. q. A reader probes 1, 2 .. until a probe fails, and so
learns the class. Probabilities mix the pair's and the word's:

    P(w | v) = m * c(v w) / c(v) + (1 - m) * (c(w) + 1) / (N + V + 1)

with m chosen for each range of c(v) so that training texts, each scored as if it
were not counted, are most likely.

Filters have as many bits as all n-grams need; none is left out. That of the pairs
is cut into parts of bounded size, which are broadcast and probed one after another:
a pair is in one part, and what the parts say of a text is added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, slices
from tierflow.llm.words import mixed, word_hashes, words_of
from tierflow.shared import stored

#: Bytes of a part of the pairs' filter: what every worker gets at once, whatever the corpus.
FILTER_BYTES = 1 << 26
#: Bits for each insertion, and bits that an insertion sets.
BITS_EACH, PROBES = 8, 4
#: Base of the classes.
BASE = 1.5
#: Tokens that are more than one in this many are counted exactly on every worker; there can be no more of them than this.
FREQUENT = 4096
#: Upper ends of the ranges of c(v), and the values that m may take.
RANGES = np.array([0.5, 9.5, 99.5, 999.5, 9999.5])
MIXES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_FLUSH = 1_000_000
_END = np.uint64(xxhash.xxh64_intdigest(b" end"))
_START = np.uint64(xxhash.xxh64_intdigest(b" start"))
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _classes(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and the end."""
    return np.append(word_hashes(words_of(text)), _END)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[_START], tokens[:-1]])
    return mixed(before * _PAIR + tokens)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _cuts(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment begins in sorted keys; a segment is a range of hashes."""
    width = (1 << 64) // segments + 1
    return np.append(np.searchsorted(keys, np.array([k * width for k in range(segments)], np.uint64), "left"), len(keys))


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys // np.uint64((1 << 64) // segments + 1)).astype(np.int64)


def _counted(docs: DataFrame, segments: int) -> DataFrame:
    """``segment, words, word_counts, pairs, pair_counts`` with sorted 64-bit hashes and counts, as bytes.

    Tasks add up what they read and ship one run for each segment and flush; a
    segment holds an equal share of all hashes, and a frequent n-gram is one entry
    of a run.
    """
    names, schema = ["segment", "words", "word_counts", "pairs", "pair_counts"], "segment int, words binary, word_counts binary, pairs binary, pair_counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> pa.RecordBatch:
            columns: list[list] = [list(range(segments))]
            for keys in held:
                keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
                cut = _cuts(keys, segments)
                columns.append([keys[a:b].tobytes() for a, b in zip(cut, cut[1:])])
                counts = counts.astype("<u4")
                columns.append([counts[a:b].tobytes() for a, b in zip(cut, cut[1:])])
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

        size = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                tokens = _tokens(text)
                held[0].append(tokens)
                held[1].append(_pairs(tokens))
                size += len(tokens)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for k, kind in enumerate(["<u8", "<u4", "<u8", "<u4"]):
                runs[k] += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(k + 1)]
        out: list = []
        for k in (0, 2):
            keys, counts = _summed(np.concatenate(runs[k]), np.concatenate(runs[k + 1]).astype(np.int64))
            out += [keys.tobytes(), counts.astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in out)], names=names)

    return docs.select("text").mapInArrow(count, schema).groupBy("segment").applyInArrow(add, schema)


def _described(counts: DataFrame, segments: int) -> tuple[int, int, dict[tuple[int, int], tuple[int, int]]]:
    """Tokens, distinct tokens, and for each order and class how many n-grams there are and the sum of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for k in (2, 4):
                for value in batch.column(k):
                    found = np.frombuffer(value.as_buffer(), "<i8")
                    kinds = _classes(found)
                    n, total = np.bincount(kinds), np.bincount(kinds, weights=found)
                    rows += [(k // 2, q, int(n[q]), int(total[q])) for q in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], [], []))], names=["n", "q", "entries", "total"])

    found = counts.mapInArrow(run, "n long, q long, entries long, total long").groupBy("n", "q").agg(F.sum("entries").alias("entries"), F.sum("total").alias("total")).collect()  # a row for each class
    table = {(r.n, r.q): (r.entries, r.total) for r in found}
    return sum(t for (n, _), (_, t) in table.items() if n == 1), sum(e for (n, _), (e, _) in table.items() if n == 1), table


class Model:
    """The filters with what is needed to turn classes into probabilities.

    ``bits`` has for each order a row of bytes for each segment from ``first`` on; the
    words' are all there, the pairs' are one part.
    """

    def __init__(self, segments: int, bits: dict[int, np.ndarray], first: dict[int, int], tokens: int, distinct: int, means: dict[int, np.ndarray], frequent: tuple[np.ndarray, np.ndarray], texts: int):
        self.segments, self.bits, self.first, self.tokens, self.distinct, self.means, self.texts = segments, bits, first, tokens, distinct, means, texts
        self.frequent, self.frequent_counts = frequent

    def here(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Whether each n-gram belongs to a segment that is there."""
        at = _segment_of(keys, self.segments) - self.first[order]
        return (at >= 0) & (at < len(self.bits[order]))

    def classes(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Class of each n-gram by repeated probes, 0 if it is not in the filter."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        left, bits = np.arange(len(keys)), self.bits[order]
        base = _segment_of(keys, self.segments) - self.first[order]
        for q in range(1, len(self.means[order])):
            hit = np.ones(len(left), bool)
            for at in _places(keys[left], q, order, bits.shape[1] * 8):
                hit &= (bits[base[left], at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
            left = left[hit]
            if not len(left):
                break
            out[left] = q
        return out[back]

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the frequent tokens, -1 for others."""
        if not len(self.frequent):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.frequent_counts[at], -1)

    def parts(self, tokens: np.ndarray, pairs: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which pairs are there, and for those the counts of the word, of the word before it and of both, as the model knows them."""
        word = np.where(exact >= 0, exact, self.means[1][self.classes(tokens, 1)]).astype(np.float64)
        before = np.concatenate([[0.0], word[:-1]])
        before[starts] = self.texts
        here = np.flatnonzero(self.here(pairs, 2))
        return here, word[here], before[here], self.means[2][self.classes(pairs[here], 2)]

    def mixtures(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P for each mix, and the range of the word before."""
        single = (word + 1) / (self.tokens + self.distinct + 1)
        double = np.minimum(1.0, pair / np.maximum(before, 1))
        return np.log10(np.outer(double, MIXES) + np.outer(single, 1 - MIXES)), np.searchsorted(RANGES, before)


def _places(keys: np.ndarray, q: int, order: int, size: int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, q) in a segment of ``size`` bits."""
    base = mixed(keys + np.uint64((q * 4 + order) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = mixed(base) | np.uint64(1)
    for k in range(PROBES):
        yield ((base + np.uint64(k) * step) >> np.uint64(16)) % np.uint64(size)


def fit(docs: DataFrame) -> tuple[list[Callable[[], Model]], DataFrame]:
    """The model of all texts of ``docs``, once for each part of the pairs' filter, and the written table of exact word counts by segment.

    Models are made when they are asked for, so that one part at a time is in the driver's memory.
    """
    spark = docs.sparkSession
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(_counted(docs, segments), "ngrams")
    tokens, distinct, table = _described(counts, segments)
    limit = tokens // FREQUENT
    size = {n: 8 + sum(entries * q for (m, q), (entries, _) in table.items() if m == n) * BITS_EACH // 8 // segments for n in (1, 2)}
    step = max(1, FILTER_BYTES // size[2])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, *values in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                for order, (keys, found) in ((1, values[:2]), (2, values[2:])):
                    bits = np.zeros(size[order] * 8, bool)
                    keys, found = np.frombuffer(keys, "<u8"), np.frombuffer(found, "<i8")
                    kinds = _classes(found)
                    if order == 1:
                        rows += [(segment, 0, None, int(k), int(c)) for k, c in zip(keys[found > limit].view(np.int64), found[found > limit])]
                    for q in range(1, int(kinds.max(initial=0)) + 1):
                        keys, kinds = keys[kinds >= q], kinds[kinds >= q]
                        for at in _places(keys, q, order, size[order] * 8):
                            bits[at.astype(np.int64)] = True
                    rows.append((segment, order, np.packbits(bits, bitorder="little").tobytes(), None, None))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["segment", "kind", "bits", "word", "n"])

    filters = stored(counts.mapInArrow(build, "segment int, kind int, bits binary, word long, n long"), "filters")

    def bits_of(order: int, first: int, last: int) -> np.ndarray:
        """Rows of bits of these segments; those without n-grams have none set."""
        out = np.zeros((last - first, size[order]), np.uint8)
        for row in filters.where((F.col("kind") == order) & F.col("segment").between(first, last - 1)).select("segment", "bits").toLocalIterator():
            out[row.segment - first] = np.frombuffer(row.bits, np.uint8)
        return out

    frequent = filters.where("kind = 0").select("word", "n").collect()  # at most FREQUENT words
    words = np.array([r.word for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(words)
    often = words[order], np.array([r.n for r in frequent], np.int64)[order]
    means = {}
    for n in (1, 2):
        top = max([q for m, q in table if m == n], default=0)
        means[n] = np.array([0.0] + [table.get((n, q), (1, 0))[1] / table.get((n, q), (1, 0))[0] for q in range(1, top + 1)])
    ends, single = int(docs.count()), bits_of(1, 0, segments)

    def model(first: int) -> Model:
        bits = {1: single, 2: bits_of(2, first, min(segments, first + step))}
        return Model(segments, bits, {1: 0, 2: first}, tokens, distinct, means, often, ends)

    return [partial(model, first) for first in range(0, segments, step)], counts


def _scored(texts: DataFrame, shared: Broadcast, kinds: int, first: bool) -> DataFrame:
    """What one part of the filter says of each text (kind 0), of all texts that learn (2) and, with ``first``, postings of rare words (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, done = shared.value, TaskContext.get().partitionId() << 40, 0
        names = ["kind", "segment", "row", "doc_id", "n_tokens", "n_known", "base", "sums", "words", "rows", "times"]

        def flush(ids: list, texts: list, learning: list) -> pa.RecordBatch:
            nonlocal done
            lists = [_tokens(t) for t in texts]
            sizes = np.array([len(t) for t in lists])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            tokens, pairs = np.concatenate(lists), np.concatenate([_pairs(t) for t in lists])
            of = np.repeat(np.arange(len(ids)), sizes)
            exact = own.exact(tokens)
            here, word, before, pair = own.parts(tokens, pairs, starts, exact)
            logs, ranges = own.mixtures(word, before, pair)
            cell = of[here] * kinds + ranges
            sums = np.stack([np.bincount(cell, logs[:, m], len(ids) * kinds) for m in range(len(MIXES))], 1).reshape(len(ids), -1)
            learns = np.array(learning, bool)[of[here]]
            loo, loo_ranges = own.mixtures(*(np.maximum(x[learns] - 1, 0) for x in (word, before, pair)))
            total = np.stack([np.bincount(loo_ranges, loo[:, m], kinds) for m in range(len(MIXES))], 1).reshape(-1)
            often = exact >= 0
            base = np.bincount(of[often], np.log10(exact[often] + 1.0), len(ids))
            known = np.bincount(of[often], minlength=len(ids))
            out: list[tuple] = [(0, None, done + k, i, int(n), int(c), float(b), s, None, None, None) for k, (i, n, c, b, s) in enumerate(zip(ids, sizes, known, base, sums))]
            out.append((2, None, None, None, None, None, None, total, None, None, None))
            # postings of the rest, once: word, row, how often
            key = tokens[~often] if first else tokens[:0]
            row = of[~often] if first else of[:0]
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(begin, len(key)))
            key, row = key[begin], row[begin]
            cut = _cuts(key, own.segments)
            for s, (a, b) in enumerate(zip(cut, cut[1:])):
                if a < b:
                    out.append((1, s, done, None, None, None, None, None, key[a:b].tobytes(), row[a:b].astype("<u4").tobytes(), times[a:b].astype("<u4").tobytes()))
            done += len(ids)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            columns[2] = pa.array([None if r is None else part + r for r in columns[2].to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in slices(batches):
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for values, value in zip(held, row):
                    values.append(value)
                size += len(row[1] or "")
                if size >= 2_000_000:
                    yield flush(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield flush(*held)

    schema = "kind int, segment int, row long, doc_id long, n_tokens long, n_known long, base double, sums array<double>, words binary, rows binary, times binary"
    return texts.mapInArrow(run, schema)


def score_documents(docs: DataFrame, train: DataFrame, learn_from: str) -> DataFrame:
    """Scores of every text under the model of ``train``.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``. ``n_known`` and
    ``base_score`` (add-one word probabilities) rest on exact counts, ``score`` on the
    filter. ``learn_from`` is a condition on ``docs`` that holds for the rows of ``train``:
    those fix the mixes, scored without themselves. Null and empty texts have one
    token, the end. Repeated rows are scored each; other columns are not read. An
    empty ``train`` gives every token the same probability.

    The texts are read once for each part of the pairs' filter, and written once more
    if there are several. Frequent tokens are counted on the worker; postings of the others go to the
    segments of the exact counts, which have no hot key then.
    """
    spark = docs.sparkSession
    bounded(spark)
    models, counts = fit(train)
    kinds = len(RANGES) + 1
    texts = docs.select("doc_id", "text", F.expr(learn_from).alias("learning"))
    if len(models) > 1:  # every pass has to meet the same rows in the same tasks
        texts = stored(texts, "texts")
    passes = []
    for make in models:
        model = make()
        shared = spark.sparkContext.broadcast(model)
        passes.append(stored(_scored(texts, shared, kinds, not passes), "scored"))
        shared.destroy()
    passed, segments = passes[0], model.segments
    every = passed.where("kind in (0, 2)").select("kind", "row", "sums")
    for more in passes[1:]:
        every = every.unionByName(more.select("kind", "row", "sums"))
    totals = every.where("kind = 2").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    table = np.zeros(kinds * len(MIXES))
    for r in totals:
        table[r.k] = r.v
    best = table.reshape(kinds, -1).argmax(1)
    score = sum((F.element_at("sums", k * len(MIXES) + int(m) + 1) for k, m in enumerate(best)), F.lit(0.0))
    scores = None if len(passes) == 1 else every.where("kind = 0").select("row", score.alias("score")).groupBy("row").agg(F.sum("score").alias("score"))

    def look_up(postings: pa.Table, exact: pa.Table) -> pa.Table:
        keys, found, out = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in exact.to_batches():
            for k, c in zip(batch.column(1), batch.column(2)):
                keys, found = np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<i8")
        for batch in postings.to_batches():
            for first, words, rows, times in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                words, rows, times = np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(rows.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4")
                at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
                hit = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                rows, times, c = rows[hit].astype(np.int64), times[hit], found[at[hit]] if len(keys) else found
                n, base = np.bincount(rows, times), np.bincount(rows, times * np.log10(c + 1.0))
                some = np.flatnonzero(n)
                out.append((first, some.astype("<u4").tobytes(), n[some].astype("<u4").tobytes(), base[some].tobytes()))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["first", "rows", "n_known", "base"])

    def total(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, base = np.zeros(0), np.zeros(0)
        for batch in parts:
            for rows, known, found in zip(batch.column(1), batch.column(2), batch.column(3)):
                rows = np.frombuffer(rows.as_buffer(), "<u4").astype(np.int64)
                if len(rows) and rows[-1] >= len(n):
                    n, base = np.pad(n, (0, int(rows[-1]) + 1 - len(n))), np.pad(base, (0, int(rows[-1]) + 1 - len(base)))
                n[rows] += np.frombuffer(known.as_buffer(), "<u4")
                base[rows] += np.frombuffer(found.as_buffer(), "<f8")
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key[0].as_py() + some, pa.int64()), pa.array(n[some].astype(np.int64)), pa.array(base[some])], names=["row", "n_rare", "base_rare"])

    postings = passed.where("kind = 1").select("segment", "row", "words", "rows", "times")
    rare = postings.groupBy("segment").cogroup(counts.select("segment", "words", "word_counts").groupBy("segment")).applyInArrow(look_up, "first long, rows binary, n_known binary, base binary")
    # what the segments know of a flush's rows is added up in one place; a flush has a bounded size
    rare = rare.groupBy("first").applyInArrow(total, "row long, n_rare long, base_rare double")
    smooth = F.lit(float(np.log10(model.tokens + model.distinct + 1)))
    known = passed.where("kind = 0")
    known = known.withColumn("score", score) if scores is None else known.join(scores, "row")
    return (
        known.join(rare, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * smooth).alias("base_score"),
            "score",
        )
    )
