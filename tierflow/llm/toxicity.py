"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over block-max indexes.

The examples stand in an inverted index of all their terms and in blocks of alike
ones. The commonest terms, which have most of all postings, are kept by block: a dense
tile of the block's values and, for each term, the largest of them. Queries come in
batches. A query adds up the postings of its other terms; the maxima tell how much the
common terms can add in each block. Its most promising blocks are completed with their
tiles and give a floor, and only blocks whose bound reaches the floor are completed
too, so the neighbours are exact.

Labelled documents with equal bags of terms are one example that has all their labels.
Neighbours vote by their distance, votes are calibrated on the examples themselves,
each document without its own label, and the neighbours are returned as evidence.

Weights are TF-IDF, raised for terms that go with the label: by ``1 + boost * phi ** 2``, with
phi the association of term and label over the examples. Every term keeps at least
its TF-IDF weight. Without the raise the few words that matter drown in the others.
The raise is one of ``BOOSTS`` (0 is plain TF-IDF): the one that orders best, in both halves of the
examples, the labels of one half by neighbours and associations of the other half.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, released, slices
from tierflow.shared import stored

#: Labelled examples of each class at most; those with the smallest hash of their id.
EXAMPLES = 2000
#: Neighbours that vote, and what is added to a neighbour's squared distance before its vote is divided by it.
NEIGHBOURS, NEAR = 15, 0.1
#: Raises of the weight of a term that goes with the label entirely, from which the examples choose.
BOOSTS = (0.0, 20.0, 200.0)
#: Examples of a block; a term is common in more than one example of ``COMMON``, and so are ``TILE`` terms at most.
BLOCK, COMMON, TILE = 64, 32, 512
#: Queries of a batch.
QUERIES = 128
#: Documents with this score or more count as toxic.
TOXIC = 0.7
_SPACES = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def terms_of(text: str | None) -> Counter:
    """Lower-cased words; ASCII signs and digits separate them."""
    return Counter(text.lower().encode("utf-8").translate(_SPACES).split()) if text else Counter()


def hashes_of(terms: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of terms. Arrays of them take a fraction of the terms' own memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64)


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the place that each had."""
    order = np.argsort(hashes)
    return hashes[order], order


def _places(known: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Places of hashes among the known ones, -1 for others."""
    if not len(known[0]):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
    return np.where(known[0][at] == hashes, known[1][at], -1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    size = end - begin
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(begin - before, size)


def association(ones: np.ndarray, zeros: np.ndarray, n_ones: int, n_zeros: int) -> np.ndarray:
    """Squared phi coefficient of each term and the label, with Yates' correction; 0 if there is one class only.

    The correction leaves almost nothing to a term of one or two examples, so
    that examples are not drawn together by rare words they have by chance.
    """
    if not n_ones or not n_zeros:
        return np.zeros(len(ones))
    both, n = ones + zeros, n_ones + n_zeros
    apart = np.maximum(0.0, np.abs(ones * float(n_zeros) - zeros * float(n_ones)) - n / 2)
    return apart * apart / (np.maximum(both, 1) * np.maximum(n - both, 1) * float(n_ones) * n_zeros)


class Index:
    """Block-max inverted index of the examples.

    ``terms``, the distinct terms' 64-bit hashes, are numbered by their place, ``number`` and ``count`` list the terms of
    all examples, one example after the other with ``sizes`` terms each; ``ones`` and
    ``zeros`` are how many labels of each kind an example has.
    """

    def __init__(self, terms: np.ndarray, weight: np.ndarray, number: np.ndarray, count: np.ndarray, sizes: np.ndarray, ones: np.ndarray, zeros: np.ndarray, ids: pa.Array, class_weights: tuple[float, float]):
        self.known, self.weight = _sorted(terms), weight
        n = len(sizes)
        of = np.repeat(np.arange(n), sizes)
        value = (1 + np.log(np.maximum(count, 1))) * weight[number]
        value /= np.sqrt(np.bincount(of, value * value, n))[of]
        # alike examples side by side: same label, same commonest term, about as many terms
        by_count = np.lexsort((number, -count, of))
        some = np.minimum(np.cumsum(sizes) - sizes, max(0, len(number) - 1))
        commonest = number[by_count[some]] if len(number) else np.zeros(n)
        order = np.lexsort((np.arange(n), sizes, commonest, ones > zeros))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = ids.take(pa.array(order)), (ones > zeros)[order].astype(np.int32)
        self.ones, self.zeros, self.class_weights = ones[order], zeros[order], class_weights
        #: Rank of each place by id, for ties.
        self.rank = order
        # postings by term and place
        where = place[of]
        posting = np.lexsort((where, number))
        self.where, self.value = where[posting].astype(np.int32), value[posting]
        self.cuts = np.searchsorted(number[posting], np.arange(len(terms) + 1))
        self.blocks = max(1, -(-n // BLOCK))
        # the common terms, which stand in tiles
        often = np.diff(self.cuts)
        common = np.argsort(-often, kind="stable")[:TILE]
        common = np.sort(common[often[common] * COMMON > n])
        self.column = np.full(len(terms), -1)
        self.column[common] = np.arange(len(common))
        self.tiles: np.ndarray | None = None
        self.curve: tuple[list[float], list[float]] = ([0.0, 1.0], [0.0, 1.0])
        self.alone = 0.5

    def __getstate__(self) -> dict:
        """Without the tiles, which are large and made again where they are needed."""
        return self.__dict__ | {"tiles": None, "most": None}

    def _build_tiles(self) -> None:
        """Tiles of the common terms' values, and their maxima."""
        common = np.flatnonzero(self.column >= 0)
        self.tiles = np.zeros((self.blocks * BLOCK, len(common)))
        for k, t in enumerate(common.tolist()):
            part = slice(self.cuts[t], self.cuts[t + 1])
            self.tiles[self.where[part], k] = self.value[part]
        self.tiles = self.tiles.reshape(self.blocks, BLOCK, len(common))
        self.most = self.tiles.max(1)

    def weighed(self, terms: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms in order, and their weights with length 1."""
        at = _places(self.known, hashes_of(terms))
        order = np.argsort(at)[int((at < 0).sum()) :]
        at = at[order]
        values = (1 + np.log(np.array(list(terms.values()), np.float64)[order])) * self.weight[at]
        return at, values / np.sqrt((values * values).sum()) if len(at) else values

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and cosines of the k nearest examples with a cosine over 0; ties go to the smaller id."""
        n = len(self.rank)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if self.tiles is None:
            self._build_tiles()
        scores, asked = np.zeros((len(queries), self.blocks * BLOCK)), np.zeros((len(queries), self.most.shape[1]))
        for q, (terms, values) in enumerate(queries):
            column = self.column[terms]
            asked[q, column[column >= 0]] = values[column >= 0]
            terms, values = terms[column < 0], values[column < 0]
            begin, end = self.cuts[terms], self.cuts[terms + 1]
            posting = _ranges(begin, end)
            scores[q] = np.bincount(self.where[posting], self.value[posting] * np.repeat(values, end - begin), scores.shape[1])
        # no cosine in a block is larger than this
        bound = (scores.reshape(len(queries), self.blocks, BLOCK).max(2) + asked @ self.most.T) * (1 + 1e-9)
        few = min(self.blocks, -(-k // BLOCK) + 1)
        live = bound >= np.partition(bound, self.blocks - few, 1)[:, self.blocks - few, None]
        done = np.zeros(bound.shape, bool)
        for _ in range(2):
            for b in np.flatnonzero(live.any(0)):
                some = np.flatnonzero(live[:, b])
                scores[some, b * BLOCK : (b + 1) * BLOCK] += asked[some] @ self.tiles[b].T
            done |= live
            sure = np.where(np.repeat(done, BLOCK, 1), scores, 0)
            floor = np.partition(sure, sure.shape[1] - k, 1)[:, sure.shape[1] - k]
            live = ~done & (bound > 0) & (bound >= floor[:, None])
        out = []
        for row, least in zip(sure[:, :n], floor):
            at = np.flatnonzero((row >= least) & (row > 0))
            at = at[np.lexsort((self.rank[at], -row[at]))[:k]]
            out.append((at, row[at]))
        return out

    def vote(self, at: np.ndarray, similarity: np.ndarray, own: tuple[int, int] | None = None) -> float:
        """Share of the label 1 in the votes, each divided by the squared distance of the unit vectors and weighed by class; NaN without voters.

        ``own`` (place, label) is a label that does not count: that of the document itself when votes are calibrated.
        """
        ones, zeros = self.ones[at] * self.class_weights[1], self.zeros[at] * self.class_weights[0]
        if own:
            less = (ones, zeros)[own[1] == 0]
            less[at == own[0]] -= self.class_weights[own[1]]
        near = 1 / (NEAR + 2 - 2 * similarity)
        total = (near * (ones + zeros)).sum()
        return float((near * ones).sum() / total) if total > 0 else float("nan")

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Fit the curve from votes (NaN: no neighbour) to probabilities: rates of label 1 made monotone by pooling neighbours."""
        lone = np.isnan(votes)
        alone = [1.0 + float(weights[lone & (labels == k)].sum()) for k in (0, 1)]
        self.alone = alone[1] / sum(alone)
        values, at = np.unique(votes[~lone], return_inverse=True)
        weight, one = (np.bincount(at, w[~lone], len(values)) for w in (weights, weights * labels))
        pooled: list[list[float]] = []  # sum of vote * weight, weight, weight of label 1
        for row in zip((values * weight).tolist(), weight.tolist(), one.tolist()):
            pooled.append(list(row))
            while len(pooled) > 1 and pooled[-2][2] / pooled[-2][1] >= pooled[-1][2] / pooled[-1][1]:
                last = pooled.pop()
                pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
        if pooled:
            self.curve = ([p[0] / p[1] for p in pooled], [(p[2] + 0.01) / (p[1] + 0.02) for p in pooled])

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Probability of label 1 of each text with the neighbours it rests on."""
        for first in range(0, len(texts), QUERIES):
            for at, similarity in self.nearest([self.weighed(terms_of(text)) for text in texts[first : first + QUERIES]]):
                vote = self.vote(at, similarity)
                yield self.alone if np.isnan(vote) else float(np.interp(vote, *self.curve)), at, similarity


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, boosts: tuple[float, ...] = BOOSTS) -> Index:
    """Index and calibration from ``labels`` (doc_id, toxic) of ``docs``.

    At most ``examples`` documents of each class are taken; the classes' votes are
    weighted by how many labels each has, and document frequencies are counted
    over all documents. Null labels are left out; of several labels of a document
    the largest counts, of several texts the first in order. Without labels every score is 0.5.
    """
    bounded(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(examples).union(known.where("toxic = 0").orderBy(*order).limit(examples))
    # the texts of at most twice ``examples`` ids
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(terms_of(text).items()) for text in batch.column(1).to_pylist()]
            bags = [xxhash.xxh3_128_digest(b"\n".join(b"%b %d" % item for item in own)) for own in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(bags, pa.binary()), pa.array([[t for t, _ in own] for own in found], pa.list_(pa.binary())), pa.array([[n for _, n in own] for own in found], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "bag", "terms", "counts"],
            )

    one = F.min_by(F.struct("terms", "counts"), "doc_id")
    bags = rows.mapInArrow(count, f"doc_id {kind}, toxic int, bag binary, terms array<binary>, counts array<long>").groupBy("bag")
    bags = bags.agg(F.min("doc_id").alias("doc_id"), F.sum("toxic").alias("ones"), (F.count("*") - F.sum("toxic")).alias("zeros"), one.alias("one"))
    every = stored(bags.select("doc_id", F.pmod(F.xxhash64("bag"), F.lit(2)).alias("half"), "ones", "zeros", "one.terms", "one.counts"), "examples")
    # the examples' terms come as Arrow columns; their number is bounded by ``examples``
    picked = every.toArrow().sort_by("doc_id").combine_chunks()
    ones, zeros, half = (picked.column(c).to_numpy() for c in ("ones", "zeros", "half"))
    sizes = pc.list_value_length(picked.column("terms")).to_numpy().astype(np.int64)
    flat = pa.chunked_array([c.flatten() for c in picked.column("terms").chunks], pa.binary()).combine_chunks().dictionary_encode()
    terms, number = hashes_of(flat.dictionary.to_pylist()), flat.indices.to_numpy().astype(np.int64)
    count_of = pa.chunked_array([c.flatten() for c in picked.column("counts").chunks], pa.int64()).to_numpy()
    df, total = _document_frequencies(docs, terms)
    idf = np.log((1 + total) / (1 + df)) + 1
    weights = tuple(max(1.0, totals.get(k, 0) / examples) for k in (0, 1))
    ids_of = picked.column("doc_id").combine_chunks()
    ids_of = ids_of if isinstance(ids_of, pa.Array) else ids_of.chunk(0)
    del picked, flat

    def index_of(some: np.ndarray, boost: float) -> Index:
        """The index of the examples that are marked in ``some``."""
        own = np.repeat(some, sizes)
        with_one, with_zero = (np.bincount(number[own], np.repeat(n[some], sizes[some]), len(terms)) for n in (ones, zeros))
        tell = association(with_one, with_zero, int(ones[some].sum()), int(zeros[some].sum()))
        return Index(terms, idf * (1 + boost * tell), number[own], count_of[own], sizes[some], ones[some], zeros[some], ids_of.filter(pa.array(some)), weights)

    def order_of(boost: float) -> float:
        """How well the halves tell each other's labels."""
        found = []
        for k in (0, 1):
            index = index_of(half == k, boost)
            votes, labels, n = _votes(every.where(F.col("half") == 1 - k), index, kind)
            found.append(ordered_share(np.where(np.isnan(votes), 0.5, votes), labels, n))
        return float(np.mean(found))

    boost = boosts[0] if len(boosts) == 1 or not len(ones) else max(boosts, key=lambda b: (round(order_of(b), 4), -b))
    index = index_of(np.ones(len(ones), bool), boost)
    if len(ones):
        index.calibrate(*_votes(every, index, kind))
    return index


def ordered_share(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Share of the pairs of a label 1 and a label 0 in which the one has the higher vote; equal votes count half."""
    values, at = np.unique(votes, return_inverse=True)
    ones, zeros = (np.bincount(at, np.where(labels == k, weights, 0), len(values)) for k in (1, 0))
    both = ones.sum() * zeros.sum()
    return float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / both) if both else 0.5


def _document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are; a row for each term and one come back."""
    wanted = docs.sparkSession.sparkContext.broadcast(_sorted(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = wanted.value, 0
        found = np.zeros(len(known[0]), np.int64)
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            n += len(texts)
            at = _places(known, hashes_of(t for text in texts if text for t in set(text.lower().encode("utf-8").translate(_SPACES).split())))
            found += np.bincount(at[at >= 0], minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some]).astype(np.int32)), pa.array(np.concatenate([[n], found[some]]).astype(np.int64))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    wanted.destroy()
    at, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def _votes(every: DataFrame, index: Index, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes on the examples in ``every`` (NaN: no voter), a label of each kind at a time without itself: vote, label and weight."""
    shared = every.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {doc: k for k, doc in enumerate(own.ids.to_pylist())}
        for batch in slices(batches, rows=QUERIES):
            docs, ones, zeros, terms, counts = (c.to_pylist() for c in batch.columns)
            near = own.nearest([own.weighed(Counter(dict(zip(*one)))) for one in zip(terms, counts)], NEIGHBOURS + 1)
            out = []
            for doc, n_one, n_zero, (at, similarity) in zip(docs, ones, zeros, near):
                here = place.get(doc, -1)
                alone = (at == here) & (n_one + n_zero == 1)
                at, similarity = at[~alone][:NEIGHBOURS], similarity[~alone][:NEIGHBOURS]
                out += [(own.vote(at, similarity, (here, k)), k, n * own.class_weights[k]) for k, n in ((0, n_zero), (1, n_one)) if n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.float64(), pa.int32(), pa.float64()))], names=["vote", "label", "weight"])
        released()

    rows = every.select("doc_id", "ones", "zeros", "terms", "counts").mapInArrow(run, "vote double, label int, weight double").toArrow()
    shared.destroy()
    return tuple(rows.column(c).to_numpy() for c in ("vote", "label", "weight"))


def score_documents(docs: DataFrame, index: Index, evidence: bool = True) -> DataFrame:
    """``doc_id, score, predicted`` and, with ``evidence``, the neighbours: array of doc_id, similarity, toxic.

    Null and empty texts, and texts with none of the index's terms, have no
    neighbours and get the rate of label 1 among such examples. Repeated rows give
    repeated rows; only doc_id and text are read; ids of any type will do. The index
    that is broadcast is bounded by the number of examples and their terms.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = list(own.score(batch.column(1).to_pylist()))
            scores = np.array([f[0] for f in found])
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= TOXIC).astype(np.int32))]
            if evidence:
                at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                similar = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
                parts = [own.ids.take(pa.array(at)), pa.array(similar), pa.array(own.labels[at].astype(np.int32))]
                ends = np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["doc_id", "similarity", "toxic"])))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "evidence"][: len(columns)])

    return picked.mapInArrow(run, f"doc_id {kind}, score double, predicted int" + f", evidence array<struct<doc_id:{kind},similarity:double,toxic:int>>" * evidence)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third: crc32 of the id, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def without_toxic(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` without the rows whose text scores ``TOXIC`` or more; all columns stay."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score < TOXIC for score, _, _ in shared.value.score(texts)], pa.bool_()))
        released()

    return docs.mapInArrow(run, docs.schema)
