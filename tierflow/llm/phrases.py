"""Collocations: frequent phrases by hash pruning (PCY, DHP) and Apriori, scored by their cuts.

One pass over the texts for each length of phrase. A pass counts its candidates exactly
and, at the same time, counts all runs that are one word longer in hash buckets. Bucket
counts become a bitmap of the buckets that reach the least count. The frequent phrases of
the pass become a bitmap as well, and the next pass counts a run only if both its parts
without an end word are in the one and its bucket is in the other. Bitmaps have false
hits but no misses, so the exact counts that follow decide alone.

The number of buckets follows the texts' bytes up to a bound, so the bitmaps that are
broadcast stay small (8 MB); beyond it buckets fill and prune less, but results do not change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, slices
from tierflow.llm.words import mixed, run_hashes
from tierflow.shared import dropped, stored

#: Powers of two between which the number of buckets lies; a bucket counts to 255.
FEWEST, MOST, FULL = 16, 26, 255
#: Rows in which a task sends its buckets.
PARTS = 256
#: Different words and counted runs that a task holds at most before it sends counts on.
WORDS, PENDING = 1 << 20, 1 << 22
#: Parts of a language that rank their best phrases before the language does.
HEATS = 64
#: What separates pieces, and what words: A-Z are lower-cased, signs and line breaks become a byte that no text has (fixed values).
_CUT = b"\xff"
_SIGNS = bytes(255 if k in b".,;:!?\n\x0b\x0c\r" else k + 32 if 65 <= k <= 90 else k for k in range(256))
_COUNTED = "lang string, phrase string, n long, part int, buckets binary"


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a text, with ``_CUT`` between pieces; none for null."""
    return (text or b"").translate(_SIGNS).replace(_CUT, b" \xff ").split()


class _Words(dict):
    """Numbers of one language's words; 0 is the border of a piece."""

    def __init__(self, lang: str, own: Vocabulary):
        super().__init__({_CUT: 0})
        self.prefix, self.lang, self.own = lang.encode("utf-8") + _CUT, lang, own

    def __missing__(self, word: bytes) -> int:
        own = self.own
        self[word] = number = len(own.words)
        own.words.append(word)
        own.langs.append(self.lang)
        own.new.append(xxhash.xxh64_intdigest(self.prefix + word))
        return number


class Vocabulary:
    """Words that a task has met, of all languages, with their hashes."""

    def __init__(self):
        self.words: list[bytes] = [b""]
        self.langs: list[str | None] = [None]
        self.new: list[int] = [0]
        self.hashes = np.zeros(0, np.uint64)
        self.of: dict[str, _Words] = {}

    def numbers(self, texts: list[bytes | None], langs: list[str]) -> np.ndarray:
        """Word numbers of texts, one after the other, 0 between pieces and texts."""
        every: list[int] = []
        for text, lang in zip(texts, langs):
            own = self.of.get(lang) or self.of.setdefault(lang, _Words(lang, self))
            every += map(own.__getitem__, tokens_of(text))
            every.append(0)
        return np.array(every, np.int64)

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array(self.new, np.uint64)])
            self.new = []
        return self.hashes[numbers]

    def rows(self, runs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Counts of runs (a row of word numbers each)."""
        phrases = [b" ".join([self.words[k] for k in run]) for run in runs.tolist()]
        langs = [self.langs[k] for k in runs[:, 0].tolist()]
        return _counted(pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)))


def _counted(langs: pa.Array, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, phrases, n, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "n", "part", "buckets"])


def _added(counts: np.ndarray, buckets: np.ndarray) -> None:
    some, n = np.unique(buckets, return_counts=True)
    counts[some] = np.minimum(counts[some] + n, FULL)


def _sent(counts: np.ndarray) -> pa.RecordBatch:
    """Bucket counts in parts; empty parts are left out."""
    parts = counts.reshape(PARTS, -1)
    some = np.flatnonzero(parts.any(1))
    nothing = [pa.nulls(len(some), t) for t in (pa.string(), pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())], names=["lang", "phrase", "n", "part", "buckets"])


def bitmap(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each of ``2 ** bits`` buckets: whether its count is ``least`` or more (or ``FULL``, if that is less). At most 8 MB come to the driver."""
    size = (1 << bits) // PARTS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint16)
        for batch in batches:
            for own in batch.column(1).to_pylist():
                total = np.minimum(total + np.frombuffer(zlib.decompress(own), np.uint8), FULL).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= min(least, FULL), bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((PARTS, size // 8), np.uint8)
    for row in rows.where("part is not null").select("part", "buckets").groupBy("part").applyInArrow(add, "part int, bits binary").collect():  # PARTS rows of fixed size
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _in(marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return ((marks[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1).astype(bool)


def count_runs(texts: DataFrame, n: int, bits: int, known: tuple[np.ndarray, np.ndarray] | None, longer: bool) -> DataFrame:
    """Task-wise counts of the candidates of ``n`` words in ``texts`` (lang, text) and, with ``longer``, of the buckets of runs of one word more.

    ``known`` are the bitmaps of frequent phrases of one word less and of the buckets of
    ``n`` words; all words are candidates for the first pass. A run one word longer goes
    into a bucket only if both its parts are candidates.
    """
    shift = np.uint64(64 - bits)
    shared = texts.sparkSession.sparkContext.broadcast(known)
    most_words, most_pending = WORDS, PENDING
    bucket = lambda hashes, size: (run_hashes(hashes, size) >> shift).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Vocabulary(), np.zeros(1 << bits, np.uint8)
        pending, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(pending)
            every = every[np.lexsort(every.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(1)]))
            times = np.diff(np.concatenate([first, [len(every)]]))
            for at in range(0, len(first), 1 << 16):
                yield own.rows(every[first[at : at + (1 << 16)]], times[at : at + (1 << 16)])

        for batch in slices(batches):
            ids = own.numbers(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            hashes, inside = own.hashed(ids), ids > 0
            m = len(ids) - n + 1
            if m <= 0:
                continue
            candidate = reduce(lambda a, b: a & b, [inside[k : k + m] for k in range(n)])
            if shared.value is not None:
                frequent, buckets = shared.value
                parts = _in(frequent, bucket(hashes, n - 1))
                candidate = candidate & parts[:m] & parts[1 : m + 1]
                at = np.flatnonzero(candidate)
                candidate[at] = _in(buckets, bucket(hashes, n)[at])
            at = np.flatnonzero(candidate)
            if len(at):
                pending.append(np.stack([ids[at + k] for k in range(n)], 1).astype(np.int32))
                size += len(at)
            if longer:
                both = candidate[:-1] & candidate[1:]
                _added(counts, bucket(hashes, n + 1)[both])
            if size >= most_pending or len(own.words) >= most_words:
                if pending:
                    yield from flush()
                pending, size = [], 0
                if len(own.words) >= most_words:
                    own = Vocabulary()
        if pending:
            yield from flush()
        if longer:
            yield _sent(counts)

    return texts.mapInArrow(run, _COUNTED)


def _marked(frequent: DataFrame, n: int, bits: int) -> DataFrame:
    """Buckets of frequent phrases of ``n`` words."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            words = [xxhash.xxh64_intdigest(lang + _CUT + word) for lang, phrase in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns)) for word in phrase.split(b" ")]
            columns = np.array(words, np.uint64).reshape(-1, n)
            hashes = np.zeros(len(columns), np.uint64)
            for k in range(n):
                hashes = mixed(hashes + columns[:, k])
            counts[(hashes >> shift).astype(np.int64)] = 1
        yield _sent(counts)

    return frequent.select("lang", "phrase").mapInArrow(run, _COUNTED)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all phrases of up to ``longest`` words that occur ``least`` times or more in a language, and ``lang, n``, the words of each.

    Null texts have no words; a null language is ``und``. Repeated rows count each time.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST, max(FEWEST, int(size // 8).bit_length()))
    found, known = [], None
    for n in range(1, longest + 1):
        raw = stored(count_runs(texts, n, bits, known, n < longest), "runs")
        counts = raw.where("part is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        frequent = stored(counts.where(F.col("f") >= least).select("lang", F.lit(n).alias("words"), "phrase", "f"), "frequent")
        if n == 1:
            totals = stored(raw.where("part is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        if n < longest:
            known = bitmap(_marked(frequent, n, bits), bits, 1), bitmap(raw, bits, least)
        found.append(frequent)
        dropped(raw)
    return reduce(DataFrame.union, found), totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``longest`` words of each language of ``docs`` (lang, text).

    ``a`` is how often a phrase occurs; cut after its first words, ``l`` and ``r`` are
    its parts' counts and ``floor(1000000 * a * a / (l * r))`` the score of the cut, of
    which the lowest counts, the first one if some are equal. A phrase is left out
    if a longer candidate that holds it has ``covered`` of a hundred of its
    occurrences. Scores are exact: their products are decimals of 38 digits.
    """
    every, totals = frequent_phrases(docs, longest, least)
    words = F.split("phrase", " ")
    candidates = every.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right"))
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    holds = candidates.where("words > 2").select("lang", "a", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(holds, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    heat = kept.withColumn("heat", F.pmod(F.xxhash64("phrase"), F.lit(HEATS)))
    heat = heat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "heat").orderBy(*best))).where(F.col("rank") <= top)
    # at most HEATS times ``top`` rows of a language are left
    ranked = heat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
