"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of the resulting
templates are joined by hash with those of the benchmark, and what stands in the
placeholders has to be renamed consistently. So a question with other numbers or
names is caught, and one that merely has the same frame is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import bounded, released, slices
from tierflow.llm.words import mixed
from tierflow.shared import stored

#: Tokens of a window, and how many of them have to be words.
WINDOW, WORDS = 8, 4
#: An item leaks if this share of its windows is found, or this many windows (together 13 tokens).
SHARE, ENOUGH = 0.5, 6
#: An item of fewer tokens than ``WORDS`` is reported only if at most this many documents hold it, or one in so many of all.
FEW, RARE = 3, 100
#: Numbers in words (fixed values).
NUMBERS = frozenset("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
#: Bits of the filter that drops windows which no item has. Fixed, so what is broadcast has 1 MB whatever the tables.
FILTER_BITS = 1 << 23
#: Units, in lower case (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz t ml cl l gal s sec min h hr d ms hz khz mhz ghz w kw kwh mwh v a j kj cal kcal n pa bar k c f "
    "percent degrees degree dollars dollar cents euros euro pounds pound meters metres meter metre kilometers kilometres miles feet inches "
    "grams kilograms litres liters seconds minutes hours days weeks months years usd eur gbp mph kph".split()
)
_CACHE = 120_000
_NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*[a-z%°]*")
_EDGE = "\"'()[]{}<>.,;:!?¡¿…“”‘’«»*#$%&"
_CAPITAL, _NUM, _UNIT, _END = 1, 2, 3, 4
_FLAGS = np.uint64(7)
_LITERAL = np.uint64(0x6C69746572616C)
_SLOTS = {_CAPITAL: np.uint64(8 * 0x51ED27), _NUM: np.uint64(8 * 0x2545F49), _UNIT: np.uint64(8 * 0x9E3779B)}
#: An odd factor and its inverse modulo 2 ** 64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _Codes(dict):
    """Codes of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[token] = code = _code(token)
        return code


_codes = _Codes()


def _coded(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` codes: sums of codes times powers of their place, modulo 2 ** 64, moved to the beginning."""
    while len(_powers[0]) <= len(codes):
        for k, factor in enumerate((_FACTOR, _INVERSE)):
            step = np.uint64(pow(factor, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers[0][: len(codes)], dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * _powers[1][: len(codes) - size + 1] + np.uint64(size))


def _code(token: str) -> int:
    """Hash of the token's word, with its kind and whether it ends a sentence in the last three bits."""
    word = token.strip(_EDGE)
    low = word.lower()
    if low in NUMBERS or _NUMBER.fullmatch(low):
        kind = _NUM
    elif low in UNITS:
        kind = _UNIT
    else:
        kind = _CAPITAL if word[:1].isupper() else 0
    return (xxhash.xxh64_intdigest(low.encode("utf-8")) & ~7) | kind | (_END if token[-1] in ".!?:" else 0)


def _template(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each template token, whether it is a placeholder, and whether it may be a name although it begins a sentence.

    A capital makes a name inside a sentence; at the beginning of one it may be a word or a
    name, so both readings have windows. A unit has to follow a number.
    """
    kinds = (codes & np.uint64(3)).astype(np.int8)
    ends = (codes & np.uint64(_END)) != 0
    before_end, before_num = np.concatenate([[True], ends[:-1]]), np.concatenate([[False], kinds[:-1] == _NUM])
    out = codes & ~_FLAGS
    slot = np.zeros(len(codes), bool)
    for kind, where in ((_CAPITAL, (kinds == _CAPITAL) & ~before_end), (_NUM, kinds == _NUM), (_UNIT, (kinds == _UNIT) & before_num)):
        out[where] = _SLOTS[kind]
        slot |= where
    return out, slot, (kinds == _CAPITAL) & before_end


def _windows(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size and reading: window hashes, their positions and the placeholder flags of all tokens.

    The second reading has only the windows that it makes different.
    """
    if not len(codes):
        return
    template, slot, maybe = _template(codes)
    readings = [(template, slot, None)]
    if maybe.any():
        readings.append((np.where(maybe, _SLOTS[_CAPITAL], template), slot | maybe, np.concatenate([[0], np.cumsum(maybe)])))
    for hashes, flags, other in readings:
        words = np.concatenate([[0], np.cumsum(~flags)])
        for size in sizes:
            if len(codes) >= size:
                fit = words[size:] - words[:-size] >= min(WORDS, size)
                if other is not None:
                    fit &= other[size:] > other[:-size]
                at = np.flatnonzero(fit)
                if len(at):
                    yield size, _rolled(hashes, size)[at], at, flags


def _literal_windows(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size: hashes of all windows of lower-cased tokens as they stand, whatever their kinds."""
    for size in sizes:
        if len(codes) >= size:
            yield size, _rolled((codes & ~_FLAGS) + _LITERAL, size)


def _slots(tokens: list[str], slot: np.ndarray, at: int, size: int) -> list[str]:
    return [tokens[k].strip(_EDGE).lower() for k in range(at, at + size) if slot[k]]


def _item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``window, item_id, at, n, slots, size, literal``; items of fewer tokens than a window are one window, those of fewer than ``WORDS`` a literal one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").split()
                size = min(WINDOW, len(words))
                codes = _coded(words)
                readings = list(_windows(codes, [size] if size >= WORDS else []))
                places = len({k for _, _, at, _ in readings for k in at.tolist()})
                for _, found, at, slot in readings:
                    rows += [(h, item, k, places, _slots(words, slot, k, size), size, False) for h, k in zip(found.view(np.int64).tolist(), at.tolist())]
                for _, found in _literal_windows(codes, [size] if size else []):
                    rows += [(h, item, k, len(found), [], size, True) for k, h in enumerate(found.view(np.int64).tolist())]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["window", "item_id", "at", "n", "slots", "size", "literal"])

    picked = benchmark.select(id_col, text_col).distinct()
    return picked.mapInArrow(run, f"window long, item_id {picked.schema[id_col].dataType.simpleString()}, at int, n int, slots array<string>, size int, literal boolean")


def _filter_of(windows: DataFrame) -> np.ndarray:
    """One bit for each hash of the windows, as bytes; at most ``FILTER_BITS`` / 64 rows come to the driver."""
    bit = F.col("window").bitwiseAND(FILTER_BITS - 1)
    words = windows.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(window & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words:
        bits[row.w] = row.b
    return bits.view(np.uint64)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: ``doc_id, item_id, n_found, n_windows, renamed``.

    ``n_found`` counts the item's windows in the document; windows whose placeholders
    are filled otherwise count only if the renaming between item and document is
    one-to-one over all of them or over those of one occurrence of the item in the
    document (then ``renamed`` is true). Literal windows of the lower-cased tokens, with
    no least number of words, find copies that the templates leave out: tables,
    arithmetic, titles in capitals and items of few tokens; items of fewer than ``WORDS``
    tokens only if they are rare (``FEW``, ``RARE``). Rows with the same id count as one document. Null and empty texts hold nothing, null items are in
    nothing; empty tables give no pairs; other columns are not read.

    Windows go through a filter of fixed size before they are shuffled, so only
    those that items have (and a few others) leave a task. Nothing after the join by
    hash needs its keys together, so Spark may split a window that is in many documents.
    """
    spark = docs.sparkSession
    bounded(spark)
    items = stored(_item_windows(benchmark, item_id_col, item_text_col), "items")
    every = items.select("size", "literal").distinct().collect()  # sizes up to WINDOW at most
    sizes, literal_sizes = (sorted(r.size for r in every if r.literal == kind) for kind in (False, True))
    bits = spark.sparkContext.broadcast(_filter_of(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value

        def known_of(found: np.ndarray) -> np.ndarray:
            low = found & np.uint64(FILTER_BITS - 1)
            return np.flatnonzero((known[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))

        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").split()
                codes = _coded(words)
                # positions of different texts of one id lie far apart
                begin = xxhash.xxh64_intdigest((text or "").encode("utf-8")) >> 2
                for size, found, at, slot in _windows(codes, sizes):
                    hit = known_of(found)
                    rows += [(h, doc, begin + k, _slots(words, slot, k, size)) for h, k in zip(found[hit].view(np.int64).tolist(), at[hit].tolist())]
                for size, found in _literal_windows(codes, literal_sizes):
                    hit = known_of(found)
                    rows += [(h, doc, begin + k, []) for h, k in zip(found[hit].view(np.int64).tolist(), hit.tolist())]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["window", "doc_id", "doc_at", "doc_slots"])
        _codes.clear()
        released()

    picked = docs.select(id_col, text_col)
    # the pairs found below are read twice; the texts are not
    hits = stored(picked.mapInArrow(run, f"window long, doc_id {picked.schema[id_col].dataType.simpleString()}, doc_at long, doc_slots array<string>"), "hits")
    met = hits.join(items, "window").select("doc_id", "item_id", "literal", "at", "n", (F.col("doc_at") - F.col("at")).alias("shift"), F.arrays_zip("slots", "doc_slots").alias("pairs"))
    same = F.expr("forall(pairs, p -> p.slots = p.doc_slots)")
    # a shift is one occurrence of the item in the document; both have as many rows as the item has windows, times its copies
    each = met.groupBy("doc_id", "item_id", "literal", "shift").agg(
        F.max("n").alias("n"),
        F.collect_set("at").alias("all"),
        F.collect_set(F.when(same, F.col("at"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.size("pairs") > 0, F.col("pairs"))))).alias("pairs"),
    )
    names = [F.size(F.array_distinct(F.col("pairs"))), F.size(F.expr("array_distinct(pairs.slots)")), F.size(F.expr("array_distinct(pairs.doc_slots)"))]
    one_to_one = (names[0] == names[1]) & (names[0] == names[2])
    both = each.groupBy("doc_id", "item_id", "literal").agg(
        F.max("n").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("all")))).cast("long").alias("n_all"),
        F.size(F.array_distinct(F.flatten(F.collect_list("same")))).cast("long").alias("n_same"),
        F.max(F.when(one_to_one, F.size("all")).otherwise(0)).cast("long").alias("n_best"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    found = F.when(one_to_one, F.col("n_all")).otherwise(F.greatest("n_same", "n_best"))
    passed = both.withColumn("n_found", found).where(F.col("n_found") >= F.least(F.lit(ENOUGH), F.ceil(F.col("n_windows") * SHARE)))
    # short items that stand everywhere tell nothing
    short = items.where("literal").groupBy("item_id").agg((F.max("size") < WORDS).alias("short")).where("short")
    common = passed.where("literal").join(short, "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("held")).where(F.col("held") > max(FEW, docs.count() // RARE))
    passed = passed.join(common.select("item_id", F.lit(True).alias("literal")), ["item_id", "literal"], "left_anti")
    # templates go first; what only literal windows find is reported by those
    kept = F.struct("literal", "n_found", F.col("n_windows").cast("long").alias("n_windows"), (F.col("n_found") > F.col("n_same")).alias("renamed"))
    return passed.groupBy("doc_id", "item_id").agg(F.min(kept).alias("kept")).select("doc_id", "item_id", "kept.n_found", "kept.n_windows", "kept.renamed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay. Rows with a null id are kept."""
    return docs.join(find_leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
