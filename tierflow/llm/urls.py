"""URL filters: rules as a sorted array of 64-bit digests in a memory-mapped file.

A rule is a host and the start of a path; it covers the host's subdomains. All
keys that could fit a URL (its host's suffixes with each path length that rules
have) are hashed, looked up by one vectorised binary search over the digests, and
confirmed against the stored strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.shared import shared_folder

#: Bytes that the file which every executor fetches may have; more rules are joined instead.
MAX_FILE_BYTES = 256_000_000
#: First part of a digest file: number of keys.
_HEADER = 8


class DigestArray:
    """Sorted xxhash64 digests, where each key's string starts, its value, and the strings."""

    def __init__(self, data: np.ndarray):
        count = int(data[:_HEADER].view("<u8")[0])
        cuts = np.cumsum([_HEADER, 8 * count, 8 * (count + 1), 4 * count])
        self.digests = data[cuts[0] : cuts[1]].view("<u8")
        self.starts = data[cuts[1] : cuts[2]].view("<u8")
        self.values = data[cuts[2] : cuts[3]].view("<u4")
        self.strings = data[cuts[3] :]

    @staticmethod
    def packed(keys: list[bytes], values: list[int], digest=xxhash.xxh64_intdigest) -> bytes:
        """The file of these keys."""
        digests = np.fromiter(map(digest, keys), "<u8", len(keys))
        order = np.argsort(digests, kind="stable")
        in_order = [keys[k] for k in order]
        starts = np.concatenate([[0], np.cumsum([len(key) for key in in_order])]).astype("<u8")
        return b"".join([np.array([len(keys)], "<u8").tobytes(), digests[order].tobytes(), starts.tobytes(), np.array(values, "<u4")[order].tobytes(), *in_order])

    def find(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The value of each key, -1 where it is not stored."""
        out = np.full(len(keys), -1, np.int64)
        wanted = np.fromiter(map(digest, keys), "<u8", len(keys))
        first, last = np.searchsorted(self.digests, wanted, "left"), np.searchsorted(self.digests, wanted, "right")
        for k in np.flatnonzero(first < last):
            for at in range(first[k], last[k]):  # more than one only if stored keys collide
                if self.strings[self.starts[at] : self.starts[at + 1]].tobytes() == keys[k]:
                    out[k] = self.values[at]
                    break
        return out


def split_rule(rule: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a rule such as ``example.org/en/``."""
    host, slash, path = rule.partition("/")
    return _lower(host), slash + path


def _lower(host: str) -> str:
    return host.encode("utf-8").lower().decode("utf-8")


def _candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every host suffix with every start of the path that some rule could have."""
    labels = host.split(".")
    suffixes = [".".join(labels[k:]) for k in range(len(labels))]
    starts = [path[:length] for length in lengths if length <= len(path)]
    return [suffix + start for suffix in suffixes for start in starts]


def with_host_and_path(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path``; both empty for null and for what has no ``://``."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.select(F.col(id_col), rest.alias("_rest"))
        .select(id_col, F.regexp_extract("_rest", r"^([^/?#]*)", 1).alias("_host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .select(id_col, F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path")
    )


def _shipped(spark: SparkSession, data: bytes) -> str:
    """Put a file into the shared folder and have every executor fetch it; returns its name."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The longest rule that fits each URL and its verdict: ``id_col, host, path, rule, verdict``.

    ``rules`` are pairs of a rule and its verdict. Of two fitting rules of the same
    length the one with the longer host wins. Null and odd URLs have an empty host,
    fit no rule and get the default; repeated rows give repeated rows; columns other
    than the two named are not read. Rules beyond ``max_file_bytes`` are not
    shipped but joined by key, with the same result. Map-only otherwise.
    """
    unique = dict(rules)
    named = [(rule, *split_rule(rule), verdict) for rule, verdict in unique.items()]
    lengths = sorted({len(path) for _, _, path, _ in named})
    urls = with_host_and_path(pages, id_col, url_col)
    kind = urls.schema[id_col].dataType.simpleString()
    if sum(24 + len(rule.encode("utf-8")) for rule in unique) > max_file_bytes:
        return _judged_by_join(urls, named, lengths, default, id_col)
    rank = sorted(range(len(named)), key=lambda k: (len(named[k][1]) + len(named[k][2]), len(named[k][1])))
    best = [named[k] for k in rank]  # a higher position wins
    name = _shipped(pages.sparkSession, DigestArray.packed([(host + path).encode("utf-8") for _, host, path, _ in best], list(range(len(best)))))
    texts = [(rule, verdict) for rule, _, _, verdict in best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        for batch in batches:
            keys, of = [], []
            for row, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                more = _candidates(host, path, lengths)
                keys += [key.encode("utf-8") for key in more]
                of += [row] * len(more)
            best_of = np.full(batch.num_rows, -1, np.int64)
            np.maximum.at(best_of, np.array(of, np.int64), array.find(keys))
            rule = [texts[k][0] if k >= 0 else None for k in best_of]
            verdict = [texts[k][1] if k >= 0 else default for k in best_of]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _judged_by_join(urls: DataFrame, named: list[tuple[str, str, str, str]], lengths: list[int], default: str, id_col: str) -> DataFrame:
    """The same for any number of rules: candidate keys meet the rules in a hash join."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(host + path, rule, len(host + path), len(host), verdict) for rule, host, path, verdict in named], "key string, rule string, n int, n_host int, verdict string")
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), k -> array_join(slice(split(host, '[.]'), k, size(split(host, '[.]'))), '.'))"
    starts = f"transform(filter(array({', '.join(map(str, lengths))}), l -> l <= length(path)), l -> substr(path, 1, l))"
    # the distinct (host, path) pairs meet the rules, so a hot URL is looked up once
    pairs = urls.select("host", "path").distinct()
    keys = pairs.select("host", "path", F.explode(F.expr(f"flatten(transform({suffixes}, s -> transform({starts}, p -> concat(s, p))))")).alias("key"))
    best = keys.join(rules, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("n", "n_host")).alias("b"))
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
