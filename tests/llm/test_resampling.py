import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from tierflow.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def runs(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, percent, least, buckets, most, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in runs(text, most)[1])
    t = Counter(bucket(f) for text in target for f in runs(text, most)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, text in docs:
        words, features = runs(text, most)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((row for row in out if row[1] >= least), key=lambda row: (-row[4], row[0]))
    ranks = {row[0]: k + 1 for k, row in enumerate(fit[: len(fit) * percent // 100])}
    return sorted((*row, ranks.get(row[0])) for row in out)


DOCS = [(k, f"Alpha beta-{k % 7} gamma_{k} Été{'!' * (k % 3)} delta " * (k % 5)) for k in range(150)] + [(200, None), (201, ""), (202, "?!"), (203, "z{z|Z~z\x7fz"), (204, "long " * 200_000)]
TARGET = ["beta 3 delta", None, "", "été gamma", "été zz zz"]


@pytest.mark.parametrize("buckets, most, percent", [(10_000, 1, 10), (50, 3, 33), (1, 1, 100)])
def test_equals_brute_force(spark, buckets, most, percent):
    docs = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, score string").repartition(5)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in TARGET], "text string"), percent, 4, buckets, most, 7)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(DOCS, TARGET, percent, 4, buckets, most, 7)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).collect() == []
    some = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    assert [tuple(r)[:4] for r in resampling.resample(some, target).collect()] == [("a", 2, 2, 2 * math.floor(1000 * math.log(10002 / (2 * 10000))))]


def test_copies_and_equal_ids(spark):
    docs = spark.createDataFrame([(None if k < 2 else k // 2, "same words here") for k in range(40)], "doc_id int, text string")
    rows = resampling.resample(docs, docs, 50, 1).collect()
    assert {(r.weight, r.n_words) for r in rows} == {(0, 3)}
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 21))
