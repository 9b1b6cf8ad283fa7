import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm import ngrams as N

LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    counts, n = Counter(), 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([*words(r.text), None])
    n = sum(counts.values())
    got = {r.doc_id: r for r in N.score_documents(docs, docs.where(LEARN), LEARN).collect()}
    assert len(got) == len(rows)
    for r in rows:
        tokens = [*words(r.text), None]
        assert got[r.doc_id].n_tokens == len(tokens) and got[r.doc_id].train_tokens == n
        assert got[r.doc_id].n_known == sum(t in counts for t in tokens)
        base = sum(math.log10((counts[t] + 1) / (n + len(counts) + 1)) for t in tokens)
        assert got[r.doc_id].base_score == pytest.approx(base, rel=1e-9)
    held = [r for d, r in got.items() if zlib.crc32(str(d).encode()) % 7 == 2]
    print("base", sum(r.base_score for r in held) / sum(r.n_tokens for r in held), "model", sum(r.score for r in held) / sum(r.n_tokens for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_has_no_misses_and_few_false_hits(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    models, counts = N.fit(docs)
    model = models[0]()
    row = counts.collect()
    keys = np.concatenate([np.frombuffer(r.words, "<u8") for r in row])
    found = np.concatenate([np.frombuffer(r.word_counts, "<i8") for r in row])
    assert (model.classes(keys, 1) >= N._classes(found)).all()
    assert found.sum() == model.tokens and len(found) == model.distinct
    assert (model.classes(np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1) > 0).mean() < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a b a", 3), (3, "a b a", 3)], "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in N.score_documents(docs, docs.where("doc_id < 3"), "doc_id < 3").collect())
    assert got == [(1, 1, 1, 2), (2, 1, 1, 2), (3, 4, 1, 2), (3, 4, 1, 2)]
    nothing = N.score_documents(docs, docs.limit(0), "false").collect()
    assert len(nothing) == 4 and all(r.train_tokens == 0 and r.base_score == 0 for r in nothing)
    assert N.score_documents(docs.limit(0), docs, "true").count() == 0


def test_score_matches_brute_force(spark, monkeypatch):
    """Exact counts in the place of the filters give the scores, but for false hits; many parts of a filter give the same as one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    one = {r.doc_id: r.score for r in N.score_documents(docs, docs.where(LEARN), LEARN).collect()}
    monkeypatch.setattr(N, "FILTER_BYTES", 1 << 12)
    assert len(N.fit(docs.where(LEARN))[0]) > 1
    many = {r.doc_id: r.score for r in N.score_documents(docs, docs.where(LEARN), LEARN).collect()}
    assert many == pytest.approx(one, rel=1e-9)

    learns = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows}
    texts = {r.doc_id: [None, *words(r.text), 0] for r in rows}  # None: start, 0: end
    single, double = Counter(), Counter()
    for d, t in texts.items():
        if learns[d]:
            single.update(t[1:])
            double.update(zip(t, t[1:]))
    n, v, starts = sum(single.values()), len(single), sum(learns.values())
    kind = lambda c: int(N._classes(np.array([c]))[0])
    means = []
    for counts in (single, double):
        by = {}
        for c in counts.values():
            by.setdefault(kind(c), []).append(c)
        means.append({q: sum(cs) / len(cs) for q, cs in by.items()})
    known = lambda w: starts if w is None else single[w] if single[w] > n // N.FREQUENT else means[0][kind(single[w])] if w in single else 0
    both = lambda p: means[1][kind(double[p])] if p in double else 0

    def logs(word, before, pair):
        return np.log10(min(1.0, pair / max(before, 1)) * N.MIXES + (word + 1) / (n + v + 1) * (1 - N.MIXES)), int(np.searchsorted(N.RANGES, before))

    total = np.zeros((len(N.RANGES) + 1, len(N.MIXES)))
    for d, t in texts.items():
        for a, b in zip(t, t[1:]) if learns[d] else []:
            values, k = logs(max(known(b) - 1, 0), max(known(a) - 1, 0), max(both((a, b)) - 1, 0))
            total[k] += values
    best = total.argmax(1)
    for d, t in texts.items():
        want = 0.0
        for a, b in zip(t, t[1:]):
            values, k = logs(known(b), known(a), both((a, b)))
            want += values[best[k]]
        assert abs(one[d] - want) < 0.05 * abs(want) + 0.5
