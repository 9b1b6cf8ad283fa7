import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tierflow.llm import toxicity as T


def made(counts, weight, labels, ids):
    """An index of examples given as counts of terms, by id."""
    terms = sorted({t for c in counts for t in c})
    at = {t: k for k, t in enumerate(terms)}
    number = np.array([at[t] for c in counts for t in c], np.int64)
    count = np.array([n for c in counts for n in c.values()], np.int64)
    return T.Index(T.hashes_of(terms), np.array([weight[t] for t in terms]), number, count, np.array([len(c) for c in counts], np.int64), np.array(labels), 1 - np.array(labels), pa.array(ids), (1.0, 1.0))


def unit(counts, weight):
    values = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items() if t in weight}
    length = math.sqrt(sum(v * v for v in values.values()))
    return {t: v / length for t, v in values.items()}


def test_nearest_is_exact():
    pick = random.Random(2)
    terms = [f"t{k}".encode() for k in range(60)]
    weight = {t: pick.choice([0.1, 1, 2, 30]) for t in terms}
    counts = [Counter(pick.choices(terms[k % 3 * 20 : k % 3 * 20 + 25], k=pick.randint(0, 12))) for k in range(900)]
    index = made(counts, weight, [k % 2 for k in range(900)], list(range(900)))
    vectors = [unit(c, weight) for c in counts]
    for _ in range(80):
        query = Counter(pick.choices(terms + [b"new"], k=pick.randint(0, 8)))
        vector = unit(query, weight)
        every = sorted(((-round(sum(v * w.get(t, 0.0) for t, v in vector.items()), 12), k) for k, w in enumerate(vectors)))
        want = [(-s, k) for s, k in every if s < 0][: T.NEIGHBOURS]
        at, similarity = index.nearest([index.weighed(query)])[0]
        assert np.allclose(similarity, [s for s, _ in want])
        ids = index.ids.take(pa.array(at)).to_pylist()
        assert not want or {k for k, s in zip(ids, similarity) if s > want[-1][0] + 1e-9} == {k for s, k in want if s > want[-1][0] + 1e-9}


def test_matches_brute_force(spark):
    """Weights, neighbours, votes, curve and scores of the whole table against plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: T.terms_of(r.text) for r in docs.collect()}
    said = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    bags = {}
    for d in sorted(texts):
        if d in said:
            bags.setdefault(tuple(sorted(texts[d].items())), []).append(d)
    known = {ids[0]: [sum(said[d] == k for d in ids) for k in (0, 1)] for ids in bags.values()}
    df = Counter(t for c in texts.values() for t in c)
    n = [sum(has[k] for has in known.values()) for k in (0, 1)]
    have = {k: Counter({t: 0 for t in ()}) for k in (0, 1)}
    for d, has in known.items():
        for k in (0, 1):
            have[k].update({t: has[k] for t in texts[d]})
    weight = {}
    for t in {t for d in known for t in texts[d]}:
        a, b = have[1][t], have[0][t]
        phi = max(0, abs(a * n[0] - b * n[1]) - (n[0] + n[1]) / 2) / math.sqrt((a + b) * max(n[0] + n[1] - a - b, 1) * n[0] * n[1])
        weight[t] = (math.log((1 + len(texts)) / (1 + df[t])) + 1) * (1 + 20 * phi**2)
    vectors = {d: unit(texts[d], weight) for d in known}

    def vote(counts, own=None, label=0):
        vector = unit(counts, weight) if any(t in weight for t in counts) else {}
        near = sorted(((-sum(v * w.get(t, 0.0) for t, v in vector.items()), d) for d, w in vectors.items()))
        near = [(-s, d) for s, d in near if s < 0 and not (d == own and sum(known[d]) == 1)][: T.NEIGHBOURS]
        shares = [(1 / (T.NEAR + 2 - 2 * s), *(known[d][k] - (d == own and label == k) for k in (0, 1))) for s, d in near]
        total = sum(w * (zero + one) for w, zero, one in shares)
        return sum(w * one for w, _, one in shares) / total if total > 0 else None

    votes = sorted((v, k) for d, has in known.items() for k in (0, 1) if has[k] and (v := vote(texts[d], d, k)) is not None for _ in range(has[k]))
    blocks = []
    for v in sorted({v for v, _ in votes}):
        ones = [one for w, one in votes if w == v]
        blocks.append([v * len(ones), len(ones), sum(ones)])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    curve = [b[0] / b[1] for b in blocks], [(b[2] + 0.01) / (b[1] + 0.02) for b in blocks]
    index = T.fit(docs, T.learnable(labels), boosts=(20.0,))
    assert np.allclose(index.curve[0], curve[0]) and np.allclose(index.curve[1], curve[1])
    rows = T.score_documents(docs, index).collect()
    for r in rows[::5]:
        v = vote(texts[r.doc_id])
        assert math.isclose(r.score, index.alone if v is None else float(np.interp(v, *curve)), abs_tol=1e-9)
        assert r.predicted == (r.score >= T.TOXIC) and all((known[e.doc_id][1] > known[e.doc_id][0]) == e.toxic for e in r.evidence)
    assert len({r.score for r in rows}) > 50


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    index = T.fit(docs, T.learnable(labels))
    rows = {r.doc_id: r for r in T.score_documents(docs, index).collect()}
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    toxic = [r for r in rows.values() if r.predicted]
    assert toxic and all(r.evidence for r in toxic) and all(0 <= r.score <= 1 for r in rows.values())
    kept = T.without_toxic(docs, index)
    assert kept.schema == docs.schema and kept.count() == docs.count() - len(toxic)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "a b", None), (3, "a b", None)], "doc_id long, text string, toxic int")
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in T.score_documents(docs, none).collect()] == [0.5] * 4
    some = T.fit(docs, spark.createDataFrame([(1, 1), (2, None), (3, 0), (9, 1)], "doc_id long, toxic int"))
    assert T.score_documents(docs, some, evidence=False).count() == 4
    assert T.score_documents(docs.limit(0), some).count() == 0
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert T.score_documents(named, T.fit(named, spark.createDataFrame([("1", 1), ("3", 0)], "doc_id string, toxic int"))).count() == 4


def test_every_term_counts(spark):
    """No term of an example is left out, however few the examples are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = T.learnable(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    index = T.fit(docs, labels)
    texts = [r.text for r in docs.join(labels.select("doc_id"), "doc_id").collect()]
    assert texts and all(np.isin(T.hashes_of(T.terms_of(t)), index.known[0]).all() for t in texts) and index.weight.min() >= 1 and len(index.where) == sum(map(len, {tuple(sorted(T.terms_of(t).items())) for t in texts}))
    rows = T.score_documents(docs, index).collect()
    assert len({r.score for r in rows}) > 10 and any(r.predicted for r in rows)


def test_equal_bags_vote(spark):
    """Examples that differ in numbers only are one example with all their labels, and it votes on equal texts."""
    rows = [(k, f"you vile rotten creature {k}", 1) for k in range(20)] + [(100 + k, f"the river runs past the mill {k}", 0) for k in range(60)]
    new = [(1000, "you vile rotten creature 999"), (1001, "the river runs past the mill 999"), (1002, "vile rotten thing"), (1003, None)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + new, "doc_id long, text string")
    index = T.fit(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    assert len(index.rank) == 2
    scores = {r.doc_id: r.score for r in T.score_documents(docs, index).collect()}
    assert all(scores[d] > 0.9 if y else scores[d] < 0.1 for d, _, y in rows)
    assert scores[1000] > 0.9 and scores[1002] > 0.9 and scores[1001] < 0.1


def test_share_of_ordered_pairs():
    pick = np.random.default_rng(3)
    votes, labels, weights = pick.integers(0, 5, 60) / 4, pick.integers(0, 2, 60), pick.integers(1, 4, 60).astype(float)
    pairs = [(weights[i] * weights[j], (votes[i] > votes[j]) + (votes[i] == votes[j]) / 2) for i in range(60) for j in range(60) if labels[i] > labels[j]]
    assert math.isclose(T.ordered_share(votes, labels, weights), sum(w * x for w, x in pairs) / sum(w for w, _ in pairs))
