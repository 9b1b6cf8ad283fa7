import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tierflow.llm import suffixes as S


def brute(rows, length):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[k : k + length] for k in range(len(data) - length + 1))
    out = []
    for d, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if counts[data[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((d, len(data), int(gone.sum()), int(sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(data)))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, length):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choices("abcdé", k=pick.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(pick.randint(length // 6, length // 2)) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [text(pick.randint(0, 40)) for _ in range(3)]
        for p in range(2):
            if pick.random() < 0.6:
                parts.insert(pick.randint(0, len(parts)), pick.choice(passages))
        rows.append((k, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "ab" * length), (203, "x" * (length + 1)), (204, "y" * length), (205, rows[0][1]), (206, rows[1][1] + "!"), (206, rows[1][1] + "!")]
    rows += [(300 + k, text(3) + " " + passages[0] + " " + text(3)) for k in range(60)]
    return rows


@pytest.mark.parametrize("length,span", [(60, 20), (400, 128)])
def test_matches_brute_force(spark, length, span):
    rows = made(length, length)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted((tuple(r) for r in S.cut_repeats(docs, length=length, span=span, with_kept=False).collect()), key=str)
    assert got == brute(rows, length)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r)[:5] for r in S.cut_repeats(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], S.LENGTH)


def test_multikey_order():
    pick = random.Random(4)
    rows = [bytes(pick.choices(b"ab", k=20)) for _ in range(500)]
    order = S.multikey_order(np.frombuffer(b"".join(rows), np.uint8).reshape(500, 20))
    assert [rows[k] for k in order] == sorted(rows)


def test_empty(spark):
    assert S.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
