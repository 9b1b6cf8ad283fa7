from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tierflow.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def brute(texts, least, chars):
    """Kept text, lines and dropped lines of each text, by counting."""
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    split = [(text or "").split("\n") for text in texts]
    keys = [[line.strip(SPACES).translate(lower) for line in own] for own in split]
    seen = Counter(key for own in keys for key in set(own) if len(key) >= chars)
    out = []
    for own, named in zip(split, keys):
        kept = [line for line, key in zip(own, named) if seen[key] < least]
        out.append(("\n".join(kept), len(own), len(own) - len(kept)))
    return out


TEXTS = (
    ["menu\nHOME page\nbody %d" % k for k in range(7)]
    + ["  MENU \nbody\x0b", "\tmenu\r\nÉtage\nhome page", "étage", None, "", "\n\n", "menu", "only", "é\né\né", "\x1cmenu", "x" * 300_000 + "\nMenu\n" + "y" * 10]
    + ["copy\nof\ncopies"] * 5
)


@pytest.mark.parametrize("broadcast", [lines.BROADCAST, -1])
@pytest.mark.parametrize("least, chars", [(3, 1), (2, 0)])
def test_equals_counting(spark, broadcast, least, chars):
    docs = spark.createDataFrame([(k, text, k * 2) for k, text in enumerate(TEXTS)], "doc_id int, text string, N_LINES int").repartition(3)
    index = lines.build_index(docs, chars)
    rows = lines.without_common_lines(docs, index, least, chars, broadcast)
    assert rows.columns == ["doc_id", "text", "N_LINES", "n_lines1", "n_dropped"]
    found = {r.doc_id: (r.text, r.n_lines1, r.n_dropped) for r in rows.collect()}
    assert [found[k] for k in range(len(TEXTS))] == brute(TEXTS, least, chars)


@pytest.mark.parametrize("broadcast", [lines.BROADCAST, -1])
def test_texts_that_the_index_has_not_seen(spark, broadcast):
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    index = lines.build_index(corpus)
    fresh = spark.createDataFrame([(1, "new line %d\nmenu\nother" % k) for k in range(500)], "id int, text string")
    assert {(r.n_lines, r.n_dropped) for r in lines.without_common_lines(fresh, index, 10, 1, broadcast).collect()} == {(3, 1)}


@pytest.mark.parametrize("broadcast", [lines.BROADCAST, -1])
def test_empty_table(spark, broadcast):
    docs = spark.createDataFrame([], "doc_id string, text string")
    index = lines.build_index(docs)
    assert lines.without_common_lines(docs, index, broadcast=broadcast).collect() == []
    some = spark.createDataFrame([("a", "one\ntwo")], "doc_id string, text string")
    assert [tuple(r) for r in lines.without_common_lines(some, index, broadcast=broadcast).collect()] == [("a", "one\ntwo", 2, 0)]


def test_perfect_hash_is_minimal():
    pick = np.random.default_rng(1)
    keys = pick.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    counts = pick.integers(1, 100_000, 5000)
    sizes, bits, marks, n = lines.perfect_hash(keys[:, 0], keys[:, 1], counts)
    assert int(np.bitwise_count(bits).sum()) == len(marks) == len(n) == 5000
    own = lines.Shards([0], [sizes], [bits.tobytes()], [marks.tobytes()], [n.tobytes()], 1)
    assert (own.find(keys[:, 0], keys[:, 1]) == np.minimum(counts, lines.MOST)).all()
    assert (own.find(keys[:, 1], keys[:, 0]) > 0).sum() == 0


def test_limit_of_counts(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        lines.without_common_lines(docs, lines.build_index(docs), 70_000)


def test_hot_line_and_copies(spark):
    docs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "the same text\nof many copies").otherwise(F.concat(F.lit("own "), "id", F.lit("\nHot\nend"))).alias("text"))
    index = lines.build_index(docs)
    for broadcast in (lines.BROADCAST, -1):
        found = lines.without_common_lines(docs, index, 10, 1, broadcast).groupBy("n_dropped").count().collect()
        assert {tuple(r) for r in found} == {(2, 3000)}
