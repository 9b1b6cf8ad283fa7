import random
import re

import pytest

from tierflow.llm import jaccard as J


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {}
    for d, text in rows:
        sets[d] = shingle_set(text)
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for e in {e for x in s for e in by[x] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def made(seed, groups=15):
    """Chains of edited copies, texts that share a passage, very short ones, exact copies."""
    pick = random.Random(seed)
    word = lambda: "w%d" % pick.randint(0, 3000)
    passage = [word() for _ in range(60)]
    rows, k = [], 0
    for _ in range(groups):
        base = [word() for _ in range(pick.choice([3, 5, 6, 12, 40, 150]))]
        for _ in range(pick.randint(1, 12)):
            rows.append((k, " ".join(base)))
            k += 1
            base = list(base)
            for _ in range(pick.randint(0, 1 + len(base) // 40)):
                base[pick.randrange(len(base))] = word()
            if pick.random() < 0.3:
                base.append(word())
    for _ in range(40):
        rows.append((k, " ".join([word() for _ in range(pick.randint(0, 14))] + passage + [word() for _ in range(pick.randint(0, 14))])))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t"), (k + 3, "One"), (k + 4, "one"), (k + 5, rows[0][1]), (k + 6, "ONE É")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,cell", [(1, 4096), (2, 20)])
def test_matches_brute_force(spark, seed, cell):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, cell=cell).collect()}
    assert got == brute(rows)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()} == want
    kept = J.without_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 1, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)], key=str)
    assert J.jaccard_components(docs.limit(0)).count() == 0
    assert J.without_near_copies(docs).count() == 4


def test_components(spark):
    pick = random.Random(9)
    links = [(k, k + 1) for k in range(40)] + [(pick.randint(100, 200), pick.randint(100, 200)) for _ in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def passages(seed, n):
    """Texts of 7 of 14 common passages, some with an edit: many members of a region, few of them linked."""
    pick = random.Random(seed)
    parts = [" ".join("p%d" % pick.randint(0, 5000) for _ in range(30)) for _ in range(14)]
    rows = []
    for k in range(n):
        words = " ".join(parts[p] for p in sorted(pick.sample(range(14), 7))).split()
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = "e%d" % pick.randint(0, 99)
        rows.append((k, " ".join(words)))
    return rows


def test_cells_in_memory():
    """Pivots and windows find the components that all pairs have."""
    rows = passages(4, 250)
    sets = [J.shingles(J.words_of(text), J.WORDS) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cells = J.Cells(sets, list(range(len(rows))), J.PERCENT)
    for a, b in cells.links():
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = brute(rows)
    assert {k: root(k) for k in range(len(rows))} == {k: c for k, (_, c) in want.items()}
    assert len(cells.known) < len(rows)


def test_common_passages(spark):
    """Regions larger than a task's share are divided by Spark."""
    rows = passages(5, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, cell=30).collect()} == brute(rows)


def test_clashing_columns(spark):
    """Columns with the names that the join and its filter use stay as they are."""
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8, "x"), (2, "a b c d e f", 9, 8, "y"), (3, "q", 1, 1, None)], "doc_id long, text string, bit int, h int, id string")
    got = sorted(map(tuple, J.without_near_copies(docs).collect()))
    assert got == [(1, "a b c d e f", 7, 8, "x"), (3, "q", 1, 1, None)]


def test_rows_repeated_in_another_task_do_not_cancel(spark):
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, f"more{g}"]))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows + rows, 2), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}
