from collections import defaultdict

import numpy as np

from tierflow.llm import decontaminate as D

ITEM = "A train leaves Paris at 9 and travels 120 km to the coast while Anna waits there for 3 hours before the rain stops."
RENAMED = "A train leaves Rome at 7 and travels 250 km to the coast while Otto waits there for 5 hours before the rain stops."
BROKEN = "A train leaves Paris at 9 and travels 9 km to the coast while Paris waits there for 9 hours before the rain stops."


def brute(docs, items):
    """Every document against every item, by the definition."""
    out = set()
    for d, text in docs:
        for i, item in items:
            n = len((item or "").split())
            if not text or n < D.WORDS:
                continue
            size = min(D.WINDOW, n)
            sides = []
            for value in (item, text):
                tokens = value.split()
                template, slot, maybe = D._template(D._coded(tokens))
                both = []
                for hashes, flags in ((template, slot), (np.where(maybe, D._SLOTS[1], template), slot | maybe)):
                    both += [(k, tuple(hashes[k : k + size].tolist()), D._slots(tokens, flags, k, size)) for k in range(len(tokens) - size + 1) if (~flags[k : k + size]).sum() >= min(D.WORDS, size)]
                sides.append(both)
            at, same, pairs = set(), set(), set()
            for k, t, s in sides[0]:
                for _, u, v in sides[1]:
                    if t == u:
                        at.add(k)
                        pairs |= set(zip(s, v))
                        if s == v:
                            same.add(k)
            good = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            found = len(at) if good else len(same)
            places = len({k for k, _, _ in sides[0]})
            if at and found >= min(D.ENOUGH, np.ceil(places * D.SHARE)):
                out.add((d, i, found, places, good and len(at) > len(same)))
                continue
            # otherwise as it stands
            plain = [[t.strip(D._EDGE).lower() for t in value.split()] for value in (item, text)]
            own, other = ([tuple(p[k : k + size]) for k in range(len(p) - size + 1)] for p in plain)
            found = sum(w in set(other) for w in own)
            if found and found >= min(D.ENOUGH, np.ceil(len(own) * D.SHARE)):
                out.add((d, i, found, len(own), False))
    return out


def test_copies_and_renamed(spark):
    filler = "some words that stand around and have nothing to do with anything at all in this test"
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {RENAMED}"), (3, BROKEN), (4, filler), (5, None), (6, ""), (7, ITEM + " " + ITEM), (8, f"{filler} tiny item of four"), (9, "12 13 14 15 16 17 18 19 20 21"), (4, filler)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "tiny item of four"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, "two words"), (7, ITEM)]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "en") for x in items], "item_id long, text string, doc_id string"))
    rows = {tuple(r) for r in got.select("doc_id", "item_id", "n_found", "n_windows", "renamed").collect()}
    assert rows == brute(docs, items)
    by = defaultdict(set)
    for r in rows:
        by[r[0]].add(r[1])
    assert by == {1: {1, 7}, 2: {1, 7}, 7: {1, 7}, 8: {4}} or by[3] <= {1, 7}
    assert 2 in by and 4 not in by and 9 not in by


def test_real_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {tuple(r) for r in D.find_leaks(docs, items).select("doc_id", "item_id", "n_found", "n_windows", "renamed").collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({g[0] for g in got})


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0


def test_copies_with_other_parameters(spark):
    """Each copy of an item is tested on its own: two renamed differently, and one beside a window filled otherwise."""
    other = RENAMED.replace("Rome", "Bonn").replace("7", "5").replace("250", "300").replace("5 hours", "8 hours")
    piece = "A train leaves Rome at 9 and travels 9 km to the coast"
    docs = [(1, f"{RENAMED} {other}"), (2, f"{piece} or so. {RENAMED}"), (3, BROKEN), (4, RENAMED), (4, other)]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert {(r.doc_id, r.n_found, r.renamed) for r in got.collect()} >= {(d, got.first().n_windows, True) for d in (1, 2, 4)}
    assert {r.doc_id for r in got.collect()} - {3} == {1, 2, 4}


def test_literal_copies(spark):
    """Items without enough words for a template: arithmetic, tables, capitals, few tokens, and a capital that follows other text."""
    items = [(1, "1 2 3 4 5 6 7 8 9 10"), (2, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG"), (3, "12 + 30 = 42"), (4, "two words"), (5, "Lakes freeze in winter"), (6, "Paris 3 km Rome 4 km Bonn 5 km Oslo 6 km")]
    around = "some other text stands here and then comes"
    docs = [(k, f"{around} {text} and more of it") for k, text in items] + [(7, around), (8, "12 13 14 15 16 17 18 19 20 21"), (9, "two other words")]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k, _ in items}


def test_names_at_the_beginning_and_numbers_in_words(spark):
    items = [(1, "Tom has 5 red apples and 3 pears"), (2, "five sheep and seven goats graze on the hill all day"), (3, "the")]
    docs = [(1, "Anna has 7 red apples and 4 pears"), (2, "Question 5 Anna has 7 red apples and 4 pears in a bag"), (3, "We saw it. Otto has 9 red apples and 2 pears"), (4, "six sheep and nine goats graze on the hill all day")]
    docs += [(5, "Tom has 5 red apples and no pears"), *((k, f"the other text {k} is about the weather") for k in range(10, 30))]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.renamed) for r in got.collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True)}


def test_texts_are_read_for_windows_once(spark):
    docs = spark.createDataFrame([(1, "before " + ITEM), (2, "x y"), (3, RENAMED)], "doc_id long, text string")
    found = D.find_leaks(docs, spark.createDataFrame([(7, ITEM), (8, "x y")], "item_id long, text string"))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {(r.doc_id, r.item_id, r.renamed) for r in found.collect()} == {(1, 7, False), (2, 8, False), (3, 7, True)}
