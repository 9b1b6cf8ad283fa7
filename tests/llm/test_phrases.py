import random
import re
from collections import Counter

import numpy as np
import pytest
from tierflow.llm import phrases

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(docs, longest, least, covered, top):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[k : k + n])) for k in range(len(words) - n + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    hidden = set()
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            hidden |= {(lang, words[k : k + n]) for k in range(len(words) - n + 1) if 100 * a >= covered * candidates.get((lang, words[k : k + n]), 0)}
    out = []
    for lang in totals:
        rows = []
        for (own, words), a in candidates.items():
            if own == lang and (own, words) not in hidden:
                cuts = [(1_000_000 * a * a // (counts[own, words[:k]] * counts[own, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(words).encode(), counts[own, words[:k]], counts[own, words[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n):
    pick = random.Random(seed)
    words = ["the", "The", "new", "york", "of", "été", "x\x1cy", "\x00", "日本", "a-b", "'s", *(f"w{k}" for k in range(60))]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?! ", " new york "]
    return [(pick.choice(["en", "fr", None]), "".join(pick.choice(words) + pick.choice(ends) for _ in range(pick.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("longest, least, covered, top", [(3, 10, 50, 2000), (4, 3, 30, 7)])
def test_equals_brute_force(spark, longest, least, covered, top):
    docs = texts(longest, 300) + [("en", None), ("de", ""), ("en", "a a a a " * 5000), (None, "only one"), *[("es", "many copies of one text")] * 50]
    rows = spark.createDataFrame([(t, lang, 1) for lang, t in docs], "text string, lang string, f int").repartition(4)
    found = phrases.collocations(rows, longest, least, covered, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs, longest, least, covered, top)


def test_tasks_send_counts_early(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PENDING", 50)
    monkeypatch.setattr(phrases, "WORDS", 30)
    docs = texts(9, 60)
    rows = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, phrases.collocations(rows, 3, 4).collect())) == brute(docs, 3, 4, 50, 2000)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_full_buckets_only_prune_less():
    marks = np.full(8, 255, np.uint8)
    assert phrases._in(marks, np.arange(64)).all() and not phrases._in(marks * 0, np.arange(64)).any()


def test_products_beyond_64_bits(spark):
    docs = [("en", "up down " * 40_000), ("en", "up " * 1000)]
    rows = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(rows, 2, 10).collect())) == brute(docs, 2, 10, 50, 2000)
