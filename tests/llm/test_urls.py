import random

import numpy as np

from tierflow.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("b.com/", "allow")]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best[0]), len(best[0].split("/")[0]))):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def samples():
    pick = random.Random(3)
    out = [None, "", "no scheme", "http://", "://x.org", "http://EXAMPLE.org/es/a?b://c", "https://a.example.org/en/12#x", "http://x.com", "http://É.Org/", "http://a.com/fr\n/x", "http://org/"]
    for _ in range(500):
        host = pick.choice(["example.org", "badexample.org", "a.example.org", "x.b.com", "com", "A.COM", "q.net", "example.org.com"])
        out.append(f"http://{host}{pick.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/', '/de/9'])}{pick.choice(['', '?q=/es/', '#x', 'z/y'])}")
    return out


def test_both_ways_match_brute_force(spark):
    rows = samples()
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(rows)], "page_id long, url string, host string")
    for limit in (urls.MAX_FILE_BYTES, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, RULES, max_file_bytes=limit).collect()}
        assert got == {k: brute(u) for k, u in enumerate(rows)}


def test_colliding_digests_are_told_apart():
    keys = [f"k{i}".encode() for i in range(20)]
    same = lambda key: len(key)
    array = urls.DigestArray(np.frombuffer(urls.DigestArray.packed(keys, list(range(20)), same), np.uint8))
    assert array.find([*keys, b"zz", b"zzz", b"other"], same).tolist() == [*range(20), -1, -1, -1]


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), []).first().verdict == "allow"
