import random

import pytest

from tierflow.operators.resolve import resolved
from tierflow.sources import code
from tierflow.sources.store import Store, fingerprint
from tierflow.streaming import build

LOG = "path string, version long, deleted boolean, content string"


def made(seed, n=60):
    """A log of changes with late, repeated and deleting ones."""
    pick = random.Random(seed)
    paths = [f"src/m{k}{pick.choice(['.ts', '.tsx', '/index.ts'])}" for k in range(12)] + ["src/m1.ts", "src/m1.js", "src/m2.jsx"]
    rows = []
    for version in range(n):
        text = "".join(f"import x from './{pick.choice(['m%d' % pick.randint(0, 13), 'm1.js', '../src/m%d' % pick.randint(0, 5)])}'\n" for _ in range(pick.randint(0, 3))) + "import 'react' // import no from './m3'"
        rows.append((pick.choice(paths), version, pick.random() < 0.25, text))
    return rows


def full(spark, rows):
    """The graph of a full build over the last versions."""
    last = {}
    for row in rows:
        if row[0] not in last or row[1] > last[row[0]][1]:
            last[row[0]] = row
    files = spark.createDataFrame([r for r in last.values() if not r[2]], LOG)
    found = resolved(code.imports(files), files.select("path")).collect()
    return {r.path for r in files.collect()}, {tuple(r) for r in found}


def state(store):
    return {r.path for r in build.files_of(store).collect()}, {tuple(r) for r in build.statuses_of(store).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_replay_give_the_full_build(spark, tmp_path, seed):
    rows = made(seed)
    store = build.build_store(spark, str(tmp_path / "state"), buckets=4)
    shuffled = rows[:]
    random.Random(seed + 5).shuffle(shuffled)
    batches = [shuffled[k : k + 20] for k in range(0, len(shuffled), 20)]
    for k, batch in enumerate(batches):
        assert build.apply_changes(store, spark.createDataFrame(batch, LOG)) > 0
        assert state(store) == full(spark, [r for b in batches[: k + 1] for r in b])
    version = store.current()[0]
    assert build.apply_changes(store, spark.createDataFrame(batches[0], LOG)) == 0 and store.current()[0] == version
    edges = {(r.source, r.specifier, r.target) for r in build.edges_of(store).collect()}
    assert edges == {(s, x, t) for s, x, status, t in state(store)[1] if status == "resolved"}
    store.vacuum()
    assert state(store) == full(spark, rows)


def test_stream_keeps_the_state(spark, tmp_path):
    rows, seen = made(3, 30), []
    for k in range(3):
        spark.createDataFrame(rows[k::3], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    store = build.build_store(spark, str(tmp_path / "state"), buckets=3)
    log = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    build.watch_files(log(), store, lambda edges, n: seen.append(edges.count()), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    assert seen and state(store) == full(spark, rows)
    # a query without its checkpoint reads the whole log again
    build.watch_files(log(), store, None, str(tmp_path / "other"), once=True).awaitTermination(120)
    assert state(store) == full(spark, rows)


def test_store(spark, tmp_path):
    frame = lambda **rows: spark.createDataFrame(list(rows.items()), "k string, v int")
    store = Store(spark, str(tmp_path), {"t": "k"}, fingerprint({"a": 1}), 8)
    assert store.current() is None and store.read("t", "k string, v int").count() == 0
    first = frame(a=1, b=2, c=3)
    store.commit({"t": (first, store.touched(first, "k"))})
    touched = store.touched(frame(a=0), "k")
    rest = store.read("t", "k string, v int", touched).where("k <> 'a'")
    assert store.commit({"t": (rest.union(frame(a=9)), touched)}) == 1
    assert {tuple(r) for r in store.read("t", "k string, v int").collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert set(store.current()[1]["tables"]["t"].values()) == ({0, 1} if len(store.touched(first, "k")) > 1 else {1})
    # a version without a complete manifest does not count
    (tmp_path / "manifest" / "2").mkdir()
    (tmp_path / "manifest" / "3").mkdir()
    (tmp_path / "manifest" / "3" / "_SUCCESS").touch()
    assert store.current()[0] == 1
    assert Store(spark, str(tmp_path), {"t": "k"}, fingerprint({"a": 2}), 8).current() is None
    store.vacuum()
    assert {r.v for r in store.read("t", "k string, v int").collect()} == {9, 2, 3}
