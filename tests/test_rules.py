import re

import pytest
from pyspark.sql import functions as F

from tierflow.functions import frameworks, paths
from tierflow.operators import graph, incremental, mapping, report, resolve, rules
from tierflow.plans import projection, ruleset
from tierflow.sources import code

CONFIG = {
    "layers": {
        "ui": {"path": "src\\UI/", "sublayers": {"features": {"path": "src/ui/features", "isolated": True}, "kit": {"path": "src/ui/kit"}}, "flow": ["features -> kit"]},
        "api": {"path": "/src/api", "publicApi": "index.ts", "maxDependents": 0},
        "core": {"path": "src/api/core"},
    },
    "flow": ["ui -> api", "api <-> core"],
}
RULES = ruleset.from_dict(CONFIG)
SCHEMA = "source string, target string, specifier string, is_type_only boolean, kind string, line int"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "x", False, "static", k + 1) for k, (a, b) in enumerate(pairs)], SCHEMA)


@pytest.mark.parametrize("rule,pairs", [("a -> b", [("a", "b")]), ("a->b -> c", [("a", "b"), ("b", "c")]), ("a <-> b", [("a", "b"), ("b", "a")])])
def test_flow_grammar(rule, pairs):
    assert ruleset.parse_flow(rule) == pairs


@pytest.mark.parametrize("rule", ["", " ", "a", "a -> ", "-> b", "a <- b", "a --> b", "a <-> b <-> c", "a <-> b -> c"])
def test_flow_errors(rule):
    with pytest.raises(ruleset.FlowError):
        ruleset.parse_flow(rule)


def test_problems():
    assert ruleset.problems(RULES) == []
    assert ("MISSING_LAYERS", "no layers") in ruleset.problems(ruleset.RuleSet((), ()))
    wrong = ruleset.from_dict({"layers": {"a": {"path": ""}, "b": {"path": "b", "flow": "x -> y"}}, "flow": ["a -> z"]})
    assert {c for c, _ in ruleset.problems(wrong)} == {"UNKNOWN_LAYER", "LAYER_NOT_IN_FLOW_WARNING", "MISSING_PATH", "UNKNOWN_SUBLAYER"}


def test_mapping(spark):
    cases = {
        "src/ui/features/Auth/a.ts": ("ui", "features", "auth", True),
        "SRC\\ui\\features\\a.ts": ("ui", "features", None, True),
        "src/ui/kit/b.ts": ("ui", "kit", None, False),
        "src/uikit/b.ts": None,
        "src/api": ("api", None, None, False),
        "src/api/core/x.ts": ("core", None, None, False),
        "./src/api/x.ts": None,
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: r.p and tuple(r.p) for r in rows.select("path", mapping.placed(F.col("path"), RULES).alias("p")).collect()}
    assert got == cases
    layers = spark.createDataFrame([(x.name, x.path) for x in RULES.layers], "layer string, path string")
    joined = {r.path: r.layer for r in mapping.layers_by_prefix(rows, layers).collect()}
    assert joined == {p: c[0] for p, c in cases.items() if c}


def test_case_chain(spark):
    cases = [
        ("other/x.ts", "other/y.ts", "unmapped"), ("src/ui/a.ts", "other/y.ts", "unlayered"),
        ("src/ui/features/a/x.ts", "src/ui/features/b/y.ts", "isolation"), ("src/ui/features/a/x.ts", "src/ui/features/a/y.ts", "ok"), ("src/ui/features/x.ts", "src/ui/features/a/y.ts", "ok"),
        ("src/ui/features/a/x.ts", "src/ui/kit/y.ts", "ok"), ("src/ui/kit/y.ts", "src/ui/features/a/x.ts", "flow"), ("src/ui/kit/y.ts", "src/ui/x.ts", "ok"),
        ("src/ui/a.ts", "src/api/b.ts", "ok"), ("src/ui/a.ts", "src/api/core/b.ts", "flow"), ("src/api/core/b.ts", "src/api/a.ts", "ok"), ("src/api/a.ts", "src/ui/a.ts", "flow"),
    ]
    got = {(r.source, r.target): r.outcome for r in rules.judged(edges(spark, *[c[:2] for c in cases]), RULES).collect()}
    assert got == {c[:2]: c[2] for c in cases}


def test_check(spark):
    graph_edges = edges(spark, ("other/x.ts", "src/ui/a.ts"), ("other/x.ts", "src/ui/b.ts"), ("src/ui/a.ts", "src/api/index.ts"), ("src/ui/a.ts", "src/api/inner.ts"), ("src/ui/a.ts", "gone/z.ts"))
    files = spark.createDataFrame([(p,) for p in ["src/ui/a.ts", "src/ui/lonely.ts", "src/index.ts", "src/api/inner.ts"]], "path string")
    found = rules.check(files, graph_edges, RULES)
    counts = {r.type: r.n for r in report.by_type(found).collect() if r.n}
    assert counts == {"unmapped": 1, "publicApi": 1, "dependentBudget": 1, "unlayered": 1, "orphan": 1}
    assert not report.passed(found) and "src/ui/lonely.ts" in report.markdown(found, 10) and report.html_rows(found).startswith("<table>")
    assert found.select(report.annotation()).count() == report.as_json(found).count() == 5


def test_judged_edges_are_written_with_numbers_of_places(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(rules, "stored", lambda df, tag: kept.setdefault(tag, df))
    cases = [("src/ui/features/a/x.ts", "src/ui/features/b/y.ts"), ("src/ui/kit/y.ts", "src/ui/features/a/x.ts"), ("src/ui/a.ts", "gone/z.ts"), ("src/ui/a.ts", "src/api/inner.ts")]
    found = rules.check(spark.createDataFrame([("src/ui/a.ts",)], "path string"), edges(spark, *cases), RULES, orphans=False)
    assert {f.dataType.typeName() for f in kept["judged"].schema} == {"string", "integer"}  # no struct of either end
    got = {(r.type, r.source_layer, r.source_sublayer, r.source_feature, r.target_layer, r.target_sublayer, r.target_feature, r.line) for r in found.where("line is not null").collect()}
    assert got == {
        ("isolation", "ui", "features", "a", "ui", "features", "b", 1), ("flow", "ui", "kit", None, "ui", "features", "a", 2),
        ("unlayered", "ui", None, None, None, None, None, 3), ("publicApi", "ui", None, None, "api", None, None, 4),
    }



def test_paths(spark):
    rows = spark.createDataFrame([("src/a.test.ts",), ("src/fr/x/y.ts",), ("b.d.ts",), ("src/index.ts",)], "path string")
    path = F.col("path")
    got = [tuple(r) for r in rows.select(paths.is_test(path), paths.is_declaration(path), paths.is_entry_point(path), paths.matches(path, ["src/fr/**"]), paths.comparable(path)).collect()]
    assert got == [(True, False, True, False, "src/a.test"), (False, False, False, True, "src/fr/x/y"), (False, True, False, False, "b.d"), (False, False, True, False, "src")]


def test_frameworks(spark):
    rows = spark.createDataFrame([("app/(shop)/page.tsx",), ("src/pages/x.ts",), ("lib/x.ts",), ("src/routes/a.ts",)], "path string")
    used = {f: [r[0] for r in rows.select(frameworks.implicitly_used(F.col("path"), f)).collect()] for f in ("nextjs-app", "nextjs-pages", "node-backend", None)}
    assert used == {"nextjs-app": [True, False, False, False], "nextjs-pages": [False, True, False, False], "node-backend": [False, False, False, True], None: [False] * 4}
    assert len(frameworks.frameworks()) == 8


@pytest.mark.parametrize("pairs,components", [
    ([("a", "b"), ("b", "a")], {"a": "a", "b": "a"}), ([("a", "a")], {"a": "a"}), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], {}),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "x")], {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}),
])
def test_strong_components(spark, pairs, components):
    got = graph.strong_components(spark.createDataFrame(pairs, "s string, t string"))
    assert {r.node: r.component for r in got.collect()} == components


def test_successor_graph(spark):
    following = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6}
    rows = spark.createDataFrame(list(following.items()), "s long, t long")
    assert {r.node: r.component for r in graph.successor_cycles(rows).collect()} == {1: 1, 2: 1, 3: 1, 6: 6}
    assert {r.node: r.depth for r in graph.successor_depth(rows).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 1, 7: 2}
    assert {r.node: r.hops for r in graph.reachable(rows, spark.createDataFrame([(5,)], "node long"), 2).collect()} == {5: 0, 4: 1, 1: 2}


def test_incremental_equals_full(spark):
    state = lambda **s: spark.createDataFrame(list(s.items()), "path string, stamp int")
    changed = incremental.changes(state(a=1, b=1, c=1), state(a=1, b=2, d=1))
    assert {r.path: r.status for r in changed.collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    before = edges(spark, ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"))
    after = incremental.merged(before, edges(spark, ("b", "d"), ("d", "a")), changed)
    assert {(r.source, r.target) for r in after.collect()} == {("a", "b"), ("b", "d"), ("d", "a")}


def test_resolution(spark):
    files = spark.createDataFrame([("src/a/b.ts",), ("src/c/index.tsx",), ("src/a/b/index.ts",)], "path string")
    imports = spark.createDataFrame([("src/a/x.ts", "./b"), ("src/a/x.ts", "../c"), ("src/a/x.ts", "./b.js"), ("src/a/x.ts", "react"), ("src/a/x.ts", "./no")], "source string, specifier string")
    got = {r.specifier: (r.status, r.target) for r in resolve.resolved(imports, files).collect()}
    assert got == {"./b": ("resolved", "src/a/b.ts"), "../c": ("resolved", "src/c/index.tsx"), "./b.js": ("resolved", "src/a/b.ts"), "react": ("external", None), "./no": ("unresolved", None)}


def test_imports_of_texts(spark):
    text = "import a from './a';\n// import no from './no';\nimport type { T } from \"./t\";\n/* require('./no') */\nexport * from './e';\nconst r = require('./r'); import('./d');\nimport './s';\n"
    got = {(r.specifier, r.kind, r.is_type_only, r.line) for r in code.imports(spark.createDataFrame([("x.ts", text), ("y.ts", None)], "path string, content string")).collect()}
    assert got == {("./a", "static", False, 1), ("./t", "static", True, 3), ("./e", "reexport", False, 5), ("./r", "require", False, 6), ("./d", "dynamic", False, 6), ("./s", "static", False, 7)}


def test_flow_rules_as_rows(spark):
    texts = ["a -> b", "a->b -> c", " a <-> b ", "", " ", "a", "a -> ", "-> b", "a <- b", "a --> b", "a <-> b <-> c", "a <-> b -> c", None]
    found = {}
    for r in ruleset.flow_pairs(spark.createDataFrame([(t,) for t in texts], "rule string")).collect():
        found.setdefault(r.rule, []).append((r.from_layer, r.to_layer))

    def parsed(text):
        try:
            return ruleset.parse_flow(text or "")
        except ruleset.FlowError:
            return []

    assert found == {t: parsed(t) for t in texts if parsed(t)}


def test_places_are_compiled_and_edges_read_once(spark):
    """Places come from generated code that the JVM compiles, and what breaks a rule comes from one pass."""
    given = spark.createDataFrame([("\\src\\handlers\\c1.ts/", "//src/Services/o1.ts", "x", False, "static", 1), ("misc/a.ts", "src/shared/s1.ts", "x", False, "static", 1), (None, "src/shared/s1.ts", "x", False, "static", 1)], SCHEMA)
    rows = rules.judged(given, projection.RULES)
    assert [(r.src.layer, r.dst.layer, r.outcome) for r in rows.collect()] == [("handlers", "services", "ok"), (None, "shared", "unmapped"), (None, "shared", "unmapped")]
    text = lambda df, mode: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    steps = [line for line in text(rows, "simple").splitlines() if "Generate" in line]
    assert steps and not any("CASE" in line or "regexp" in line for line in steps), steps
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text(rules.judged(given, projection.RULES).where("outcome = 'flow'"), "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000, sizes
    assert {r.source_file for r in rules.unmapped_violations(given, projection.RULES).collect()} == {"misc/a.ts", None}


def test_ancestors_meet_layers_without_copies_of_paths(spark):
    paths_ = ["src/a/x.ts", "src/a/b/c/y.ts", "SRC\\a\\b\\z.ts", "src/ab/x.ts", "src", "src/a/x.ts", None, ""]
    layers = spark.createDataFrame([("top", "src"), ("a", "/src/a/"), ("c", "src/a/b/C")], "layer string, path string")
    files = spark.createDataFrame([(p,) for p in paths_], "path string")
    found = mapping.layers_by_prefix(files, layers)
    assert sorted(tuple(r) for r in found.collect()) == [("SRC\\a\\b\\z.ts", "a"), ("src", "top"), ("src/a/b/c/y.ts", "c"), ("src/a/x.ts", "a"), ("src/ab/x.ts", "top")]
    assert mapping.layers_by_prefix(files, layers.limit(0)).collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
