import json

import pytest
from pyspark.sql import functions as F

from tierflow.functions import frameworks
from tierflow.operators import folders, report, resolve, workspace
from tierflow.plans import project, ruleset

TEXTS = {
    "tsconfig.json": '{ "compilerOptions": { "paths": { "@/*": ["src/*"] } } }',
    "package.json": '{ "name": "root", "workspaces": ["packages/*", "!packages/old", "deep/**"] }',
    "packages/kit/package.json": '{ "name": "@own/kit", "main": "./lib/main.ts", "exports": { ".": { "require": "./no.ts", "import": "./src/start.ts" } } }',
    "packages/kit/src/start.ts": "export const start = 1",
    "packages/kit/tools/index.ts": "",
    "packages/old/package.json": '{ "name": "old" }',
    "packages/old/src/index.tsx": "",
    "deep/a/b/package.json": '{ "name": "b", "module": "m.js" }',
    "deep/a/node_modules/c/package.json": '{ "name": "c" }',
    "other/package.json": '{ "name": "other" }',
    "packages/bad/package.json": "no json",
    "src/ui/page.ts": "import { load } from '@/core/index'\nimport type { T } from '../core/types'\nimport { start } from '@own/kit'\nimport '@own/kit/tools'\nimport o from 'old'\nimport react from 'react'\nimport './none'\nconst b = import('./page')",
    "src/core/index.ts": "export { get as load } from '../data/db'\nexport * from './types'",
    "src/core/types.ts": "export type T = 1; import '../ui/page'",
    "src/data/db.ts": "export const get = 1; require('../core/types')",
    "src/ui/page.test.ts": "import './page'",
    "node_modules/x/index.ts": "import './y'",
}
RULES = ruleset.from_dict({"layers": {"ui": {"path": "src/ui"}, "core": {"path": "src/core"}, "data": {"path": "src/data"}, "kit": {"path": "packages"}}, "flow": ["ui -> core -> data", "ui -> kit"]})


def texts(spark):
    return spark.createDataFrame([*TEXTS.items(), ("src/core/binary.ts", None)], "path string, content string")


def test_whole_build(spark):
    built = project.build(texts(spark))
    assert {r.path for r in built.files.collect()} == {p for p in TEXTS if p.endswith((".ts", ".tsx")) and "test" not in p and "node_modules" not in p} | {"src/core/binary.ts"}
    found = {(r.source, r.specifier): (r.status, r.target) for r in built.statuses.collect()}
    assert {s: t for (f, s), t in found.items() if f == "src/ui/page.ts"} == {
        "@/core/index": ("resolved", "src/core/index.ts"), "../core/types": ("resolved", "src/core/types.ts"), "@own/kit": ("resolved", "packages/kit/src/start.ts"), "@own/kit/tools": ("resolved", "packages/kit/tools/index.ts"),
        "old": ("resolved", "packages/old/src/index.tsx"), "react": ("external", None), "./none": ("unresolved", None), "./page": ("resolved", "src/ui/page.ts"),
    }
    assert [tuple(r) for r in built.unresolved().collect()] == [("src/ui/page.ts", "./none")] and [r[0] for r in built.externals().collect()] == ["react"]
    assert [r.path for r in built.errors.collect()] == ["src/core/binary.ts"]
    plain = {(r.type, r.source_file, r.target_file) for r in project.check_project(built, RULES).collect()}
    assert ("flow", "src/core/types.ts", "src/ui/page.ts") in plain and ("flow", "src/data/db.ts", "src/core/types.ts") in plain and ("flow", "src/ui/page.ts", "src/data/db.ts") not in plain
    assert any(t == "circular" for t, _, _ in plain)
    traced = {(r.type, r.source_file, r.target_file) for r in project.check_project(built, RULES, origin=True, circular=False).collect()}
    assert ("flow", "src/ui/page.ts", "src/data/db.ts") in traced
    rows = project.check_project(built, RULES)
    cycle = [json.loads(r.json) for r in report.json_of(rows).collect() if '"circular"' in r.json]
    assert cycle and cycle[0]["cyclePath"][0] == cycle[0]["cyclePath"][-1] and "sourceFeature" not in cycle[0]
    assert {r.label for r in report.type_chart(rows).collect()} <= set(report.LABELS.values())


def test_files_of_a_folder(spark, tmp_path):
    for path, text in TEXTS.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/core/binary.ts").write_bytes(b"import '\xff\xfe'")
    built = project.build(project.texts_of(spark, str(tmp_path)))
    assert built.edges.count() == project.build(texts(spark)).edges.count() and [r.path for r in built.errors.collect()] == ["src/core/binary.ts"]


def test_packages(spark):
    patterns = workspace.patterns_of(texts(spark))
    assert [tuple(r) for r in patterns.orderBy("nth").collect()] == [(0, "packages/*"), (1, "!packages/old"), (2, "deep/**")]
    found = {r.name: (r.folder, r.main) for r in workspace.packages_of(texts(spark), patterns).collect()}
    assert found == {"@own/kit": ("packages/kit", "./src/start.ts"), "old": ("packages/old", None), "b": ("deep/a/b", "m.js")}
    assert {r.name for r in workspace.packages_of(texts(spark), patterns, exclude=True).collect()} == {"@own/kit", "b"}
    yaml = spark.createDataFrame([("pnpm-workspace.yaml", "x: 1\npackages:\n  - 'a/*'\n# note\n\n  - \"b\"\n  - c/**\nother:\n  - no\n"), ("package.json", '{"workspaces": {"packages": ["z"]}}')], "path string, content string")
    assert [r.pattern for r in workspace.patterns_of(yaml).orderBy("nth").collect()] == ["a/*", "b", "c/**"]
    assert [r.pattern for r in workspace.patterns_of(yaml.where("path = 'package.json'")).collect()] == ["z"]


def test_many_rule_sets(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = frame([("p", "a/x.ts", "b/y.ts", 1), ("p", "b/y.ts", "a/x.ts", 2), ("p", "o.ts", "a/x.ts", 3), ("q", "a/x.ts", "b/y.ts", 1), ("q", "a/x.ts", "o.ts", 2), ("q", "b/y.ts", "a/x.ts", 1), ("r", "a/x.ts", "b/y.ts", 1)], "package string, source string, target string, line int")
    layers = frame([("p", "one", "a"), ("p", "two", "b"), ("q", "one", "A/"), ("q", "two", "b"), ("q", "three", "b/y.ts")], "package string, layer string, path string")
    flow = frame([("p", "one", "two"), ("q", "one", "three")], "package string, from_layer string, to_layer string")
    limits = frame([("p", "error", None, None), ("q", "warn", 1, 0), ("s", "error", 1, 1)], "package string, unlayered string, max_imports int, max_dependents int")
    found = workspace.check_packages(edges, layers, flow, limits)
    assert sorted((r.package, r.type, r.source_file, r.target_file, r.severity) for r in found.collect()) == sorted([
        ("p", "flow", "b/y.ts", "a/x.ts", "error"), ("p", "unmapped", "o.ts", None, "warn"), ("q", "unlayered", "a/x.ts", "o.ts", "warn"), ("q", "importCount", "a/x.ts", None, "warn"),
        ("q", "flow", "b/y.ts", "a/x.ts", "error"), ("q", "dependentBudget", "", None, "warn"), ("q", "dependentBudget", "", None, "warn"),
    ])
    assert {tuple(r) for r in workspace.package_totals(found, limits).collect()} == {("p", 1, 1, False), ("q", 1, 4, False), ("s", 0, 0, True), (None, 2, 5, False)}


def test_folders(spark):
    paths = ["src/app/a.ts", "src/app/in/b.tsx", "src/app/in/c.css", "src/src/lib/d.js", "lib/e.mts", "tools/f.js", ".hidden/g.ts", "src/dist/h.ts", "i.ts", "docs/j.md", "hooks/k.jsx", "stores/l.ts", "src/app/.m.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    counts = {r.folder: r.n for r in folders.folder_counts(files).collect()}
    assert counts == {"": 7, "src": 3, "src/app": 2, "src/app/in": 1, "src/src": 1, "src/src/lib": 1, "tools": 1, "hooks": 1, "stores": 1}
    rows = folders.layer_candidates(files).orderBy("rank").collect()
    assert [(r.path, r.is_common, r.n) for r in rows] == [("src", True, 3), ("src/app", True, 2), ("hooks", True, 1), ("src/src", True, 1), ("src/src/lib", True, 1), ("stores", True, 1), ("lib", True, 0), ("tools", False, 1)]
    assert rows[0].subfolders == ["app", "src"]
    names = spark.createDataFrame([(r.name,) for r in rows], "name string")
    assert {r.rule for r in folders.suggested_flow(names).collect()} == {"hooks -> lib", "hooks <-> stores"}


@pytest.mark.parametrize("framework, used, unused", [
    ("nextjs-app", ["app/page.tsx", "src/app/(shop)/cart/layout.js", "middleware.ts"], ["app/util.ts", "page.tsx", "lib/app/page.tsx"]),
    ("nextjs-pages", ["pages/a/b.tsx", "src/pages/x.js", "src/middleware.ts"], ["lib/pages/x.ts", "pages/style.css"]),
    ("vite-react", ["src/main.tsx", "index.html", "vite.config.ts"], ["main.tsx", "src/app.tsx"]),
    ("vite-react-router", ["src/routes/a.tsx", "src/root.tsx", "src/router.ts"], ["routes/a.tsx", "src/root.ts"]),
    ("vite-tanstack-router", ["src/routeTree.gen.ts", "src/routes/__root.tsx"], ["src/tree.gen.ts"]),
    ("node-backend", ["server.js", "src/app.ts", "x.config.mjs", "lib/routes/a.ts"], ["src/lib/app.ts", "migrations/a.ts"]),
    ("vue-nuxt", ["vue.config.js", "vue.config.ts", "vite.config.ts", "nuxt.config.js", "src/main.js", "a/b.vue", "src/pages/x.ts", "server/api.ts"], ["vite.config.mjs", "vue.config.mjs", "src/lib/x.ts"]),
    ("angular", ["src/main.ts", "angular.json", "src/x/y.service.ts", "src/environments/e.ts"], ["src/x/y.ts", "main.ts"]),
])
def test_frameworks_one_by_one(spark, framework, used, unused):
    rows = spark.createDataFrame([(p,) for p in used + unused], "path string")
    found = {r.path for r in rows.where(frameworks.implicitly_used(F.col("path"), framework)).collect()}
    assert found == set(used)
