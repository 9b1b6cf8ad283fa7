import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators import barrels, resolve
from tierflow.plans import compiler, projection
from tierflow.sources import code
from tierflow.sources.lexer import exports_of, imports_of

TEXT = r"""import a from './a' // import no from './no1'
import type { T } from "./t";
import type from './type'
import type, { q } from './type2'
import * as ns from './ns'
import d, { x as y, type Z } from './d'
import './side'
const s = "import x from 'y'", u = '/*', esc = 'it\'s'
import after from './after'
/* import z from './no2' */
foo.import("./no3"); foo?.import('./no4'); module.require('./no5')
const l = () => import("./lazy"); await import('./lazy2', { with: {} })
const r = require('./req')
export * from './all'
export * as space from './space'
export { a as b, default as c } from './named'
export type { T2 } from './t2'
export { local }
export const k = `import x from './no6' ${require('./inner') + `n ${import("./deep")} }`} export * from './no7'`
const re = /import y from '.\/no8'/g, dv = a / b / c; import('./no' + y); require(`./no9`)
import eq = require('./no10')
if (x) return /["'`/*]/.test(s) / 2
import {
  multi
} from './multi'
function require(x) { return import.meta.url }
const o = { import: 'x', export: 'y' }, broken = "unclosed
import end from './end'
/* never closed import no from './no11'"""
FOUND = [
    ("./a", "static", False, 1, 0, [("default", "a")]), ("./t", "static", True, 2, 0, [("T", "T")]), ("./type", "static", False, 3, 0, [("default", "type")]),
    ("./type2", "static", False, 4, 0, [("default", "type"), ("q", "q")]), ("./ns", "static", False, 5, 0, [("*", "ns")]), ("./d", "static", False, 6, 0, [("default", "d"), ("x", "y"), ("Z", "Z")]),
    ("./side", "static", False, 7, 0, []), ("./after", "static", False, 9, 0, [("default", "after")]), ("./lazy", "dynamic", False, 12, 16, []), ("./lazy2", "dynamic", False, 12, 40, []),
    ("./req", "require", False, 13, 10, []), ("./all", "reexport", False, 14, 0, [("*", "*")]), ("./space", "reexport", False, 15, 0, [("*", "space")]),
    ("./named", "reexport", False, 16, 0, [("a", "b"), ("default", "c")]), ("./t2", "reexport", True, 17, 0, [("T2", "T2")]), ("./inner", "require", False, 19, 42, []), ("./deep", "dynamic", False, 19, 68, []),
    ("./multi", "static", False, 23, 0, [("multi", "multi")]), ("./end", "static", False, 28, 0, [("default", "end")]),
]


def test_lexer():
    assert [tuple(i) for i in imports_of(TEXT)] == FOUND
    assert imports_of(None) == imports_of("") == imports_of("import") == imports_of("export {") == imports_of("import { a") == imports_of("require(") == []
    assert imports_of("`${`") == [] and len(imports_of("import './x';\n" * 3000)) == 3000


def test_lexer_reads_any_text():
    pick = random.Random(4)
    parts = ["import", "export", " from ", "'x'", '"', "'", "`", "${", "}", "{", "/", "*", "//", "\n", "a", "(", ")", "require", "\\", "type", ",", "as", "é", "\u2028"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        assert all(1 <= i.line <= text.count("\n") + 1 for i in imports_of(text)) and isinstance(exports_of(text), list)


def test_exports():
    text = "export const a = 1; export async function* f() {}\nexport default class X {}\nexport { b as c, d }; export { no } from './x'; export * from './y'\nexport type T = 1; export const enum E {}; foo.export = 3; export abstract class K {} // export const no2"
    assert exports_of(text) == ["a", "f", "default", "c", "d", "T", "E", "K"]


def test_imports_as_rows(spark):
    files = spark.createDataFrame([("x.ts", TEXT), ("y.ts", None)], "path string, content string")
    rows = code.imports(files).orderBy("line", "column").collect()
    assert [(r.specifier, r.kind, r.is_type_only, r.line, r.column, [tuple(n) for n in r.names]) for r in rows] == FOUND
    assert code.imports(files, require=False).where("kind = 'require'").count() == 0
    assert [r.path for r in code.errors(files).collect()] == ["y.ts"]


def test_texts_are_read_by_many_tasks(spark, tmp_path):
    parts = spark.range(1, 20_001).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    texts = projection.module_texts(spark, str(tmp_path))
    kept = code.scanned(texts).where("status = 'file'")
    read = code.imports(kept).groupBy(F.spark_partition_id()).agg(F.count_distinct("source").alias("n")).collect()
    assert sum(r.n for r in read) == 20_000 and max(r.n for r in read) < 12_000
    below = kept._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")[2].partition("Relation")[0]
    assert below and "regexp_extract" not in below  # the scan's tasks judge no paths


def test_order_of_candidates(spark):
    names = ["a/x.js", "a/x.mts", "a/y.mts", "a/y/index.ts", "a/z.tsx", "a/z.jsx", "a/w.ts", "a/w.js", "a/v.mts", "a/v.mjs", "a/k.cjs", "a/data.json", "a/u/index.cjs", "root.ts"]
    wanted = {"./x": "a/x.js", "./y": "a/y/index.ts", "./z.jsx": "a/z.tsx", "./w.js": "a/w.ts", "./v.mjs": "a/v.mts", "./k": "a/k.cjs", "./data.json": "a/data.json", "./u": "a/u/index.cjs", "../root": "root.ts", "./w.ts": "a/w.ts", "/root": "root.ts", "./none": None, "../../../root": "root.ts"}
    imports = spark.createDataFrame([("a/m.ts", s) for s in wanted], "source string, specifier string")
    found = {r.specifier: r.target for r in resolve.resolved(imports, spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert found == wanted


CONFIGS = {
    "tsconfig.json": '{ // root\n "extends": "./base", "references": [{ "path": "./lib" }], "compilerOptions": { "baseUrl": "src", "paths": { "@/*": ["*", "gen/*"], "@/ui/*.css": ["styles/*"], "exact": ["one/exact.ts",], } } }',
    "base.json": '{ "compilerOptions": { "paths": { "hidden/*": ["no/*"] } } }',
    "lib/tsconfig.json": '{ "references": [{ "path": ".." }, { "path": "./deep/tsconfig.json" }, { "path": "./gone" }], "compilerOptions": { "paths": { "lib/*": ["code/*"], "@/*": ["alt/*"] } } }',
    "lib/deep/tsconfig.json": '{ "compilerOptions": { "baseUrl": "..", "paths": { "deep": ["deep/main.ts"] } } }',
    "app/tsconfig.json": '{ "extends": "../lib/tsconfig" }',
    "app/inner/tsconfig.json": '{ "extends": "../tsconfig.json", "compilerOptions": { "paths": { "~*": ["./*"] } } }',
    "bad/tsconfig.json": "{ no json",
    "loop/tsconfig.json": '{ "extends": "./other.json" }',
    "loop/other.json": '{ "extends": "./tsconfig.json" }',
}


def test_path_mappings(spark):
    configs = spark.createDataFrame(list(CONFIGS.items()), "path string, content string")
    table = compiler.path_mappings(configs)
    found = {}
    for r in table.orderBy("nth").collect():
        found.setdefault(r.folder, {}).setdefault(r.pattern, []).append(r.target)
    root = {"@/*": ["src/*", "src/gen/*", "lib/alt/*"], "@/ui/*.css": ["src/styles/*"], "exact": ["src/one/exact.ts"], "lib/*": ["lib/code/*"], "deep": ["lib/deep/main.ts"]}
    assert found[""] == root
    assert found["lib"] == {**root, "@/*": ["lib/alt/*", "src/*", "src/gen/*"]}
    assert found["lib/deep"] == {"deep": ["lib/deep/main.ts"]}
    assert found["app"] == {"lib/*": ["lib/code/*"], "@/*": ["lib/alt/*"]}
    assert found["app/inner"] == {"~*": ["app/inner/./*"]} and set(found) == {"", "lib", "lib/deep", "app", "app/inner"}
    files = ["src/a.ts", "src/gen/b.ts", "src/styles/main.ts", "src/one/exact.ts", "lib/code/c/index.ts", "lib/alt/a.ts", "app/inner/q.ts", "src/ui/z.css.ts"]
    cases = {
        ("src/m.ts", "@/a"): "src/a.ts", ("src/m.ts", "@/b"): "src/gen/b.ts", ("src/m.ts", "@/ui/main.css"): "src/styles/main.ts", ("src/m.ts", "exact"): "src/one/exact.ts", ("src/m.ts", "exact2"): None,
        ("app/m.ts", "@/a"): "lib/alt/a.ts", ("lib/x/m.ts", "@/a"): "lib/alt/a.ts", ("lib/x/m.ts", "lib/c"): "lib/code/c/index.ts", ("app/inner/m.ts", "~q"): "app/inner/q.ts", ("app/inner/m.ts", "@/a"): None, ("src/m.ts", "react"): None,
    }
    imports = spark.createDataFrame(list(cases), "source string, specifier string")
    rows = resolve.resolved(imports, spark.createDataFrame([(f,) for f in files], "path string"), table).collect()
    assert {(r.source, r.specifier): r.target for r in rows} == cases
    assert {r.status for r in rows} == {"resolved", "external"}


def brute_origins(start, links, exports):
    """Origins of (file, name) by search, one pair at a time."""
    out, seen, todo = set(), set(), [start]
    while todo:
        file, name = todo.pop()
        if (file, name) in seen:
            continue
        seen.add((file, name))
        own = [link for link in links if link[0] == file and link[1] != file]
        if exports is None:
            out |= {(file, name)} if not own else set()
        elif any(f == file and name in ("*", n) for f, n in exports):
            out.add((file, name))
        named = [link for link in own if link[3] == name and name != "*"]
        for _, target, there, here in own if name == "*" else named or [link for link in own if link[3] == "*" and name != "default"]:
            todo.append((target, name if here == "*" and name != "*" else there))
    return out


@pytest.mark.parametrize("with_exports", [False, True])
def test_names_through_barrels(spark, with_exports):
    pick = random.Random(7)
    files, names = [f"f{k}" for k in range(14)], ["a", "b", "c", "default"]
    links = {(pick.choice(files[:9]), pick.choice(files), *pick.choice([("*", "*"), ("*", "ns"), ("*", "a"), (pick.choice(names), pick.choice(names)), (pick.choice(names), pick.choice(names))])) for _ in range(26)}
    exports = {(pick.choice(files), pick.choice(names)) for _ in range(25)} if with_exports else None
    wanted = [(f, n) for f in files for n in [*names, "ns", "*"]]
    reexports = spark.createDataFrame([(f, t, [(a, b)]) for f, t, a, b in links], "source string, target string, names array<struct<name:string,as:string>>")
    own = spark.createDataFrame(sorted(exports), "file string, name string") if exports else None
    found = barrels.origins_of_names(spark.createDataFrame(wanted, "file string, name string"), reexports, own).collect()
    assert {tuple(r) for r in found} == {(*w, *o) for w in wanted for o in brute_origins(w, links, exports)}


def test_origin_edges(spark):
    struct = "array<struct<name:string,as:string>>"
    edges = spark.createDataFrame([("m.ts", "lib/index.ts", [("a", "x")], 1), ("m.ts", "lib/index.ts", None, 2), ("m.ts", "lib/plain.ts", [("a", "a")], 3), ("lib/two.ts", "lib/index.ts", [("b", "b")], 4)], f"source string, target string, names {struct}, line int")
    again = spark.createDataFrame([("lib/index.ts", "lib/one.ts", [("default", "a")]), ("lib/index.ts", "lib/two.ts", [("*", "*")]), ("lib/two.ts", "lib/index.ts", [("*", "*")])], f"source string, target string, names {struct}")
    found = {(r.source, r.target, r.line) for r in barrels.origin_edges(edges, again).collect()}
    assert found == {("m.ts", "lib/one.ts", 1), ("m.ts", "lib/one.ts", 2)}
    assert barrels.origin_edges(edges, again).columns == edges.columns
