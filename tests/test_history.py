from tierflow.operators import report, rules, workspace
from tierflow.sources import history


def test_shapes_of_a_history(spark):
    texts = ['[{"timestamp": "2024-01-02T03:04:05Z", "counts": {"flow": 2, "total": 3}, "fileCount": 7, "branch": "main"}, null]', '{"history": [{"timestamp": "2024-01-01T00:00:00Z", "report": {"counts": {"total": 1}}}]}',
             '{"timestamp": "2024-01-03T00:00:00Z", "date": "third", "commitSha": "abc"}', "{}", "no json", "[]", '{"history": []}', None, ""]
    rows = history.history_of(spark.createDataFrame([(t,) for t in texts], "content string")).orderBy("timestamp").collect()
    found = [(r.timestamp[:10], r.date, r.counts, r.files, r.imports, r.commit, r.branch) for r in rows[:3]]
    assert found == [("2024-01-01", "2024-01-01", {"total": 1}, 0, 0, None, None), ("2024-01-02", "2024-01-02", {"flow": 2, "total": 3}, 7, 0, None, "main"), ("2024-01-03", "third", {}, 0, 0, "abc", None)]
    assert len(rows) == 4 and rows[3].timestamp > "2025" and rows[3].date == rows[3].timestamp[:10]


def test_points_are_appended(spark):
    found = spark.createDataFrame([("flow", "error", "a.ts", "m"), ("flow", "error", "b.ts", "m"), ("orphan", "warn", "c.ts", "m")], "type string, severity string, source_file string, message string")
    files, edges = spark.createDataFrame([("a.ts",)], "path string"), spark.createDataFrame([("a.ts", "b.ts")] * 4, "source string, target string")
    old = history.history_of(spark.createDataFrame([('[{"timestamp": "2024-01-0%dT00:00:00Z", "counts": {"total": %d}}]' % (k, k),) for k in range(1, 6)], "content string"))
    new = history.point_of(found, files, edges, "2024-02-01T00:00:00Z", branch="main")
    assert new.first().counts == {"flow": 2, "orphan": 1, "total": 3} and (new.first().files, new.first().imports) == (1, 4)
    assert [r.date for r in history.appended(old, new, 3).orderBy("date").collect()] == ["2024-01-04", "2024-01-05", "2024-02-01"]
    nothing = history.point_of(found.limit(0), files, edges, "2024-02-01T00:00:00Z").first()
    assert nothing.counts == {"total": 0}


def test_ci_lines(spark):
    rows = rules.violations(spark.createDataFrame([("flow", "error", 3), ("circular", "error", None), ("orphan", "warn", None)], "t string, s string, l int"), rules.F.col("t"), rules.F.col("s"), source_file=rules.F.lit("a.ts"), source_layer=rules.F.lit("x"), target_layer=rules.F.lit("y"), line=rules.F.col("l"), message=rules.F.lit("m"))
    assert {r.line for r in report.ci_lines(rows).collect()} == {
        "::error file=a.ts,line=3,title=Layer violation: x → y::m", "::error file=a.ts,line=1,title=Circular dependency::m", "::warning file=a.ts,line=1,title=Architecture violation::m", "::notice::Found 3 violation(s): 2 error(s), 1 warning(s)",
    }
    assert [r.line for r in report.ci_lines(rows.limit(0)).collect()] == ["::notice::No architectural violations found"]


def test_frameworks_of_projects(spark):
    files = {
        "a": [("next.config.ts", None)], "b": [("package.json", '{"dependencies": {"next": "1"}}'), ("src/app/x.ts", None)], "c": [("package.json", "broken"), ("tsconfig.json", None)],
        "d": [("package.json", '{"devDependencies": {"@angular/core": "1", "express": "2"}}')], "e": [("sub/vite.config.ts", None)],
    }
    rows = spark.createDataFrame([(p, *f) for p, own in files.items() for f in own], "project string, path string, content string")
    assert {r.project: (r.framework, r.typescript) for r in workspace.frameworks_of(rows).collect()} == {"a": ("nextjs-app", False), "b": ("nextjs-app", False), "c": ("unknown", True), "d": ("angular", False), "e": ("unknown", False)}
    packages = spark.createDataFrame([("kit", "packages/kit", 1), ("x", "kit", 0), ("y", "packages/tool", 2)], "name string, folder string, nth int")
    assert [workspace.package_called(packages, n).first().folder for n in ("kit", "tool", "packages/tool")] == ["packages/kit", "packages/tool", "packages/tool"]
    assert workspace.package_called(packages, "ool").first() is None
