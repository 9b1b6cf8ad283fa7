"""Packages of a workspace: which there are, what their names resolve to, and rules of many packages judged at once.

Rule sets are rows here (layers, flow, limits by package), so hundreds of packages are one
plan: folders of paths meet the layers by equality, and edges the flow by anti-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.paths import normal
from tierflow.plans.ruleset import SEVERITY

#: Conditions of an export in the order in which they are taken (fixed values).
CONDITIONS = ("source", "import", "require", "default")
#: Files that stand for a package without a main file, and endings of files inside it, in the order in which they are tried (fixed values).
ENTRIES = ("src/index.ts", "src/index.tsx", "index.ts", "index.tsx")
INNER = (".ts", ".tsx", ".js", ".jsx")


def patterns_of(files: DataFrame) -> DataFrame:
    """``nth, pattern`` of the workspace whose root the paths start from, from texts (path, content).

    A ``pnpm-workspace.yaml`` counts before ``workspaces`` of ``package.json``; there the patterns are a list or a list called ``packages``.
    """
    block = F.regexp_extract("content", r"(?m)^\s*packages:[ \t]*\n((?:[ \t]*(?:[-#][^\n]*)?(?:\n|$))*)", 1)
    lines = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t]*$"), F.lit(1))
    plain = F.transform(lines, lambda x: F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2"))
    spaces = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>", {"mode": "PERMISSIVE"}), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"))
    found = files.where(F.col("path").isin("pnpm-workspace.yaml", "package.json")).select(
        F.when(F.col("path") == "package.json", 1).otherwise(0).alias("kind"), F.when(F.col("path") == "package.json", spaces).otherwise(plain).alias("patterns")
    )
    first = found.where("kind = 0 or patterns is not null").groupBy().agg(F.min_by("patterns", "kind").alias("patterns"))  # one row
    return first.select(F.posexplode("patterns").alias("nth", "pattern")).where("pattern <> ''")


def packages_of(files: DataFrame, patterns: DataFrame, exclude: bool = False) -> DataFrame:
    """``name, folder, main, nth`` of the packages whose folders fit ``patterns`` (nth, pattern), from texts (path, content) of their ``package.json``.

    A pattern is a folder, ``folder/*`` for the folders in it or has ``**`` for all below what precedes it; folders that begin
    with a dot and ``node_modules`` are left out of these. The first pattern that fits names the place; patterns with ``!`` take folders out with ``exclude`` and are
    ignored without. ``main`` is the first condition of the main export, otherwise ``module`` or ``main``.
    """
    kind = F.when(F.col("p").contains("**"), "below").when(F.col("p").endswith("/*"), "in").otherwise("at")
    base = F.when(F.col("kind") == "below", F.regexp_replace(F.substring_index("p", "**", 1), "/$", "")).when(F.col("kind") == "in", F.expr("left(p, length(p) - 2)")).otherwise(F.regexp_replace("p", "/$", ""))
    wanted = patterns.select("nth", F.col("pattern").startswith("!").alias("no"), F.regexp_replace("pattern", r"^(!|\./)+", "").alias("p")).withColumn("kind", kind).withColumn("base", base).drop("p")
    texts = files.where(F.col("path").rlike("(^|/)package[.]json$")).select(F.regexp_replace("path", "/?package[.]json$", "").alias("folder"), "content")
    parts = "split(folder, '/')"
    folders = texts.where("folder <> ''").select("folder", F.inline(F.expr(f"""concat(
        array(named_struct('kind', 'at', 'base', folder)),
        if(element_at({parts}, -1) like '.%', array(), array(named_struct('kind', 'in', 'base', array_join(slice({parts}, 1, size({parts}) - 1), '/')))),
        transform(filter(sequence(0, size({parts})), k -> not exists(slice({parts}, k + 1, size({parts}) - k), x -> x like '.%' or x = 'node_modules')),
                  k -> named_struct('kind', 'below', 'base', array_join(slice({parts}, 1, k), '/'))))""")))
    met = folders.join(wanted, ["kind", "base"]).groupBy("folder").agg(F.min(F.when(~F.col("no"), F.col("nth"))).alias("nth"), F.bool_or("no").alias("no"))
    met = met.where(F.col("nth").isNotNull() & ((~F.col("no")) if exclude else F.lit(True))).select("folder", "nth")
    dot = F.from_json(F.get_json_object("content", "$.exports"), "map<string,string>")["."]
    inner = F.from_json(dot, "map<string,string>")
    text = lambda c: F.when(~c.rlike(r"^\s*[\[{]"), c)
    main = F.coalesce(text(dot), *(text(inner[key]) for key in CONDITIONS), F.get_json_object("content", "$.module"), F.get_json_object("content", "$.main"))
    return met.join(texts, "folder").select(F.get_json_object("content", "$.name").alias("name"), "folder", main.alias("main"), "nth").where("name is not null and name <> ''")


def package_candidates(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """``source, specifier, n, path``: files that imports of packages (name, folder, main) may stand for, in order.

    The specifier's leading parts meet the names by equality. The name alone stands for the main file, or one of ``ENTRIES`` without
    one; what follows it for an ``index`` there, a file with an ending, or the path itself.
    """
    heads = F.expr("transform(sequence(1, size(split(specifier, '/'))), k -> array_join(slice(split(specifier, '/'), 1, k), '/'))")
    met = imports.select("source", "specifier").distinct().select("source", "specifier", F.explode(heads).alias("name")).join(packages.select("name", "folder", "main", "nth"), "name")
    first = met.groupBy("source", "specifier").agg(F.min(F.struct("nth", "name", "folder", "main")).alias("p")).select("source", "specifier", "p.*")
    entries = ", ".join(f"'{e}'" for e in ENTRIES)
    rest = "substring(specifier, length(name) + 2)"
    inner = ", ".join([*(f"concat({rest}, '/index{e}')" for e in INNER), *(f"concat({rest}, '{e}')" for e in INNER), rest])
    names = F.expr(f"if(specifier = name, if(main is null, array({entries}), array(main)), array({inner}))")
    each = first.select("source", "specifier", "folder", F.posexplode(names).alias("n", "file"))
    path = F.regexp_replace(F.concat_ws("/", "folder", F.regexp_replace("file", r"^(\./)+", "")), "^/", "")
    return each.select("source", "specifier", "n", path.alias("path"))


def placed_rows(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """``package, path, layer``: the layer (package, layer, path) of the longest folder of a path (package, path); null outside all."""
    every = paths.select("package", "path").distinct()
    folders = F.expr("transform(sequence(1, size(split(_n, '/'))), k -> array_join(slice(split(_n, '/'), 1, k), '/'))")
    each = every.withColumn("_n", normal(F.col("path"))).select("package", "path", F.explode(folders).alias("folder"))
    met = each.join(layers.select("package", "layer", normal(F.col("path")).alias("folder")), ["package", "folder"])
    found = met.groupBy("package", "path").agg(F.max_by("layer", F.struct(F.length("folder"), "layer")).alias("layer"))
    return every.join(found, ["package", "path"], "left")


def check_packages(edges: DataFrame, layers: DataFrame, flow: DataFrame, limits: DataFrame) -> DataFrame:
    """``package, type, severity, source_file, target_file, source_layer, target_layer, line, actual`` of all packages with a rule set.

    ``edges`` are (package, source, target, line), ``layers`` (package, layer, path), ``flow`` (package, from_layer, to_layer) the
    allowed pairs, and ``limits`` (package, unlayered, max_imports, max_dependents): error, warn or ignore for imports of files outside all layers, and
    numbers or null. A package without limits has no rule set and is not checked.
    """
    own = edges.join(limits.select("package", "unlayered", "max_imports", "max_dependents"), "package")
    ends = own.select("package", F.col("source").alias("path")).union(own.select("package", "target"))
    places = placed_rows(ends, layers)
    end = lambda name: places.select("package", F.col("path").alias(name), F.col("layer").alias(f"{name}_layer"))
    rows = own.join(end("source"), ["package", "source"]).join(end("target"), ["package", "target"])
    allowed = flow.select("package", F.col("from_layer").alias("source_layer"), F.col("to_layer").alias("target_layer"), F.lit(True).alias("allowed")).distinct()
    rows = rows.join(allowed, ["package", "source_layer", "target_layer"], "left")
    across = F.col("source_layer") != F.col("target_layer")
    said = F.when(F.col("source_layer").isNull(), "unmapped").when(F.col("target_layer").isNull() & (F.col("unlayered") != "ignore"), "unlayered").when(across & F.col("allowed").isNull(), "flow")
    level = F.when(F.col("type") == "unlayered", F.col("unlayered")).when(F.col("type") == "unmapped", SEVERITY["unmapped"]).otherwise(SEVERITY["flow"])
    columns = ("package", "type", "severity", "source_file", "target_file", "source_layer", "target_layer", "line", "actual")
    judged = rows.withColumn("type", said).where("type is not null").withColumn("severity", level)
    none = lambda kind: F.lit(None).cast(kind)
    of_edges = judged.where("type <> 'unmapped'").select("package", "type", "severity", F.col("source").alias("source_file"), F.col("target").alias("target_file"), "source_layer", "target_layer", "line", none("long").alias("actual"))
    unmapped = judged.where("type = 'unmapped'").select("package", "type", "severity", F.col("source").alias("source_file")).distinct()
    many = own.groupBy("package", "source", "max_imports").agg(F.count("*").alias("actual")).where("actual > max_imports").select("package", F.lit("importCount").alias("type"), F.lit(SEVERITY["importCount"]).alias("severity"), F.col("source").alias("source_file"), "actual")
    pairs = rows.where(across).select("package", "target_layer", "source_layer", "max_dependents").distinct()
    budget = pairs.groupBy("package", "target_layer", "max_dependents").agg(F.count("*").alias("actual")).where("actual > max_dependents")
    budget = budget.select("package", F.lit("dependentBudget").alias("type"), F.lit(SEVERITY["dependentBudget"]).alias("severity"), F.lit("").alias("source_file"), "target_layer", "actual")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [of_edges, unmapped, many, budget]).select(*columns)


def package_totals(violations: DataFrame, limits: DataFrame) -> DataFrame:
    """``package, errors, warnings, passed`` of every package with a rule set, and of all together (null)."""
    each = limits.select("package").join(violations.select("package", "severity"), "package", "left")
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warn")
    return each.groupingSets([["package"], []], "package").agg(errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("passed"))


def frameworks_of(files: DataFrame) -> DataFrame:
    """``project, framework, typescript`` of projects from their files (project, path, content); the content matters for ``package.json`` only.

    The first that fits counts: configuration files of Next, Vite, Angular and Nuxt, then what the package depends on. All
    projects are judged in one aggregation.
    """
    path = F.col("path")
    has = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    depends = F.when(path == "package.json", F.map_keys(F.map_concat(*(F.coalesce(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for k in ("dependencies", "devDependencies")))))
    rows = files.withColumn("needs", F.coalesce(depends, F.array().cast("array<string>")))
    needs = lambda *names: has(F.arrays_overlap("needs", F.array(*map(F.lit, names))))
    flags = rows.groupBy("project").agg(
        has(path == "tsconfig.json").alias("typescript"), has(path.rlike("^next[.]config[.](ts|js|mjs)$")).alias("next"), has(path.rlike("^(src/)?app/")).alias("app"), has(path.rlike("^(src/)?pages/")).alias("pages"),
        has(path.rlike("^vite[.]config[.](ts|js|mjs)$")).alias("vite"), has(path == "angular.json").alias("angular"), has(path.rlike("^nuxt[.]config[.](ts|js)$")).alias("nuxt"),
        needs("next").alias("on_next"), needs("vue", "nuxt").alias("on_vue"), needs("@angular/core").alias("on_angular"), needs("express", "fastify", "koa").alias("on_node"),
    )
    kind = (
        F.when(F.col("next"), F.when(F.col("app") | ~F.col("pages"), "nextjs-app").otherwise("nextjs-pages")).when(F.col("vite"), "vite-react").when(F.col("angular"), "angular").when(F.col("nuxt"), "vue")
        .when(F.col("on_next"), F.when(F.col("app"), "nextjs-app").otherwise("nextjs-pages")).when(F.col("on_vue"), "vue").when(F.col("on_angular"), "angular").when(F.col("on_node"), "node").otherwise("unknown")
    )
    return flags.select("project", kind.alias("framework"), "typescript")


def package_called(packages: DataFrame, name_or_path: str) -> DataFrame:
    """The package (name, folder) with this name, otherwise the first one whose folder is this path or ends with it."""
    path = name_or_path.replace("\\", "/")
    rank = F.when(F.col("name") == name_or_path, 0).when((F.col("folder") == path) | F.col("folder").endswith(f"/{path}"), 1)
    return packages.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "nth").limit(1).drop("_rank")
