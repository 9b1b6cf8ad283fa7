"""The star schema as a dependency graph: customers use orders, orders use parts, parts use suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.plans.ruleset import Layer, RuleSet, Sublayer, flow_pairs

#: Source texts that a task makes and reads.
TEXTS = 10_000

RULES = RuleSet(
    layers=(
        Layer("handlers", "src/handlers"),
        Layer("services", "src/services", max_dependents=1),
        Layer("repository", "src/repository", (Sublayer("features", "src/repository/features", True), Sublayer("common", "src/repository/common")), ("features -> common",)),
        Layer("shared", "src/shared", public_api=("s1.ts", "src/shared/s2.ts")),
    ),
    flow=("handlers -> services -> repository -> shared",),
    max_imports=20,
    exceptions=(("src/services/**", "src/misc/*"),),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(folder, key):
    return F.concat(F.lit(folder), key.cast("string"), F.lit(".ts"))


def _paths(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Key and path of each table's files."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("src/handlers/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey"), F.lit(".ts")).alias("c_path"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "STANDARD", _file("src/repository/common/p", F.col("p_partkey")))
        .otherwise(F.concat(F.lit("src/repository/features/"), F.col("p_brand"), F.lit("/p"), F.col("p_partkey"), F.lit(".ts"))).alias("p_path"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nation), "s_nationkey")  # 25 nations
    supplier = supplier.select("s_suppkey", F.concat(F.when(F.col("n_regionkey") == 0, "src/misc/s").otherwise("src/shared/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("s_path"))
    return {"customer": customer, "part": part, "supplier": supplier}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` of every file."""
    own = _paths(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(_file("src/services/o", F.col("o_orderkey")).alias("path"))
    return own["customer"].select(F.col("c_path").alias("path")).union(orders).union(own["part"].select("p_path")).union(own["supplier"].select("s_path"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, target, specifier, is_type_only, kind, line`` of every import."""
    own = _paths(spark, sf_dir)
    kinds = F.when(F.col("l_returnflag") == "A", "static").when(F.col("l_returnflag") == "N", "dynamic").otherwise("reexport")
    order = lambda key: _file("src/services/o", F.col(key))
    plain = (F.lit(False).alias("is_type_only"), F.lit("static").alias("kind"), F.lit(1).alias("line"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(own["customer"], "c_custkey")
    lines = table(spark, sf_dir, "lineitem")
    with_part = lines.join(own["part"], lines.l_partkey == own["part"].p_partkey)
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate")
    # an edge to the part and one from it to the next part of the order, from the same row
    plain_next = F.struct(F.col("p_path").alias("source"), F.col("next").alias("target"), F.lit("next").alias("specifier"), *plain)
    own_part = F.struct(order("l_orderkey").alias("source"), F.col("p_path").alias("target"), F.lit("part").alias("specifier"), (F.col("l_linestatus") == "O").alias("is_type_only"), kinds.alias("kind"), F.col("l_linenumber").cast("int").alias("line"))
    lined = with_part.withColumn("next", F.lead("p_path").over(after)).select(F.inline(F.when(F.col("next").isNull(), F.array(own_part)).otherwise(F.array(own_part, plain_next))))
    supplied = with_part.select("p_path", F.col("l_suppkey").alias("s_suppkey")).distinct().join(own["supplier"], "s_suppkey")
    back = lines.where("l_discount >= 0.1 and l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(own["supplier"], "s_suppkey")
    parts = [
        orders.select(F.col("c_path").alias("source"), order("o_orderkey").alias("target"), F.lit("order").alias("specifier"), *plain),
        lined,
        supplied.select(F.col("p_path").alias("source"), F.col("s_path").alias("target"), F.lit("supplier").alias("specifier"), *plain),
        back.select(F.col("s_path").alias("source"), order("l_orderkey").alias("target"), F.lit("back").alias("specifier"), *plain),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def successor_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, t``: every part points to one part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ends = part.agg(F.min("p_partkey").alias("low"), F.count("*").alias("n"))
    return part.crossJoin(F.broadcast(ends)).select(F.col("p_partkey").alias("s"), ((F.col("p_partkey") * 3 + F.col("p_size")) % F.col("n") + F.col("low")).alias("t"))  # one row


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, k``: a module for each part; 48 neighbours are a package, ``k`` is the place in it."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr("cast(p_partkey % 48 as int)").alias("k"), "p_size")


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, target, specifier, is_type_only, kind, line`` of a graph of as many modules as there are parts, with chains, cycles and loops inside packages."""
    part = _modules(spark, sf_dir)
    forward = part.where("k + 4 + p_size % 6 < 48").select("key", F.expr("key + 4 + p_size % 6").alias("to"))
    ends = forward.union(part.where("p_size % 10 = 7").select("key", F.expr("key - k % 12")))
    ends = ends.distinct().join(part.select(F.col("key").alias("to")).hint("merge"), "to", "left_semi")
    name = lambda c: _module_path(F.col(c))
    return ends.select(name("key").alias("source"), name("to").alias("target"), F.lit("module").alias("specifier"), F.lit(False).alias("is_type_only"), F.lit("static").alias("kind"), F.lit(1).alias("line"))


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` of the modules and of three files that look like entry points."""
    modules = _modules(spark, sf_dir).select(_module_path(F.col("key")).alias("path"))
    return modules.union(spark.createDataFrame([("src/index.ts",), ("src/app.tsx",), ("src/app/x.ts",)], "path string"))


def _module_path(number: Column) -> Column:
    key, k = number.cast("string"), number % 48
    return F.concat(
        F.when(k < 12, F.lit("src/handlers/auto/c")).when(k < 24, F.lit("src/services/o")).when((k < 36) & (k % 2 == 0), F.lit("src/repository/common/p"))
        .when(k < 36, F.concat(F.lit("src/repository/features/b"), (k % 4).cast("string"), F.lit("/p"))).when(k % 7 == 0, F.lit("src/misc/s")).otherwise(F.lit("src/shared/s")),
        key, F.lit(".ts"),
    )


def module_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: a source text for each part. What looks like an import in its comments, strings and templates is none.

    Odd parts are barrels (index files) that re-export the next one under another name. Aliases of ``@/`` are mapped by ``tsconfig.json``.
    Parts are dealt to as many tasks as their number asks for: a row is small, and a scan leaves them to one task, but its text is long to read.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ends = part.agg(F.max("p_partkey").alias("top"))
    rows = part.repartition(part.count() // TEXTS + 1, "p_partkey").crossJoin(F.broadcast(ends))  # one row
    to = "((p_partkey * 7 + p_size) % top + 1)"
    place = lambda k: f"if({k} % 2 = 1, concat('lib/b', {k}, '/index.ts'), concat('lib/m', {k}, '.ts'))"
    name = lambda k: f"if({k} % 2 = 1, concat('b', {k}), concat('m', {k}))"
    plain = f"""concat('// import no from "./no1"\\n/* import no from "./no2" */ const s = "import no from \\'./no3\\'"\\n',
        'import {{ a', p_partkey % 3, ' as x }} from "', if(p_size % 2 = 0, '@/', './'), {name(to)}, '"\\n',
        if(p_size % 5 = 0, 'const t = `$' || '{{ import("react") }} import no from "./no4"`\\n', ''), if(p_size % 7 = 0, 'import type {{ T }} from "./gone', ''), if(p_size % 7 = 0, concat(p_partkey, '"\\n'), ''), 'export const a', p_partkey % 3, ' = /"import/')"""
    barrel = f"""concat('export {{ a', p_partkey % 3, ' as a0, a1 }} from "../', {name('(p_partkey % top + 1)')}, '"\\nexport * from "../', {name(to)}, '"\\n')"""
    text = F.struct(F.expr(place("p_partkey")).alias("path"), F.expr(f"if(p_partkey % 2 = 1, {barrel}, {plain})").alias("content"))
    texts = rows.select(F.inline(F.array(text)))  # conditions on paths are not moved from here to the few tasks of the scan
    config = spark.createDataFrame([("tsconfig.json", '{ // aliases\n "compilerOptions": { "paths": { "@/*": ["lib/*"], }, } }')], "path string, content string")
    return texts.union(config)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, version, deleted, content``: several versions of the file of each part; some are deleted at last."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ends = part.agg(F.max("p_partkey").alias("top"))
    rows = part.crossJoin(F.broadcast(ends))  # one row
    versions = "filter(array(if(p_partkey % 4 = 0, 0, null), 1, if(p_partkey % 3 = 0, 2, null), if(p_partkey % 11 = 0, 3, null)), v -> v is not null)"
    each = rows.select("*", F.explode(F.expr(versions)).alias("v"))
    to = "case v when 0 then 'old' when 1 then concat('f', (p_partkey * 3 + p_size) % top + 1) when 2 then concat('f', (p_partkey * 7) % top + 1) else 'none' end"
    return each.select(F.expr("concat('src/f', p_partkey, '.ts')").alias("path"), F.col("v").cast("long").alias("version"), (F.col("v") == 3).alias("deleted"), F.expr(f"""concat('import x from "./', {to}, '" // import no from "./no"')""").alias("content"))


def rule_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, layers, allowed flow and limits of a package for every 48 parts; the rules differ from package to package."""
    edges = module_edges(spark, sf_dir).withColumn("package", F.expr("cast(cast(regexp_extract(source, '([0-9]+)[.]ts$', 1) as long) div 48 as string)")).select("package", "source", "target", "line")
    packages = edges.select("package").distinct().withColumn("k", F.col("package").cast("long"))
    folders = "array(named_struct('layer', 'handlers', 'path', 'src/handlers'), named_struct('layer', 'services', 'path', 'src/services'), named_struct('layer', 'repository', 'path', 'src/repository'), named_struct('layer', if(k % 2 = 0, 'shared', 'tools'), 'path', 'src/shared'))"
    layers = packages.select("package", F.inline(F.expr(folders)))
    rules = F.expr("if(k % 3 = 0, array('handlers -> services -> repository', concat('repository -> ', if(k % 2 = 0, 'shared', 'tools'))), array('handlers -> services', 'services <-> repository'))")
    flow = flow_pairs(packages.select("package", F.explode(rules).alias("rule"))).select("package", "from_layer", "to_layer")
    limits = packages.where("k % 5 <> 4").select("package", F.expr("case k % 4 when 0 then 'error' when 1 then 'warn' else 'ignore' end").alias("unlayered"), F.expr("if(k % 2 = 0, 1, null)").alias("max_imports"), F.expr("if(k % 3 = 1, 0, null)").alias("max_dependents"))
    return edges, layers, flow, limits
