"""Folders of a project: how many source files are below each, which look like layers, and what flow suits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.resolve import ancestors

#: Names of folders that are common layers, those that are never counted or never candidates, and endings of counted files (fixed values).
COMMON = tuple("app pages src components hooks utils lib services api types constants stores modules features shared common core models controllers routes middleware helpers".split())
UNCOUNTED = ("node_modules", ".git", ".next", "dist", "build")
UNFIT = ("node_modules", ".git", ".next", "dist", "build", "coverage", "__tests__", "__mocks__", ".turbo", ".cache")
COUNTED = (".ts", ".tsx", ".js", ".jsx")
#: Usual flow between common layers, one way and both ways (fixed values).
FLOW = (
    ("app", "pages"), ("pages", "components"), ("app", "components"), ("components", "hooks"), ("components", "utils"), ("components", "lib"), ("components", "services"),
    ("hooks", "api"), ("hooks", "utils"), ("hooks", "lib"), ("hooks", "services"), ("api", "utils"), ("api", "lib"), ("services", "utils"), ("services", "lib"), ("services", "models"),
    ("utils", "types"), ("lib", "types"), ("controllers", "services"), ("controllers", "models"), ("services", "models"), ("routes", "controllers"), ("middleware", "utils"),
)
BOTH = (("hooks", "stores"), ("api", "stores"))


def folder_counts(files: DataFrame) -> DataFrame:
    """``folder, n``: counted source files (path) below each folder, the root as an empty text.

    Files are counted by their own folder first; only these counts are rolled up to the folders above, so the root is no hot key.
    """
    names = "split(folder, '/')"
    own = files.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*COUNTED) & ~F.col("path").rlike(r"(^|/)\.[^/]*$")).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    fit = f"folder = '' or not exists({names}, x -> x like '.%' or x in ({', '.join(map(repr, UNCOUNTED))}))"
    counts = own.where(fit).groupBy("folder").agg(F.count("*").alias("n"))
    above = F.expr(f"if(folder = '', array(''), {ancestors("concat(folder, '/x')")})")
    return counts.select(F.explode(above).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n"))


def layer_candidates(files: DataFrame) -> DataFrame:
    """``path, name, is_common, n, subfolders, rank`` of folders that may be layers: those at the top and, inside folders called src there, up to two levels more.

    Folders with source files or a common name count. Common ones come first, then those with more files, then by path.
    """
    names = "split(path, '/')"
    folders = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("path")).where("path <> ''").distinct()
    every = folders.select(F.explode(F.expr(f"slice({ancestors("concat(path, '/x')")}, 2, 4)")).alias("path")).distinct()
    name = F.element_at(F.split("path", "/"), -1)
    every = every.where(f"not exists({names}, x -> x like '.%' or x in ({', '.join(map(repr, UNFIT))}))").withColumn("name", name)
    depth = F.size(F.split("path", "/"))
    parents = F.expr(f"slice({names}, 1, size({names}) - 1)")
    inside = every.groupBy(F.array_join(parents, "/").alias("path")).agg(F.sort_array(F.collect_set("name")).alias("subfolders"))
    fit = every.where((depth <= 3) & F.forall(parents, lambda x: x == "src"))
    common = F.col("name").isin(*COMMON)
    found = fit.join(folder_counts(files).withColumnRenamed("folder", "path"), "path", "left").join(inside, "path", "left")
    found = found.select("path", "name", common.alias("is_common"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("subfolders", F.array().cast("array<string>")).alias("subfolders")).where("n > 0 or is_common")
    place = F.struct(~F.col("is_common"), -F.col("n"), F.col("path"))
    whole = found.groupBy().agg(F.array_sort(F.collect_list(place)).alias("all"))  # folders of three levels: few, whatever the number of files
    return found.crossJoin(whole).select("path", "name", "is_common", "n", "subfolders", F.array_position("all", place).cast("int").alias("rank"))


def suggested_flow(layers: DataFrame) -> DataFrame:
    """``rule``: usual flow between the layers (name) that there are; each pair once."""
    pairs = [(a, b, f"{a} -> {b}") for a, b in dict.fromkeys(FLOW)] + [(a, b, f"{a} <-> {b}") for a, b in BOTH]
    table = layers.sparkSession.createDataFrame(pairs, "a string, b string, rule string")
    names = layers.select("name").distinct()
    return table.join(names.withColumnRenamed("name", "a"), "a", "left_semi").join(names.withColumnRenamed("name", "b"), "b", "left_semi").select("rule")
