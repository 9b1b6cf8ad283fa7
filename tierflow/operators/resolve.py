"""Resolution of specifiers to files: the first candidate that exists.

Candidates of an import meet the files in one equi-join and the earliest wins, so a
specifier costs as many rows as it has candidates, whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.functions.paths import is_external
from tierflow.operators.workspace import package_candidates

#: Endings of the compiler's own resolution and those of the fallback after it, each in the order in which they are tried (fixed values).
FIRST = (".ts", ".tsx", ".d.ts", ".js", ".jsx")
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs")


def _plain(path: str) -> str:
    """SQL for a path without ``.``, ``..`` and empty parts."""
    parts = f"filter(split({path}, '/'), p -> p not in ('', '.'))"
    return f"array_join(aggregate({parts}, cast(array() as array<string>), (done, p) -> if(p = '..', slice(done, 1, greatest(size(done) - 1, 0)), array_append(done, p))), '/')"


def _joined(source: str, specifier: str) -> str:
    """SQL for the path that a relative specifier names."""
    return _plain(f"if({specifier} like '/%', {specifier}, concat(regexp_replace({source}, '[^/]*$', ''), {specifier}))")


def _candidates(base: str) -> str:
    """SQL for the array of files that a path may stand for, in order.

    A compiled ending stands for what it is compiled from, and then for itself; without one
    the endings of ``FIRST`` are added, to the path and to an ``index`` in it. What the
    compiler does not find is looked for with ``ENDINGS`` in the same two places.
    """
    added = lambda stem, ends: ", ".join(f"concat({stem}, '{e}')" for e in ends)
    stem = f"regexp_replace({base}, '[.][cm]?[jt]sx?$', '')"
    known = (
        f"when {base} rlike '[.]([jt]s)$' then array({added(stem, FIRST)}) when {base} rlike '[.]([jt]sx)$' then array({added(stem, ('.tsx', '.ts', '.d.ts', '.jsx', '.js'))}) "
        f"when {base} rlike '[.]m[jt]s$' then array({added(stem, ('.mts', '.d.mts', '.mjs'))}) when {base} rlike '[.]c[jt]s$' then array({added(stem, ('.cts', '.d.cts', '.cjs'))})"
    )
    folder = f"concat({base}, '/index')"
    return f"concat(case {known} else cast(array() as array<string>) end, array({added(base, FIRST)}, {added(folder, FIRST)}, {added(base, ENDINGS)}, {added(folder, ENDINGS)}, {base}))"


def ancestors(path: str) -> str:
    """SQL for all folders of a path, the root as an empty text first."""
    return f"concat(array(''), transform(sequence(1, size(split({path}, '/')) - 1), k -> array_join(slice(split({path}, '/'), 1, k), '/')))"


def mapped(imports: DataFrame, mappings: DataFrame) -> DataFrame:
    """``source, specifier, nth, base``: paths that ``mappings`` (folder, pattern, nth, target) give to imports (source, specifier), in the order in which they are tried.

    The configuration of the nearest folder above the source counts. Of its patterns an
    exact one wins, otherwise the one with the longest text before its star; the
    star's part of the specifier goes into the target. Prefixes of specifiers and folders
    of sources meet the table by equality.
    """
    table = mappings.select("folder", F.substring_index("pattern", "*", 1).alias("prefix"), F.when(F.instr("pattern", "*") > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).alias("suffix"), F.col("nth").alias("at"), "target")
    every = imports.select("source", "specifier").distinct()
    folders = mappings.select("folder").distinct()
    nearest = every.select("source").distinct().select("source", F.explode(F.expr(ancestors("source"))).alias("folder")).join(folders, "folder")
    nearest = nearest.groupBy("source").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    heads = F.expr("transform(sequence(0, length(specifier)), k -> substring(specifier, 1, k))")
    met = every.join(nearest, "source").select("source", "specifier", "folder", F.explode(heads).alias("prefix")).join(table, ["folder", "prefix"])
    star = F.col("suffix").isNotNull()
    fits = (~star & (F.col("prefix") == F.col("specifier"))) | (star & F.expr("endswith(specifier, suffix) and length(specifier) >= length(prefix) + length(suffix)"))
    rank = F.when(star, F.length("prefix")).otherwise(F.length("prefix") + 1_000_000)
    met = met.where(fits).withColumn("rank", rank)
    best = met.groupBy("source", "specifier").agg(F.max("rank").alias("rank"))
    part = F.when(star, F.expr("substring(specifier, length(prefix) + 1, length(specifier) - length(prefix) - length(suffix))")).otherwise("")
    return met.join(best, ["source", "specifier", "rank"]).select("source", "specifier", F.col("at").alias("nth"), F.replace("target", F.lit("*"), part).alias("raw")).select("source", "specifier", "nth", F.expr(_plain("raw")).alias("base"))


def tried(imports: DataFrame, mappings: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """``source, specifier, n, path``: all files that imports (source, specifier) may stand for, in order; external ones have none."""
    rows = imports.select("source", "specifier").distinct()
    found = rows.where(~is_external(F.col("specifier"))).select("source", "specifier", F.lit(0).alias("nth"), F.expr(_joined("source", "specifier")).alias("base"))
    if mappings is not None:
        found = found.union(mapped(rows.where(~F.col("specifier").startswith(".")), mappings))
    files = found.select("source", "specifier", "nth", F.posexplode(F.expr(_candidates("base"))).alias("k", "path"))
    files = files.select("source", "specifier", (F.col("nth") * 100 + F.col("k")).alias("n"), "path")
    if packages is not None:  # after all mappings
        more = package_candidates(rows.where(is_external(F.col("specifier"))), packages)
        files = files.union(more.select("source", "specifier", (F.col("n") + 1_000_000).alias("n"), "path"))
    return files


def resolved(imports: DataFrame, files: DataFrame, mappings: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """``source, specifier, status, target`` of imports (source, specifier): external, resolved or unresolved.

    Relative specifiers are tried as paths. Others are tried by ``mappings`` (see
    :func:`mapped`) and by ``packages`` (name, folder, main, nth) and are external if no file fits.
    """
    rows = imports.select("source", "specifier").distinct()
    candidates = tried(rows, mappings, packages)
    found = candidates.join(files.select("path"), "path", "left_semi").groupBy("source", "specifier").agg(F.min_by("path", "n").alias("target"))
    out = rows.join(found, ["source", "specifier"], "left")
    status = F.when(F.col("target").isNotNull(), "resolved").when(is_external(F.col("specifier")), "external").otherwise("unresolved")
    return out.select("source", "specifier", status.alias("status"), "target")


def workspace_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports whose specifier is a package's name or a path in it; each specifier's leading parts meet ``packages`` (name) by equality."""
    heads = F.expr("transform(sequence(1, size(split(specifier, '/'))), k -> array_join(slice(split(specifier, '/'), 1, k), '/'))")
    met = imports.select("specifier").distinct().select("specifier", F.explode(heads).alias("name")).join(packages, "name", "left_semi")
    return imports.join(met.select("specifier").distinct(), "specifier", "left_semi")
