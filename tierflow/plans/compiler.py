"""Path mappings of compiler configurations: inherited options, referenced projects, one table of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.resolve import _plain
from tierflow.shared import stored

_SHAPE = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>, extends string, references array<struct<path:string>>"


def _folder(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def _beside(path: str, name: str) -> str:
    """SQL for the path that ``name`` means beside the file ``path``."""
    return _plain(f"concat({_folder(path)}, '/', {name})")


def configurations(files: DataFrame) -> DataFrame:
    """``path, base, paths, parent, refs`` of configuration texts (path, content); comments and commas before closing brackets are allowed.

    Texts that are no JSON are left out. ``base`` is the folder that targets are relative to.
    """
    clean = F.regexp_replace("content", r",(\s*[}\]])", "$1")
    read = files.select("path", F.from_json(clean, _SHAPE, {"allowComments": "true"}).alias("c")).where("c is not null and (c.compilerOptions is not null or c.extends is not null or c.references is not null)")
    base = f"if(c.compilerOptions.baseUrl is null, {_folder('path')}, {_beside('path', 'c.compilerOptions.baseUrl')})"
    parent = f"if(c.extends like '.%', {_beside('path', 'c.extends')}, null)"
    refs = f"transform(coalesce(c.references, array()), r -> {_beside('path', 'r.path')})"
    return read.select("path", F.expr(base).alias("base"), F.col("c.compilerOptions.paths").alias("paths"), F.expr(parent).alias("parent"), F.expr(refs).alias("refs"))


def _to_file(links: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b``: links to configuration files; a link may leave out ``.json`` or name a folder."""
    names = links.select("a", F.col("b").alias("link"), F.posexplode(F.expr("array(b, concat(b, '.json'), regexp_replace(concat(b, '/tsconfig.json'), '^/', ''))")).alias("n", "b"))
    return names.join(known.select(F.col("path").alias("b")), "b").groupBy("a", "link").agg(F.min_by("b", "n").alias("b")).select("a", "b").distinct()


def path_mappings(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """``folder, pattern, nth, target`` for the folders that have a configuration called ``name``, from configuration texts (path, content).

    A configuration without patterns of its own has those of what it extends, and so on. Patterns
    of projects that it refers to, directly or not, are added; targets of a pattern keep
    their order, its own ones first. Cycles of references end.
    """
    known = stored(configurations(files), "configurations")
    # patterns by inheritance: each round looks one step further up for those that have none
    up = stored(_to_file(known.where("parent is not null").select(F.col("path").alias("a"), F.col("parent").alias("b")), known), "extends")
    own = known.where("paths is not null").select(F.col("path").alias("at"), "base", "paths")
    open_, done = known.select("path", F.col("path").alias("at")), None
    for _ in range(known.count()):
        found = open_.join(own, "at").select("path", "base", "paths")
        done = found if done is None else done.union(found)
        open_ = stored(open_.join(own.select("at"), "at", "left_anti").join(up, F.col("at") == up.a).select("path", F.col("b").alias("at")), "open")
        if not open_.limit(1).count():
            break
    # references: pairs are joined with themselves, so each round doubles how far they reach
    refs = _to_file(known.select(F.col("path").alias("a"), F.explode("refs").alias("b")), known)
    reach = stored(known.select(F.col("path").alias("a"), F.col("path").alias("b"), F.lit(0).alias("hops")).union(refs.select("a", "b", F.lit(1))), "references")
    n = reach.count()
    while True:
        further = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("hops").alias("more")), "b").select("a", F.col("c").alias("b"), (F.col("hops") + F.col("more")).alias("hops"))
        reach = stored(further.groupBy("a", "b").agg(F.min("hops").alias("hops")), "references")
        if reach.count() == n:
            break
        n = reach.count()
    if done is None:
        return files.sparkSession.createDataFrame([], "folder string, pattern string, nth int, target string")
    patterns = done.select(F.col("path").alias("b"), "base", F.explode("paths").alias("pattern", "targets"))
    patterns = patterns.select("b", "pattern", F.posexplode("targets").alias("k", "t"), "base").select("b", "pattern", "k", F.expr("concat(if(base = '', '', concat(base, '/')), t)").alias("target"))
    rows = reach.where(F.regexp_extract("a", "[^/]*$", 0) == name).join(patterns, "b").groupBy("a", "pattern", "target").agg(F.min(F.struct("hops", "b", "k")).alias("first"))
    order = F.expr("array_sort(collect_list(struct(first, target)))")
    return rows.groupBy("a", "pattern").agg(order.alias("targets")).select(F.expr(_folder("a")).alias("folder"), "pattern", F.posexplode("targets.target").alias("nth", "target"))
