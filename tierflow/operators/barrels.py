"""Names followed through re-exporting files to where they come from.

Reachability with labels: a pair of file and name goes on to the pairs that its
re-exports give it. A renamed export changes the label, ``export *`` keeps every label but
``default``, and a namespace ends in the whole of a file (label ``*``). All starting
pairs are followed at once, a round for each re-export on the way; pairs met before are
not followed again, so cycles of barrels end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.shared import dropped, stored
from tierflow.sources.code import is_barrel_name

ALL = "*"


def barrel_links(reexports: DataFrame) -> DataFrame:
    """``file, target, name, as`` of resolved re-exports (source, target, names): the name in the target and the name here."""
    links = reexports.select(F.col("source").alias("file"), "target", F.inline("names"))
    return links.where("file <> target").distinct()


def _forward(front: DataFrame, links: DataFrame) -> DataFrame:
    """``start, start_name, file, name`` one re-export further."""
    met = front.join(links.withColumnRenamed("name", "there"), "file")
    all_, same, star = F.col("name") == ALL, F.col("as") == F.col("name"), F.col("as") == ALL
    own = F.max(same & ~star & ~all_)  # an explicit export of the name hides those of stars
    explicit = met.groupBy("start", "start_name", "file", "name").agg(own.alias("explicit"))
    met = met.join(explicit, ["start", "start_name", "file", "name"])
    goes = all_ | same | (star & ~F.col("explicit") & (F.col("name") != "default"))
    name = F.when(star & ~all_, F.col("name")).otherwise(F.col("there"))
    return met.where(goes).select("start", "start_name", F.col("target").alias("file"), name.alias("name")).distinct()


def origins_of_names(wanted: DataFrame, reexports: DataFrame, exports: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``file, name, origin, origin_name``: where names (file, name) come from, through re-exports (source, target, names).

    The name ``*`` stands for all that a file exports. With ``exports`` (file, name), the
    names that files export themselves, a name ends only where it is exported; without
    them, in every file without re-exports that it reaches. A name that a file exports
    itself and takes from no other has that file as its origin. ``most`` limits the re-exports on the way.
    """
    links = stored(barrel_links(reexports), "links")
    barrels = links.select("file").distinct()
    start = wanted.select(F.col("file").alias("start"), F.col("name").alias("start_name"), "file", "name").distinct()
    parts, rounds = [stored(start, "names")], 0
    while most is None or rounds < most:
        rounds += 1
        seen = reduce(DataFrame.union, parts)
        front = stored(_forward(parts[-1], links).join(seen, ["start", "start_name", "file", "name"], "left_anti"), "names")
        if not front.limit(1).count():
            break
        parts.append(front)
        if len(parts) > 6:  # the plan of what was seen stays short
            whole = stored(reduce(DataFrame.union, parts[:-1]), "names")
            for part in parts[:-1]:
                dropped(part)
            parts = [whole, front]
    seen = reduce(DataFrame.union, parts)
    if exports is None:
        ends = seen.join(barrels, "file", "left_anti")
    else:
        own = exports.select("file", F.col("name").alias("exported")).distinct()
        ends = seen.join(own, "file").where((F.col("name") == ALL) | (F.col("name") == F.col("exported"))).select(seen.columns).distinct()
    return ends.select(F.col("start").alias("file"), F.col("start_name").alias("name"), F.col("file").alias("origin"), F.col("name").alias("origin_name"))


def origin_edges(edges: DataFrame, reexports: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Edges into barrels (files called index) drawn to the origins of the names that they import; the columns are those of ``edges``.

    ``edges`` have ``names``; one without names (for its effects, or dynamic) stands for all of them. What
    leads back to the barrel or to the importing file itself is left out.
    """
    into = edges.where(is_barrel_name(F.col("target")))
    asked = F.when(F.size(F.coalesce("names", F.array())) > 0, F.col("names.name")).otherwise(F.array(F.lit(ALL)))
    each = into.select(*edges.columns, F.explode(F.array_distinct(asked)).alias("_name"))
    found = origins_of_names(each.select(F.col("target").alias("file"), F.col("_name").alias("name")), reexports, exports)
    found = found.select(F.col("file").alias("target"), F.col("name").alias("_name"), "origin").distinct()
    drawn = each.join(found, ["target", "_name"]).where("origin <> target and origin <> source")
    others = [c for c in edges.columns if c != "target"]
    return drawn.select(*others, F.col("origin").alias("target")).distinct().select(edges.columns)
