"""Longest-prefix mapping of paths to layers, sublayers and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.functions.paths import normal, normal_text
from tierflow.plans.ruleset import Layer, RuleSet, Sublayer
from tierflow.shared import stored

#: More layers than this are joined by the ancestors of a path instead of compiled into one CASE.
COMPILED = 50
#: Paths that a task makes distinct.
ROWS = 250_000


def _inside(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def _by_length(items: list) -> list:
    return sorted(items, key=lambda item: -len(normal_text(item.path)))


def _case(cases: list[tuple[Column, Column]]) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(None) if out is None else out


def _places(rules: RuleSet) -> list[tuple[Layer, Sublayer | None]]:
    """Layers, each after its sublayers, in the order in which a path meets them. Sublayers count only inside the winning layer."""
    return [(layer, sub) for layer in _by_length(list(rules.layers)) for sub in [*_by_length(list(layer.sublayers)), None]]


def _number(plain: Column, rules: RuleSet) -> Column:
    """The number of the first of :func:`_places` that a normal path is in, from 1; 0 outside all layers."""
    cases = []
    for k, (layer, sub) in enumerate(_places(rules), 1):
        outer, inner = normal_text(layer.path), normal_text((sub or layer).path)
        here = _inside(plain, inner)
        cases.append((here if inner == outer or inner.startswith(outer + "/") else _inside(plain, outer) & here, F.lit(k)))
    return F.coalesce(_case(cases).cast("int"), F.lit(0))


def _parts(plain: Column, number: Column, rules: RuleSet) -> dict[str, Column]:
    """Layer, sublayer, feature and isolation of a normal path with the number of its place: one look at a constant array each.

    One CASE for all four keeps the generated code of a stage below 8,000 bytes, beyond which the JVM does not compile a method.
    """
    places = _places(rules)
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in [None, *values])), number)
    rest = F.substr(plain, of([len(normal_text(sub.path)) + 2 if sub else None for _, sub in places], "int"))
    return {
        "layer": of([layer.name for layer, _ in places], "string"),
        "sublayer": of([sub.name if sub else None for _, sub in places], "string"),
        "feature": F.when(F.instr(rest, "/") > 0, F.substring_index(rest, "/", 1)),
        "isolated": F.coalesce(of([bool(sub and sub.isolated) for _, sub in places], "boolean"), F.lit(False)),
    }


def placed(path: Column, rules: RuleSet) -> Column:
    """``struct(layer, sublayer, feature, isolated)``; null outside all layers. CASE expressions, no join."""
    parts = _parts(normal(path), _number(normal(path), rules), rules)
    return F.when(parts["layer"].isNotNull(), F.struct(*(c.alias(n) for n, c in parts.items())))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, computed once.

    They are projected, in generated code, and then pass through a generator of one row. Conditions on them stay
    above it, where the optimizer would copy a projected expression into each of them. The generator itself
    is interpreted row by row, so it is given finished columns only.
    """
    made = rows.select("*", *(c.alias(f"_made_{n}") for n, c in columns.items()))
    return made.select(*rows.columns, F.inline(F.array(F.struct(*(F.col(f"_made_{n}").alias(n) for n in columns)))))


def annotated(edges: DataFrame, rules: RuleSet, numbers: bool = False) -> DataFrame:
    """Edges with ``src`` and ``dst``, the places of both ends; their ``layer`` is null outside all layers. ``numbers`` keeps those of the places, ``_from`` and ``_to``."""
    rows = edges.select("*", normal(F.col("source")).alias("_src"), normal(F.col("target")).alias("_dst"))
    rows = rows.select("*", _number(F.col("_src"), rules).alias("_from"), _number(F.col("_dst"), rules).alias("_to"))
    place = lambda end, number: F.struct(*(c.alias(n) for n, c in _parts(F.col(end), F.col(number), rules).items()))
    return computed(rows, src=place("_src", "_from"), dst=place("_dst", "_to")).drop("_src", "_dst", *(() if numbers else ("_from", "_to")))


def numbered(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """``src`` and ``dst`` of edges whose places have been numbered (``_from``, ``_to``): of each, only what a plan reads is looked up."""
    place = lambda end, number: F.struct(*(c.alias(n) for n, c in _parts(normal(F.col(end)), F.col(number), rules).items()))
    return edges.select("*", place("source", "_from").alias("src"), place("target", "_to").alias("dst")).drop("_from", "_to")


def layers_by_prefix(files: DataFrame, layers: DataFrame) -> DataFrame:
    """``path, layer`` for layer tables of any size: the ancestor folders of a path meet ``layers`` (layer, path) by equality, one depth after the other.

    A path has one row throughout; the deepest folder wins. Paths are dealt to as many tasks as their number asks
    for before they are made distinct, so what a task holds does not grow with the table.
    """
    folders = stored(layers.select("layer", normal(F.col("path")).alias("_folder")).groupBy("_folder").agg(F.max("layer").alias("layer")), "layers")
    depth = F.size(F.split("_folder", "/"))
    found = sorted((r[0] for r in folders.select(depth).distinct().collect()), reverse=True)  # a number for each depth
    dealt = files.select("path").repartition(files.count() // ROWS + 1, "path").distinct()
    rows = dealt.withColumn("_n", normal(F.col("path")))
    for k in found:
        own = folders.where(depth == k).select(F.col("_folder").alias(f"_at{k}"), F.col("layer").alias(f"_layer{k}"))
        rows = rows.join(own, F.substring_index("_n", "/", k) == F.col(f"_at{k}"), "left").drop(f"_at{k}")
    layer = F.coalesce(*(F.col(f"_layer{k}") for k in found), F.lit(None).cast("string"))
    return rows.select("path", layer.alias("layer")).where("layer is not null")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
