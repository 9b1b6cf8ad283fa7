"""Rules over edges and files; each returns rows of the violations table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions.frameworks import implicitly_used
from tierflow.functions.paths import comparable, glob_regex, is_entry_point, normal_text
from tierflow.operators.graph import chain_lengths, cycle_paths, strong_components
from tierflow.operators.mapping import annotated, computed, numbered, placed
from tierflow.plans.ruleset import SEVERITY, RuleSet
from tierflow.shared import stored

#: The violations table.
COLUMNS = (
    "type string, severity string, source_file string, target_file string, source_layer string, source_sublayer string, source_feature string, "
    "target_layer string, target_sublayer string, target_feature string, import_specifier string, line int, message string, max_allowed int, actual int, dependent_layers array<string>"
)


def violations(rows: DataFrame, kind: str | Column, severity: str | Column | None = None, **columns: Column) -> DataFrame:
    """``rows`` as violations of one type, or of the type in a column; columns that are not given are null."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"type": as_column(kind), "severity": as_column(SEVERITY[kind] if severity is None else severity), **columns}
    fields = [field.strip().split(" ") for field in COLUMNS.split(",")]
    return rows.select(*(given.get(name, F.lit(None)).cast(of).alias(name) for name, of in fields))


def _pair_in(left: Column, right: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, [(left == a) & (right == b) for a, b in pairs], F.lit(False))


def outcome(rules: RuleSet, sublayer_flow: bool = True, isolation: bool = True) -> Column:
    """What the first rule that fits says of an annotated edge: ``ok`` or a violation type."""
    src, dst = F.col("src"), F.col("dst")
    same_layer = src.layer == dst.layer
    same_sub = src.sublayer.eqNullSafe(dst.sublayer)
    out = F.when(src.layer.isNull(), "unmapped").when(dst.layer.isNull(), F.lit("ok" if rules.unlayered == "ignore" else "unlayered"))
    if isolation:
        out = out.when(same_layer & same_sub & src.isolated & (src.feature != dst.feature), "isolation")
    out = out.when(same_layer & same_sub, "ok")
    if sublayer_flow:
        for layer in rules.layers:
            if layer.flow and layer.sublayers:
                inner = (src.layer == layer.name) & same_layer & src.sublayer.isNotNull() & dst.sublayer.isNotNull()
                out = out.when(inner & ~_pair_in(src.sublayer, dst.sublayer, rules.allowed(layer.name)), "flow")
    return out.when(same_layer, "ok").when(~_pair_in(src.layer, dst.layer, rules.allowed()), "flow").otherwise("ok")


def judged(edges: DataFrame, rules: RuleSet, **switches: bool) -> DataFrame:
    """Annotated edges with ``outcome``. A projection only: one pass over the edges."""
    return computed(annotated(edges, rules), outcome=outcome(rules, **switches))


def _written(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """Of judged edges what the rules read again. Places are two numbers instead of eight columns, which took longer to write than to make."""
    return computed(annotated(edges, rules, numbers=True), outcome=outcome(rules)).select("source", "target", "specifier", "line", "_from", "_to", "outcome")


def edge_violations(edges: DataFrame, rules: RuleSet, apply_exceptions: bool = False) -> DataFrame:
    """Flow, isolation and unlayered violations of each edge, and one unmapped violation for each source outside all layers.

    What breaks a rule is written once, so that the edges are made and judged only once.
    """
    return _of_edges(stored(judged(edges, rules).where("outcome <> 'ok'"), "broken"), rules, apply_exceptions)


def _of_edges(rows: DataFrame, rules: RuleSet, apply_exceptions: bool = False) -> DataFrame:
    rows = rows.where("outcome <> 'ok'")
    if apply_exceptions:
        for a, b in rules.exceptions:
            rows = rows.where(~(F.col("source").rlike(glob_regex(a)) & F.col("target").rlike(glob_regex(b))))
    src, dst = F.col("src"), F.col("dst")
    where = dict(
        source_file=F.col("source"), target_file=F.col("target"), source_layer=src.layer, source_sublayer=src.sublayer, source_feature=src.feature,
        target_layer=dst.layer, target_sublayer=dst.sublayer, target_feature=dst.feature, import_specifier=F.col("specifier"), line=F.col("line"),
    )
    name = lambda end: F.concat_ws("/", end.layer, F.when(src.layer == dst.layer, end.sublayer))
    said = (
        F.when(F.col("outcome") == "flow", F.concat(name(src), F.lit(" may not import "), name(dst)))
        .when(F.col("outcome") == "isolation", F.concat(F.lit("feature "), src.feature, F.lit(" may not import feature "), dst.feature))
        .otherwise(F.concat(F.col("target"), F.lit(" is in no layer")))
    )
    level = F.when(F.col("outcome") == "unlayered", F.lit(rules.unlayered)).otherwise(F.lit(SEVERITY["flow"]))
    of_edges = violations(rows.where("outcome <> 'unmapped'"), F.col("outcome"), level, message=said, **where)
    return of_edges.unionByName(_unmapped(rows))


def unmapped_violations(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """One violation for each source outside all layers: the edges are read once, for nothing else."""
    return _unmapped(judged(edges, rules))


def _unmapped(rows: DataFrame) -> DataFrame:
    sources = rows.where("outcome = 'unmapped'").select("source").distinct()
    return violations(sources, "unmapped", message=F.concat(F.col("source"), F.lit(" is in no layer")), source_file=F.col("source"))


def public_api_violations(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """Edges from other layers to files outside the target layer's public API."""
    return _of_apis(annotated(edges, rules), rules)


def _of_apis(rows: DataFrame, rules: RuleSet) -> DataFrame:
    apis = {}
    for layer in rules.layers:
        if layer.public_api:
            folder = layer.path.replace("\\", "/").strip("/")
            apis[layer.name] = [p if normal_text(p).startswith(normal_text(layer.path)) else f"{folder}/{p}" for p in layer.public_api]
    rows = rows.where("src.layer <> dst.layer")
    open_ = reduce(lambda a, b: a | b, [(F.col("dst.layer") == n) & comparable(F.col("target")).isin(*(comparable_text(p) for p in ps)) for n, ps in apis.items()], F.lit(False))
    rows = rows.where(F.col("dst.layer").isin(*apis) & ~open_) if apis else rows.where("false")
    return violations(
        rows, "publicApi", source_file=F.col("source"), target_file=F.col("target"), source_layer=F.col("src.layer"), target_layer=F.col("dst.layer"),
        import_specifier=F.col("specifier"), line=F.col("line"), message=F.concat(F.col("target"), F.lit(" is not in the public API of "), F.col("dst.layer")),
    )


def comparable_text(path: str) -> str:
    """As ``functions.paths.comparable``, for a text."""
    plain = path.replace("\\", "/")
    for end in (".tsx", ".jsx", ".mjs", ".cjs", ".ts", ".js"):
        if plain.endswith(end):
            plain = plain[: -len(end)]
            break
    return plain.removesuffix("/index")


def dependents(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """``layer, n, layers``: the other layers that import each layer. One partial aggregation over the edges."""
    return _dependents(annotated(edges, rules))


def _dependents(rows: DataFrame) -> DataFrame:
    rows = rows.where("src.layer <> dst.layer")
    pairs = rows.select(F.col("dst.layer").alias("layer"), F.col("src.layer").alias("by")).distinct()
    return pairs.groupBy("layer").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("by")).alias("layers"))


def budget_violations(edges: DataFrame, rules: RuleSet) -> DataFrame:
    """Layers that more layers import than they allow."""
    return _over_budget(dependents(edges, rules), rules)


def _over_budget(found: DataFrame, rules: RuleSet) -> DataFrame:
    limits = [(x.name, x.max_dependents) for x in rules.layers if x.max_dependents is not None]
    limit = F.coalesce(*(F.when(F.col("layer") == n, F.lit(m)) for n, m in limits), F.lit(None).cast("int"))
    rows = found.withColumn("most", limit).where("n > most")
    return violations(rows, "dependentBudget", source_file=F.lit(""), target_layer=F.col("layer"), max_allowed=F.col("most"), actual=F.col("n"), dependent_layers=F.col("layers"), message=F.concat(F.col("layer"), F.lit(" has too many dependent layers")))


def count_violations(edges: DataFrame, most: int) -> DataFrame:
    """Files with more imports than allowed."""
    rows = edges.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return violations(rows, "importCount", source_file=F.col("source"), max_allowed=F.lit(most), actual=F.col("n"), message=F.lit("too many imports"))


def orphan_violations(files: DataFrame, edges: DataFrame, rules: RuleSet, framework: str | None = None) -> DataFrame:
    """Files that nothing imports, without entry points and what the framework uses by itself."""
    rows = files.join(edges.select(F.col("target").alias("path")).distinct(), "path", "left_anti")
    rows = rows.where(~is_entry_point(F.col("path")) & ~implicitly_used(F.col("path"), framework))
    return violations(rows, "orphan", source_file=F.col("path"), source_layer=placed(F.col("path"), rules).layer, message=F.concat(F.col("path"), F.lit(" is imported by nothing")))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()


def circular_violations(edges: DataFrame, severity: str | None = None, components: DataFrame | None = None) -> DataFrame:
    """One violation for each cyclic component of the imports: a shortest cycle through its first file is the message, the number of its files ``actual``."""
    ends = _ends(edges)
    found = components if components is not None else stored(strong_components(ends), "components")
    size = found.groupBy("component").agg(F.count("*").alias("n"))
    rows = cycle_paths(ends, found).join(size, "component")
    return violations(rows, "circular", severity, source_file=F.col("component"), actual=F.col("n"), message=F.array_join("path", " -> "))


def depth_violations(edges: DataFrame, most: int, components: DataFrame | None = None) -> DataFrame:
    """Files whose longest chain of imports has more than ``most`` edges."""
    rows = chain_lengths(_ends(edges), components).where(F.col("depth") > most)
    return violations(rows, "depth", source_file=F.col("node"), max_allowed=F.lit(most), actual=F.col("depth"), message=F.lit("chain of imports is too long"))


def check(files: DataFrame, edges: DataFrame, rules: RuleSet, orphans: bool = True, framework: str | None = None, with_type_only: bool = True, apply_exceptions: bool = False, circular: bool = False) -> DataFrame:
    """All violations of a graph, of ten types.

    Edges are judged once and written with the numbers of their places; every rule reads the columns it needs of that
    table and looks up layers, sublayers and features for the edges that break it.
    ``circular`` adds cycles and ``rules.max_depth`` chains, which take rounds of joins.
    """
    if not with_type_only:
        edges = edges.where(~F.col("is_type_only"))
    rows = numbered(stored(_written(edges, rules), "judged"), rules)
    parts = [_of_edges(rows, rules, apply_exceptions), _of_apis(rows, rules), _over_budget(_dependents(rows), rules)]
    if rules.max_imports is not None:
        parts.append(count_violations(rows, rules.max_imports))
    if orphans:
        parts.append(stored(orphan_violations(files, rows, rules, framework), "orphans"))
    if circular or rules.max_depth is not None:
        cyclic = stored(strong_components(_ends(rows)), "components")
        if circular:
            parts.append(circular_violations(rows, components=cyclic))
        if rules.max_depth is not None:
            parts.append(depth_violations(rows, rules.max_depth, cyclic))
    return reduce(DataFrame.unionByName, parts)
