"""Registered queries of the rule engine, each with its SQL."""

from __future__ import annotations

import dataclasses
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.functions import paths
from tierflow.operators import barrels, folders, graph, incremental, mapping, report, resolve, rules, workspace
from tierflow.plans.projection import RULES, changes, edges, files, module_edges, module_files, module_texts, rule_tables, successor_graph, table
from tierflow.plans import project, ruleset
from tierflow.plans.ruleset import RuleSet
from tierflow.shared import shared_folder, stored
from tierflow.sources import code, history
from tierflow.sources.store import fingerprint
from tierflow.streaming import build

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_FILES = """
files AS (
  SELECT 'src/handlers/' || lower(c_mktsegment) || '/c' || c_custkey || '.ts' AS path FROM customer
  UNION ALL SELECT 'src/services/o' || o_orderkey || '.ts' FROM orders
  UNION ALL SELECT p_path FROM parts
  UNION ALL SELECT s_path FROM suppliers)"""
_KEYS = """
parts AS (SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'src/repository/common/p' || p_partkey || '.ts' ELSE 'src/repository/features/' || p_brand || '/p' || p_partkey || '.ts' END AS p_path FROM part),
suppliers AS (SELECT s_suppkey, CASE WHEN n_regionkey = 0 THEN 'src/misc/s' ELSE 'src/shared/s' END || s_suppkey || '.ts' AS s_path FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_EDGES = """
edges AS (
  SELECT 'src/handlers/' || lower(c_mktsegment) || '/c' || c_custkey || '.ts' AS source, 'src/services/o' || o_orderkey || '.ts' AS target, 'order' AS specifier, false AS is_type_only, 'static' AS kind, 1 AS line
    FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'src/services/o' || l_orderkey || '.ts', p_path, 'part', l_linestatus = 'O', CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'dynamic' ELSE 'reexport' END, l_linenumber
    FROM lineitem JOIN parts ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT p_path, s_path, 'supplier', false, 'static', 1 FROM lineitem JOIN parts ON l_partkey = p_partkey JOIN suppliers ON l_suppkey = s_suppkey
  UNION ALL SELECT s_path, 'src/services/o' || l_orderkey || '.ts', 'back', false, 'static', 1 FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey WHERE l_discount >= 0.1 AND l_returnflag = 'R'
  UNION ALL SELECT p_path, next, 'next', false, 'static', 1 FROM (
    SELECT p_path, lead(p_path) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_shipdate) AS next
    FROM lineitem JOIN parts ON l_partkey = p_partkey) WHERE next IS NOT NULL)"""
_PLACE = """
place AS (
  SELECT DISTINCT path,
    CASE WHEN path LIKE 'src/handlers/%' THEN 'handlers' WHEN path LIKE 'src/services/%' THEN 'services' WHEN path LIKE 'src/repository/%' THEN 'repository' WHEN path LIKE 'src/shared/%' THEN 'shared' END AS layer,
    CASE WHEN path LIKE 'src/repository/features/%' THEN 'features' WHEN path LIKE 'src/repository/common/%' THEN 'common' END AS sublayer,
    CASE WHEN path LIKE 'src/repository/features/%/%' THEN lower(split_part(path, '/', 4)) END AS feature
  FROM files)"""
_JUDGED = """
judged AS (
  SELECT e.*, s.layer AS s_layer, s.sublayer AS s_sub, s.feature AS s_feature, t.layer AS t_layer, t.sublayer AS t_sub, t.feature AS t_feature,
    CASE WHEN s.layer IS NULL THEN 'unmapped'
         WHEN t.layer IS NULL THEN 'unlayered'
         WHEN s.layer = t.layer AND s.sublayer IS NOT DISTINCT FROM t.sublayer AND s.sublayer = 'features' AND s.feature <> t.feature THEN 'isolation'
         WHEN s.layer = t.layer AND s.sublayer IS NOT DISTINCT FROM t.sublayer THEN 'ok'
         WHEN s.layer = t.layer AND s.sublayer IS NOT NULL AND t.sublayer IS NOT NULL AND NOT (s.sublayer = 'features' AND t.sublayer = 'common') THEN 'flow'
         WHEN s.layer = t.layer THEN 'ok'
         WHEN (s.layer, t.layer) NOT IN (('handlers', 'services'), ('services', 'repository'), ('repository', 'shared')) THEN 'flow'
         ELSE 'ok' END AS outcome
  FROM edges e JOIN place s ON e.source = s.path JOIN place t ON e.target = t.path)"""
_ALL = """
violations AS (
  SELECT outcome AS type, 'error' AS severity, source AS source_file, target AS target_file, s_layer AS source_layer, line FROM judged WHERE outcome IN ('flow', 'isolation', 'unlayered')
  UNION ALL SELECT DISTINCT 'unmapped', 'warn', source, NULL, NULL, CAST(NULL AS INTEGER) FROM judged WHERE outcome = 'unmapped'
  UNION ALL SELECT 'publicApi', 'error', source, target, s_layer, line FROM judged WHERE s_layer <> t_layer AND t_layer = 'shared' AND target NOT IN ('src/shared/s1.ts', 'src/shared/s2.ts')
  UNION ALL SELECT 'dependentBudget', 'warn', '', NULL, NULL, NULL FROM judged WHERE s_layer <> t_layer AND t_layer = 'services' GROUP BY t_layer HAVING count(DISTINCT s_layer) > 1
  UNION ALL SELECT 'importCount', 'warn', source, NULL, NULL, NULL FROM edges GROUP BY source HAVING count(*) > 20
  UNION ALL SELECT 'orphan', 'warn', path, NULL, (SELECT layer FROM place p WHERE p.path = f.path), NULL FROM files f WHERE path NOT IN (SELECT target FROM edges))"""
_BASE = f"WITH RECURSIVE {_KEYS.strip()}, {_FILES.strip()}, {_EDGES.strip()}, {_PLACE.strip()}, {_JUDGED.strip()}, {_ALL.strip()}"
_FILE_NAMES = "listing AS (SELECT 'src/' || coalesce(lang, 'x') || '/' || coalesce(source, 'x') || '/d' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.JSX' ELSE '-spec.js' END AS path FROM documents)"
_HISTORY = "history AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1)"


def query(sql: str | None):
    """Register a query with its SQL; without one it is held against brute force in the tests."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, [".ts", ".test.ts", ".d.ts", ".md", ".JSX", "-spec.js"])), (F.col("doc_id") % 6 + 1).cast("int"))
    parts = [F.lit("src/"), F.coalesce("lang", F.lit("x")), F.lit("/"), F.coalesce("source", F.lit("x")), F.lit("/d"), F.col("doc_id").cast("string"), end]
    return table(spark, sf_dir, "documents").select(F.concat(*parts).alias("path"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check(files(spark, sf_dir), edges(spark, sf_dir), RULES)


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(edges(spark, sf_dir), RULES)


@query(f"WITH {_FILE_NAMES} SELECT path FROM listing WHERE regexp_matches(lower(path), '[.](ts|tsx|js|jsx|mts|mjs|cts|cjs)$')")
def scan_filter_source(spark, sf_dir):
    return _listing(spark, sf_dir).where(paths.is_source(F.col("path")))


@query(f"WITH {_FILE_NAMES} SELECT path FROM listing WHERE regexp_matches(lower(path), '[.](ts|tsx|js|jsx|mts|mjs|cts|cjs)$') AND NOT regexp_matches(path, '([.]test[.]|[.]spec[.]|-test[.]|-spec[.])') AND NOT regexp_matches(path, '[.]d[.](ts|mts|cts)$')")
def scan_skip_tests(spark, sf_dir):
    return code.scanned(_listing(spark, sf_dir)).where("status = 'file'").select("path")


@query(f"WITH {_FILE_NAMES} SELECT path FROM listing WHERE NOT (path LIKE 'src/fr/%' OR lower(path) LIKE '%.jsx' OR regexp_matches(path, '/d[^/]*77[^/]*$'))")
def ignore_glob(spark, sf_dir):
    return _listing(spark, sf_dir).where(~paths.matches(F.col("path"), ["src/fr/**", "*.jsx", "77"]))


@query(f"{_BASE} SELECT source, target, specifier, is_type_only, kind, line FROM edges")
def edge_project(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"{_BASE} SELECT kind, count(*) AS n FROM edges WHERE NOT is_type_only GROUP BY kind")
def type_only_filter(spark, sf_dir):
    return edges(spark, sf_dir).where(~F.col("is_type_only")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT source, target, line FROM edges WHERE kind = 'reexport'")
def kind_filter(spark, sf_dir):
    return edges(spark, sf_dir).where("kind = 'reexport'").select("source", "target", "line")


@query(f"{_BASE} SELECT path, layer, sublayer, feature, coalesce(sublayer = 'features', false) AS isolated FROM place WHERE layer IS NOT NULL")
def layer_map_longest_prefix(spark, sf_dir):
    return files(spark, sf_dir).select("path", mapping.placed(F.col("path"), RULES).alias("p")).where("p is not null").select("path", "p.*")


@query(f"{_BASE} SELECT path, layer FROM place WHERE layer IS NOT NULL")
def layer_map_by_ancestors(spark, sf_dir):
    layers = spark.createDataFrame([(x.name, x.path) for x in RULES.layers], "layer string, path string")
    return mapping.layers_by_prefix(files(spark, sf_dir), layers)


@query(f"{_BASE} SELECT s_layer AS src_layer, t_layer AS dst_layer, count(*) AS n FROM judged GROUP BY 1, 2")
def edge_annotate(spark, sf_dir):
    rows = mapping.annotated(edges(spark, sf_dir), RULES)
    return rows.groupBy(F.col("src.layer").alias("src_layer"), F.col("dst.layer").alias("dst_layer")).agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT outcome, count(*) AS n FROM judged GROUP BY 1")
def edge_rule_case_chain(spark, sf_dir):
    return _outcome(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT s_layer AS src_layer, t_layer AS dst_layer, source, target, line FROM judged WHERE outcome = 'flow' AND s_layer <> t_layer")
def flow_violations(spark, sf_dir):
    return _outcome(spark, sf_dir).where("outcome = 'flow' and src.layer <> dst.layer").select(F.col("src.layer").alias("src_layer"), F.col("dst.layer").alias("dst_layer"), "source", "target", "line")


@query(f"{_BASE} SELECT s_sub AS src_sublayer, t_sub AS dst_sublayer, source, target FROM judged WHERE outcome = 'flow' AND s_layer = t_layer")
def sublayer_flow_violations(spark, sf_dir):
    return _outcome(spark, sf_dir).where("outcome = 'flow' and src.layer = dst.layer").select(F.col("src.sublayer").alias("src_sublayer"), F.col("dst.sublayer").alias("dst_sublayer"), "source", "target")


@query(f"{_BASE} SELECT s_layer AS src_layer, t_layer AS dst_layer, count(*) AS n FROM judged WHERE s_layer IS NOT NULL AND t_layer IS NOT NULL AND s_layer <> t_layer AND (s_layer, t_layer) NOT IN (('handlers', 'services'), ('services', 'handlers'), ('services', 'repository')) GROUP BY 1, 2")
def bidirectional_allowed(spark, sf_dir):
    both = RuleSet(RULES.layers, ("handlers <-> services", "services -> repository"))
    rows = rules.judged(edges(spark, sf_dir), both, sublayer_flow=False, isolation=False).where("outcome = 'flow'")
    return rows.groupBy(F.col("src.layer").alias("src_layer"), F.col("dst.layer").alias("dst_layer")).agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT source, target, s_feature, t_feature FROM judged WHERE outcome = 'isolation'")
def isolation_violations(spark, sf_dir):
    return _outcome(spark, sf_dir).where("outcome = 'isolation'").select("source", "target", F.col("src.feature").alias("s_feature"), F.col("dst.feature").alias("t_feature"))


@query(f"{_BASE} SELECT DISTINCT source AS source_file FROM judged WHERE outcome = 'unmapped'")
def unmapped_sources(spark, sf_dir):
    return rules.unmapped_violations(edges(spark, sf_dir), RULES).select("source_file")


@query(f"{_BASE} SELECT target, count(*) AS n FROM judged WHERE outcome = 'unlayered' GROUP BY 1")
def unlayered_imports(spark, sf_dir):
    return _outcome(spark, sf_dir).where("outcome = 'unlayered'").groupBy("target").agg(F.count("*").alias("n"))


@query(f"{_BASE} SELECT source_file, target_file, line FROM violations WHERE type = 'publicApi'")
def public_api_violations(spark, sf_dir):
    return rules.public_api_violations(edges(spark, sf_dir), RULES).select("source_file", "target_file", "line")


@query(f"{_BASE} SELECT t_layer AS layer, count(DISTINCT s_layer) AS n, array_to_string(list_sort(list(DISTINCT s_layer)), ',') AS layers FROM judged WHERE s_layer <> t_layer GROUP BY 1")
def dependent_layers(spark, sf_dir):
    return rules.dependents(edges(spark, sf_dir), RULES).select("layer", "n", F.concat_ws(",", "layers").alias("layers"))


@query(f"{_BASE} SELECT t_layer AS target_layer, 1 AS max_allowed, CAST(count(DISTINCT s_layer) AS INTEGER) AS actual FROM judged WHERE s_layer <> t_layer AND t_layer = 'services' GROUP BY 1 HAVING count(DISTINCT s_layer) > 1")
def dependent_budget(spark, sf_dir):
    return rules.budget_violations(edges(spark, sf_dir), RULES).select("target_layer", "max_allowed", "actual")


@query(f"{_BASE} SELECT source AS source_file, CAST(count(*) AS INTEGER) AS actual FROM edges GROUP BY 1 HAVING count(*) > 20")
def import_count(spark, sf_dir):
    return rules.count_violations(edges(spark, sf_dir), 20).select("source_file", "actual")


@query(f"{_BASE} SELECT source_file, source_layer FROM violations WHERE type = 'orphan'")
def orphan_files(spark, sf_dir):
    return rules.orphan_violations(files(spark, sf_dir), edges(spark, sf_dir), RULES).select("source_file", "source_layer")


@query(f"{_BASE} SELECT source_file FROM violations WHERE type = 'orphan' AND NOT regexp_matches(source_file, '(^|/)(routes|controllers|middleware|middlewares|handlers|migrations|seeds)/')")
def orphan_with_plugin(spark, sf_dir):
    return rules.orphan_violations(files(spark, sf_dir), edges(spark, sf_dir), RULES, framework="node-backend").select("source_file")


@query(f"{_BASE} SELECT DISTINCT target AS path FROM edges WHERE source = 'src/services/o7.ts'")
def dependencies_of(spark, sf_dir):
    return graph.dependencies_of(edges(spark, sf_dir), "src/services/o7.ts")


@query(f"{_BASE} SELECT DISTINCT source AS path FROM edges WHERE target = 'src/shared/s5.ts'")
def dependents_of(spark, sf_dir):
    return graph.dependents_of(edges(spark, sf_dir), "src/shared/s5.ts")


@query(f"{_BASE} SELECT kind, line FROM edges WHERE source = (SELECT p_path FROM parts WHERE p_partkey = 3) AND target = 'src/shared/s5.ts'")
def edges_between(spark, sf_dir):
    first = table(spark, sf_dir, "part").where("p_partkey = 3").select("p_brand", "p_type").first()
    path = "src/repository/common/p3.ts" if first.p_type == "STANDARD" else f"src/repository/features/{first.p_brand}/p3.ts"
    return graph.edges_between(edges(spark, sf_dir), path, "src/shared/s5.ts").select("kind", "line")


@query(f"{_BASE} SELECT (SELECT count(*) FROM files) AS files, count(*) AS imports, count(*) FILTER (is_type_only) AS type_only, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges")
def graph_stats(spark, sf_dir):
    return graph.stats(files(spark, sf_dir), edges(spark, sf_dir))


@query(f"{_BASE} SELECT f.path, count(DISTINCT target) AS n FROM files f LEFT JOIN edges e ON f.path = e.source GROUP BY 1")
def adjacency_sizes(spark, sf_dir):
    return graph.adjacency(files(spark, sf_dir), edges(spark, sf_dir))


@query(f"{_BASE} SELECT t.type, count(v.type) AS n FROM (VALUES ('flow'), ('isolation'), ('circular'), ('unmapped'), ('unlayered'), ('orphan'), ('depth'), ('publicApi'), ('dependentBudget'), ('importCount')) t(type) LEFT JOIN violations v ON t.type = v.type GROUP BY 1")
def violation_report_by_type(spark, sf_dir):
    return report.by_type(_violations(spark, sf_dir))


@query(f"{_BASE} SELECT severity, count(*) AS n FROM violations GROUP BY 1")
def violations_by_severity(spark, sf_dir):
    return report.by_severity(_violations(spark, sf_dir))


@query(f"{_BASE} SELECT type, severity, count(*) AS n FROM violations GROUP BY GROUPING SETS ((type), (severity), ())")
def summary_grouping_sets(spark, sf_dir):
    return report.summary(_violations(spark, sf_dir))


@query(f"{_BASE} SELECT source_layer AS layer, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM violations), 6) AS pct FROM violations WHERE source_layer IS NOT NULL GROUP BY 1")
def violations_by_layer_pct(spark, sf_dir):
    return report.by_layer(_violations(spark, sf_dir)).withColumn("pct", F.col("pct").cast("double"))


@query(f"{_BASE} SELECT source_file, count(*) AS n FROM violations GROUP BY 1 ORDER BY n DESC, source_file LIMIT 10")
def hot_files_topk(spark, sf_dir):
    return report.hot_files(_violations(spark, sf_dir))


@query(f"{_BASE} SELECT '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || source_file || ',line=' || coalesce(line, 1) || ',title=' || type AS note, count(*) AS n FROM violations GROUP BY 1")
def sink_annotations(spark, sf_dir):
    rows = _violations(spark, sf_dir).select(report.annotation(with_message=False).alias("note"))
    return rows.groupBy("note").agg(F.count("*").alias("n"))


@query(f"WITH {_HISTORY} SELECT ts, total FROM history ORDER BY ts DESC LIMIT 20")
def history_last_n(spark, sf_dir):
    return report.last_points(_history(spark, sf_dir), 20)


@query(f"WITH {_HISTORY} SELECT ts, total, total - lag(total) OVER (ORDER BY ts) AS change FROM history")
def history_trend(spark, sf_dir):
    return report.trend(_history(spark, sf_dir))


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts is not null").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("total"))


_ROUTES = "routes AS (SELECT l_orderkey AS k, list('n' || s_nationkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS stops FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


def _routes(spark, sf_dir):
    """``k, rule``: a flow rule for each order, the nations of its suppliers in a chain; two stops go both ways."""
    stops = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    chain = F.expr("transform(array_sort(collect_list(struct(l_linenumber, l_suppkey, l_partkey, s_nationkey))), x -> concat('n', x.s_nationkey))")
    rules = stops.groupBy(F.col("l_orderkey").alias("k")).agg(chain.alias("stops"))
    return rules.select("k", F.expr("array_join(stops, if(size(stops) = 2, '<->', ' -> '))").alias("rule"))


@query(f"""WITH {_ROUTES}, pairs AS (SELECT k, unnest(list_transform(range(1, len(stops)), lambda i: [stops[i], stops[i + 1]])) AS p FROM routes
           UNION ALL SELECT k, [stops[2], stops[1]] FROM routes WHERE len(stops) = 2) SELECT p[1] AS from_layer, p[2] AS to_layer, count(*) AS n FROM pairs GROUP BY ALL""")
def flow_chain_pairs(spark, sf_dir):
    """Allowed pairs of flow rules, which are texts in rows; how many rules allow each."""
    return ruleset.flow_pairs(_routes(spark, sf_dir)).groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROUTES}, pairs AS (SELECT DISTINCT k, unnest(stops[:-2]) AS f FROM routes UNION SELECT k, stops[2] FROM routes WHERE len(stops) = 2),
           names AS (SELECT DISTINCT 'n' || s_nationkey AS layer FROM supplier) SELECT layer, count(f) AS n FROM names LEFT JOIN pairs ON layer = f GROUP BY 1""")
def layer_order(spark, sf_dir):
    """How many rules start a pair at each layer."""
    names = table(spark, sf_dir, "supplier").select(F.expr("concat('n', s_nationkey)").alias("layer")).distinct()
    pairs = ruleset.flow_pairs(_routes(spark, sf_dir)).select("k", "from_layer").distinct()
    return report.layer_order(names, pairs)


_SUCCESSOR = "g AS (SELECT p_partkey AS s, (p_partkey * 3 + p_size) % (SELECT count(*) FROM part) + (SELECT min(p_partkey) FROM part) AS t FROM part)"


@query(f"WITH {_SUCCESSOR} SELECT s AS node FROM g WHERE s = t")
def self_loops(spark, sf_dir):
    return graph.self_loops(successor_graph(spark, sf_dir))


# A walk by recursion takes rows as the square of the nodes, so the SQL stops following a node once it is on a cycle's jump.
_JUMPS = "j0 AS (SELECT s, t FROM g), " + ", ".join(f"j{k + 1} AS (SELECT a.s, b.t FROM j{k} a JOIN j{k} b ON a.t = b.s)" for k in range(15)) + ", cyc AS (SELECT DISTINCT t AS s FROM j15)"


@query(f"WITH RECURSIVE {_SUCCESSOR}, {_JUMPS}, r(s, pos) AS (SELECT s, s FROM cyc UNION SELECT r.s, g.t FROM r JOIN g ON r.pos = g.s) SELECT s AS node, min(pos) AS component FROM r GROUP BY s")
def scc_components(spark, sf_dir):
    return graph.successor_cycles(successor_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {_SUCCESSOR}, {_JUMPS}, r(s, pos) AS (SELECT s, s FROM cyc UNION SELECT r.s, g.t FROM r JOIN g ON r.pos = g.s), c AS (SELECT s, min(pos) AS c FROM r GROUP BY s) SELECT c AS component, count(*) AS size FROM c GROUP BY 1")
def cycle_sizes(spark, sf_dir):
    return graph.successor_cycles(successor_graph(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))


@query(f"WITH {_SUCCESSOR}, {_JUMPS} SELECT count(*) > 0 AS cyclic FROM cyc")
def has_any_cycle(spark, sf_dir):
    return graph.successor_cycles(successor_graph(spark, sf_dir)).agg((F.count("*") > 0).alias("cyclic"))


@query(f"""WITH RECURSIVE {_SUCCESSOR}, {_JUMPS}, r(s, pos) AS (SELECT s, s FROM cyc UNION SELECT r.s, g.t FROM r JOIN g ON r.pos = g.s), size AS (SELECT s, count(*) AS n FROM r GROUP BY s),
       d(s, n) AS (SELECT s, n FROM size UNION ALL SELECT g.s, d.n + 1 FROM d JOIN g ON g.t = d.s WHERE g.s NOT IN (SELECT s FROM cyc)) SELECT s AS node, n AS depth FROM d""")
def import_depth(spark, sf_dir):
    return graph.successor_depth(successor_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {_SUCCESSOR}, r(node) AS (SELECT s FROM g WHERE s NOT IN (SELECT t FROM g) UNION SELECT g.t FROM r JOIN g ON r.node = g.s) SELECT node FROM r")
def reachability(spark, sf_dir):
    """All nodes that those without predecessors reach, themselves included."""
    ends = successor_graph(spark, sf_dir)
    start = ends.select(F.col("s").alias("node")).join(ends.select(F.col("t").alias("node")).distinct(), "node", "left_anti")
    return graph.reachable(ends, start).select("node")


@query(f"""{_BASE}, x AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'reexport'), o(barrel, pos, n) AS (SELECT source, target, 1 FROM x UNION SELECT o.barrel, x.target, n + 1 FROM o JOIN x ON o.pos = x.source WHERE n < 10)
       SELECT DISTINCT barrel, pos AS origin FROM o WHERE pos NOT IN (SELECT source FROM x)""")
def barrel_origins(spark, sf_dir):
    return graph.origins(edges(spark, sf_dir).where("kind = 'reexport'"))


_STATES = "old AS (SELECT 'o' || o_orderkey AS path, o_totalprice AS stamp FROM orders WHERE o_orderkey % 5 <> 0), new AS (SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS stamp FROM orders WHERE o_orderkey % 7 <> 0)"


def _states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    old = orders.where("o_orderkey % 5 <> 0").select("path", F.col("o_totalprice").alias("stamp"))
    return old, orders.where("o_orderkey % 7 <> 0").select("path", F.expr("if(o_orderkey % 3 = 0, o_totalprice + 1, o_totalprice)").alias("stamp"))


@query(f"WITH {_STATES} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' WHEN old.stamp = new.stamp THEN 'same' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.path = new.path")
def cache_diff(spark, sf_dir):
    return incremental.changes(*_states(spark, sf_dir))


@query("SELECT 'src/services/o' || l_orderkey || '.ts' AS source, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1")
def cache_merge(spark, sf_dir):
    every = edges(spark, sf_dir).where("specifier = 'part'")
    old, new = _states(spark, sf_dir)
    named = lambda df: df.withColumn("path", F.concat(F.lit("src/services/"), F.col("path"), F.lit(".ts")))
    changed = incremental.changes(named(old), named(new))
    before = every.join(named(old).select(F.col("path").alias("source")), "source", "left_semi")
    fresh = every.join(changed.where("status in ('new', 'changed')").select(F.col("path").alias("source")), "source", "left_semi")
    return incremental.merged(before.select(every.columns), fresh.select(every.columns), changed).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT 'src/a/m' || (p_partkey % 50) || '.ts' AS source, CASE p_partkey % 5 WHEN 0 THEN './n' || p_partkey WHEN 1 THEN '../b/n' || p_partkey || '.js' WHEN 2 THEN 'lib' || p_partkey WHEN 3 THEN './none' || p_partkey ELSE '../b/d' || p_partkey END AS specifier, p_partkey AS k FROM part)
          SELECT source, specifier, CASE k % 5 WHEN 2 THEN 'external' WHEN 3 THEN 'unresolved' ELSE 'resolved' END AS status,
                 CASE k % 5 WHEN 0 THEN 'src/a/n' || k || '.tsx' WHEN 1 THEN 'src/b/n' || k || '.ts' WHEN 4 THEN 'src/b/d' || k || '/index.js' END AS target FROM v""")
def resolve_first_match(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    specifier = F.expr("case p_partkey % 5 when 0 then './n' || p_partkey when 1 then '../b/n' || p_partkey || '.js' when 2 then 'lib' || p_partkey when 3 then './none' || p_partkey else '../b/d' || p_partkey end")
    imports = part.select(F.expr("'src/a/m' || (p_partkey % 50) || '.ts'").alias("source"), specifier.alias("specifier"))
    names = F.expr("case p_partkey % 5 when 0 then array('src/a/n' || p_partkey || '.tsx', 'src/a/n' || p_partkey || '/index.ts') when 1 then array('src/b/n' || p_partkey || '.ts') when 4 then array('src/b/d' || p_partkey || '/index.js') end")
    return resolve.resolved(imports, part.select(F.explode(names).alias("path")))


@query("SELECT 'pkg' || (p_partkey % 9) || CASE WHEN p_partkey % 2 = 0 THEN '/sub/x' ELSE '' END || CASE WHEN p_partkey % 4 = 3 THEN 'y' ELSE '' END AS specifier FROM part WHERE p_partkey % 9 IN (1, 4) AND p_partkey % 4 <> 3")
def workspace_prefix_match(spark, sf_dir):
    imports = table(spark, sf_dir, "part").select(F.expr("'pkg' || (p_partkey % 9) || if(p_partkey % 2 = 0, '/sub/x', '') || if(p_partkey % 4 = 3, 'y', '')").alias("specifier"))
    return resolve.workspace_imports(imports, spark.createDataFrame([("pkg1",), ("pkg4",)], "name string"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def extract_links_from_html(spark, sf_dir):
    return code.links(table(spark, sf_dir, "pages"))


@query(f"{_BASE} SELECT type, count(*) AS n FROM violations WHERE type IN ('flow', 'isolation', 'unlayered', 'unmapped') AND NOT (source_file LIKE 'src/services/%' AND coalesce(target_file, '') LIKE 'src/misc/%') GROUP BY 1")
def glob_exceptions(spark, sf_dir):
    return rules.edge_violations(edges(spark, sf_dir), RULES, apply_exceptions=True).groupBy("type").agg(F.count("*").alias("n"))


# A graph of as many modules as there are parts, in packages of 48: general graphs against recursive SQL.
_M_PATH = "CASE WHEN {k} % 48 < 12 THEN 'src/handlers/auto/c' WHEN {k} % 48 < 24 THEN 'src/services/o' WHEN {k} % 48 < 36 AND {k} % 2 = 0 THEN 'src/repository/common/p' WHEN {k} % 48 < 36 THEN 'src/repository/features/b' || ({k} % 48 % 4) || '/p' WHEN {k} % 48 % 7 = 0 THEN 'src/misc/s' ELSE 'src/shared/s' END || {k} || '.ts'"
_M_FILES = f"files AS (SELECT {_M_PATH.format(k='p_partkey')} AS path FROM part UNION ALL VALUES ('src/index.ts'), ('src/app.tsx'), ('src/app/x.ts'))"
_M_EDGES = f"""ends AS (SELECT p_partkey AS k, p_partkey + 4 + p_size % 6 AS t FROM part WHERE p_partkey % 48 + 4 + p_size % 6 < 48 UNION SELECT p_partkey, p_partkey - p_partkey % 48 % 12 FROM part WHERE p_size % 10 = 7),
edges AS (SELECT {_M_PATH.format(k='k')} AS source, {_M_PATH.format(k='t')} AS target, 'module' AS specifier, false AS is_type_only, 'static' AS kind, 1 AS line FROM ends WHERE t IN (SELECT p_partkey FROM part))"""
_M_REACH = "reach(a, b) AS (SELECT source, target FROM edges UNION SELECT r.a, e.target FROM reach r JOIN edges e ON r.b = e.source)"
_M_CYCLES = "cyc AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_M_DEPTH = """every AS (SELECT source AS node FROM edges UNION SELECT target FROM edges),
comp AS (SELECT node, coalesce(component, node) AS c FROM every LEFT JOIN cyc USING (node)),
weight AS (SELECT c, CAST(count(*) FILTER (node IN (SELECT node FROM cyc)) AS BIGINT) AS w FROM comp GROUP BY c),
dag AS (SELECT DISTINCT a.c AS a, b.c AS b FROM edges JOIN comp a ON source = a.node JOIN comp b ON target = b.node WHERE a.c <> b.c),
d(c, d) AS (SELECT c, w FROM weight UNION SELECT dag.a, d.d + 1 + w FROM d JOIN dag ON d.c = dag.b JOIN weight ON dag.a = weight.c),
depth AS (SELECT node, max(d) AS depth FROM comp JOIN d USING (c) GROUP BY node)"""
_MODULES = f"WITH RECURSIVE {_M_FILES}, {_M_EDGES}, {_M_REACH}, {_M_CYCLES}"
_M_LOOPS = "loops(component, pos, hops) AS (SELECT c.component, e.target, 1 FROM cyc c JOIN edges e ON c.node = c.component AND e.source = c.node UNION SELECT l.component, e.target, hops + 1 FROM loops l JOIN edges e ON l.pos = e.source JOIN cyc x ON x.node = e.target AND x.component = l.component WHERE hops < 40 AND l.pos <> l.component)"
#: Rules of the module graph: those of the whole graph with lower limits and with depth.
MODULE_RULES = dataclasses.replace(RULES, layers=tuple(dataclasses.replace(x, max_dependents=0) if x.name == "services" else x for x in RULES.layers), max_imports=1, max_depth=8)
_M_ALL = _ALL.replace("count(*) > 20", "count(*) > 1").replace("HAVING count(DISTINCT s_layer) > 1", "HAVING count(DISTINCT s_layer) > 0").replace("WHERE path NOT IN (SELECT target FROM edges))", """WHERE path NOT IN (SELECT target FROM edges) AND NOT regexp_matches(path, '^(src/)?(index|main)[.][jt]sx?$|^src/app[.][jt]sx?$')
  UNION ALL SELECT 'circular', 'error', component, NULL, NULL, NULL FROM cyc GROUP BY component
  UNION ALL SELECT 'depth', 'warn', node, NULL, NULL, NULL FROM depth WHERE depth > 8)""")


def _module_graph(spark, sf_dir):
    return module_edges(spark, sf_dir).select(F.col("source").alias("s"), F.col("target").alias("t"))


@query(f"{_MODULES} SELECT node, component FROM cyc")
def strong_components(spark, sf_dir):
    """Cyclic components of a general graph."""
    return graph.strong_components(_module_graph(spark, sf_dir))


@query(f"{_MODULES}, {_M_DEPTH} SELECT node, depth FROM depth")
def chain_lengths(spark, sf_dir):
    """Longest chains of a general graph."""
    return graph.chain_lengths(_module_graph(spark, sf_dir))


@query(f"{_MODULES}, {_M_LOOPS} SELECT component, min(hops) AS length, true AS is_cycle FROM loops WHERE pos = component GROUP BY component")
def cycle_paths(spark, sf_dir):
    """A shortest cycle of each component, every step of which is an edge."""
    ends = _module_graph(spark, sf_dir)
    found = graph.cycle_paths(ends, graph.strong_components(ends))
    steps = found.select("component", F.size("path").alias("n"), F.inline(F.expr("transform(sequence(1, size(path) - 1), i -> named_struct('s', path[i - 1], 't', path[i]))")))
    known = steps.join(ends.distinct().withColumn("edge", F.lit(True)), ["s", "t"], "left")
    return known.groupBy("component").agg((F.max("n") - 1).alias("length"), F.bool_and(F.coalesce("edge", F.lit(False))).alias("is_cycle"))


@query(f"{_MODULES} SELECT DISTINCT source AS node FROM edges WHERE source = target")
def module_self_loops(spark, sf_dir):
    """Files that import themselves."""
    return graph.self_loops(_module_graph(spark, sf_dir))


@query(f"{_MODULES} SELECT count(*) > 0 AS cyclic FROM cyc")
def module_has_cycle(spark, sf_dir):
    """Whether a general graph has any cycle."""
    return graph.strong_components(_module_graph(spark, sf_dir)).agg((F.count("*") > 0).alias("cyclic"))


@query(f"{_MODULES} SELECT target, kind, line FROM edges WHERE source = 'src/handlers/auto/c2.ts' AND target IN ('src/handlers/auto/c6.ts', 'src/handlers/auto/c7.ts', 'src/handlers/auto/c8.ts', 'src/handlers/auto/c9.ts', 'src/handlers/auto/c10.ts', 'src/handlers/auto/c11.ts')")
def module_edges_between(spark, sf_dir):
    """Edges from one file to each of six others."""
    every = module_edges(spark, sf_dir)
    found = [graph.edges_between(every, "src/handlers/auto/c2.ts", f"src/handlers/auto/c{k}.ts") for k in range(6, 12)]
    return functools.reduce(DataFrame.union, found).select("target", "kind", "line")


@query(f"WITH RECURSIVE {_M_FILES}, {_M_EDGES}, r(node, hops) AS (SELECT path, 0 FROM files WHERE path NOT IN (SELECT target FROM edges) UNION SELECT e.target, hops + 1 FROM r JOIN edges e ON r.node = e.source WHERE hops < 48) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def reachable_from_roots(spark, sf_dir):
    """Every file that those without importers reach, with the fewest steps."""
    ends = _module_graph(spark, sf_dir)
    roots = module_files(spark, sf_dir).join(ends.select(F.col("t").alias("path")).distinct().hint("merge"), "path", "left_anti").select(F.col("path").alias("node"))
    return graph.reachable(ends, roots)


_M_CHECKED = f"{_MODULES}, {_M_DEPTH}, {_PLACE.strip()}, {_JUDGED.strip()}, {_M_ALL.strip()}"


def _module_violations(spark, sf_dir):
    return rules.check(module_files(spark, sf_dir), module_edges(spark, sf_dir), MODULE_RULES, circular=True)


@query(f"{_M_CHECKED} SELECT type, severity, count(*) AS n FROM violations GROUP BY GROUPING SETS ((type), (severity), ())")
def module_summary(spark, sf_dir):
    """Counts by type, by severity and in all, cycles and depth among them."""
    return report.summary(_module_violations(spark, sf_dir))


@query(f"{_M_CHECKED} SELECT source_layer AS layer, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM violations), 6) AS pct FROM violations WHERE source_layer IS NOT NULL GROUP BY 1")
def module_by_layer_pct(spark, sf_dir):
    """Shares of the layers in all violations, cycles and depth among them."""
    return report.by_layer(_module_violations(spark, sf_dir)).withColumn("pct", F.col("pct").cast("double"))


@query(f"{_M_CHECKED} SELECT source_file, count(*) AS n FROM violations GROUP BY 1 ORDER BY n DESC, source_file LIMIT 10")
def module_hot_files(spark, sf_dir):
    """Files with most violations, cycles and depth among them."""
    return report.hot_files(_module_violations(spark, sf_dir))


@query(f"{_MODULES}, {_M_DEPTH}, {_PLACE.strip()}, {_JUDGED.strip()}, {_M_ALL.strip()} SELECT type, severity, count(*) AS n FROM violations GROUP BY 1, 2")
def ten_types_of_violations(spark, sf_dir):
    """All rules at once, cycles and depth among them."""
    return _module_violations(spark, sf_dir).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query(f"{_MODULES}, {_M_DEPTH}, {_PLACE.strip()}, {_JUDGED.strip()}, {_M_ALL.strip()} SELECT source_file FROM violations WHERE type = 'orphan'")
def orphans_but_entry_points(spark, sf_dir):
    """Files that nothing imports, some of which are entry points."""
    return rules.orphan_violations(module_files(spark, sf_dir), module_edges(spark, sf_dir), MODULE_RULES).select("source_file")


@query(f"{_MODULES}, {_M_DEPTH}, {_PLACE.strip()}, {_JUDGED.strip()}, {_M_ALL.strip()} SELECT source_file FROM violations WHERE type = 'orphan' AND NOT regexp_matches(source_file, '(^|/)(routes|controllers|middlewares?|handlers)(/|$)|^(src/)?(index|main|server|app)[.](ts|js|mjs|cjs)$')")
def orphans_of_a_framework(spark, sf_dir):
    """Orphans without what a framework uses by itself."""
    return rules.orphan_violations(module_files(spark, sf_dir), module_edges(spark, sf_dir), MODULE_RULES, framework="node-backend").select("source_file")


# A source text for each part: lexer, mappings, names through barrels.
_T_NAME = "(CASE WHEN {k} % 2 = 1 THEN 'b' ELSE 'm' END || {k})"
_T_PATH = "('lib/' || CASE WHEN {k} % 2 = 1 THEN 'b' || {k} || '/index.ts' ELSE 'm' || {k} || '.ts' END)"
_TO, _NEXT = "((p_partkey * 7 + p_size) % top + 1)", "(p_partkey % top + 1)"
_TEXTS = f"""p AS (SELECT p_partkey, p_size, (SELECT max(p_partkey) FROM part) AS top FROM part),
found AS (
  SELECT {_T_PATH.format(k="p_partkey")} AS source, CASE WHEN p_size % 2 = 0 THEN '@/' ELSE './' END || {_T_NAME.format(k=_TO)} AS specifier, {_T_PATH.format(k=_TO)} AS target, 'static' AS kind, false AS is_type_only, 3 AS line FROM p WHERE p_partkey % 2 = 0
  UNION ALL SELECT {_T_PATH.format(k="p_partkey")}, 'react', NULL, 'dynamic', false, 4 FROM p WHERE p_partkey % 2 = 0 AND p_size % 5 = 0
  UNION ALL SELECT {_T_PATH.format(k="p_partkey")}, './gone' || p_partkey, NULL, 'static', true, CASE WHEN p_size % 5 = 0 THEN 5 ELSE 4 END FROM p WHERE p_partkey % 2 = 0 AND p_size % 7 = 0
  UNION ALL SELECT {_T_PATH.format(k="p_partkey")}, '../' || {_T_NAME.format(k=_NEXT)}, {_T_PATH.format(k=_NEXT)}, 'reexport', false, 1 FROM p WHERE p_partkey % 2 = 1
  UNION ALL SELECT {_T_PATH.format(k="p_partkey")}, '../' || {_T_NAME.format(k=_TO)}, {_T_PATH.format(k=_TO)}, 'reexport', false, 2 FROM p WHERE p_partkey % 2 = 1)"""


def _built(spark, sf_dir):
    return project.build(module_texts(spark, sf_dir), packages=False)


@query(f"WITH {_TEXTS} SELECT source, specifier, kind, is_type_only, line FROM found")
def imports_of_texts(spark, sf_dir):
    """Imports among comments, strings, templates and regular expressions."""
    return code.imports(module_texts(spark, sf_dir)).select("source", "specifier", "kind", "is_type_only", "line")


@query(f"WITH {_TEXTS} SELECT DISTINCT source, specifier, CASE WHEN target IS NOT NULL THEN 'resolved' WHEN specifier = 'react' THEN 'external' ELSE 'unresolved' END AS status, target FROM found")
def whole_build(spark, sf_dir):
    """From texts to what each import resolves to, aliases included."""
    return _built(spark, sf_dir).statuses


@query(f"""WITH RECURSIVE {_TEXTS}, links AS (
  SELECT {_T_PATH.format(k="p_partkey")} AS file, {_T_PATH.format(k=_NEXT)} AS target, unnest(['a' || (p_partkey % 3), 'a1']) AS there, unnest(['a0', 'a1']) AS here FROM p WHERE p_partkey % 2 = 1
  UNION SELECT {_T_PATH.format(k="p_partkey")}, {_T_PATH.format(k=_TO)}, '*', '*' FROM p WHERE p_partkey % 2 = 1),
wanted AS (SELECT DISTINCT {_T_PATH.format(k=_TO)} AS start, 'a' || (p_partkey % 3) AS asked FROM p WHERE p_partkey % 2 = 0 AND {_TO} % 2 = 1),
walk(start, asked, file, name) AS (SELECT start, asked, start, asked FROM wanted UNION
  SELECT w.start, w.asked, l.target, CASE WHEN l.here = '*' THEN w.name ELSE l.there END FROM walk w JOIN links l ON w.file = l.file AND l.target <> l.file
  WHERE l.here = w.name OR l.here = '*' AND NOT list_contains(['a0', 'a1'], w.name)),
own AS (SELECT {_T_PATH.format(k="p_partkey")} AS file, 'a' || (p_partkey % 3) AS name FROM p WHERE p_partkey % 2 = 0)
SELECT DISTINCT start AS file, asked AS name, w.file AS origin, w.name AS origin_name FROM walk w JOIN own ON w.file = own.file AND w.name = own.name""")
def origins_of_names(spark, sf_dir):
    """Where the names that are imported from barrels come from, through renames and stars."""
    built = _built(spark, sf_dir)
    wanted = built.edges.where((F.col("kind") == "static") & code.is_barrel_name(F.col("target"))).select(F.col("target").alias("file"), F.explode("names.name").alias("name"))
    return barrels.origins_of_names(wanted, built.reexports(), built.exports)


@query("""WITH p AS (SELECT p_partkey AS k, p_size, (SELECT max(p_partkey) FROM part) AS top FROM part)
       SELECT 'src/f' || k || '.ts' AS source, './f' || t AS specifier, CASE WHEN t % 11 = 0 OR t NOT IN (SELECT k FROM p) THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN t % 11 <> 0 AND t IN (SELECT k FROM p) THEN 'src/f' || t || '.ts' END AS target
       FROM (SELECT k, CASE WHEN k % 3 = 0 THEN (k * 7) % top + 1 ELSE (k * 3 + p_size) % top + 1 END AS t FROM p WHERE k % 11 <> 0)""")
def incremental_build(spark, sf_dir):
    """The state after a stream of file changes that come in any order, some of them twice."""
    folder = f"{shared_folder(spark)}/tierflow/build-{uuid.uuid4().hex}"
    log = changes(spark, sf_dir)
    late = F.expr("pmod(xxhash64(path, version), 3)")
    for k in range(3):  # a file of the log is a batch; the second has all of the first again
        log.where(late == k if k != 1 else late <= 1).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    store = build.build_store(spark, f"{folder}/state", fingerprint(RULES), 16)
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    build.watch_files(source, store, None, f"{folder}/checkpoint", once=True).awaitTermination()
    return build.statuses_of(store)


_R_PACKAGE = "CAST(CAST(regexp_extract(source, '([0-9]+)[.]ts$', 1) AS BIGINT) // 48 AS VARCHAR)"
_R_LAYER = "CASE WHEN {c} LIKE 'src/handlers/%' THEN 'handlers' WHEN {c} LIKE 'src/services/%' THEN 'services' WHEN {c} LIKE 'src/repository/%' THEN 'repository' WHEN {c} LIKE 'src/shared/%' THEN CASE WHEN k % 2 = 0 THEN 'shared' ELSE 'tools' END END"
_RULES = f"""WITH {_M_FILES}, {_M_EDGES}, e AS (SELECT *, {_R_PACKAGE} AS package, CAST({_R_PACKAGE} AS BIGINT) AS k FROM edges),
own AS (SELECT *, {_R_LAYER.format(c="source")} AS s, {_R_LAYER.format(c="target")} AS t, CASE k % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'ignore' END AS level FROM e WHERE k % 5 <> 4),
ok AS (SELECT *, CASE WHEN k % 3 = 0 THEN (s, t) IN (('handlers', 'services'), ('services', 'repository'), ('repository', 'shared'), ('repository', 'tools')) ELSE (s, t) IN (('handlers', 'services'), ('services', 'repository'), ('repository', 'services')) END AS fine FROM own),
v AS (SELECT package, 'unlayered' AS type, level AS severity FROM ok WHERE s IS NOT NULL AND t IS NULL AND level <> 'ignore'
  UNION ALL SELECT package, 'flow', 'error' FROM ok WHERE s <> t AND NOT fine
  UNION ALL SELECT DISTINCT ON (package, source) package, 'unmapped', 'warn' FROM ok WHERE s IS NULL
  UNION ALL SELECT package, 'importCount', 'warn' FROM ok WHERE k % 2 = 0 GROUP BY package, source HAVING count(*) > 1
  UNION ALL SELECT package, 'dependentBudget', 'warn' FROM ok WHERE k % 3 = 1 AND s <> t GROUP BY package, t)"""


@query(f"{_RULES} SELECT package, type, severity, count(*) AS n FROM v GROUP BY ALL")
def rules_of_packages(spark, sf_dir):
    """A rule set for every package, all judged in one plan."""
    return workspace.check_packages(*rule_tables(spark, sf_dir)).groupBy("package", "type", "severity").agg(F.count("*").alias("n"))


@query(f"""{_RULES}, every AS (SELECT DISTINCT package FROM own), each AS (SELECT e.package, severity FROM every e LEFT JOIN v ON e.package = v.package)
       SELECT package, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed FROM each GROUP BY GROUPING SETS ((package), ())""")
def package_totals(spark, sf_dir):
    """Errors and warnings of every package and of all together."""
    tables = rule_tables(spark, sf_dir)
    return workspace.package_totals(stored(workspace.check_packages(*tables), "packages"), tables[3])


_FOLDERS = _FILE_NAMES + ", f AS (SELECT string_split(path, '/') AS p FROM listing WHERE regexp_matches(path, '[.](ts|tsx|js|jsx)$'))"


@query(f"WITH {_FOLDERS} SELECT folder, count(*) AS n FROM (SELECT unnest(list_transform(range(len(p)), lambda k: array_to_string(p[1:k], '/'))) AS folder FROM f) GROUP BY 1")
def folder_counts(spark, sf_dir):
    """Source files below each folder."""
    return folders.folder_counts(_listing(spark, sf_dir))


@query(f"{_M_CHECKED}, n AS (SELECT type, count(*) AS n FROM violations WHERE type <> 'orphan' GROUP BY 1) SELECT label, n, round(n * 100.0 / (SELECT count(*) FROM violations), 6) AS pct FROM n JOIN (VALUES ('flow', 'Flow'), ('isolation', 'Isolation'), ('circular', 'Circular'), ('unlayered', 'Unlayered'), ('depth', 'Depth'), ('publicApi', 'Public API'), ('dependentBudget', 'Dependents'), ('importCount', 'Import Count'), ('unmapped', 'Unmapped')) l(type, label) USING (type)")
def type_chart(spark, sf_dir):
    """Shares of the types of violations, cycles and depth among them."""
    return report.type_chart(stored(_module_violations(spark, sf_dir), "violations")).withColumn("pct", F.col("pct").cast("double"))


_TRIED = "part p, (VALUES (0, ['.js', '.mts'], '.js'), (1, ['.mts', '/index.ts'], '/index.ts'), (2, ['.jsx', '.d.ts'], '.d.ts'), (3, ['.cjs', '.mjs'], '.mjs'), (4, ['/index.cjs', ''], '/index.cjs'), (5, ['/index.mts', '.cts', '/index.jsx'], '/index.jsx')) t(k, ends, first)"


@query(f"SELECT './x' || p_partkey AS specifier, 'a/x' || p_partkey || first AS target FROM {_TRIED} WHERE p_partkey % 6 = k")
def resolve_order(spark, sf_dir):
    """Of several files that an import may stand for, the one that is tried first."""
    ends = F.expr("case p_partkey % 6 when 0 then array('.js', '.mts') when 1 then array('.mts', '/index.ts') when 2 then array('.jsx', '.d.ts') when 3 then array('.cjs', '.mjs') when 4 then array('/index.cjs', '') else array('/index.mts', '.cts', '/index.jsx') end")
    part = table(spark, sf_dir, "part").select("p_partkey", ends.alias("ends"))
    names = part.select(F.expr("inline(transform(ends, e -> named_struct('path', concat('a/x', p_partkey, e))))"))
    imports = part.select(F.lit("a/m.ts").alias("source"), F.expr("concat('./x', p_partkey)").alias("specifier"))
    return resolve.resolved(imports, names).select("specifier", "target")


_WORKSPACE = """w AS (SELECT s_suppkey AS k, '@n' || s_nationkey || '/s' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 0 THEN 'packages/s' WHEN 1 THEN 'deep/n' || s_nationkey || '/s' WHEN 2 THEN 'other/s' ELSE 'deep/node_modules/s' END || s_suppkey AS folder,
  CASE s_suppkey % 3 WHEN 0 THEN './src/a.ts' WHEN 1 THEN './i.ts' ELSE 'm.ts' END AS main FROM supplier)"""


def _workspace(spark, sf_dir):
    """Texts of a workspace with a package for each supplier."""
    folder = "concat(case s_suppkey % 4 when 0 then 'packages/s' when 1 then concat('deep/n', s_nationkey, '/s') when 2 then 'other/s' else 'deep/node_modules/s' end, s_suppkey)"
    main = """case s_suppkey % 3 when 0 then '"exports": {".": "./src/a.ts"}, "main": "no.js"' when 1 then '"exports": {".": {"require": "./r.ts", "import": "./i.ts"}}' else '"exports": {"./x": "./x.ts"}, "main": "m.ts"' end"""
    each = table(spark, sf_dir, "supplier").select(F.expr(f"concat({folder}, '/package.json')").alias("path"), F.expr(f"""concat('{{"name": "@n', s_nationkey, '/s', s_suppkey, '", ', {main}, '}}')""").alias("content"))
    return each.union(spark.createDataFrame([("package.json", '{"name": "root", "workspaces": {"packages": ["packages/*", "deep/**"]}}')], "path string, content string"))


@query(f"WITH {_WORKSPACE} SELECT name, folder, main, CAST(k % 4 AS INTEGER) AS nth FROM w WHERE k % 4 < 2")
def workspace_packages(spark, sf_dir):
    """Packages whose folders fit a workspace's patterns, with their main files."""
    texts = _workspace(spark, sf_dir)
    return workspace.packages_of(texts, workspace.patterns_of(texts))


@query(f"""WITH {_WORKSPACE}, i AS (SELECT 'm' || p_partkey || '.ts' AS source, w.*, p_partkey % 2 = 0 AS inner_ FROM part JOIN w ON p_partkey % (SELECT count(*) FROM w) + 1 = k)
           SELECT source, name || CASE WHEN inner_ THEN '/tools' ELSE '' END AS specifier, CASE WHEN k % 4 < 2 THEN 'resolved' ELSE 'external' END AS status, CASE WHEN k % 4 < 2 THEN folder || '/' || CASE WHEN inner_ THEN 'tools/index.tsx' ELSE ltrim(main, './') END END AS target FROM i""")
def package_imports(spark, sf_dir):
    """Imports of a workspace's packages, by name and of what is in them."""
    texts = _workspace(spark, sf_dir)
    packages = workspace.packages_of(texts, workspace.patterns_of(texts))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('@n', s_nationkey, '/s', s_suppkey)").alias("name"))
    n = supplier.agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select("p_partkey", (F.col("p_partkey") % F.col("n") + 1).alias("s_suppkey"))  # one row
    imports = part.join(supplier, "s_suppkey").select(F.expr("concat('m', p_partkey, '.ts')").alias("source"), F.expr("concat(name, if(p_partkey % 2 = 0, '/tools', ''))").alias("specifier"))
    names = packages.select(F.expr("inline(array(named_struct('path', concat(folder, '/tools/index.tsx')), named_struct('path', concat(folder, '/tools.ts')), named_struct('path', concat(folder, '/', regexp_replace(main, '^[.]/', '')))))"))
    return resolve.resolved(imports, names, packages=packages)


_NAMES = ["app", "pages", "components", "hooks", "utils", "lib", "services", "api", "types", "stores", "legacy", "tools"]
_AREAS = f"""f AS (SELECT {_NAMES}[p_partkey % 12 + 1] AS name, p_partkey % 3 = 0 AS top FROM part),
c AS (SELECT 'src' AS path, 'src' AS name, count(*) AS n FROM f WHERE NOT top HAVING count(*) > 0 UNION ALL SELECT CASE WHEN top THEN '' ELSE 'src/' END || name, name, count(*) FROM f GROUP BY top, name),
r AS (SELECT path, name, name NOT IN ('legacy', 'tools') AS is_common, n, CAST(row_number() OVER (ORDER BY name IN ('legacy', 'tools'), n DESC, path) AS INTEGER) AS rank FROM c)"""


def _areas(spark, sf_dir):
    names = F.expr(f"concat(if(p_partkey % 3 = 0, '', 'src/'), element_at(array({', '.join(map(repr, _NAMES))}), cast(p_partkey % 12 + 1 as int)), if(p_partkey % 5 = 0, '/in/', '/'), 'p', p_partkey, '.ts')")
    return table(spark, sf_dir, "part").select(names.alias("path"))


@query(f"WITH {_AREAS} SELECT path, name, is_common, n, rank FROM r")
def layer_candidates(spark, sf_dir):
    """Folders that look like layers, in order."""
    return folders.layer_candidates(_areas(spark, sf_dir)).select("path", "name", "is_common", "n", "rank")


@query(f"""WITH {_AREAS} SELECT a || CASE WHEN twoway THEN ' <-> ' ELSE ' -> ' END || b AS rule FROM (VALUES {", ".join(f"('{a}', '{b}', {both})" for both, pairs in (("false", dict.fromkeys(folders.FLOW)), ("true", folders.BOTH)) for a, b in pairs)}) t(a, b, twoway) WHERE a IN (SELECT name FROM r) AND b IN (SELECT name FROM r)""")
def suggested_flow(spark, sf_dir):
    """Usual flow between the folders that there are."""
    return folders.suggested_flow(folders.layer_candidates(_areas(spark, sf_dir)))


@query(f"""{_M_CHECKED.replace("SELECT outcome AS type, 'error' AS severity, source AS source_file, target AS target_file, s_layer AS source_layer, line FROM", "SELECT outcome AS type, 'error' AS severity, source AS source_file, CASE WHEN outcome = 'flow' THEN t_layer END AS target_file, s_layer AS source_layer, line FROM")}
       SELECT '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || source_file || ',line=' || coalesce(line, 1) || ',title=' || CASE type WHEN 'flow' THEN 'Layer violation: ' || source_layer || ' → ' || target_file WHEN 'isolation' THEN 'Feature isolation violation' WHEN 'circular' THEN 'Circular dependency' WHEN 'unmapped' THEN 'Unmapped file' ELSE 'Architecture violation' END AS note, count(*) AS n FROM violations GROUP BY 1
       UNION ALL SELECT '::notice::Found ' || count(*) || ' violation(s): ' || count(*) FILTER (severity = 'error') || ' error(s), ' || count(*) FILTER (severity = 'warn') || ' warning(s)', 1 FROM violations""")
def ci_report(spark, sf_dir):
    """The lines of a CI log up to their messages, with the closing notice."""
    lines = report.ci_lines(stored(_module_violations(spark, sf_dir), "violations"))
    note = F.when(F.col("kind") == "notice", F.col("line")).otherwise(F.regexp_extract("line", "^(::[^:]*(: [^:]*)?)::", 1))
    return lines.select(note.alias("note")).groupBy("note").agg(F.count("*").alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS project, CASE c_custkey % 9 WHEN 0 THEN 'nextjs-app' WHEN 1 THEN 'nextjs-pages' WHEN 2 THEN 'vite-react' WHEN 3 THEN 'angular' WHEN 4 THEN 'vue' WHEN 5 THEN 'nextjs-pages' WHEN 6 THEN 'vue' WHEN 7 THEN 'node' ELSE 'unknown' END AS framework, c_custkey % 2 = 0 AS typescript FROM customer""")
def frameworks_of_projects(spark, sf_dir):
    """What framework each project uses, by its files and dependencies."""
    paths = "case c_custkey % 9 when 0 then array('next.config.mjs', 'pages/a.tsx', 'src/app/x.tsx') when 1 then array('next.config.js', 'src/pages/b.tsx') when 2 then array('vite.config.ts', 'angular.json') when 3 then array('angular.json', 'nuxt.config.js') when 4 then array('nuxt.config.ts') else array('src/a.ts') end"
    needs = "case c_custkey % 9 when 5 then '\"dependencies\": {\"next\": \"1\", \"vue\": \"1\"}' when 6 then '\"devDependencies\": {\"nuxt\": \"1\"}' when 7 then '\"dependencies\": {\"koa\": \"1\"}, \"devDependencies\": {\"x\": \"1\"}' else '\"name\": \"express\"' end"
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project"), F.expr(f"concat({paths}, if(c_custkey % 2 = 0, array('tsconfig.json'), array()), array('package.json'))").alias("paths"), F.expr(f"concat('{{', {needs}, '}}')").alias("text"))
    files = customer.select("project", F.explode("paths").alias("path"), "text").select("project", "path", F.when(F.col("path") == "package.json", F.col("text")).alias("content"))
    return workspace.frameworks_of(files)


@query(f"WITH {_HISTORY}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, total, row_number() OVER (ORDER BY ts) AS k FROM history) SELECT day || 'T00:00:00Z' AS timestamp, day AS date, total, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS files FROM d")
def history_points(spark, sf_dir):
    """Points of a history from JSON texts of three shapes."""
    days = _history(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "total", F.row_number().over(Window.orderBy("ts")).alias("k"))  # one row a day
    counts = "concat('{\"total\": ', total, '}')"
    point = f"concat('{{\"timestamp\": \"', day, 'T00:00:00Z\", ', if(k % 3 = 0, concat('\"report\": {{\"counts\": ', {counts}, '}}'), concat('\"counts\": ', {counts}, ', \"fileCount\": ', k)), '}}')"
    texts = days.select(F.expr(f"case k % 3 when 0 then concat('[', {point}, ']') when 1 then concat('{{\"history\": [', {point}, ']}}') else {point} end").alias("content"))
    found = history.history_of(texts.union(spark.createDataFrame([("no json",), ("{",), ("[1",), ("",)], "content string")))
    return found.select("timestamp", "date", F.element_at("counts", "total").alias("total"), "files")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports against the declared flow, by pair of layers."""
    return flow_violations(spark, sf_dir).groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n"))
