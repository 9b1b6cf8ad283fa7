"""From the texts of a folder to its graph and violations, as lazy plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.frameworks import ignored
from tierflow.functions.paths import matches
from tierflow.operators import barrels, rules
from tierflow.operators.resolve import resolved
from tierflow.operators.workspace import packages_of, patterns_of
from tierflow.plans.compiler import path_mappings
from tierflow.plans.ruleset import RuleSet
from tierflow.shared import stored
from tierflow.sources import code


@dataclass(frozen=True)
class Project:
    """Tables of a build: files (path), imports, statuses (source, specifier, status, target), edges with ``names``, exports (file, name), errors (path, error)."""

    files: DataFrame
    imports: DataFrame
    statuses: DataFrame
    edges: DataFrame
    exports: DataFrame
    errors: DataFrame

    def unresolved(self) -> DataFrame:
        """``source, specifier`` of imports that no file answers."""
        return self.statuses.where("status = 'unresolved'").select("source", "specifier")

    def externals(self) -> DataFrame:
        """``specifier`` of everything imported from outside."""
        return self.statuses.where("status = 'external'").select("specifier").distinct()

    def reexports(self) -> DataFrame:
        """``source, target, names`` of the re-exports among the edges."""
        return self.edges.where("kind = 'reexport'").select("source", "target", "names")


def texts_of(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of all files below ``root``, paths relative to it."""
    base = "/" + root.partition(":")[2].lstrip("/") if ":" in root else "/" + root.strip("/")
    files = code.source_files(spark, root)
    return files.select(F.expr(f"substring(path, {len(base.rstrip('/')) + 2})").alias("path"), "content")


def build(texts: DataFrame, ignore: tuple[str, ...] = (), tests: bool = False, require: bool = True, mappings: bool = True, packages: bool = True) -> Project:
    """The graph of texts (path, content), paths relative to the project's root.

    Imports are read once and written; the rest is lazy. Imports resolve to any file there is; files to be
    scanned leave out tests, declarations, ``ignore`` and what is never scanned. With ``mappings`` and ``packages`` the compiler's configurations and the
    workspace's packages are read from the same texts. What cannot be read as text is in ``errors`` and has no imports.
    """
    files = code.scanned(texts, ignore, tests).where("status = 'file'").drop("status")
    read = stored(code.imports(files, require), "imports")
    exports = code.exports(files)
    configs = texts.where(F.col("path").rlike("(^|/)(tsconfig[^/]*|[^/]*config[^/]*|base)[.]json$") & F.col("content").isNotNull())
    table = path_mappings(configs) if mappings else None
    own = packages_of(texts, patterns_of(texts)) if packages else None
    statuses = stored(resolved(read, texts.select("path"), table, own), "statuses")
    hit = statuses.where("status = 'resolved'").select("source", "specifier", "target")
    edges = read.join(hit, ["source", "specifier"]).select("source", "target", "specifier", "is_type_only", "kind", "line", "names")
    return Project(files.select("path"), read, statuses, edges, exports, code.errors(files))


def check_project(project: Project, ruleset: RuleSet, framework: str | None = None, type_only: bool = False, origin: bool = False, circular: bool = True) -> DataFrame:
    """All violations of a project. With ``origin`` the edges from importing files to where names come from are judged as well as those to the barrels."""
    edges = project.edges if type_only else project.edges.where("not is_type_only")
    files = project.files.where(~matches(F.col("path"), ignored(list(ruleset.ignore), framework))) if ruleset.ignore or framework else project.files
    found = rules.check(files, edges.drop("names"), ruleset, framework=framework, circular=circular)
    if not origin:
        return found
    drawn = barrels.origin_edges(edges, project.reexports(), project.exports)
    return found.unionByName(rules.edge_violations(drawn.drop("names"), ruleset))
