"""Source texts and their imports: files by Spark's binary source, imports by a token automaton."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.paths import is_declaration, is_source, is_test, matches, name_of
from tierflow.sources.lexer import exports_of, imports_of

#: Names of folders and files that are never scanned (fixed values).
SKIPPED = ("node_modules", ".next", ".nuxt", ".output", "dist", "build", "out", "coverage", "__tests__", "__mocks__", ".git", ".svn")

def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, stamp, content`` of all files below ``root``; content is read only if it is used and null if it is not UTF-8.

    Spark's scan leaves out files without content. They are taken from its listing, which the driver has for any scan,
    have no stamp and an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.expr("regexp_replace(path, '^[a-z]+:/*', '/')").alias("path")
    read = files.select(path, F.col("modificationTime").alias("stamp"), F.expr("try_validate_utf8(cast(content as string))").alias("content"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(path)
    empty = listed.join(files.select(path), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("stamp"), F.lit("").alias("content"))
    return read.union(empty)


def scanned(files: DataFrame, ignore: tuple[str, ...] = (), tests: bool = False, declarations: bool = False) -> DataFrame:
    """Rows of ``files`` (path) with ``status``: file, skipped or skipped_dir."""
    path = F.col("path")
    in_skipped = path.rlike("(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")(/|$)")
    out = matches(path, list(ignore))
    if not tests:
        out = out | is_test(path)
    if not declarations:
        out = out | is_declaration(path)
    return files.where(is_source(path)).withColumn("status", F.when(in_skipped, "skipped_dir").when(out, "skipped").otherwise("file"))


def imports(files: DataFrame, require: bool = True) -> DataFrame:
    """``source, specifier, kind, is_type_only, line, column, names`` of texts (path, content), by the token automaton of :mod:`tierflow.sources.lexer`.

    What stands in comments, strings, templates and regular expressions does not count, and
    only literal specifiers do. Lines count from 1, columns from 0; ``names`` are pairs of
    the name in the other file and the name here. Null texts have no imports.
    """
    rows = files.select(F.col("path").alias("source"), "content")
    kinds = ("static", "reexport", "dynamic", *(["require"] if require else []))
    names = pa.list_(pa.struct([("name", pa.string()), ("as", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, one) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for one in imports_of(text) if one.kind in kinds]
            columns = [pa.array([p for p, _ in found], pa.string()), *(pa.array([getattr(one, n) for _, one in found], t) for n, t in (("specifier", pa.string()), ("kind", pa.string()), ("is_type_only", pa.bool_()), ("line", pa.int32()), ("column", pa.int32())))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[{"name": a, "as": b} for a, b in one.names] for _, one in found], names)], names=["source", "specifier", "kind", "is_type_only", "line", "column", "names"])

    return rows.mapInArrow(read, "source string, specifier string, kind string, is_type_only boolean, line int, column int, names array<struct<name:string,as:string>>")


def exports(files: DataFrame) -> DataFrame:
    """``file, name`` of what texts (path, content) export themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, name) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for name in exports_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["file", "name"])

    return files.select("path", "content").mapInArrow(read, "file string, name string")


def errors(files: DataFrame) -> DataFrame:
    """``path, error`` of texts that could not be read as UTF-8."""
    return files.where(F.col("content").isNull()).select("path", F.lit("the file is not readable as UTF-8 text").alias("error"))


def is_barrel_name(path):
    """Whether a file is called index, with or without a code ending."""
    return name_of(path).rlike(r"^index(\.(tsx?|jsx?|mts|mjs|cts|cjs))?$")


def links(pages: DataFrame) -> DataFrame:
    """``page_id, link`` of all quoted ``href`` values."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("link"))
