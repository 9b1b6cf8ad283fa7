"""Path functions as Column expressions, so that Catalyst can push them down."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of sources, declaration endings and marks of tests (fixed values).
SOURCE = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs")
DECLARATION = (".d.ts", ".d.mts", ".d.cts")
TEST = (".test.", ".spec.", "-test.", "-spec.")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def normal(path: Column) -> Column:
    """Slashes forward, none at the ends, lower case."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(F.when(plain.startswith("/") | plain.endswith("/"), F.btrim(plain, F.lit("/"))).otherwise(plain))


def normal_text(path: str) -> str:
    return path.replace("\\", "/").strip("/").lower()


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"(\.[^.]+)$", 1)).isin(*SOURCE)


def is_test(path: Column) -> Column:
    return any_of([name_of(path).contains(mark) for mark in TEST])


def is_declaration(path: Column) -> Column:
    return any_of([path.endswith(end) for end in DECLARATION])


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``**`` crosses folders, ``*`` does not, ``?`` is one character; case does not count."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "(?i)^" + "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in parts) + "$"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore pattern fits: one with a slash the whole path, one with a star the name, another one a part of the name."""
    found = []
    for pattern in patterns:
        if "/" in pattern:
            found.append(path.rlike(glob_regex(pattern)))
        elif "*" in pattern:
            found.append(name_of(path).rlike(glob_regex(pattern)))
        else:
            found.append(F.lower(name_of(path)).contains(pattern.lower()))
    return any_of(found)


#: Files that nothing needs to import (fixed values): indexes, mains, the app file, configs, tests.
ENTRY_POINT = r"^(src/)?(index|main)\.[jt]sx?$|^src/app\.[jt]sx?$|\.config\.[jt]s$|\.(test|spec)\.[jt]sx?$"


def is_entry_point(path: Column) -> Column:
    """Whether a file is started by something else than an import."""
    return path.rlike(ENTRY_POINT)


def comparable(path: Column) -> Column:
    """For public APIs: without extension and without a closing ``/index``; case counts."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    return F.regexp_replace(plain, "/index$", "")


def is_external(specifier: Column) -> Column:
    return ~(specifier.startswith(".") | specifier.startswith("/"))


def escaped_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text
