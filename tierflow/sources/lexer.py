"""Tokens of a source text, and the imports among them.

The automaton knows what a regular expression over the raw text cannot: whether it is
inside a string, a template, a comment or a regular expression. It keeps a stack for the
braces of templates, and the token before a slash decides whether that begins a
regular expression. Texts that break off inside any of these are read to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>//[^\n\r\u2028\u2029]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
    |(?P<template>`)
    |(?P<word>(?:[^\W\d]|\$)[\w$]*)
    |(?P<number>\.?\d[\w.]*)
    |(?P<sign>=>|\?\.(?!\d)|\.\.\.|.)""",
    re.S | re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?:.|\Z)|\$(?!\{))*(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
#: Words after which a slash begins a regular expression (fixed values).
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Import(NamedTuple):
    """An import: ``names`` are pairs of the name in the other file (``default``, ``*``) and the name here (``*`` for all)."""

    specifier: str
    kind: str
    is_type_only: bool
    line: int
    column: int
    names: list[tuple[str, str]]


def tokens(text: str) -> Iterator[Token]:
    """Words, numbers, signs and strings of a text; templates count as one token each between their expressions."""
    at, before, braces = 0, None, []
    while at < len(text):
        found = _TOKEN.match(text, at)
        kind, part = found.lastgroup, found.group()
        if kind == "sign" and part == "/" and _regex_may_follow(before) and (regex := _REGEX.match(text, at)):
            kind, part = "regex", regex.group()
        elif kind == "template" or kind == "sign" and part == "}" and braces and braces[-1] == 0:
            if kind == "sign":
                braces.pop()
            end = _TEMPLATE.match(text, at + 1)
            kind, part = "template", text[at : end.end()]
            if end.group(1) == "${":
                braces.append(0)
        elif kind == "sign" and braces and part in "{}":
            braces[-1] += 1 if part == "{" else -1
        if kind not in ("space", "comment"):
            before = Token(kind, part, at)
            yield before
        at += len(part)


def _regex_may_follow(before: Token | None) -> bool:
    if before is None:
        return True
    if before.kind == "template":
        return before.text.endswith("${")
    if before.kind == "word":
        return before.text in _BEFORE_REGEX
    return before.kind == "sign" and before.text not in (")", "]")


def _value(token: Token) -> str:
    body = token.text[1:-1] if len(token.text) > 1 and token.text[-1] == token.text[0] else token.text[1:]
    return re.sub(r"\\(.)", r"\1", body, flags=re.S)


class _Reader:
    """The tokens of a text with a place."""

    def __init__(self, text: str):
        self.all = list(tokens(text))

    def text(self, k: int) -> str:
        return self.all[k].text if 0 <= k < len(self.all) and self.all[k].kind in ("word", "sign") else ""

    def string(self, k: int) -> str | None:
        return _value(self.all[k]) if 0 <= k < len(self.all) and self.all[k].kind == "string" else None

    def named(self, k: int, names: list[tuple[str, str]]) -> int:
        """Read ``{ a, b as c }`` from its brace; the place after it, or -1."""
        k += 1
        while (word := self.text(k)) != "}":
            if word in ("{", ";", "") and self.string(k) is None:
                return -1
            if word == ",":
                k += 1
                continue
            if word == "type" and self.text(k + 1) not in (",", "}", "as"):
                k += 1
            name = self.text(k) or self.string(k)
            as_ = name
            if self.text(k + 1) == "as":
                as_ = self.text(k + 2) or self.string(k + 2)
                k += 2
            if not name or not as_:
                return -1
            names.append((name, as_))
            k += 1
        return k + 1

    def clause(self, k: int, export: bool) -> tuple[str | None, bool, list[tuple[str, str]]]:
        """Specifier, type-only and names of what follows the word import or export at ``k``; no specifier if it is something else."""
        names: list[tuple[str, str]] = []
        k += 1
        if not export and self.string(k) is not None:
            return self.string(k), False, names
        # ``type`` is a name of its own in ``import type from`` and ``import type, { a }``
        type_only = self.text(k) == "type" and (self.text(k + 1) in ("{", "*") or not export and self.text(k + 1)[:1].isidentifier() and (self.text(k + 1) != "from" or self.text(k + 2) == "from"))
        k += type_only
        if not export and self.text(k)[:1].isidentifier() or self.text(k).startswith("$") and not export:
            names.append(("default", self.text(k)))
            k += 1
            if self.text(k) == ",":
                k += 1
        if self.text(k) == "*":
            if self.text(k + 1) == "as":
                names.append(("*", self.text(k + 2) or self.string(k + 2) or "*"))
                k += 3
            else:
                names.append(("*", "*"))
                k += 1
        elif self.text(k) == "{":
            k = self.named(k, names)
            if k < 0:
                return None, False, []
        return (self.string(k + 1) if self.text(k) == "from" else None), bool(type_only), names


def imports_of(text: str | None) -> list[Import]:
    """All imports, re-exports, dynamic imports and require calls of a text whose specifier is a plain string, in order."""
    if not text or "import" not in text and "export" not in text and "require" not in text:
        return []
    read, found = _Reader(text), []
    for k, token in enumerate(read.all):
        if token.kind != "word" or token.text not in ("import", "export", "require") or read.text(k - 1) in (".", "?."):
            continue
        specifier, kind, type_only, names = None, "", False, []
        if token.text != "export" and read.text(k + 1) == "(":
            if read.text(k + 3) in (")", ",") and not (token.text == "require" and (read.text(k - 1) == "function" or read.text(k - 2) == "import" or read.text(k - 3) == "import" and read.text(k - 1) == "=")):
                specifier, kind = read.string(k + 2), "dynamic" if token.text == "import" else "require"
        elif token.text != "require":
            specifier, type_only, names = read.clause(k, token.text == "export")
            kind = "static" if token.text == "import" else "reexport"
        if specifier:
            found.append((token.at, specifier, kind, type_only, names))
    line, begin, at, out = 1, 0, 0, []
    for start, specifier, kind, type_only, names in found:
        breaks = text.count("\n", at, start)
        if breaks:
            line, begin = line + breaks, text.rfind("\n", at, start) + 1
        at = start
        out.append(Import(specifier, kind, type_only, line, start - begin, names))
    return out


def exports_of(text: str | None) -> list[str]:
    """Names that a text exports itself, ``default`` among them, in order; what it takes from another file is not its own."""
    if not text or "export" not in text:
        return []
    read, out = _Reader(text), []
    for k, token in enumerate(read.all):
        if token.kind != "word" or token.text != "export" or read.text(k - 1) in (".", "?."):
            continue
        k += 1
        if read.text(k) == "default":
            out.append("default")
            continue
        if read.text(k) == "{" or read.text(k) == "type" and read.text(k + 1) == "{":
            names: list[tuple[str, str]] = []
            end = read.named(k + (read.text(k) == "type"), names)
            out += [as_ for _, as_ in names] if end > 0 and read.text(end) != "from" else []
            continue
        while read.text(k) in ("declare", "abstract", "async") or read.text(k) == "const" and read.text(k + 1) == "enum":
            k += 1
        if read.text(k) in ("const", "let", "var", "function", "class", "enum", "interface", "type", "namespace"):
            k += 1 + (read.text(k + 1) == "*")
            if read.text(k)[:1].isidentifier() or read.text(k)[:1] == "$":
                out.append(read.text(k))
    return list(dict.fromkeys(out))
