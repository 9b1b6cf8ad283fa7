"""Secret scans: known forms, and high entropy in a sliding window. DataFrame functions only.

Every text is scanned inside one projection: no shuffle, no Python, no state
between rows, so hot sources and very long texts cost what they weigh.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.llm.batches import fresh

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropyhex", "entropy64")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters of a window.
WINDOW = 20
#: Classes of characters: candidate strings and the bits a window has to reach.
CLASSES = {
    "entropyhex": (r"(?<![A-Za-z0-9+/_-])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_-])", 3.01),
    "entropy64": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", 3.87),
}
#: What is no secret inside a candidate: identifiers, placeholders, alphabets. Windows that touch it do not count.
ALLOWED = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|example|placeholder|changeme|xxxx|0123456789|abcdefghij"
#: A candidate is cut into pieces of this many characters, so that a step costs the same in long ones.
PIECE = 256
#: Matches of a run when they are folded.
RUN = 128


def _found(text: str, pattern: str, kind: int, group: int = 0, least: int = 1) -> str:
    """SQL for an array of (start, kind, end, value): leftmost non-overlapping matches whose group has ``least`` characters.

    Starts come from the lengths of what lies between the matches. Matches are folded
    by runs of ``RUN``, so that what a step copies is bounded in texts with very many.
    """
    regex = "r'" + pattern.replace("'", r"\x27") + "'"
    none = "cast(array() as array<struct<start:int,kind:int,stop:int,val:string>>)"
    every = f"arrays_zip(transform(split({text}, {regex}, -1), gap -> length(gap)), regexp_extract_all({text}, {regex}, 0), regexp_extract_all({text}, {regex}, {group}))"
    runs = f"transform(array({every}), z -> transform(sequence(0, cast((size(z) - 1) div {RUN} as int)), r -> slice(z, r * {RUN} + 1, {RUN})))[0]"
    return f"""
    if({text} rlike {regex},
       aggregate({runs}, named_struct('at', 0, 'spans', cast(array() as array<array<struct<start:int,kind:int,stop:int,val:string>>>)),
         (whole, run) -> transform(array(aggregate(run, named_struct('at', whole.at, 'spans', {none}),
           (done, x) -> named_struct(
             'at', done.at + x.`0` + coalesce(length(x.`1`), 0),
             'spans', if(length(x.`2`) >= {least}, array_append(done.spans, named_struct('start', done.at + x.`0`, 'kind', {kind}, 'stop', done.at + x.`0` + length(x.`1`), 'val', x.`1`)), done.spans)))),
           part -> named_struct('at', part.at, 'spans', array_append(whole.spans, part.spans)))[0],
         whole -> flatten(whole.spans)),
       {none})"""


def _hot(value: str, bits: float) -> str:
    """SQL for (first, last): the first character of the first window of ``value`` with that entropy and the last of the last one; 0 if none.

    With c the count of a character in the window, H = log2(w) - sum(c log2 c) / w.
    The fold carries the counts of the window, five bits each in a few long integers,
    and the sum. A step takes the character that leaves from its count, adds the
    one that enters to its own, and changes the sum by two differences. Windows with a
    blank, which stands for an allowed value, do not count.
    """
    weigh = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 2)) + ")"
    words = -(-(127 - 32) // 12)
    count = lambda x: f"cast(shiftright(s.held[{x} div 12], 5 * ({x} % 12)) & 31 as int)"
    enters = f"({count('c.e')} - if(c.l = c.e, 1, 0))"
    change = f"if(c.l < 0, 0D, {weigh}[{count('greatest(c.l, 0)')} - 1] - {weigh}[{count('greatest(c.l, 0)')}]) + {weigh}[{enters} + 1] - {weigh}[{enters}]"
    held = "transform(s.held, (x, k) -> x - if(c.l >= 0 and k = c.l div 12, shiftleft(1L, 5 * (c.l % 12)), 0L) + if(k = c.e div 12, shiftleft(1L, 5 * (c.e % 12)), 0L))"
    hot = f"i - c.blank >= {WINDOW} and {math.log2(WINDOW)!r}D - c.sum / {WINDOW} >= {bits}D"
    pieces = f"""transform(sequence(0, cast(floor((length({value}) - 1) / {PIECE}) as int)),
                 k -> named_struct('from', greatest(0, k * {PIECE} - {WINDOW - 1}), 'val', substr({value}, greatest(0, k * {PIECE} - {WINDOW - 1}) + 1, {PIECE} + if(k > 0, {WINDOW - 1}, 0))))"""
    fold = f"""aggregate(sequence(1, length(p.val)), named_struct('held', array_repeat(0L, {words}), 'sum', 0D, 'blank', 0, 'first', 0, 'last', 0),
                 (s, i) -> transform(transform(
                    array(named_struct('l', if(i > {WINDOW}, ascii(substr(p.val, i - {WINDOW}, 1)) - 32, -1), 'e', ascii(substr(p.val, i, 1)) - 32)),
                    c -> named_struct('held', {held}, 'sum', s.sum + {change}, 'blank', if(c.e = 0, i, s.blank))),
                    c -> named_struct('held', c.held, 'sum', c.sum, 'blank', c.blank,
                                      'first', if(s.first = 0 and {hot}, p.from + i - {WINDOW - 1}, s.first), 'last', if({hot}, p.from + i, s.last)))[0],
                 s -> named_struct('first', s.first, 'last', s.last))"""
    return f"""aggregate(transform({pieces}, p -> {fold}), named_struct('first', 0, 'last', 0),
                 (a, b) -> named_struct('first', if(a.first = 0, b.first, a.first), 'last', greatest(a.last, b.last)))"""


def _entropy(text: str, name: str) -> str:
    """SQL for the spans of one class of characters, in the form of ``_found``; windows that touch an allowed value are left out."""
    pattern, bits = CLASSES[name]
    blanked = f"""if(c.val rlike r'{ALLOWED}', aggregate(arrays_zip(split(c.val, r'{ALLOWED}', -1), regexp_extract_all(c.val, r'{ALLOWED}', 0)), '',
                  (o, x) -> concat(o, x.`0`, repeat(' ', coalesce(length(x.`1`), 0)))), c.val)"""
    hot = f"transform(transform({_found(text, pattern, KINDS.index(name))}, c -> named_struct('c', c, 'val', {blanked})), c -> named_struct('c', c.c, 'hot', {_hot('c.val', bits)}))"
    return f"""transform(filter({hot}, x -> x.hot.first > 0),
                 x -> named_struct('start', x.c.start + x.hot.first - 1, 'kind', x.c.kind, 'stop', x.c.start + x.hot.last,
                                   'val', substr(x.c.val, x.hot.first, x.hot.last - x.hot.first + 1)))"""


def _listed(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = "array(" + ", ".join(f"'{kind}'" for kind in KINDS) + ")"
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.stop)))")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every whole text: ``id_col, secrets`` (array of start, kind, stop, val; code points, end exclusive).

    Spans are in the order of start and then kind. A null text counts as empty and
    has none; repeated rows give repeated rows; other columns are not read.
    """
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))  # no other column is there
    base = [_found("_t", ASSIGN, 0, group=2, least=6), _found("_t", ACCESS, 1), _found("_t", HEX, 2)]
    each = text.select(id_col, *(F.expr(x).alias(f"_s{k}") for k, x in enumerate([*base, *(_entropy("_t", name) for name in CLASSES)])))
    return each.select(id_col, F.sort_array(F.concat(*(f"_s{k}" for k in range(len(KINDS))))).alias("secrets"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the digest of the spans of known forms, and all spans as text. Edge cases: see :func:`find_secrets`."""
    found = find_secrets(docs, id_col, text_col)
    known = found.withColumn("_base", F.expr("filter(secrets, s -> s.kind <= 2)"))
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return known.select(id_col, *counts, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("secrets").alias("spans"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``; overlapping spans are replaced once.

    All columns, rows and texts without secrets stay as they are, whatever the
    columns are called.
    """
    own, spans = fresh("own_text", docs.columns), fresh("own_spans", docs.columns)
    text = docs.withColumn(own, F.coalesce(F.col(text_col), F.lit("")))
    base = [_found(own, ASSIGN, 0, group=2, least=6), _found(own, ACCESS, 1), _found(own, HEX, 2)]
    found = text.withColumn(spans, F.expr(f"sort_array(concat({', '.join([*base, *(_entropy(own, name) for name in CLASSES)])}))"))
    cut = F.expr(f"""aggregate({spans}, named_struct('at', 0, 'out', ''),
        (d, s) -> named_struct('at', greatest(d.at, s.stop),
                               'out', if(s.start < d.at, d.out, concat(d.out, substr({own}, d.at + 1, s.start - d.at), '{mask}'))),
        d -> concat(d.out, substr({own}, d.at + 1)))""")
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(F.col(text_col))).select(docs.columns)
