"""Rule sets: layers with sublayers, allowed flow between them, limits. Plain values on the driver, or rules as rows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Violation types in report order (fixed values).
TYPES = ("flow", "isolation", "circular", "unmapped", "unlayered", "orphan", "depth", "publicApi", "dependentBudget", "importCount")
#: Default severity of each type (fixed values).
SEVERITY = {
    "flow": "error", "isolation": "error", "circular": "error", "unlayered": "error", "publicApi": "error",
    "unmapped": "warn", "orphan": "warn", "depth": "warn", "dependentBudget": "warn", "importCount": "warn",
}


@dataclass(frozen=True)
class Sublayer:
    name: str
    path: str
    isolated: bool = False


@dataclass(frozen=True)
class Layer:
    name: str
    path: str
    sublayers: tuple[Sublayer, ...] = ()
    flow: tuple[str, ...] = ()
    public_api: tuple[str, ...] = ()
    max_dependents: int | None = None


@dataclass(frozen=True)
class RuleSet:
    layers: tuple[Layer, ...]
    flow: tuple[str, ...]
    #: error, warn or ignore, for imports of files outside all layers
    unlayered: str = "error"
    max_depth: int | None = None
    max_imports: int | None = None
    ignore: tuple[str, ...] = ()
    exceptions: tuple[tuple[str, str], ...] = field(default=())

    def allowed(self, layer: str | None = None) -> list[tuple[str, str]]:
        """Distinct allowed pairs, of the whole set or inside one layer."""
        rules = self.flow if layer is None else next((x.flow for x in self.layers if x.name == layer), ())
        return list(dict.fromkeys(pair for rule in rules for pair in parse_flow(rule)))


class FlowError(ValueError):
    """A flow rule that cannot be read."""


def parse_flow(rule: str) -> list[tuple[str, str]]:
    """Allowed pairs of ``a -> b -> c`` (neighbours) or ``a <-> b`` (both ways)."""
    text = rule.strip()
    if not text:
        raise FlowError("empty rule")
    both = "<->" in text
    rest = text.replace("<->", "\0")
    if "-->" in rest or "<-" in rest or both and "->" in rest:
        raise FlowError(f"unreadable arrows in {rule!r}")
    names = [name.strip() for name in re.split("\0|->", rest)]
    if len(names) < 2 or not all(names):
        raise FlowError(f"a name or an arrow is missing in {rule!r}")
    if both:
        if len(names) != 2:
            raise FlowError(f"two names stand around <-> in {rule!r}")
        return [(names[0], names[1]), (names[1], names[0])]
    return list(zip(names, names[1:]))


def flow_pairs(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """``rules`` with ``from_layer`` and ``to_layer``, a row for each allowed pair of the rule in a column; what :func:`parse_flow` refuses has none."""
    text = F.trim(F.col(rule))
    names = F.transform(F.split(F.replace(text, F.lit("<->"), F.lit("->")), "->"), lambda n: F.trim(n))
    both = F.contains(text, F.lit("<->"))
    rest = F.replace(text, F.lit("<->"), F.lit("|"))
    good = ~F.contains(rest, F.lit("-->")) & ~F.contains(rest, F.lit("<-")) & ~(both & F.contains(rest, F.lit("->"))) & (F.size(names) > 1) & F.forall(names, lambda n: n != "") & (~both | (F.size(names) == 2))
    steps = F.transform(F.sequence(F.lit(0), F.size(names) - 2), lambda i: F.struct(F.get(names, i).alias("from_layer"), F.get(names, i + 1).alias("to_layer")))
    back = F.array(F.struct(F.get(names, F.lit(1)).alias("from_layer"), F.get(names, F.lit(0)).alias("to_layer")))
    return rules.where(good).select("*", F.inline(F.when(both, F.concat(steps, back)).otherwise(steps)))


def isolated_names(names: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Names that no pair mentions."""
    used = {name for pair in pairs for name in pair}
    return [name for name in names if name not in used]


def problems(rules: RuleSet) -> list[tuple[str, str]]:
    """(code, message) of what is wrong with a rule set; codes that end in ``WARNING`` do not stop a check."""
    found = []
    if not rules.layers:
        found.append(("MISSING_LAYERS", "no layers"))
    if not rules.flow:
        found.append(("MISSING_FLOW", "no flow rules"))
    if found:
        return found
    names = [layer.name for layer in rules.layers]
    pairs: list[tuple[str, str]] = []
    for rule in rules.flow:
        try:
            pairs += parse_flow(rule)
        except FlowError as wrong:
            found.append(("INVALID_FLOW", str(wrong)))
    found += [("UNKNOWN_LAYER", name) for name in dict.fromkeys(n for p in pairs for n in p) if name not in names]
    found += [("LAYER_NOT_IN_FLOW_WARNING", name) for name in isolated_names(names, pairs)]
    for layer in rules.layers:
        if not layer.path:
            found.append(("MISSING_PATH", layer.name))
        inner = [s.name for s in layer.sublayers]
        found += [("MISSING_PATH", f"{layer.name}/{s.name}") for s in layer.sublayers if not s.path]
        for rule in layer.flow:
            try:
                found += [("UNKNOWN_SUBLAYER", f"{layer.name}/{n}") for p in parse_flow(rule) for n in p if n not in inner]
            except FlowError as wrong:
                found.append(("INVALID_FLOW", str(wrong)))
    if rules.unlayered not in ("error", "warn", "ignore"):
        found.append(("INVALID_RULE", "unlayered"))
    return found


def from_dict(config: dict) -> RuleSet:
    """A rule set from plain data (JSON or a dict); code is never evaluated."""
    as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v or ())
    rules = config.get("rules", {})
    layers = tuple(
        Layer(
            name, spec.get("path", ""),
            tuple(Sublayer(n, s.get("path", ""), bool(s.get("isolated"))) for n, s in (spec.get("sublayers") or {}).items()),
            as_tuple(spec.get("flow")), as_tuple(spec.get("publicApi")), spec.get("maxDependents"),
        )
        for name, spec in (config.get("layers") or {}).items()
    )
    exceptions = tuple((e["from"], e["to"]) for e in config.get("exceptions", []))
    return RuleSet(layers, as_tuple(config.get("flow")), rules.get("unlayeredImports", "error"), rules.get("maxImportDepth"), rules.get("maxImportsPerFile"), as_tuple(config.get("ignore")), exceptions)


def from_json(text: str) -> RuleSet:
    return from_dict(json.loads(text))
