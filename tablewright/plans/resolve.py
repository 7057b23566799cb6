"""Binding of target columns to source columns. Looks at names only, never at rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tablewright.plans.schema import AUTO, ROW_ID, TargetColumn, TargetSchema

# Name patterns per well-known target, tried in this order.
NAME_PATTERNS = {
    "genesymbol": ["gene", "symbol", "name", "id"],
    "foldchange": ["fold", "fc", "log2?fc", "ratio", "change"],
    "pvalue": ["p[-_]?val", "pvalue", "significance", "adj[-_]?p"],
}
# Where an adjustment looks for raw p-values when its source is not named.
P_VALUE_PATTERNS = ["p[-_]?val", "pvalue", "significance"]


@dataclass(frozen=True)
class Binding:
    target: str
    source: str
    rule: str  # source | exact | case | pattern


def _as_pattern(name: str) -> str:
    """A name without patterns of its own is the pattern; taken literally if it is no valid one."""
    try:
        re.compile(name)
        return name
    except re.error:
        return re.escape(name)


def resolve_column(names: list[str], col: TargetColumn,
                   patterns: dict[str, list[str]] | None = None) -> Binding | None:
    """Explicit source, then exact name, then any letter case, then name patterns.

    The first input column in table order wins. The row key is never bound by guessing.
    """
    if col.source != AUTO:
        return Binding(col.name, col.source, "source") if col.source in names else None
    if col.name in names:
        return Binding(col.name, col.name, "exact")
    candidates = [n for n in names if n != ROW_ID]
    same = next((n for n in candidates if n.lower() == col.name.lower()), None)
    if same is not None:
        return Binding(col.name, same, "case")
    table = {**NAME_PATTERNS, **(patterns or {})}
    wanted = table.get(col.name.lower(), [_as_pattern(col.name.lower())])
    hit = next((n for n in candidates if any(re.search(p, n.lower()) for p in wanted)), None)
    return Binding(col.name, hit, "pattern") if hit is not None else None


def resolve(names: list[str], schema: TargetSchema,
            patterns: dict[str, list[str]] | None = None) -> dict[str, Binding]:
    """Bindings by target name; unresolved targets are absent."""
    found = (resolve_column(names, c, patterns) for c in schema.columns)
    return {b.target: b for b in found if b is not None}


def mapping(bindings: dict[str, Binding]) -> dict[str, str]:
    return {t: b.source for t, b in bindings.items()}


def binding_notes(bindings: dict[str, Binding]) -> list[tuple[str, str]]:
    """(target, message) for bindings a person should look at: guessed, or one source bound twice."""
    notes = [(b.target, f"Column '{b.target}' was bound to '{b.source}' by name pattern")
             for b in bindings.values() if b.rule == "pattern"]
    first_user: dict[str, str] = {}
    for b in bindings.values():
        other = first_user.setdefault(b.source, b.target)
        if other != b.target:
            notes.append((b.target, f"Source '{b.source}' is bound to both '{other}' and '{b.target}'"))
    return notes


def p_value_source(names: list[str], col: TargetColumn) -> str | None:
    """The column an adjustment reads: the named one, else the first that looks like p-values."""
    named = col.stat_test_source_column
    if named and named in names:
        return named
    return next((n for n in names
                 if any(re.search(p, n.lower()) for p in P_VALUE_PATTERNS)), None)
