"""Rule tables written as SQL expressions, for the side-by-side check only."""

from __future__ import annotations

from collections.abc import Sequence

from shelfmark.functions.rules import NameRule, Rule, by_priority


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text('(?i)' + pattern)})"


def any_of(column: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(matches(column, p) for p in patterns) + ")"


def case(arms: Sequence[tuple[str, str]], otherwise: str = "NULL") -> str:
    if not arms:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {otherwise} END"


def path_rule(rule: Rule, name: str, stem: str, ext: str) -> str:
    parts = []
    if rule.file:
        parts.append(matches(name, rule.file))
    if rule.extension:
        hit = matches(ext, rule.extension)
        parts.append(f"({hit} AND {matches(stem, rule.context)})" if rule.context else hit)
    condition = "(" + " OR ".join(parts) + ")"
    return f"({condition} AND NOT {matches(name, rule.exclude)})" if rule.exclude else condition


def path_rules(rules: Sequence[Rule], field: str, name: str, stem: str, ext: str) -> str:
    """field: document_type, confidence, method or name."""
    arms = []
    for rule in by_priority(rules):
        value = {
            "document_type": text(rule.document_type),
            "confidence": f"CAST({rule.confidence} AS DOUBLE)",
            "method": text("pattern_override" if rule.priority >= 90 else "pattern_extension"),
            "name": text(rule.name),
        }[field]
        arms.append((path_rule(rule, name, stem, ext), value))
    otherwise = {"confidence": "CAST(0 AS DOUBLE)", "method": "'no_match'"}.get(field, "NULL")
    return case(arms, otherwise)


def name_rules(rules: Sequence[NameRule], field: str, column: str) -> str:
    arms = []
    for rule in sorted(rules, key=lambda r: r.order):
        condition = any_of(column, rule.patterns)
        if rule.exclude:
            condition = f"({condition} AND NOT {any_of(column, rule.exclude)})"
        value = f"CAST({rule.confidence} AS DOUBLE)" if field == "confidence" else text(getattr(rule, field))
        arms.append((condition, value))
    return case(arms)


def stored_rules(rules, field: str, column: str) -> str:
    arms = []
    for name, pattern, kind, _ in sorted(rules, key=lambda r: -r[3]):
        arms.append((matches(column, pattern), text(kind if field == "document_type" else name)))
    return case(arms)


def hits(column: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {text(w)}) AS INTEGER)" for w in words) + ")"


def has_any(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def best(entries: Sequence[tuple[str, str, str]], source: str, key: str) -> str:
    """Rows of the best entry per key: (score sql, payload columns sql, tie position)."""
    unions = " UNION ALL ".join(
        f"SELECT {key}, {score} AS score, {place} AS place, {payload} FROM {source}"
        for place, (score, payload, _) in enumerate(entries)
    )
    return (
        f"SELECT * FROM ({unions}) WHERE score IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, place) = 1"
    )
