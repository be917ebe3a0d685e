"""Classification rules compiled to one chain of ``when`` branches.

Rules are driver-side configuration.  ``CASE WHEN`` stops at the first branch that
holds, so a chain in priority order is the first-match loop, inside codegen.
"""

from __future__ import annotations

import re
from re import _parser
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.text import phrase_hits


@dataclass(frozen=True)
class Rule:
    """A rule over a file name.  ``priority``: higher is tried first."""

    name: str
    document_type: str
    confidence: float
    priority: int = 50
    file: str | None = None
    extension: str | None = None
    context: str | None = None
    exclude: str | None = None


@dataclass(frozen=True)
class NameRule:
    """Several alternative name patterns; ``order``: lower is tried first."""

    name: str
    document_type: str
    confidence: float
    patterns: tuple[str, ...]
    order: int = 100
    exclude: tuple[str, ...] = field(default_factory=tuple)


def any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def by_priority(rules: Sequence[Rule]) -> list[Rule]:
    """Highest priority first; equal priorities keep their given order."""
    return sorted(rules, key=lambda r: -r.priority)


def rules_from_config(entries: Sequence[Mapping]) -> list[Rule]:
    """Rules from parsed YAML/JSON entries with ``*_pattern`` keys."""
    renamed = {
        "file_pattern": "file",
        "extension_pattern": "extension",
        "context_pattern": "context",
        "exclude_pattern": "exclude",
    }
    return [Rule(**{renamed.get(k, k): v for k, v in entry.items()}) for entry in entries]


RESULT = ("document_type", "confidence", "method", "matched_rule")


def with_struct(df: DataFrame, value: Column, fields: Sequence[str]) -> DataFrame:
    """Add the fields of a struct as columns, computing the struct once per row.

    A generator keeps the optimizer from copying a long rule chain into every later
    filter and projection that uses one of its fields.
    """
    return df.select("*", F.inline(F.array(value)).alias(*fields))


def _result(document_type: str | None, confidence: float, method: str, rule: str | None) -> Column:
    return F.struct(
        F.lit(document_type).cast("string").alias("document_type"),
        F.lit(float(confidence)).alias("confidence"),
        F.lit(method).cast("string").alias("method"),
        F.lit(rule).cast("string").alias("matched_rule"),
    )


def _first(conditions: Sequence[Column], results: Sequence[Column], none: Column) -> Column:
    """Result of the first condition that holds.

    The chain yields a position and one constant array holds the results, which keeps
    the generated code small.
    """
    position = F
    for i, condition in enumerate(conditions):
        position = position.when(condition, i + 1)
    last = len(conditions) + 1
    chosen = F.lit(last) if position is F else position.otherwise(last)
    return F.element_at(F.array(*results, none), chosen)


_WORD_LIST = re.compile(r"^\^\(?([a-z0-9|]+)\)?\$$")


def _found_in_lower(value: Column, pattern: str) -> Column:
    """Case-insensitive search in a lower-cased value; cheaper without the flag."""
    bare = re.sub(r"\\.", "", pattern)
    return value.rlike(pattern if bare == bare.lower() else any_case(pattern))


def _extension_in(ext: Column, pattern: str) -> Column:
    """A plain word list becomes a set test instead of a regex."""
    words = _WORD_LIST.match(pattern)
    return ext.isin(*words.group(1).split("|")) if words else _found_in_lower(ext, pattern)


def _rule_condition(rule: Rule, name: Column, stem: Column, ext: Column) -> Column:
    """A file pattern alone suffices; an extension must also meet its context."""
    options = []
    if rule.extension:
        by_ext = _extension_in(ext, rule.extension)
        options.append(by_ext & _found_in_lower(stem, rule.context) if rule.context else by_ext)
    if rule.file:
        options.append(_found_in_lower(name, rule.file))
    hit = reduce(lambda a, b: a | b, options) if options else F.lit(False)
    return hit & ~_found_in_lower(name, rule.exclude) if rule.exclude else hit


def with_path_rule(
    df: DataFrame, path: Column, rules: Sequence[Rule], fields: Sequence[str] = RESULT, override_at: int = 90
) -> DataFrame:
    """Adds document_type, confidence, method and matched_rule for a path.

    Name, stem and extension are columns of their own first, so the rule chain refers
    to them instead of repeating their expressions.
    """
    ordered = by_priority(rules)
    results = [
        _result(r.document_type, r.confidence, "pattern_override" if r.priority >= override_at else "pattern_extension", r.name)
        for r in ordered
    ]
    name, stem, ext = F.col("_name"), F.col("_stem"), F.col("_ext")
    staged = df.withColumn("_path", path).withColumns(
        {
            "_name": F.lower(paths.name(F.col("_path"))),
            "_stem": F.lower(paths.stem(F.col("_path"))),
            "_ext": F.ltrim(paths.extension(F.col("_path")), F.lit(".")),
        }
    )
    chain = _first([_rule_condition(r, name, stem, ext) for r in ordered], results, _result(None, 0.0, "no_match", None))
    return with_struct(staged, chain, fields).drop("_path", "_name", "_stem", "_ext")


def classify_by_table(path: Column, rules: Sequence[tuple[str, str, str, int]], confidence: float = 0.95) -> Column:
    """Stored (rule_name, pattern, document_type, priority) rules over the lower-cased name."""
    name = F.lower(paths.name(path))
    ordered = [r for r in sorted(rules, key=lambda r: -r[3]) if r[1]]
    results = [_result(kind, confidence, "pattern", rule_name) for rule_name, _, kind, _ in ordered]
    return _first([name.rlike(any_case(r[1])) for r in ordered], results, _result(None, 0.0, "no_pattern_match", None))


def lower_pattern(pattern: str) -> str:
    """The pattern with its letters in lower case, escapes such as ``\\S`` untouched."""
    return re.sub(r"\\.|[A-Z]", lambda m: m.group(0) if m.group(0)[0] == "\\" else m.group(0).lower(), pattern)


_LITERAL_MIN = 3
# \b for the characters of \w, whatever the Java version counts as letters at an edge
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def needed_words(pattern: str) -> list[frozenset[str]]:
    """Sets of plain strings; a text matches the pattern only if it holds one string of each set."""
    def of(parts) -> list[frozenset[str]]:
        sets, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value)
                continue
            if len(run) >= _LITERAL_MIN:
                sets.append(frozenset([run]))
            run = ""
            if op is _parser.SUBPATTERN:
                sets += of(value[3])
            elif op is _parser.BRANCH:
                # of each branch the set with the longest strings; a branch without one leaves all open
                best = [max(of(branch), key=lambda found: min(map(len, found)), default=None) for branch in value[1]]
                if None not in best:
                    sets.append(frozenset().union(*best))
            elif op is _parser.MAX_REPEAT and value[0] > 0:
                sets += of(value[2])
        return sets

    return of(_parser.parse(pattern))


def _may_match(low: Column, patterns: Sequence[str]) -> Column:
    """Whether the text holds what one of the patterns needs; each must need something."""
    needs = [needed_words(p) for p in patterns]
    one_of = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in sorted(words)])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(one_of, sets)) for sets in needs])


def with_name_rule(
    df: DataFrame, name: Column, rules: Sequence[NameRule], fields: Sequence[str] = RESULT, method: str = "filename_pattern"
) -> DataFrame:
    """Adds the first rule whose patterns match and whose exclusions do not; NULLs otherwise.

    Patterns ignore case: they are lower-cased once here and run over a lower-cased
    column, which is cheaper than a case-insensitive search per row.  A pattern is only
    searched where the plain strings it needs occur: they are found in the bytes, and a
    pattern such as ``a.*b`` reads on to the end of the text from every ``a``.
    """
    low = F.col("_low_name")

    def search(patterns: Sequence[str]) -> Column:
        return low.rlike("|".join(f"(?:{p})" for p in patterns).replace(r"\b", _WORD_EDGE))

    def found(patterns: Sequence[str]) -> Column:
        lowered = [lower_pattern(p) for p in patterns]
        open_ones = [p for p in lowered if not needed_words(p)]
        tested = [p for p in lowered if needed_words(p)]
        tests = [_may_match(low, tested) & search(tested)] if tested else []
        return reduce(lambda a, b: a | b, [*tests, *([search(open_ones)] if open_ones else [])])

    ordered = sorted(rules, key=lambda r: r.order)
    conditions = [found(r.patterns) & ~found(r.exclude) if r.exclude else found(r.patterns) for r in ordered]
    results = [_result(r.document_type, r.confidence, method, r.name) for r in ordered]
    none = F.struct(
        *[F.lit(None).cast("double" if f == "confidence" else "string").alias(f) for f in RESULT]
    )
    staged = df.withColumn("_low_name", F.lower(name))
    return with_struct(staged, _first(conditions, results, none), fields).drop("_low_name")


def priority_bands(rules: Sequence[Rule]) -> dict[str, int]:
    """How many rules fall in the high, medium and low priority bands."""
    bands = {"high (90+)": 0, "medium (70-89)": 0, "low (<70)": 0}
    for rule in rules:
        key = "high (90+)" if rule.priority >= 90 else "medium (70-89)" if rule.priority >= 70 else "low (<70)"
        bands[key] += 1
    return bands


def best_of(scored: Sequence[tuple[Column, Column]]) -> Column:
    """Payload of the highest score; the earliest entry wins ties; NULL scores never win."""
    entries = F.array(
        *[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("rank"), p.alias("payload"))
          for i, (s, p) in enumerate(scored)]
    )
    return F.array_max(F.filter(entries, lambda e: e["score"].isNotNull()))


def with_keyword_category(
    df: DataFrame,
    low: Column,
    ext: Column,
    groups: Sequence[tuple[tuple[str, ...], str]],
    ext_types: Mapping[str, str],
) -> DataFrame:
    """Adds predicted_category and confidence: most keyword hits (two at least), else
    the extension, else unknown."""
    scored = with_struct(
        df, best_of([(phrase_hits(low, words), F.lit(kind)) for words, kind in groups]), ["_hits", "_rank", "_kind"]
    )
    known = F.element_at(F.create_map(*[F.lit(x) for pair in ext_types.items() for x in pair]), ext)
    fallback = F.when(ext.isin(*ext_types), known)
    hit = F.col("_hits") >= 2
    share = F.round(F.lit(0.5) + F.col("_hits") * F.lit(0.1), 6)
    return (
        scored.withColumn(
            "predicted_category", F.when(hit, F.col("_kind")).otherwise(F.coalesce(fallback, F.lit("unknown")))
        )
        .withColumn(
            "confidence",
            F.when(hit, F.least(share, F.lit(0.8))).when(ext.isin(*ext_types), F.lit(0.3)).otherwise(F.lit(0.1)),
        )
        .drop("_hits", "_rank", "_kind")
    )


CONTENT_RESULT = ("document_type", "confidence", "matched_rule", "keywords_matched")


def classify_content(low: Column, rules: Sequence[tuple[str, tuple[str, ...], int, str, float]]) -> Column:
    """struct of CONTENT_RESULT: keyword share per rule once its minimum is met.

    NULL when no rule qualifies.  Every rule counts its hits once; the winner's type,
    confidence and name come from a constant array.
    """
    counted = F.array(
        *[
            F.struct(
                F.when(phrase_hits(low, words) >= required, phrase_hits(low, words) / F.lit(float(len(words)))).alias("score"),
                F.lit(-i).alias("rank"),
            )
            for i, (_, words, required, _, _) in enumerate(rules)
        ]
    )
    facts = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("weight"), F.lit(n).alias("name"), F.lit(len(w)).alias("size"))
            for n, w, _, k, c in rules
        ]
    )
    # one-element transforms name the winner once instead of repeating the scoring
    best = F.filter(F.array(F.array_max(F.filter(counted, lambda e: e["score"].isNotNull()))), lambda e: e.isNotNull())
    described = F.transform(
        best,
        lambda e: F.struct(
            F.element_at(facts, 1 - e["rank"])["kind"].alias("document_type"),
            F.round(F.element_at(facts, 1 - e["rank"])["weight"] * e["score"], 6).alias("confidence"),
            F.element_at(facts, 1 - e["rank"])["name"].alias("matched_rule"),
            F.round(e["score"] * F.element_at(facts, 1 - e["rank"])["size"], 0).cast("long").alias("keywords_matched"),
        ),
    )
    return F.try_element_at(described, F.lit(1))
