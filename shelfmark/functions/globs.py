"""Shell-style patterns compiled once on the driver to anchored regexes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import paths


def glob_regex(pattern: str) -> str:
    """Anchored regex for ``*``, ``?`` and ``[...]``; ``**/`` also matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*")
            while pattern[i : i + 1] == "*":
                i += 1
            continue
        if c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(value: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """One ``rlike`` over the alternation of all patterns."""
    if not patterns:
        return F.lit(False)
    flag = "(?is)" if ignore_case else "(?s)"
    body = "|".join(glob_regex(p)[len("(?s)") :] for p in patterns)
    return value.rlike(f"{flag}{body}")


def excluded(path: Column, name_patterns: Sequence[str], folder_patterns: Sequence[str]) -> Column:
    """A file whose name, or any folder segment, is on the exclusion lists."""
    segments = paths.parts(paths.parent(path))
    return matches_any(paths.name(path), name_patterns) | F.exists(
        segments, lambda s: matches_any(s, folder_patterns)
    )


def sync_selected(
    path: Column,
    size: Column,
    max_size: int | None = None,
    exclude: Sequence[str] = (),
    include: Sequence[str] = (),
) -> Column:
    """Size limit, then excludes, then (when given) at least one include."""
    name = paths.name(path)
    keep = F.lit(True)
    if max_size:
        keep = keep & (F.coalesce(size, F.lit(0)) <= max_size)
    if exclude:
        keep = keep & ~(matches_any(name, exclude, False) | matches_any(path, exclude, False))
    if include:
        keep = keep & (matches_any(name, include, False) | matches_any(path, include, False))
    return keep
