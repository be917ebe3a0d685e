"""Path arithmetic on string columns; both ``/`` and ``\\`` separate parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def name(path: Column) -> Column:
    """Last path component."""
    return F.substring_index(slashed(path), "/", -1)


def suffix_of_name(file_name: Column) -> Column:
    """Last suffix with its dot, as written; empty for ``.env`` and ``a.``."""
    return F.regexp_extract(file_name, r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot (the catalog convention)."""
    return F.lower(suffix_of_name(name(path)))


def bare_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name, without the dot."""
    n = name(path)
    return F.when(F.instr(n, ".") > 0, F.lower(F.substring_index(n, ".", -1))).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """Name without its last suffix."""
    n = name(path)
    return F.left(n, F.length(n) - F.length(suffix_of_name(n)))


def bare_stem(path: Column) -> Column:
    """Name up to its last dot (the dotted-record convention: ``.env`` -> empty)."""
    n = name(path)
    last = F.substring_index(n, ".", -1)
    return F.when(F.instr(n, ".") > 0, F.left(n, F.length(n) - F.length(last) - 1)).otherwise(n)


def parent(path: Column) -> Column:
    """Everything before the last separator; empty at the root."""
    p = slashed(path)
    return F.left(p, F.greatest(F.length(p) - F.length(name(path)) - 1, F.lit(0)))


def separators(path: Column) -> Column:
    """How many separators the path has (the depth used for keeper scoring)."""
    p = slashed(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def parts(path: Column) -> Column:
    """Non-empty path components."""
    return F.filter(F.split(slashed(path), "/"), lambda x: x != "")


def folder_depth(path: Column) -> Column:
    """Number of path parts; the root of an absolute path counts as one."""
    p = slashed(path)
    return F.size(parts(path)) + F.when(F.startswith(p, F.lit("/")), 1).otherwise(0)


def ancestors(folder: Column) -> Column:
    """Every folder from the top level down to ``folder`` itself."""
    pieces = F.split(slashed(folder), "/")
    joined = F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/")
    )
    return F.filter(joined, lambda x: x != "")


def top_level(folder: Column) -> Column:
    """First meaningful component: the root of absolute paths and ``C:`` are skipped."""
    p = parts(folder)
    drive = F.coalesce(F.try_element_at(p, F.lit(1)).rlike("^.:$"), F.lit(False))
    return F.try_element_at(p, F.when(drive, 2).otherwise(1))


def first_dot_extension(path: Column) -> Column:
    """Lower-cased text after the FIRST dot of the whole path (registry reports)."""
    return F.lower(F.substr(path, F.instr(path, ".") + 1))


def project(path: Column, markers: tuple[str, ...] = ("projects", "work", "dev", "development", "code")) -> Column:
    """Sanitised component after the first marker folder that has a successor."""
    from shelfmark.functions.names import sanitize

    p = parts(path)
    marker = F.array(*[F.lit(m) for m in markers])
    followers = F.filter(
        F.transform(
            p,
            lambda x, i: F.when(
                F.array_contains(marker, F.lower(x)) & (i + 1 < F.size(p)), F.try_element_at(p, i + 2)
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return sanitize(F.try_element_at(followers, F.lit(1)))


def age_days(ts: Column, as_of: Column) -> Column:
    """Fractional days between ``ts`` and the clock."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def gigabytes(size: Column) -> Column:
    return size / F.lit(1e9)


def megabytes(size: Column) -> Column:
    return size / F.lit(1e6)
