"""Windows-style paths and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .like import ascii_lower

#: The column of a stored table that holds the normalised path of each row.
PATH_KEY = "path_key"


def normalize_path(path: Column) -> Column:
    """Backslashes throughout, and one after a drive."""
    return F.regexp_replace(F.translate(path, "/", "\\"), r"^([A-Za-z]:)(?!\\)", r"$1\\")


def normalize_root(path: Column) -> Column:
    """A normalised path without backslashes at its end, but a drive keeps one."""
    return F.regexp_replace(F.regexp_replace(normalize_path(F.trim(path)), r"\\+$", ""), r"^([A-Za-z]:)$", r"$1\\")


def root_key(root: Column) -> Column:
    """What a root and the folders above a file have in common, whatever their separators and ASCII case."""
    return ascii_lower(normalize_root(root))


def path_and_above(path: Column) -> Column:
    """The keys of a path itself and of all folders above it."""
    parts = F.split(ascii_lower(normalize_path(path)), r"\\")
    up_to = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))
    return F.array_append(up_to, F.concat(F.element_at(parts, 1), F.lit("\\")))


def is_under(path: Column, root: Column) -> Column:
    """Whether the path is the root or lies below it; separators and ASCII case don't matter."""
    p, r = ascii_lower(normalize_path(path)), ascii_lower(normalize_root(root))
    return (p == r) | p.startswith(F.when(r.endswith("\\"), r).otherwise(F.concat(r, F.lit("\\"))))


def volume_key(path: Column) -> Column:
    """Upper-case drive, ``\\\\host\\share``, or the first part of the path."""
    p = F.translate(path, "/", "\\")
    drive, share = F.regexp_extract(p, r"^([A-Za-z]:)", 1), F.regexp_extract(p, r"^(\\\\[^\\]+\\[^\\]+)", 1)
    return F.when(drive != "", F.upper(drive)).when(share != "", share).otherwise(F.regexp_extract(p, r"^\\*([^\\]*)", 1))
