"""Comparisons that fold ASCII letters only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def like_term(value: Column, term: str) -> Column:
    """``%term%`` against the value, ``%`` and ``_`` in the term being wildcards; null counts as empty."""
    pattern = "%" + term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\") + "%"
    return ascii_lower(F.coalesce(value, F.lit(""))).like(pattern)
