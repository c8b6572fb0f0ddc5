"""64-bit perceptual hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIDE, _KEPT = 64, 8


def parse_hash64(text: Column) -> Column:
    """A hexadecimal 64-bit number as the long with its bits; null if it is none."""
    digits = F.regexp_replace(F.trim(text), "^0+(?=.)", "")
    padded = F.lpad(digits, 16, "0")
    half = lambda at: F.conv(F.substring(padded, at, 8), 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def median_bits(values: Column) -> Column:
    """64 numbers as a hash: bit i, from the highest, tells whether value i is above the median (mean of the 32nd and 33rd)."""
    ordered = F.sort_array(values)
    median = (F.element_at(ordered, 32).cast("double") + F.element_at(ordered, 33).cast("double")) / 2
    # A struct in an array of one, so that values are sorted once and not for each of them.
    one = F.array(F.struct(values.alias("v"), median.alias("m")))
    above = F.transform(one, lambda s: F.array_join(F.transform(s["v"], lambda v: F.when(v.cast("double") > s["m"], "1").otherwise("0")), ""))[0]
    half = lambda at: F.conv(F.substring(above, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def dct_matrix(side: int = _SIDE) -> np.ndarray:
    """DCT-II with the scale of Lee's recursion: the plain cosine sums."""
    k = np.arange(side)
    return np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * side))


@F.pandas_udf(T.LongType())
def perceptual_hash(gray: pd.Series) -> pd.Series:
    """Hash of a 64 x 64 grey image given as 4096 numbers, row by row: bit i, from the highest, tells whether the
    i-th of its 8 x 8 lowest frequencies is above their median (mean of the 32nd and 33rd); null for null."""
    m = dct_matrix()[:_KEPT]
    some = gray.notna()
    images = np.array(gray[some].tolist(), float).reshape(-1, _SIDE, _SIDE)
    low = np.einsum("ai,nij,bj->nab", m, images, m).reshape(len(images), _KEPT * _KEPT)
    ordered = np.sort(low, axis=1)
    above = low > ((ordered[:, 31] + ordered[:, 32]) / 2)[:, None]
    out = pd.Series(pd.array([pd.NA] * len(gray), "Int64"), index=gray.index)
    out[some] = np.packbits(above, axis=1).view(">i8").astype(np.int64).ravel()
    return out
