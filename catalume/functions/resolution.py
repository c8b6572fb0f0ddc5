"""Resolution words in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolution words and the height each stands for, and the word written for a height.
HEIGHTS = {"4320p": 4320, "4320": 4320, "8k": 4320, "uhd8k": 4320, "2160p": 2160, "2160": 2160, "4k": 2160, "uhd": 2160, "1440p": 1440, "1440": 1440, "2k": 1440, "qhd": 1440, "1080p": 1080, "1080": 1080, "fhd": 1080, "720p": 720, "720": 720, "480p": 480, "480": 480, "sd": 480}
CANONICAL = {4320: "4320p", 2160: "4K", 1440: "1440p", 1080: "1080p", 720: "720p", 480: "480p"}
_WORD = r"(?<![A-Za-z0-9])({})(?![A-Za-z0-9])"
_ANY = "(?i)" + _WORD.format("|".join(sorted(HEIGHTS, key=len, reverse=True)))
_CAPITALS = _WORD.format("|".join(w.upper() for w in HEIGHTS if w.isalpha()))


def canonical_token(height: Column) -> Column:
    out = F.when(height.isNull(), "unknown")
    for h, token in CANONICAL.items():
        out = out.when(height == h, token)
    return out.otherwise("downscaled")


def token_height(word: Column) -> Column:
    """The height a single word stands for, or null."""
    table = F.create_map(*[x for w, h in HEIGHTS.items() for x in (F.lit(w), F.lit(h))])
    return F.try_element_at(table, F.lower(F.trim(word)))


def is_resolution_token(word: Column) -> Column:
    return F.coalesce(F.lower(F.trim(word)).isin(*HEIGHTS), F.lit(False))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def detect_token_height(name: Column) -> Column:
    """The height that the last resolution word of a file name stands for, its extension aside."""
    return token_height(F.try_element_at(F.regexp_extract_all(_stem(name), F.lit(_ANY), F.lit(1)), F.lit(-1)))


def rewrite_resolution(name: Column, mode: str, height: Column | int) -> Column:
    """Resolution words of a name replaced by that of the height (in capitals where the word was), removed, or left."""
    if mode == "leave":
        return name
    stem = _stem(name)
    extension = F.substr(name, F.char_length(stem) + 1)
    if mode == "remove":
        return F.concat(F.trim(F.regexp_replace(F.regexp_replace(stem, _ANY, ""), r"[-_. \[\](){}]+", " ")), extension)
    token = canonical_token(height if isinstance(height, Column) else F.lit(height))
    marked = F.replace(F.regexp_replace(F.regexp_replace(stem, _CAPITALS, "\x01"), _ANY, "\x02"), F.lit("\x02"), token)
    return F.concat(F.replace(marked, F.lit("\x01"), F.upper(token)), extension)
