"""Weights of play and shuffle, and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of its weight that an asset keeps while it rests.
COOLED = 0.12


def recency_multiplier(last: Column, now: Column) -> Column:
    """Less for what was played lately; 1.35 for what never was."""
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(last), F.lit(0)) / 3600
    return F.when(last.isNull(), 1.35).when(age < 1, 0.08).when(age < 6, 0.2).when(age < 24, 0.4).when(age < 168, 0.7).otherwise(1.0)


def cooldown_size(n: Column) -> Column:
    """How many of n assets rest after a play."""
    return F.when(n <= 1, 0).otherwise(F.least(F.lit(40), F.greatest(F.lit(3), F.floor(n * 3 / 20)))).cast("int")


def shuffle_weight(favorite: Column, last: Column, now: Column, cooling: Column) -> Column:
    base = F.greatest(favorite, F.lit(1)) * recency_multiplier(last, now) * F.when(cooling, COOLED).otherwise(1.0)
    return F.greatest(F.lit(0.05), base)


def watch_threshold(duration: Column) -> Column:
    """Seconds that make a play: a tenth, 30 at most; 30 if the length is unknown."""
    return F.when(duration > 0, F.least(F.lit(30.0), duration / 10)).otherwise(30.0)


def vtt_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm, cut off below the millisecond."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((s - whole) * 1000))


def parse_vtt_time(text: Column) -> Column:
    """Seconds of ``HH:MM:SS.n``, where n counts thousandths however many digits it has; 0 for any other text, null for null."""
    pattern = r"^\s*([0-9]+):([0-9]+):([0-9]+)\.([0-9]+)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000).when(text.isNotNull(), 0.0)


def _size_text(size: Column) -> Column:
    """Bytes in the greatest of B, KB, MB, GB, TB that leaves 1 or more; one decimal but for bytes."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def spec_line(codec: Column, width: Column, height: Column, duration: Column, fps: Column, bitrate: Column, size: Column) -> Column:
    """What is known of a file as one line, its parts joined by dots: codec, size of the picture, length, rate, bit rate, bytes."""
    s = F.floor(duration).cast("long")
    clock = F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
    rate = F.concat(F.regexp_replace(F.format_string("%.2f", fps.cast("double")), r"\.?0+$", ""), F.lit(" fps"))
    mbit = F.format_string("%.1f Mb/s", bitrate.cast("double") / 1e6)
    picture = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    return F.concat_ws(" · ", F.when(codec != "", codec), picture, F.when(duration.isNotNull(), clock), F.when(fps.isNotNull(), rate), F.when(bitrate.isNotNull(), mbit), F.when(size > 0, _size_text(size)))
