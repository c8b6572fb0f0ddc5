from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, rank int, kept boolean, words string, __doc long"


def documents(spark, rows):
    """documents of (doc_id, text, lang, source) with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 0.5, 3, 4, True, "w", 9) for r in rows], SCHEMA)


PROSE = " ".join(f"word{i} of the story{i % 7}" for i in range(60))
#: Null in every column, empty and very long texts, ties and repeated rows.
MESSY = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE + " tail", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, None),
    (6, "", "xx", None),
    (None, "a null id here", "de", "c"),
    (7, "one", "fr", "a"),
    (8, "xyz " * 60_000, "en", "c"),
    (9, "Été 中文 \U0001f642 naïve", "fr", "b"),
]


@pytest.fixture
def messy(spark):
    return documents(spark, MESSY)


@pytest.fixture
def empty(spark):
    return documents(spark, [])
