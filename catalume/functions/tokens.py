"""Full-text tokens: runs of letters and digits, lower case, without diacritics, stemmed if asked."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

_WORD = re.compile(r"[^\W_]+")


#: Texts whose tokens are held as Python objects at once, and words whose stems are.
TEXTS, STEMS = 128, 50_000


def tokens_of(text: str | None, stemmed: bool = True) -> list[str]:
    """The same for one string on the driver, as for a search term."""
    text = text or ""
    folded = (text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))).lower()
    words = _WORD.findall(folded)
    return [stem(w) for w in words] if stemmed else words


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(text: pa.Array) -> pa.Array:
    """A few texts at a time, so that memory follows neither their number nor how many words they have in all."""
    known: dict[str, str] = {}
    out = [pa.array([], pa.list_(pa.string()))]
    for at in range(0, len(text), TEXTS):
        lists = []
        for t in text.slice(at, TEXTS).to_pylist():
            words = tokens_of(t, False)
            for w in words:
                if w not in known:
                    known[w] = stem(w)
            lists.append([known[w] for w in words])
            if len(known) > STEMS:
                known.clear()
        out.append(pa.array(lists, pa.list_(pa.string())))
    return pa.concat_arrays(out)


def fts_tokens(text: Column, stemmed: bool = True) -> Column:
    """Tokens of a text; unstemmed ones of plain letters stay in JVM functions."""
    return _stemmed(text) if stemmed else F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_match(tokens: Column, phrase: list[str]) -> Column:
    """Whether the phrase's tokens follow each other in the tokens; an empty phrase matches nothing."""
    if not phrase:
        return F.lit(False)
    return F.coalesce(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " "), F.lit(False))
