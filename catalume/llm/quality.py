"""Quality rules by distribution divergence.

A text's histogram of character classes and its histogram of common words are
compared with those of its language by the Jensen-Shannon distance. The
references are sums over all texts of the language that pass the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed
from . import textkit as K

# Frequent function words of each language with a reference, lower case.
COMMON_WORDS = {
    "en": "the of and to in is was that it for as with on are by this be not or from at an have he you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un une du que est pour qui dans au sur par il pas plus ne ce avec son",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
#: Character classes: lower-case ASCII, upper-case ASCII, digits, white space, full stops and commas,
#: symbols of ``#*$%&|<>``, other ASCII, and bytes beyond ASCII.
CLASSES = 8
#: A text with fewer words isn't judged by its classes, or by its common words.
LEAST_WORDS, LEAST_COMMON = 50, 100
#: Greatest distances (0 to 1) of a text that is kept.
MOST_CLASSES, MOST_WORDS = 0.30, 0.335
#: Words of a repeated window.
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 7
_CLASS[[0x20, *range(0x09, 0x0E)]], _CLASS[list(b".,")], _CLASS[list(_SYMBOLS)] = 3, 4, 5
_COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _lookup(lang: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.utf8(pa.array(COMMON_WORDS[lang].split()))
    hashes = K.word_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], order


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it."""
    window, at = K.windows(hashes, first, WINDOW)
    doc = K.text_of_words(first)[at]
    order = np.lexsort((window, doc))
    again = np.zeros(len(at) + 1, bool)
    again[1:-1] = (window[order][1:] == window[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = at[order[again[:-1] | again[1:]]]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    starts, ends, first = K.spans(data, offsets, newline)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    doc = K.text_of_words(first)[worded]
    line = K.word_hashes(data, starts[worded], ends[worded])
    order = np.lexsort((line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=len(offsets) - 1)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {lang: _lookup(lang) for lang in COMMON_WORDS}
    most = max(len(w.split()) for w in COMMON_WORDS.values())
    for batch in K.slices(batches, "text"):
        data, offsets = K.utf8(batch.column("text"))
        n = batch.num_rows
        starts, ends, first = K.spans(data, offsets, K.SPACE)
        hashes = K.word_hashes(data, starts, ends)
        doc = K.text_of_words(first)
        classes = np.stack([_sums(_CLASS[data] == c, offsets) for c in range(CLASSES)], 1)
        points = _sums(((data & 0xC0) != 0x80) & ~K.SPACE[data], offsets)
        lowered = K.LOWER[data]
        inner, outer, at = K.spans(lowered, offsets, K.NOT_ALNUM)
        lower_hashes, lower_doc = K.word_hashes(lowered, inner, outer), K.text_of_words(at)
        common = np.zeros((n, most + 1), np.int64)
        langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
        for lang, (table, place) in known.items():
            own = langs == lang
            mine = own[lower_doc]
            k = np.minimum(np.searchsorted(table, lower_hashes[mine]), len(table) - 1)
            hit = table[k] == lower_hashes[mine]
            np.add.at(common, (lower_doc[mine][hit], place[k[hit]]), 1)
        common[:, most] = np.bincount(lower_doc, minlength=n) - common.sum(1)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (classes, common)]
        longs = [np.diff(first), points, classes[:, 5], _dup_lines(data, offsets, starts), _repeats(hashes, first)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *map(pa.array, longs), *lists], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two arrays of counts of equal length; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n, m = total(counts), total(reference)

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(counts, reference, lambda x, y: part(x / n, y / m) + part(y / m, x / n))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def divergence(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts of the base rules, base_failed, the two distances
    (js_classes, js_words; null where a guard holds), kept.

    docs: doc_id, text, lang; other columns are ignored. A text is rejected that fails the base rules
    (under 20 words, or over 30 % of the words in repeated windows) or whose distance from its
    language exceeds ``MOST_CLASSES`` or ``MOST_WORDS``. A text of a language without reference,
    or too short for a histogram, is judged by the base rules alone. Null and empty texts have zeros
    and fail; rows that repeat are each judged; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = checkpointed(texts.mapInArrow(count, _COUNTS)).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    size = 1 + max(len(w.split()) for w in COMMON_WORDS.values())
    sums = lambda c, k: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    good = counts.where(F.col("lang").isin(*COMMON_WORDS) & ~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS))
    reference = good.groupBy("lang").agg(sums("classes", CLASSES).alias("__classes"), sums("common", size).alias("__common"))
    # A row for each language with a word list at most.
    judged = counts.join(F.broadcast(reference.withColumnRenamed("lang", "__lang")), F.col("lang") == F.col("__lang"), "left")
    judged = judged.withColumn("js_classes", F.when(F.col("n_words") >= LEAST_WORDS, js_distance(F.col("classes"), F.col("__classes"))))
    judged = judged.withColumn("js_words", F.when(F.col("n_words") >= LEAST_COMMON, js_distance(F.col("common"), F.col("__common"))))
    far = (F.coalesce("js_classes", F.lit(0.0)) > MOST_CLASSES) | (F.coalesce("js_words", F.lit(0.0)) > MOST_WORDS)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "js_classes", "js_words")
