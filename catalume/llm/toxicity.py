"""A toxicity classifier regularised by counterfactuals.

Logistic regression over the presence of words and of their
beginnings. Beside the labels it is given
pairs of texts that differ in identity terms alone (a term swapped for another of
its kind, or a neutral mention put in), and the squared change of the score
between the two is penalised: a mention of a group by itself then moves no score.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed
from . import textkit as K

# Identity terms by kind, lower case; a term is swapped for another of its line.
IDENTITY_TERMS = """
muslim christian jewish hindu buddhist atheist catholic protestant sikh
muslims christians jews hindus buddhists atheists catholics protestants sikhs
woman man girl boy
women men girls boys
gay straight lesbian bisexual transgender queer heterosexual
black white asian latino hispanic african arab european indian
american mexican chinese russian german french spanish turkish polish italian
immigrant refugee foreigner native citizen
immigrants refugees foreigners natives citizens
blind deaf disabled autistic paralyzed
old young elderly teenage
""".split("\n")
KINDS = [line.split() for line in IDENTITY_TERMS if line.strip()]
_KIND = {w: k for k in KINDS for w in k}
#: Neutral mentions, one put into a text that names no group; {} is the term.
MENTIONS = ("my {} neighbour", "a {} teacher spoke", "the {} family", "some {} people")

#: Labelled documents that the classifier is fitted on at most, by a hash of doc_id; half of each label where there are enough; the
#: intercept then makes up for the shares of the labels, so the bound moves no score on the whole.
SAMPLE = 16_000
#: Bits of a word's hash that find its weight: every word of the sample carries one, and a million of them are few to share.
WIDTH = 20
#: Standard errors by which a word's share in toxic documents must differ from that in others for its full step; with fewer, its
#: weight is held back by the square, but no word is left out.
SURE = 4.0
#: Bytes of a longer word's beginning.
STEM_BYTES = 5
#: Strength of the ridge penalty, and of the counterfactual one.
RIDGE, COUNTERFACTUAL = 1.0, 1.0
#: Training documents for each that holds out, by the remainder of crc32(doc_id).
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def swapped(text: str, draw: random.Random) -> str:
    """The text with each identity term swapped for another of its kind, or a neutral mention put in if it has none."""
    words = re.split(r"([a-z]+)", text.lower())
    at = [i for i, w in enumerate(words) if w in _KIND]
    for i in at:
        words[i] = draw.choice([w for w in _KIND[words[i]] if w != words[i]])
    if at:
        return "".join(words)
    return f"{text} {draw.choice(MENTIONS).format(draw.choice(draw.choice(KINDS)))}"


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) pairs of words and, for longer ones, of how they begin, which inflected and rare forms share."""
    data, offsets = K.utf8(texts)
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.NOT_ALNUM)
    sums, doc = K.prefix_sums(data), K.text_of_words(first)
    longer = np.flatnonzero(ends - starts > STEM_BYTES)
    stems = K.mix(K.range_hash(sums, starts[longer], starts[longer] + STEM_BYTES))
    hashes, doc = np.concatenate([K.range_hash(sums, starts, ends), stems]), np.concatenate([doc, doc[longer]])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], hashes[new]


def _places(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - width)).astype(np.int64)


class Model:
    """A weight for each place of a table that hashes fall on, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept, self.width = weights, intercept, len(weights).bit_length() - 1

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, hashes = _present(texts)
        total = self.intercept + np.bincount(doc, self.weights[_places(hashes, self.width)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def training_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """__doc and toxic of all labelled documents that are there and aren't held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.join(docs.select(F.col("doc_id").cast("long").alias("__id")), F.col("__doc") == F.col("__id"), "left_semi")


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, words array<int> and other array<int> (places of its own and of its counterfactual) of at most ``sample`` labelled documents that
    aren't held out, and how many of each label there are in all."""
    known = checkpointed(training_labels(docs, labels))
    order = F.xxhash64("__doc")
    half = known.where("toxic = 1").orderBy(order, "__doc").limit(sample // 2).unionByName(known.where("toxic = 0").orderBy(order, "__doc").limit(sample - sample // 2))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            other = [swapped(t or "", random.Random(str(i))) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)]
            columns = []
            for side in (batch.column("text"), pa.array(other, pa.string())):
                doc, hashes = _present(side)
                at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(_places(hashes, width).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *columns], names=["doc_id", "toxic", "words", "other"])

    # The sample's size is bounded by the parameter.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(half), F.col("doc_id") == F.col("__doc"))
    whole = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    return texts.select("doc_id", "text", "toxic").mapInArrow(pairs, "doc_id long, toxic int, words array<int>, other array<int>"), whole


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = WIDTH, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold; the same rows give the same model.

    The sample is fitted in one task, which holds its words; what comes back is a table of ``2 ** width`` weights at most.
    """
    rows, whole = training_sample(docs, labels, sample, width)
    if len(whole) < 2:
        share = (whole.get(1, 0) + 1) / (sum(whole.values()) + 2)
        return Model(np.zeros(1 << width), float(np.log(share / (1 - share))))
    fitted = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(partial(_fitted, width, ridge, counterfactual), "place int, weight double").toArrow()
    place, weight = fitted.column("place").to_numpy(), fitted.column("weight").to_numpy()
    weights = np.zeros(1 << width)
    weights[place[1:]] = weight[1:]
    # The sample holds other shares of the two labels than all training rows do; the intercept is moved to theirs.
    taken = {1: min(whole[1], sample // 2), 0: min(whole[0], sample - sample // 2)}
    return Model(weights, float(weight[0] + np.log(whole[1] / taken[1]) - np.log(whole[0] / taken[0])))


class _Sparse:
    """Which text has which places, added up by either. Texts ascend in ``row``."""

    def __init__(self, texts: int, row: np.ndarray, col: np.ndarray) -> None:
        self.texts, self.col = texts, col
        starts = np.searchsorted(row, np.arange(texts))
        self.some = np.flatnonzero(np.diff(np.append(starts, len(row))))
        self.starts = starts[self.some]
        by = np.argsort(col, kind="stable")
        self.row = row[by]
        ordered = col[by]
        self.firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.places = ordered[self.firsts]
        self.held = np.empty(len(col))

    def by_text(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.texts)
        if len(self.some):
            out[self.some] = np.add.reduceat(np.take(weights, self.col, out=self.held, mode="clip"), self.starts)
        return out

    def by_place(self, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(self.places):
            out[self.places] = np.add.reduceat(np.take(values, self.row, out=self.held, mode="clip"), self.firsts)
        return out


def _fitted(width: int, ridge: float, counterfactual: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, weight) of all sampled texts, the intercept first. Some 20 bytes for each word of a text and of its pair."""
    toxic: list[np.ndarray] = []
    sizes: dict[str, list] = {"words": [], "other": []}
    places: dict[str, list] = {"words": [], "other": []}
    for b in batches:
        for name in sizes:
            lists = b.column(name)
            sizes[name].append(np.diff(lists.offsets.to_numpy()))
            places[name].append(lists.flatten().to_numpy().copy())
        toxic.append(b.column("toxic").to_numpy().astype(float))
    y, n = np.concatenate(toxic), sum(map(len, toxic))
    mark = np.zeros(1 << width, bool)
    for col in [*places["words"], *places["other"]]:
        mark[col] = True
    used = np.flatnonzero(mark)
    number = np.cumsum(mark, dtype=np.int32) - 1

    def side(name: str) -> _Sparse:
        row = np.repeat(np.arange(n, dtype=np.int32), np.concatenate(sizes.pop(name)))
        return _Sparse(n, row, number[np.concatenate(places.pop(name))])

    own, other = side("words"), side("other")
    held = np.empty(max(len(own.col), len(other.col)))
    own.held, other.held = held[: len(own.col)], held[: len(other.col)]
    weights, intercept = descend(own, other, y, trust(own, y, len(used)), ridge, counterfactual)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used).astype(np.int32)), pa.array(np.append(intercept, weights))], ["place", "weight"])


def trust(own: _Sparse, y: np.ndarray, d: int) -> np.ndarray:
    """How far each place's weight may go, 0 to 1: the square of how surely its presence tells the labels apart."""
    a, b = y.sum(), (1 - y).sum()
    n, t = own.by_place(np.ones(len(y)), d), own.by_place(y, d)
    p, q = t / a, (n - t) / b
    # Two words that share a place can count twice.
    both = np.minimum((p + q) / 2, 1)
    told = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / a + 1 / b) + 1e-9)
    return np.minimum(told / SURE, 1) ** 2


def descend(own: _Sparse, other: _Sparse, y: np.ndarray, scale: np.ndarray, ridge: float, counterfactual: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that make the loss small: cross entropy, squared differences of the two scores of a pair, and
    ridge on the weights over their scale."""
    m, d = len(y), len(scale)
    v, c = np.zeros(d), float(np.log(y.sum() / (m - y.sum())))
    moment, square = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        s, s2 = (1 / (1 + np.exp(-(side.by_text(v * scale) + c))) for side in (own, other))
        gap = 2 * counterfactual * (s - s2)
        g, g2 = (s - y) + gap * s * (1 - s), -gap * s2 * (1 - s2)
        grad = np.append(scale * (own.by_place(g, d) + other.by_place(g2, d)) + ridge * v, g.sum() + g2.sum()) / m
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        v, c = v - move[:-1], c - move[-1]
    return v * scale, float(c)


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Only the words of the text
    enter a score, all of them however long it is; a null or empty text gets the intercept's score.
    Labels other than 0 and 1 or without doc_id are not used, a doc_id labelled twice is toxic if one
    label says so; without labels of both kinds all scores are alike. A null doc_id is not held out.
    Rows that repeat are each scored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text scores under 0.5, all their columns kept, each judged by its own text.

    A null or empty text has the intercept's score. Rows that repeat share their fate, whatever their doc_id; an
    empty table stays empty. The score is put beside the rows in one pass, so nothing is joined or shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            yield batch.filter(pa.array(model.value.score(batch.column("text")) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
