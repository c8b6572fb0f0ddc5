"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task cuts its texts into shards of a few MB, sorts the shard's suffixes of
words, and looks up every suffix of the benchmark by binary search. Matches
are verbatim in words and never leave one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Words of a window.
WINDOW = 10
#: Bytes of training text of one suffix array; a longer text has one of its own.
SHARD_BYTES = 3 << 20
#: Benchmark words that are broadcast together; a larger benchmark goes out in several such blocks.
BLOCK_WORDS = 400_000

RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, longest long, longest_at long, longest_item string"


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.utf8(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.NOT_ALNUM)
    return K.word_hashes(data, starts, ends), first


def suffix_array(words: np.ndarray, first: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The words' positions in the order of the suffixes that start there, by at least ``depth`` words.

    Ranks double from one word to two, four and so on; the end of a text comes before any word.
    """
    order = np.argsort(words)
    new = np.concatenate([[True], np.diff(words[order]) != 0]) if len(words) else np.zeros(0, bool)
    rank = np.empty(len(words), np.uint64)
    rank[order] = np.cumsum(new).astype(np.uint64)
    end = np.repeat(first[1:], np.diff(first))
    at, step = np.arange(len(words)), 1
    while step < depth and len(words) and rank[order[-1]] < len(words):
        key, inside = rank * np.uint64(len(words) + 1), at + step < end
        key[inside] += rank[at[inside] + step]
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[True], np.diff(key[order]) != 0])).astype(np.uint64)
        step *= 2
    return order


class Suffixes:
    """Distinct windows of a block of items: their words, lengths, and the items that have each."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int) -> None:
        rows, lengths, owners, places = [], [], [], []
        # An item without id has windows as any other, but no name to give.
        self.ids = [i for i, _ in items]
        self.words = [np.array(w, np.int64).view(np.uint64) for _, w in items]
        for k, w in enumerate(self.words):
            n = min(window, len(w))
            for at in range(len(w) - n + 1) if n else ():
                rows.append(np.concatenate([w[at : at + n], np.zeros(window - n, np.uint64)]))
                lengths.append(n)
                owners.append(k)
                places.append(at)
        whole = np.array(rows, np.uint64).reshape(len(rows), window)
        self.query, self.some, back = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        self.length = np.array(lengths, np.int64)[self.some]
        order = np.argsort(back, kind="stable")
        # The items of each window, and the windows' places in them.
        self.items, self.places = np.array(owners, np.int64)[order], np.array(places, np.int64)[order]
        self.begin = np.searchsorted(back[order], np.arange(len(self.query) + 1))

    def find(self, words: np.ndarray, first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all windows at once: the positions that match, and the window of each."""
        end = np.repeat(first[1:], np.diff(first))
        span = np.arange(self.query.shape[1])
        asked = span[None, :] < self.length[:, None]

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.query), np.int64), np.full(len(self.query), len(order))
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                at = order[mid][:, None] + span[None, :]
                have = np.where(at < end[order[mid]][:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))
                other = (have != self.query[open_]) & asked[open_]
                j = other.argmax(1)
                row = np.arange(len(open_))
                differs = other[row, j]
                less = np.where(differs, have[row, j] < self.query[open_][row, j], after)
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            return low

        if not len(order) or not len(self.query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = bound(False), bound(True)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        return order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], window

    def extend(self, words: np.ndarray, first: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all items that have a matched window: where each verbatim match begins in the text, its words, and the item.

        A match whose text and item agree on the word before as well is left out: it is part of the one that begins there.
        """
        n = self.begin[window + 1] - self.begin[window]
        own = np.repeat(self.begin[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place, at, length = self.items[own], self.places[own], np.repeat(at, n), np.repeat(self.length[window], n)
        flat = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        begin = np.cumsum([0, *map(len, self.words)])
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
        q = begin[item] + place
        inner = (at > first[text]) & (place > 0)
        inner[inner] = words[at[inner] - 1] == flat[q[inner] - 1]
        item, at, length, q, text = (x[~inner] for x in (item, at, length, q, text))
        end, item_end, going = first[text + 1], begin[item + 1], np.arange(len(at))
        while going.size:
            a, b = at[going] + length[going], q[going] + length[going]
            same = (a < end[going]) & (b < item_end[going])
            same &= words[np.minimum(a, len(words) - 1)] == flat[np.minimum(b, len(flat) - 1)]
            going = going[same]
            length[going] += 1
        return at, length, item


def _blocks_of(items: DataFrame, window: int, block_words: int) -> list:
    """The items' words as broadcast blocks, each of about so many words."""
    spark = items.sparkSession

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text"):
            words, first = words_of(batch)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], names=["item_id", "words"])

    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(item_words, "item_id string, words array<long>").where("size(words) > 0").distinct()
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    sent = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).orderBy("item_id", "words").collect()
        sent.append(spark.sparkContext.broadcast([(r.item_id, list(r.words)) for r in rows]))
    return sent


def _found(batches: Iterator[pa.RecordBatch], sent: list, window: int):
    """For each slice: the slice, where its texts' words begin, which words are hit, and (window set, places, windows) of each block with matches."""
    kept = Suffixes(sent[0].value, window) if len(sent) == 1 else None
    for batch in K.slices(batches, "text", SHARD_BYTES):
        words, first = words_of(batch)
        order = suffix_array(words, first, window)
        steps, matches = np.zeros(len(words) + 1, np.int64), []
        for block in sent:
            s = kept or Suffixes(block.value, window)
            at, which = s.find(words, first, order)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + s.length[which], -1)
            if len(at):
                matches.append((s, at, which))
        yield batch, words, first, np.cumsum(steps[:-1]) > 0, matches


def verbatim_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: its words, how many lie in an occurrence of a benchmark window, the
    items concerned, and the longest verbatim match with its place (word number) and item; of equally
    long ones the first, and of its items the least.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have
    no words, match nothing and are returned with zeros; an item without words has no window; one
    without id counts for the words that are hit and for the longest match, but isn't among item_ids; rows
    that repeat are each judged; an empty table gives an empty result.
    """
    sent = _blocks_of(items, window, block_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, first, hits, matches in _found(batches, sent, window):
            n, doc = batch.num_rows, K.text_of_words(first)
            found: list[set[str]] = [set() for _ in range(n)]
            best = [(0, 0, None)] * n
            for s, at, which in matches:
                for pair in np.unique(doc[at] * len(s.query) + which):
                    d, q = divmod(int(pair), len(s.query))
                    found[d].update(s.ids[i] for i in s.items[s.begin[q] : s.begin[q + 1]] if s.ids[i] is not None)
                start, length, item = s.extend(words, first, at, which)
                longest = np.zeros(n, np.int64)
                np.maximum.at(longest, doc[start], length)
                top = np.flatnonzero(length == longest[doc[start]])
                for k in top[np.lexsort((start[top], doc[start[top]]))]:
                    d = int(doc[start[k]])
                    mine = (int(length[k]), int(start[k] - first[d]), s.ids[item[k]])
                    if best[d][0] < mine[0] or best[d][0] == mine[0] and (best[d][1], best[d][2] is None, best[d][2] or "") > (mine[1], mine[2] is None, mine[2] or ""):
                        best[d] = mine
            upto = np.concatenate([[0], np.cumsum(hits)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(upto[first[1:]] - upto[first[:-1]]), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] if b[0] else None for b in best], pa.int64()), pa.array([b[2] for b in best], pa.string())],
                names=["doc_id", "n_words", "n_hit", "item_ids", "longest", "longest_at", "longest_item"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, RESULT)


def digest(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at", "longest_item")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with no benchmark window, all their columns kept, each judged by its own text.

    Null and empty texts stay, whatever their doc_id; so do rows that repeat, if they are clean. Rows go in the
    pass that searches them: nothing is shuffled.
    """
    sent = _blocks_of(items, window, block_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, first, hits, _ in _found(batches, sent, window):
            upto = np.concatenate([[0], np.cumsum(hits)])
            yield batch.filter(pa.array(upto[first[1:]] == upto[first[:-1]]))

    return docs.mapInArrow(keep, docs.schema)
