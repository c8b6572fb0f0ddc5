"""Token counts by byte-pair merging with a heap over a linked list.

Counts are those of a BPE vocabulary file of sentencepiece; no identifiers are
made. The vocabulary is read once by the driver and broadcast (its size is fixed).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Words whose counts a Python worker keeps.
KEPT_WORDS = 1_000_000
#: Most tokens of a text that isn't over the limit.
LIMIT = 4096
_MARK = "▁"


def vocabulary(path: str) -> dict[str, int]:
    """The ordinary pieces of a sentencepiece BPE model, with ranks in merge order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): rank for rank, i in enumerate(plain)}


def count_tokens(text: str, ranks: dict[str, int]) -> int:
    """Tokens of a text whose spaces are marked: initial symbols minus merges.

    A character outside the vocabulary stands for as many symbols as it has bytes.
    """
    symbols: list[str | None] = list(text)
    total = sum(1 if c in ranks else len(c.encode()) for c in symbols)
    n = len(symbols)
    if n < 2:
        return total
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    if not heap:
        return total
    heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        rank, i = heappop(heap)
        left = symbols[i]
        if left is None or (j := after[i]) >= n:
            continue
        both = left + symbols[j]
        if ranks.get(both) != rank:
            continue
        symbols[i], symbols[j] = both, None
        k = after[i] = after[j]
        total -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get(both + symbols[k])) is not None:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] + both)) is not None:
            heappush(heap, (r, h))
    return total


class Counter(dict):
    """Counts of words as ``split`` gives them, kept as they come up."""

    def __init__(self, ranks: dict[str, int], most: int = KEPT_WORDS) -> None:
        self.ranks, self.most = ranks, most
        # Where no piece goes on over a mark or a line feed, neither does a merge.
        self.lines = not any("\n" in p for p in ranks if len(p) > 1)
        if any(_MARK in p.lstrip(_MARK) for p in ranks):
            raise ValueError("pieces that hold a space inside aren't supported")
        if missing := {c for p in ranks for c in p} - ranks.keys():
            raise ValueError(f"characters only inside pieces: {sorted(missing)[:5]}")

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = count_tokens(word if word[:1] == "\n" and self.lines else _MARK + word, self.ranks)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _MARK in text:
            text = text.replace(_MARK, " ")
        if self.lines:
            text = text.replace("\n", " \n")
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total = spaces = 0
        for word in words:
            spaces += 1
            if word:
                line = self.lines and word[0] == "\n"
                if spaces == 1:
                    total += self[word]
                else:
                    total += count_tokens(_MARK * (spaces - line) + word, self.ranks)
                spaces = 0
        return total + (count_tokens(_MARK * spaces, self.ranks) if spaces else 0)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    docs: doc_id, text; other columns are ignored. A null or empty text has no bytes and no
    tokens; rows that repeat are each counted; an empty table gives an empty result. path names a
    sentencepiece BPE model whose normaliser is the identity with a space put in front.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in K.slices(batches, "text"):
            texts = batch.column("text")
            n = np.array([counter.count(t.as_py() or "") for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(K.utf8(texts)[1])), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
