"""The stages of the corpus pipeline, each on what the one before kept, against brute force."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
from catalume.cluster import table, written
from catalume.llm import textkit as K
from catalume.llm import toxicity

from ..conftest import SMALL
from .conftest import MESSY, documents
from .test_operators import WORD, brute_classes, brute_hits, lowered


def brute_score(model, text):
    """The model's score of one text, word by word."""
    import numpy as np

    one = lambda b: int(K.range_hash(K.prefix_sums(np.frombuffer(b, np.uint8)), np.zeros(1, np.int64), np.array([len(b)]))[0])
    weight = lambda h: model.weights[h >> (64 - model.width)]
    words = {w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))}
    stems = {w[:5] for w in words if len(w) > 5}
    total = model.intercept + sum(weight(one(w)) for w in words)
    total += sum(weight(int(K.mix(np.array([one(s)], np.uint64))[0])) for s in stems)
    return 1 / (1 + np.exp(-total))


def test_stages(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SMALL)))
        if name != "sharding":
            assert kept[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text, r.source) for r in k.select("doc_id", "text", "source").collect()] for k in kept[:5]]
    ids = [sorted(r[0] for r in k) for k in rows]
    model = toxicity.fit(docs, labels)
    assert ids[1] == sorted(d for d, t, _ in rows[0] if brute_score(model, t) < 0.5)
    assert ids[2] == sorted(d for d, c, _ in brute_classes(rows[1]) if d == c)
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    shingles = [lowered(t).split() for _, t in items]
    assert shingles and ids[3] == sorted(d for d, t, _ in rows[2] if not brute_hits(t, items)[4])
    # The mix: no document more than twice, each source near its target.
    size = {d: len(WORD.findall(t)) for d, t, _ in rows[3]}
    times = {d: ids[4].count(d) for d in size}
    assert set(ids[4]) <= set(ids[3]) and max(times.values()) <= 2
    sources = sorted({s for _, _, s in rows[3]})
    own = {s: sum(size[d] for d, _, x in rows[3] if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * own[s], level * weight[s]) for s in sources) < 1.5 * sum(own.values()) else (low, level)
    for s in sources:
        taken = sum(size[d] * times[d] for d, _, x in rows[3] if x == s)
        assert abs(taken - min(2 * own[s], low * weight[s])) <= max(size[d] for d, _, x in rows[3] if x == s)
    # The shards: every row of the mix once, counts at most one apart, slots gapless along the curve.
    out = kept[5].toPandas()
    assert sorted(zip(out.doc_id, out.text_crc32, strict=True)) == sorted((d, zlib.crc32(t.encode())) for d, t, _ in rows[4])
    n = out.groupby("shard").size()
    assert n.max() - n.min() <= 1 and all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("shard"))
    assert out.sort_values(["shard", "slot"]).curve.is_monotonic_increasing


def test_stages_over_messy_and_empty_tables(spark):
    docs = documents(spark, MESSY)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SMALL)
        assert none.count() == 0
        out = written(stage(spark, docs, SMALL))
        if name == "sharding":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns and none.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        if name == "near duplicates":
            # One of the equal and near texts, one of the two empty ones; the null text and the row without id stay.
            assert sorted((r.doc_id for r in out.collect()), key=lambda d: d or 0) == [None, 1, 4, 5, 7, 8, 9]
        docs = out


def test_run_equals_its_stages(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = rows(corpus_pipeline.run(spark, SMALL))
    assert len(got) > 100 and got == rows(docs)



def test_entry_lists_the_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
