"""Queries and their SQL on tables that hold what only larger ones do."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

from catalume.functions.porter import _STEP2, _STEP3, _STEP4, stem
from catalume.queries import ORACLE_SQL, QUERIES
from catalume.queries.scalars import _FORMS

from .conftest import SMALL
from .test_oracle import TABLES, rows

_TIMES = ["2024-01-02 00:00:0%d" % i for i in range(6)]


def _events(load_user: int, samples: list[tuple[float, str]], ties: bool = False) -> str:
    """Events of one load, all at a multiple of 40, so that their positions are their values below 2."""
    made = [f"({40 * (i + 1)}::bigint, timestamp '{_TIMES[0 if ties else i]}', {load_user}::bigint, '{kind}', {value}::double, '')" for i, (value, kind) in enumerate(samples)]
    return f"select * from (values {', '.join(made)}) e(event_id, ts, user_id, event_type, value, props)"


#: Steps whose sum is 0.3 and 0.5 to the microsecond, but less in binary.
_SUMMED = [(0.4, "view"), (0.5, "view"), (0.6, "view"), (0.7, "view")]
_HALF = [(5.0, "error"), (0.2, "view"), (0.3, "view"), (0.7, "view")]
_NAMELESS = {"documents": "select * replace (case doc_id % 7 when 0 then '' when 1 then '  ' when 2 then chr(10) when 3 then null else text end as text) from {documents}"}
CASES = {
    ("path_haystack", "names of an extension alone"): _NAMELESS,
    ("titles_and_terms", "names of an extension alone"): _NAMELESS,
    ("backfill_titles", "parts of seven digits"): {"lineitem": "select * replace (l_partkey + 1200000 as l_partkey) from {lineitem}"},
    ("clear_identify", "parts of seven digits"): {"lineitem": "select * replace (l_partkey + 1200000 as l_partkey) from {lineitem}"},
    ("default_keeper", "vectors alike"): {"embeddings": "select * from {embeddings} union all select vec_id + 5001, embedding, label from {embeddings} where vec_id % 3 = 0"},
    ("merge_duplicates", "vectors alike"): {"embeddings": "select * from {embeddings} union all select vec_id + 5001, embedding, label from {embeddings} where vec_id % 3 = 0"},
    ("fts_stems", "rare forms"): {"documents": "select * replace (text || ' andes ofes offing ofnesses andful hieds theys theyings des' as text) from {documents}"},
    ("play_event_stream", "a sum that is the threshold"): {"events": _events(9, _SUMMED)},
    ("play_events", "a sum that is the threshold"): {"events": _events(9, _HALF)},
    # The paused one of two samples alike comes last, whichever is read first.
    ("forward_watch_time", "samples alike, paused first"): {"events": _events(9, [(0.4, "error"), (0.4, "view"), (0.6, "view")], ties=True)},
    ("forward_watch_time", "samples alike, paused last"): {"events": _events(9, [(0.4, "view"), (0.4, "error"), (0.6, "view")], ties=True)},
}


@pytest.mark.parametrize("case", CASES, ids="-".join)
def test_query(spark, tmp_path, case):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if t in CASES[case]:
            made = CASES[case][t].format(**{t: f"'{SMALL}/{t}.parquet'"})
            con.execute(f"copy ({made}) to '{tmp_path}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = QUERIES[case[0]](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL[case[0]]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def _words_of(stem_: str) -> set[str]:
    """All words with the stem: the steps of the algorithm backwards, then checked forwards."""
    found = {stem_} | ({stem_ + "l"} if stem_.endswith("l") else set())
    found |= {w + "e" for w in found}
    found |= {w + s for w in found for s in _STEP4}
    for step in (_STEP3, _STEP2):
        found |= {w[: len(w) - len(r)] + s for w in found for s, r in step.items() if w.endswith(r)}
    found |= {w[:-1] + "y" for w in found if w.endswith("i")}
    for s in ("ed", "ing"):
        found |= {x for w in set(found) for x in (w + s, w.removesuffix("e") + s, w + w[-1] + s)}
    found |= {w + "d" for w in found if w.endswith("ee")}
    found |= {w + s for w in found for s in ("s", "es")}
    return {w for w in found if stem(w) == stem_}


@pytest.mark.parametrize("of", _FORMS)
def test_forms_of_stems_are_complete(of):
    words = _words_of(of)
    assert all(re.fullmatch(_FORMS[of], w) for w in words)
    near = {w[:k] + c + w[k:] for w in words for k in range(len(w) + 1) for c in "esdinglyuf"} | {w[:k] + w[k + 1 :] for w in words for k in range(len(w))}
    assert not [w for w in near if re.fullmatch(_FORMS[of], w) and stem(w) != of]


def test_stems_hold_few_words(spark):
    """Memory of a batch of texts stays the same however many words it has that occur once."""
    import tracemalloc

    import pyarrow as pa

    from catalume.functions.tokens import _stemmed

    def peak(n: int) -> int:
        texts = pa.array([" ".join(f"w{at * 40 + i}x" for i in range(40)) for at in range(n)])
        tracemalloc.start()
        out = _stemmed.func(texts)
        assert out[n - 1].as_py()[-1] == f"w{n * 40 - 1}x" and len(out) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(10_000) < 1.5 * peak(2_500)


def test_postings_come_in_small_batches():
    import pyarrow as pa

    from catalume.operators.textindex import _posted

    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([["a", "b", "a"]] * n), pa.array([None] * n, pa.list_(pa.string()))], ["asset_id", "title", "details"])
    out = list(_posted(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 2 * n
    assert out[0].slice(0, 2).to_pylist() == [{"term": "a", "asset_id": "0", "field": 0, "gaps": [0, 2]}, {"term": "b", "asset_id": "0", "field": 0, "gaps": [1]}]


def test_a_listing_is_one_batch_whatever_the_tasks(spark, tmp_path, monkeypatch):
    """Each of seven listings costs one commit of the catalog, though the orders are read by several tasks."""
    from catalume.store import CatalogStore

    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderkey % 8 = 1").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    commits, commit = [], CatalogStore.commit
    monkeypatch.setattr(CatalogStore, "commit", lambda store, *a, **k: commits.append(1) or commit(store, *a, **k))
    QUERIES["listing_stream"](spark, str(tmp_path))
    assert len(commits) == 8


def test_orphans_of_a_scan_are_sought_in_assets_alone(spark):
    from pyspark.sql import functions as F

    from catalume.plans import workflows
    from catalume.queries.lifecycle import _now, _scan_inputs

    after = workflows.scan(*_scan_inputs(spark, SMALL), _now())[0]
    plan = after.files._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") <= 2
    assert after.files.join(after.assets.select(F.col("id").alias("a")), F.col("asset_id") == F.col("a"), "left_anti").isEmpty()
