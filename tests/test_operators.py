"""Small scenarios of the operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from catalume.catalog import Catalog, read_catalog, write_catalog
from catalume.functions.hashing import hamming
from catalume.operators import collections as C
from catalume.operators import duplicates as D
from catalume.operators import identify as I
from catalume.operators import inventory as V
from catalume.operators import search as S
from catalume.operators.files import latest_file, representative_file
from catalume.operators.graph import connected_components
from catalume.operators.plays import play_events
from catalume.plans import downscale as Z
from catalume.sources import media, records
from catalume.streaming import playback

T0 = datetime(2024, 1, 1)


def three_assets(spark):
    """Asset 0 with tags A, B, C, a studio and a person; 1 with A; 2 with A and B, ignored; 3 without file."""
    assets = spark.createDataFrame([(str(i), t, None, i, 0, "s" if i == 0 else None, T0, 2, None, T0 if i == 2 else None, T0 + timedelta(days=i), None) for i, t in enumerate(["Concatenate this", "A cat", "zebra", None])], "id string, title string, details string, favorite int, play_count long, studio_id string, checked_at timestamp, match_count int, applied_at timestamp, ignored_at timestamp, created_at timestamp, last_played_at timestamp")
    files = spark.createDataFrame([("f0", "0", r"E:\100% legit\a.mp4", 10.0, 480, 1, T0), ("f1", "1", r"E:\Lib\b.mp4", None, 720, 1, T0), ("f2", "1", r"E:\LibX\c.mp4", 5.0, 1080, 1, T0), ("f3", "2", r"E:\Lib\d 1080p.mp4", 5.0, 1080, 1000, T0)], "id string, asset_id string, path string, duration double, height int, size_bytes long, scanned_at timestamp")
    tags = spark.createDataFrame([(t, t) for t in "ABC"], "id string, name string")
    links = spark.createDataFrame([("0", "A"), ("0", "B"), ("0", "C"), ("1", "A"), ("2", "A"), ("2", "B")], "asset_id string, tag_id string")
    people = spark.createDataFrame([("p", "Robin Monroe")], "id string, name string")
    cast = spark.createDataFrame([("0", "p")], "asset_id string, person_id string")
    return Catalog(assets=assets, files=files, tags=tags, asset_tags=links, people=people, asset_people=cast)


def found(catalog, **args):
    return {r.id for r in S.filter_assets(catalog, S.SearchArgs(**args)).collect()}


def test_tag_and_state_filters(spark):
    c = three_assets(spark)
    assert found(c) == {"0", "1", "2"}
    assert found(c, tags_all=("A", "B", "C")) == {"0"}
    assert found(c, tags_all=("A",), tags_none=("C",)) == {"1", "2"}
    assert found(c, tags_all=("A", "B"), min_tags=3) == {"0"}
    assert found(c, tags_all=("A",), tags_none=("C",), min_tags=3) == set()
    assert found(c, ignored=True) == {"2"} and found(c, ignored=False) == {"0", "1"}
    assert found(c, not_studios=("s",)) == {"1", "2"} and found(c, studios=("s",)) == {"0"}
    assert found(c, folders=(r"e:\lib",)) == {"1", "2"} and found(c, folders=(r"E:\100% legit",)) == {"0"}
    assert found(c, min_duration=6) == {"0"}


def test_text_is_tokens_for_include_and_substrings_for_exclude(spark):
    c = three_assets(spark)
    assert found(c, include=("cat",)) == {"1"}
    assert found(c, exclude=("cat",)) == {"2"}
    assert found(c, include=("robin",)) == {"0"} and found(c, include=("cat robin",)) == set()
    assert found(c, include=("cat robin",), inverse=True) == {"2"}
    assert found(c, include=("%",)) == {"0", "1", "2"}


def test_pages_add_up_and_carry_the_total(spark):
    c = three_assets(spark)
    pages = [r for o in range(3) for r in S.search_assets(c, S.SearchArgs(limit=1, offset=o)).collect()]
    assert [r.id for r in pages] == ["2", "1", "0"] and {r.total for r in pages} == {3}


def test_files_that_stand_for_assets(spark):
    f = three_assets(spark).files
    assert {r.asset_id: r.id for r in representative_file(f).collect()} == {"0": "f0", "1": "f2", "2": "f3"}
    assert {r.asset_id: r.id for r in latest_file(f).collect()}["1"] == "f1"


def test_rescan_is_idempotent_and_copies_share_an_asset(spark):
    listing = spark.createDataFrame([(f"E:/x/{i}.mp4", 1, T0) for i in range(100)], "path string, size long, mtime timestamp")
    empty = spark.createDataFrame([], "id string, asset_id string, path string, size_bytes long, modified_at timestamp")
    first = V.inventory_diff(listing, empty)
    assert V.scan_summary(first).first().asDict() == {"found": 100, "added": 100, "updated": 0, "removed": 0}
    none = spark.createDataFrame([], "file_id string, hash_type string, value string")
    placed = V.detect_moves(first.select("path", F.lit("h").alias("oshash")), none, empty)
    assert placed.select("asset_id").distinct().count() == 1
    files = placed.select(F.col("path").alias("id"), "asset_id", "path", F.lit(1).alias("size_bytes"), F.lit(T0).alias("modified_at"))
    assert V.scan_summary(V.inventory_diff(listing, files)).first().asDict() == {"found": 100, "added": 0, "updated": 0, "removed": 0}
    assert playback.incremental_inventory(listing.limit(0), files, False).count() == 0


def test_cascades(spark):
    c = three_assets(spark)
    left = V.delete_assets(c, spark.createDataFrame([("0",)], "id string"))
    assert left.asset_tags.count() == 3 and left.files.count() == 3 and left.asset_people.count() == 0
    assert V.delete_tags(c, spark.createDataFrame([("A",)], "id string")).asset_tags.count() == 3


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    hashes = base + [b ^ ((1 << r.randrange(14)) - 1) for b in base]
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    for t in (3, 8, 14):
        got = {(x.a, x.b, x.distance) for x in D.hamming_pairs(df, t).collect()}
        u = sorted(set(hashes))
        want = {(a, b, d) for i, a in enumerate(u) for b in u[i + 1 :] if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= t}
        assert got == want
    assert df.select(hamming(F.col("hash"), F.col("hash")).alias("d")).agg(F.max("d")).first()[0] == 0


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = {n: top(n) for a, b in edges if a != b for n in (a, b)}
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_keeps_the_best(spark):
    c = three_assets(spark)
    groups = spark.createDataFrame([("0", 7, 7), ("2", 7, 7)], "id string, hash long, group long")
    merged = D.merge_duplicates(c, groups, spark.createDataFrame([(7, "0")], "group long, keeper string"))
    assert {r.id: r.favorite for r in merged.assets.collect()} == {"0": 2, "1": 1, "3": 3}


def test_weighted_shuffle_prefers_weight(spark):
    items = spark.createDataFrame([(1, 1), (2, 5)], "asset_id long, favorite int")
    first = [C.weighted_shuffle(items, str(s)).first().asset_id for s in range(60)]
    assert 38 <= first.count(2) <= 58
    assert [r.asset_id for r in C.weighted_shuffle(items, "a").collect()] == [r.asset_id for r in C.weighted_shuffle(items, "a").collect()]


def test_durations(spark):
    for a, b, wanted in [(2580.0, 7320.0, False), (600.0, 610.0, True), (None, 100.0, True)]:
        assert spark.createDataFrame([(a, b)], "a double, b double").select(I.duration_plausible(F.col("a"), F.col("b"))).first()[0] is wanted


def test_outcomes(spark):
    pending = spark.createDataFrame([(i,) for i in range(5)], "id long")
    raw = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (4,)], "asset_id long")
    left = spark.createDataFrame([(1,), (2,), (2,)], "asset_id long")
    auto = {r.asset_id: r.outcome for r in I.identify_outcome(pending, raw, left, True).collect()}
    assert auto == {0: "none", 1: "applied", 2: "review", 3: "none", 4: "review"}
    hand = {r.asset_id: r.outcome for r in I.identify_outcome(pending, raw, left, False).collect()}
    assert hand == {0: "none", 1: "review", 2: "review", 3: "none", 4: "none"}


def test_clear_identify(spark):
    c = three_assets(spark)
    a = c.assets.withColumns({"title_source": F.lit("box"), "details_source": F.lit("box"), "cover_source": F.lit("box"), "cover_path": F.lit("x"), "remote_id": F.lit("r")})
    c = c.but(assets=a, rejected_matches=spark.createDataFrame([], "asset_id string, provider_id string, remote_id string"))
    out = I.clear_identify(c, spark.createDataFrame([("0",)], "asset_id string"), ("box",), "box", F.lit(T0), strip_links=True)
    row = out.assets.where("id = '0'").first()
    assert row.studio_id is None and row.cover_path is None and row.remote_id is None
    assert out.asset_tags.where("asset_id = '0'").count() == 0 and out.rejected_matches.count() == 1


def test_downscale(spark):
    c = three_assets(spark)
    t = Z.plan_totals(Z.downscale_plan(c.assets.where("id in ('2')"), c.files, 720)).first()
    assert (t.would_transcode, t.would_skip, t.bytes_saved) == (1, 0, 555)
    assert Z.downscale_plan(c.assets.where("id = '2'"), c.files, 720).first().new_name == "d 720p.mp4"
    assert Z.plan_totals(Z.downscale_plan(c.assets, c.files, 1080)).first().would_transcode == 0


def test_catalog_round_trip(spark, tmp_path):
    c = three_assets(spark)
    write_catalog(Catalog(tags=c.tags), str(tmp_path))
    assert read_catalog(spark, str(tmp_path), ["tags"]).tags.select("name").count() == 3


def test_media_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MP4").write_bytes(bytes(range(20)))
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.mkv").write_bytes(b"\x01" * 70000)
    assert media.list_media(spark, [str(tmp_path), str(tmp_path / "none")]).count() == 2
    got = {r.path.rsplit("/", 1)[1]: r.oshash for r in media.file_oshash(media.file_contents(spark, [str(tmp_path)])).collect()}
    words = sum(int.from_bytes(bytes(range(8 * k, 8 * k + 8)), "little") for k in (0, 1))
    assert got["a.MP4"] == f"{(20 + words) % (1 << 64):016x}"
    assert got["c.mkv"] == f"{(70000 + 2 * 8192 * int.from_bytes(b'\x01' * 8, 'little')) % (1 << 64):016x}"
    assert media.file_md5(media.file_contents(spark, [str(tmp_path)])).where("md5 = md5('x')").count() == 1


def test_foreign_catalog_and_cues(spark):
    prints = spark.createDataFrame([("f", "md5", "v")], "file_id string, hash_type string, value string")
    links = spark.createDataFrame([("f", "r")], "file_id string, remote_id string")
    meta = spark.createDataFrame([("r", "t", None, "s")], "remote_id string, title string, details string, studio string")
    names = spark.createDataFrame([("r", "b"), ("r", "a")], "remote_id string, name string")
    p, m = records.read_foreign_catalog(prints, links, meta, names, names.limit(0))
    assert p.first().remote_id == "r" and m.first().people == ["a", "b"] and m.first().tags == []
    vtt = spark.createDataFrame([("x", "WEBVTT\n\n00:00:01.000\n00:00:01.000 --> 00:00:02.500\ns.jpg#xywh=0,90,160,90\n\n00:00:03.000 --> 00:00:04.000\nno cell\n")], "file_id string, t string")
    assert [tuple(r) for r in records.parse_cues(vtt, "t").collect()] == [("x", 1.0, 2.5, 0, 90, 160, 90)]


def _samples(spark):
    rows = [(load, load, T0 + timedelta(seconds=i), float(i) if not (load == 3 and i == 5) else None, load == 2, load == 4 and i == 3, 100.0) for load in (1, 2, 3, 4) for i in range(14)]
    return spark.createDataFrame([r for r in rows if r[0] != 4 or r[2] < T0 + timedelta(seconds=5)], "load_id long, asset_id long, ts timestamp, pos double, paused boolean, eof boolean, duration double")


def test_plays_of_stream_and_batch_agree(spark, tmp_path):
    samples = _samples(spark)
    want = sorted(r.load_id for r in play_events(samples).collect())
    assert want == [1, 3, 4]
    for i, part in enumerate((samples.where(F.col("ts") < F.lit(T0 + timedelta(seconds=6))), samples.where(F.col("ts") >= F.lit(T0 + timedelta(seconds=6))))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        plays = playback.play_event_stream(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
        run = plays.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    assert sorted(r.load_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_loads_of_a_stream_share_calls_and_rows_of_state(spark, tmp_path, monkeypatch):
    """300 loads in two batches take 8 rows of state at most, and give the plays of the batch."""
    monkeypatch.setattr(playback, "BUCKETS", 8, raising=False)
    rows = [(None if load == 7 else load + (1 << 60), None if load == 9 else load, T0 + timedelta(seconds=i), None if load % 11 == i else i * 1.5, load % 13 == 12, load % 17 == i, float(load % 30) if load % 5 else None) for load in range(300) for i in range(6)]
    samples = spark.createDataFrame(rows, "load_id long, asset_id long, ts timestamp, pos double, paused boolean, eof boolean, duration double")
    states = []
    for part in (F.col("ts") < F.lit(T0 + timedelta(seconds=3)), F.col("ts") >= F.lit(T0 + timedelta(seconds=3))):
        samples.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        plays = playback.play_event_stream(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
        run = plays.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        states += [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators]
    got = spark.read.parquet(str(tmp_path / "out"))
    of = lambda df: sorted(((r.load_id, r.asset_id) for r in df.collect()), key=str)
    assert of(got) == of(play_events(samples)) and got.where("ts is null").isEmpty()
    assert 0 < max(states) <= 8


def test_idle_loads_of_a_bucket_go(spark):
    import pandas as pd

    class State:
        hasTimedOut, get, now, until = False, None, 0, None
        exists = property(lambda self: self.get is not None)
        getCurrentWatermarkMs = lambda self: self.now
        update = lambda self, value: setattr(self, "get", value)
        setTimeoutTimestamp = lambda self, ms: setattr(self, "until", ms)
        remove = lambda self: setattr(self, "get", None)

    state, loads = State(), lambda: np.frombuffer(state.get[0], playback._KEPT)["load"].tolist()
    row = lambda load, s, pos: {"load": load, "named": True, "asset": "5", "ts": pd.NaT, "us": s * 1_000_000, "pos": pos, "paused": 0, "eof": False, "duration": 20.0}
    assert not list(playback._watch((0,), iter([pd.DataFrame([row(1, 0, 1.0), row(2, 3600, 1.0)])]), state))
    assert loads() == [1, 2] and state.until == playback.IDLE_MS
    # The first load goes alone, and the second plays on from its last position.
    state.now, state.hasTimedOut = playback.IDLE_MS + 1, True
    assert not list(playback._watch((0,), iter([]), state)) and loads() == [2]
    state.hasTimedOut = False
    (played,) = playback._watch((0,), iter([pd.DataFrame([row(2, 22_000, 3.0), row(1, 22_000, 2.0)])]), state)
    assert played.values.tolist() == [[2, 5, 22_000_000_000]]
    state.now, state.hasTimedOut = 2 * state.until, True
    assert not list(playback._watch((0,), iter([]), state)) and state.get is None


def test_throttle(spark):
    rows = [("r", i, T0 + timedelta(milliseconds=i), i == 99) for i in (*range(10), 99)]
    df = spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, terminal boolean")
    assert sorted(r.seq for r in playback.throttle(df, 200).collect()) == [0, 99]
    assert playback.throttle(df, 0).count() == 11
    assert playback.latest_progress(df).first().seq == 99


def test_cues_are_named_by_their_start(spark):
    cues = spark.createDataFrame([("f", 1.5, 2.25, 160, 90, 160, 90)], "file_id string, start double, end double, x int, y int, w int, h int")
    assert records.write_cues(cues, "s.jpg").first().vtt == "WEBVTT\n\n00:00:01.500\n00:00:01.500 --> 00:00:02.250\ns.jpg#xywh=160,90,160,90\n"


def test_many_roots_meet_by_equality(spark, monkeypatch):
    from catalume.operators import inventory

    paths = ["K:\\reels\\a.mp4", "k:/REELS", "K:\\reels9\\a.mp4", "L:b.mp4", "\\\\store\\films\\x\\c.mp4", "M:\\d.mp4"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    roots = spark.createDataFrame([("K:\\Reels\\",), ("l:",), ("//store/films",)], "path string")
    few = {r.path for r in inventory.under_root(files, roots).collect()}
    monkeypatch.setattr(inventory, "FEW_ROOTS", 0)
    assert {r.path for r in inventory.under_root(files, roots).collect()} == few == {paths[0], paths[1], paths[3], paths[4]}


def test_listed_paths_that_normalise_alike(spark):
    from catalume.operators.inventory import inventory_diff

    listing = spark.createDataFrame([("E:/a", 5, T0), ("E:\\a", 9, T0), ("E:\\b", None, None)], "path string, size long, mtime timestamp")
    files = spark.createDataFrame([("1", "x", "E:\\b", 3, T0)], "id string, asset_id string, path string, size_bytes long, modified_at timestamp")
    got = {r.path: (r.status, r.size) for r in inventory_diff(listing, files).collect()}
    assert got == {"E:\\a": ("added", 9), "E:\\b": ("updated", None)}


def test_a_name_of_most_rows_brings_them_into_no_one_task(spark):
    from pyspark.sql import functions as F

    from catalume.operators import identify as I

    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") < 3900, F.concat(F.lit("n"), "id")).alias("name"))
    named = rows.select("name").distinct().where("name is not null").select("name", F.concat(F.lit("d"), "name").alias("dim_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = I.with_dim(rows, named, I.name_counts(rows))
        assert I.with_dim(rows, named, I.name_counts(rows), "left").count() == 4000
        assert out.count() == 3975 and out.where("dim_id != concat('d', name)").isEmpty()
        hot = out.where("name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in hot) == 3000 and max(r["count"] for r in hot) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_that_many_rows_share_stay_where_they_are_though_unknown(spark):
    from catalume.operators import identify as I

    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 1, "hot").when(F.col("id") % 4 != 2, F.concat(F.lit("n"), "id")).alias("name"))
    named = rows.select("name").distinct().where("name != 'hot'").select("name", F.concat(F.lit("d"), "name").alias("dim_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = I.with_dim(rows, named, I.name_counts(rows), "left")
        assert out.count() == 4000 and out.where("dim_id is distinct from case when name != 'hot' then concat('d', name) end").isEmpty()
        assert I.with_dim(rows, named, I.name_counts(rows)).count() == 2000
        for kind in ("name = 'hot'", "name is null"):
            parts = [r["count"] for r in out.where(kind).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(parts) == 1000 and max(parts) < 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_terms_with_a_word_that_no_record_has_meet_no_record(spark):
    from catalume.operators import identify as I

    terms = spark.createDataFrame([(k, f"order {k}") for k in range(50)] + [(90, "blue sky"), (91, "blue blue sky"), (92, "!")], "asset_id long, term string")
    records = spark.createDataFrame([("r1", "the sky is blue", None), ("r2", "blue", "SKY-1"), ("r3", "order", None), ("r4", None, "7")], "remote_id string, title string, code string")
    none = spark.createDataFrame([(91,)], "asset_id long")
    for few in (I.FEW_WORDS, 0):
        held, I.FEW_WORDS = I.FEW_WORDS, few
        try:
            got = I.title_search_fallback(terms, none, records)
            assert sorted(map(tuple, got.collect())) == [(90, "r1", 2), (90, "r2", 1)]
        finally:
            I.FEW_WORDS = held


def test_names_of_records_are_dealt_out_before_they_are_gathered(spark):
    prints = spark.createDataFrame([("f", "md5", "x")], "file_id string, hash_type string, value string")
    links = spark.createDataFrame([("f", 1)], "file_id string, remote_id long")
    meta = spark.createDataFrame([(1, "one", None, None), (2, None, None, None)], "remote_id long, title string, details string, studio string")
    names = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (3, "c")], "remote_id long, name string")
    out = records.read_foreign_catalog(prints, links, meta, names, names.where("name = 'b'"))[1]
    assert sorted((r.remote_id, r.people, r.tags) for r in out.collect()) == [(1, ["a", "b"], ["b"]), (2, [], [])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("partial_collect_set") < plan.rindex("Exchange")


def test_candidates_are_dealt_out_before_they_are_sorted(spark):
    text = '[[{"id": "a", "title": "one"}], [{"id": "a", "title": "two"}, {"id": "b"}, {"title": "none"}]]'
    out = records.parse_candidates_json(spark.createDataFrame([(1, text), (2, None), (3, text)], "asset_id long, j string"), "j")
    assert sorted((r.asset_id, r.remote_id, r.title) for r in out.collect()) == [(1, "a", "one"), (1, "b", None), (3, "a", "one"), (3, "b", None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("SortAggregate") < plan.rindex("Exchange")
