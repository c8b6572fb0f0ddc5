"""Golden values of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalume.functions import hashing as H
from catalume.functions import names as N
from catalume.functions import paths as P
from catalume.functions import plays as Y
from catalume.functions import resolution as R
from catalume.functions.porter import stem
from catalume.functions.tokens import fts_tokens, phrase_match, tokens_of

CASES = [
    (N.normalize_for_match, [("Ada.Byron-Part_07", "ada byron part 07"), ("  ", "")]),
    (N.clean_title, [("Ada Byron - [Kelpwood.com] - [2021] - A Long Walk Home - 4K", "Ada Byron A Long Walk Home"), ("4410", None), ("77120_03_720p", None), ("Deep [one [two] three] Blue Water", "Deep Blue Water"), (None, None)]),
    (N.title_from_path, [(r"H:\Harbour Tales PL\videos\4410.mp4", "Harbour Tales PL - 4410"), (r"H:\videos\07.mp4", None)]),
    (N.identify_term, [("QRST-4410", "QRST-4410"), ("4410", None), ("KLM-007", "KLM-007"), ("Ada Byron", "Ada Byron"), ("Rosalind", "Rosalind"), ("2291", None), ("720P_3500K_118004401", None), ("Ida", None), ("Wilma", None), ("sample", None), ("Export", None), ("", None)]),
    (N.weak_reason, [("", "empty"), ("4410", "id_only"), ("Ida", "vague")]),
    (N.folder_hints, [(r"K:\Sorted\Ada Byron\clips\take.mp4", [("person", "Ada Byron")]), (r"K:\Sorted\Kelpwood\a take.mp4", [("studio", "Kelpwood")])]),
    (N.bracket_studios, [("[Kelpwood] - Ada Byron", ["Kelpwood"]), ("[Solo] y [1280x720] [2021]", []), ("[Reef.com] [reef]", ["Reef"])]),
    (N.path_haystack, [(r"K:\shelf 9\kelpwood.ada.mp4", "shelf 9 kelpwood ada")]),
    (N.pretty_tag, [("uhd", "uhd"), ("hdr", "hdr"), ("1440p", "1440p"), ("3on1", "3on1"), ("540p", "540p"), ("pov", "Pov")]),
    (P.normalize_path, [("K:", "K:\\"), (r"K:Shelf\a.mp4", r"K:\Shelf\a.mp4"), ("K:/Shelf/b.mp4", r"K:\Shelf\b.mp4")]),
    (P.normalize_root, [("D:\\Stock\\", "D:\\Stock"), ("K:", "K:\\")]),
    (P.volume_key, [("k:/one/two.mp4", "K:"), (r"\\store\films\a.mp4", r"\\store\films")]),
    (R.detect_token_height, [("Take 8K.mp4", 4320), ("Reel-480p.mp4", 480), ("Blue Water.mp4", None), ("b 1080p 2k.mp4", 1440)]),
    (R.token_height, [("8K Reels", None), (" qhd ", 1440)]),
    (H.parse_hash64, [("00000000000000ff", 255), (" 0fedcba987654321 ", 0x0FEDCBA987654321), ("zz", None), ("", None), ("fffffffffffffffff", None), ("8000000000000000", -(1 << 63))]),
    (Y.parse_vtt_time, [("02:03:04.250", 7384.25), (" 2:03:04.5 ", 7384.005), ("03:04.250", 0.0), ("x", 0.0), (None, None)]),
]


def apply(spark, f, inputs):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(inputs)], "i int, a string")
    rows = df.select("i", f(F.col("a")).alias("o")).orderBy("i").collect()
    return [[tuple(x) if hasattr(x, "asDict") else x for x in r.o] if isinstance(r.o, list) else r.o for r in rows]


@pytest.mark.parametrize("f,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_golden(spark, f, cases):
    assert apply(spark, f, [a for a, _ in cases]) == [b for _, b in cases]


@pytest.mark.parametrize("mode,given,wanted", [("replace", "Take 8k.mp4", "Take 1080p.mp4"), ("replace", "QHD - Reef.mp4", "1080P - Reef.mp4"), ("replace", "Reel [8k] QHD.mp4", "Reel [1080p] 1080P.mp4"), ("replace", "Wilma1440 - Take.mp4", "Wilma1440 - Take.mp4"), ("remove", "Reef.1440p.CUT.mkv", "Reef CUT.mkv"), ("remove", "Reel-480p.mp4", "Reel.mp4"), ("leave", "B 8K.mp4", "B 8K.mp4")])
def test_rewrite(spark, mode, given, wanted):
    assert apply(spark, lambda c: R.rewrite_resolution(c, mode, 1080), [given]) == [wanted]


def test_hamming_of_extremes(spark):
    a = H.parse_hash64(F.lit("ffffffffffffffff"))
    assert spark.range(1).select(H.hamming(a, F.lit(0).cast("long"))).first()[0] == 64


def test_paths_under_roots(spark):
    for path, root, wanted in [("k:/reels/a.mp4", "K:\\REELS", True), ("K:\\reels9\\a.mp4", "K:\\reels", False), ("K:Shelf\\a.mp4", "K:\\", True), ("L:\\Shelf\\a.mp4", "K:\\", False)]:
        assert spark.range(1).select(P.is_under(F.lit(path), F.lit(root))).first()[0] is wanted


@pytest.mark.parametrize("word,wanted", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, wanted):
    assert stem(word) == wanted


def test_phrase_of_stemmed_tokens(spark):
    df = spark.createDataFrame([("Crème Brûlée recipes",), ("recipe for crème",), (None,)], "t string")
    got = [r.m for r in df.select(phrase_match(fts_tokens(F.col("t")), tokens_of("creme brulees recipe")).alias("m")).collect()]
    assert got == [True, False, False]


def test_perceptual_hash_tells_images_apart(spark):
    import random

    flat = spark.createDataFrame([(None,)], "g array<double>").select(H.perceptual_hash(F.col("g"))).first()[0]
    assert flat is None
    one, other = ([r.random() * 255 for _ in range(4096)] for r in (random.Random(1), random.Random(2)))
    rows = spark.createDataFrame([(0, one), (1, [v + 3 for v in one]), (2, other)], "i int, g array<double>")
    h = {r.i: r.h for r in rows.select("i", H.perceptual_hash(F.col("g")).alias("h")).collect()}
    bits = lambda a, b: bin((h[a] ^ h[b]) & (1 << 64) - 1).count("1")
    assert bits(0, 1) <= 2 and bits(0, 2) > 15


def test_words_of_long_texts_are_found_without_lambdas(spark):
    """A lambda over words, or a pattern that replaces between them, took some microseconds a byte."""
    d = spark.createDataFrame([("[x [y] z] Ada 1080P ab12 2001 Byron] 4000K",), (" ",), (None,)], "s string")
    got = d.select(N.title_text(F.col("s")), N.product_code(F.col("s")), N.clean_title(F.col("s")), N.is_pure_id(F.col("s")))
    assert [tuple(r) for r in got.collect()] == [("Ada ab12 Byron", "AB12", "Ada ab12 Byron", False), (None, None, None, False), (None, None, None, None)]
    plan = d.select(N.clean_title(F.col("s")), N.product_code(F.col("s")), N.is_pure_id(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan


def test_probe_text_is_parsed_once(spark):
    from catalume.sources.media import parse_probe_json

    text = '{"format": {"duration": "2.5", "tags": {"TITLE": " t ", "Artist": " ", "Author": "b", "Description": "c"}}, "streams": [{"codec_type": "video", "width": 3, "avg_frame_rate": "50/2"}]}'
    out = parse_probe_json(spark.createDataFrame([(text,), ("{no json",)], "s string"), "s")
    assert out.columns == ["s", "probe"]
    assert [(r.probe.duration, r.probe.width, r.probe.fps, r.probe.title, r.probe.artist, r.probe.comment) for r in out.collect()] == [(2.5, 3, 25.0, "t", "b", "c"), (None,) * 6]
    assert out.select("probe.*")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
