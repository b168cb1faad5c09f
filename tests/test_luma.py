import numpy as np
from pyspark.sql import functions as F

from offerloom.functions import geometry, luma
from offerloom.operators import frames


def test_percentiles_profiles_and_clipping_equal_numpy(spark):
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, size=(r, c)) for r, c in ((1, 1), (2, 3), (5, 4), (7, 7))]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pictures)] + [(9, []), (10, None)], "i int, luma array<array<int>>")
    told = {r.i: r for r in df.select("i", luma.row_profile(F.col("luma")).alias("p"), luma.brightness(F.col("luma")).alias("b"), luma.clipped_share(F.col("luma")).alias("c"), luma.percentile(F.flatten("luma"), 5).alias("low")).collect()}
    for i, p in enumerate(pictures):
        assert np.allclose(told[i].p, p.mean(axis=1)) and np.isclose(told[i].b, np.percentile(p, 90)) and np.isclose(told[i].low, np.percentile(p, 5)) and np.isclose(told[i].c, (p >= 250).mean())
    assert (told[9].b, told[9].c, told[10].b) == (None, 0.0, None)


def test_banding_is_what_moves(spark):
    card = np.arange(48).reshape(6, 8)
    ripple = lambda k: card + 30 * ((np.arange(6) + k) % 3 == 0)[:, None]
    shots = {1: [card, card, card], 2: [ripple(0), ripple(1), ripple(2)], 3: [card], 4: [ripple(0), ripple(1)[:4]], 5: [None]}
    df = spark.createDataFrame([(s, n, None if p is None else p.tolist()) for s, some in shots.items() for n, p in enumerate(some)], "shot int, nth int, luma array<array<int>>")
    told = {r.shot: r.banding for r in frames.exposure_scores(df, ["shot"]).collect()}
    short = np.abs(ripple(0)[:4].mean(axis=1) - ripple(1)[:4].mean(axis=1)).mean()
    assert told == {1: 0.0, 2: 20.0, 3: 0.0, 4: short}


def test_dark_mode_keeps_its_answer_when_too_close(spark):
    light, dark, close = [0] * 2 + [200] * 17 + [250] * 2, [0] * 2 + [40] * 17 + [250] * 2, [0] * 2 + [126] * 17 + [250] * 2
    rows = [(1, close), (1, dark), (1, close), (1, None), (1, close), (1, light), (1, close), (2, []), (2, dark)]
    df = spark.createDataFrame([(r, i, i, p) for i, (r, p) in enumerate(rows)], "rig int, ord int, seen_ms long, pixels array<int>")
    told = [r.dark for r in frames.dark_mode(df, ["rig"]).orderBy("ord").collect()]
    assert told == [False, True, True, None, True, False, False, None, True]


def test_nearest_centre_prefers_what_holds_it(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [(1, 0, box(300.0, 200.0, 30.0, 60.0)), (1, 1, box(200.0, 100.0, 400.0, 380.0)), (2, 0, box(0.0, 0.0, 50.0, 50.0)), (2, 1, box(500.0, 300.0, 40.0, 40.0)), (3, 0, box(320.0, 240.0, 0.0, 0.0)), (4, 0, None), (5, 0, box(10.0, 10.0, 20.0, 20.0)), (5, 1, box(10.0, 10.0, 20.0, 20.0))]
    df = spark.createDataFrame([(f, n, q, 640.0, 480.0) for f, n, q in rows], "frame int, nth int, quad array<struct<x:double,y:double>>, frame_width double, frame_height double")
    told = {r.frame: r for r in frames.nearest_centre(df, ["frame"]).collect()}
    assert set(told) == {1, 2, 3, 5} and told[1].quad[0].x == 300.0 and told[2].quad[0].x == 500.0 and told[3].score == 1e9 and told[5].candidates == 2
    middle = df.where("frame = 3").select(geometry.area_centre(F.col("quad")).alias("c")).first().c
    assert middle is None
