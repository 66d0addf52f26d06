"""Operators on traces, groups and images that no task holds, against plain versions, whatever the size of blocks, tiles and passes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import recursive
from trialweave.operators import graphs, raster, recurrence, regions, selection, tiles, traces
from trialweave.plans import session
from trialweave.sources import bindings as B

DATA = "/root/testdata/sf0.001"
LOW = recursive.low_pass(4, 40.0, 500.0)


def plain_filter(x, b, a, z):
    y, z = [], [*z, 0.0]
    for v in x:
        y.append(b[0] * v + z[0])
        z = [z[k + 1] + b[k + 1] * v - a[k + 1] * y[-1] for k in range(len(a) - 1)] + [0.0]
    return y


def plain_zero_phase(x, b, a):
    pad = 3 * (len(a) - 1)
    if len(x) <= pad:
        return [None] * len(x)
    ext = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    unit = recursive.steady_state(b, a)
    for _ in range(2):
        ext = plain_filter(ext, b, a, [s * ext[0] for s in unit])[::-1]
    return ext[pad:-pad]


def rows_of(trials):
    return [(t, k + 1, v) for t, x in trials.items() for k, v in enumerate(x)]


@pytest.mark.parametrize("size,fan", [(13, 2), (64, 3), (1024, 256)])
def test_block_scan_equals_a_fold(spark, size, fan):
    rng = random.Random(size)
    trials = {f"t{n}": [rng.random() * 10 + 5 for _ in range(n)] for n in (1, 12, 13, 14, 64, 65, 500)}
    df = spark.createDataFrame(rows_of(trials), "trial string, frame long, v double").repartition(5)
    one = {(r.trial, r.frame): r.y for r in recurrence.causal(df, *LOW, size=size, fan=fan).collect()}
    two = {(r.trial, r.frame): r.y for r in recurrence.zero_phase(df, *LOW, size=size, fan=fan).collect()}
    assert len(one) == len(two) == df.count()
    for t, x in trials.items():
        assert np.allclose([one[t, k + 1] for k in range(len(x))], plain_filter(x, *LOW, [0.0] * 4), rtol=0, atol=1e-9)
        want = plain_zero_phase(x, *LOW)
        got = [two[t, k + 1] for k in range(len(x))]
        assert got == want if want[0] is None else np.allclose(got, want, rtol=0, atol=1e-9)


def test_block_scan_of_missing_samples(spark):
    df = spark.createDataFrame(rows_of({1: [1.0] * 40 + [None] + [1.0] * 60, 2: [2.0] * 30}), "trial long, frame long, v double")
    got = {(r.trial, r.frame): r.y for r in recurrence.causal(df, *LOW, size=16, fan=2).collect()}
    assert all((got[1, k] is None) == (k > 40) for k in range(1, 102)) and all(got[2, k] is not None for k in range(1, 31))
    assert recurrence.causal(df.limit(0), *LOW).collect() == [] and recurrence.zero_phase(df.limit(0), *LOW).collect() == []


def test_a_long_trace_stays_in_blocks(spark):
    df = spark.range(1, 100_001).select(F.lit(1).cast("long").alias("trial"), F.col("id").alias("frame"), F.sin(F.col("id") / 50).alias("v"))
    parts = recurrence.blocks(df, "trial", "frame", "v")
    assert parts.agg(F.max(F.size("xs"))).first()[0] == recurrence.BLOCK and parts.count() == math.ceil(100_000 / recurrence.BLOCK)
    got = [r.y for r in recurrence.zero_phase(df, *LOW, fan=8).orderBy("frame").collect()]
    assert np.allclose(got, plain_zero_phase([math.sin(k / 50) for k in range(1, 100_001)], *LOW), rtol=0, atol=1e-8)


def test_sessions_take_long_traces(spark, monkeypatch):
    s = session.Session(freq=100.0, ipi=10.0, n_pulses=1.0, pre=30.0, post=-30.0, cutoff=10.0)
    pixels = spark.range(60).select((F.col("id") % 2).alias("trial"), (F.floor(F.col("id") / 2) + 1).alias("frame"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.rand(3).alias("v"))
    cells = spark.createDataFrame([(1, 0, 0)], "cell long, r long, c long")
    want = sorted(session.traces_of(pixels, cells, cells, s).collect())
    monkeypatch.setattr(recursive, "LONG", 10)
    got = sorted(session.traces_of(pixels, cells, cells, s).collect())
    assert [r[:6] for r in got] == [r[:6] for r in want] and np.allclose([r.filt_f for r in got], [r.filt_f for r in want])
    rows = B.traces(spark, DATA).select("trial", "frame", "v")
    onsets = rows.select("trial").distinct().select("trial", F.lit(1).alias("holo"), F.lit(0.066).alias("onset"))
    none = rows.where("false")
    a, b = (sorted(session.sorted_sweeps(x, onsets, none, 500.0, 120.0, 32, 34.0).collect()) for x in (B.trace_arrays(spark, DATA), rows))
    assert [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r.flat for r in a], [r.flat for r in b])


@pytest.mark.parametrize("fit,steps", [(20, 8), (300, 256)])
def test_selection_equals_sorting(spark, fit, steps):
    rng = random.Random(fit)
    groups = {"ties": [1.0] * 500 + [2.0] * 500 + [3.0], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)], "even": list(range(1501)), "small": [4.0, 1.0], "one": [7.0], "same": [5.0] * 900}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, value double").repartition(4)
    want = [(g, k, sorted(x)[k - 1]) for g, x in groups.items() for k in sorted({1, len(x), len(x) // 2 or 1, len(x) // 3 + 1})]
    asked = spark.createDataFrame([(g, k, len(groups[g])) for g, k, _ in want], "g string, rank long, n long")
    got = sorted(tuple(r) for r in selection.ranked_values(df, asked, ["g"], fit, steps).collect())
    assert got == sorted(want)
    p = {"p1": 1, "p50": 50, "p99": 99}
    a = sorted(map(tuple, selection.percentiles(df, ["g"], "value", p, fit).collect()))
    b = sorted(map(tuple, raster.percentiles(df, ["g"], "value", p).collect()))
    assert a == b


def test_deviations_equal_the_windows(spark):
    df = B.stored(spark, DATA, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("double")).alias("v"))
    want = traces.deviation_outliers(df, ["l_returnflag"]).select("l_returnflag", "med", "mad").distinct()
    assert sorted(map(tuple, selection.deviations(df, ["l_returnflag"], fit=100).collect())) == sorted(map(tuple, want.collect()))


def image(spark, height, width, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, r, c, float(rng.normal())) for i in range(2) for r in range(height) for c in range(width)], "img long, r long, c long, v double")


@pytest.mark.parametrize("side", [5, 16, 100])
def test_tiles_equal_whole_images(spark, side):
    pixels = image(spark, 23, 31, side)
    close = lambda a, b, *cols: np.allclose([[r[c] for c in cols] for r in a.orderBy("img", "r", "c").collect()], [[r[c] for c in cols] for r in b.orderBy("img", "r", "c").collect()], atol=1e-12)
    assert close(tiles.ridge(pixels, 0.5, (4, 6), side=side), raster.ridge(pixels, 0.5, (4, 6)), "img", "r", "c", "v", "ridge")
    assert close(tiles.normalised(pixels, side=side, fit=50), raster.normalised(pixels), "img", "r", "c", "filt", "norm")
    eig = lambda p: raster.hessian(raster.blurred(p, {"g": (1.0, 3)}, key="tile"), {"g": 1.0}, "tile")
    assert close(tiles.tiled(pixels, eig, 5, side), raster.hessian(raster.blurred(pixels, {"g": (1.0, 3)}), {"g": 1.0}), "img", "r", "c", "g_l1", "g_l2")


@pytest.mark.parametrize("side,small,connectivity,least", [(1, 10**6, 8, 9), (4, 0, 8, 9), (4, 0, 4, 3), (7, 3, 4, 9), (64, 0, 8, 2)])
def test_components_of_tiles(spark, side, small, connectivity, least):
    mask = image(spark, 26, 19, 11).where("v > 0.1").select("img", "r", "c")
    want = sorted(map(tuple, raster.area_opened(mask, least, connectivity=connectivity).collect()))
    assert sorted(map(tuple, tiles.area_opened(mask, least, side, connectivity=connectivity, small=small).collect())) == want


def test_components_of_nothing(spark):
    assert tiles.area_opened(spark.createDataFrame([], "img long, r long, c long"), 2, 8).collect() == []


def test_components_of_graphs(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, two = (sorted(map(tuple, graphs.components(df, small).collect())) for small in (10**6, 0))
    assert one == two and dict(one)[159] == 100 and dict(one)[559] == 500


def plain_separation(rows, separation):
    out = []
    for _, label, r, c, it in sorted(rows, key=lambda x: (-x[4], x[1])):
        if all((r - y[2]) ** 2 + (c - y[3]) ** 2 >= separation**2 for y in out):
            out.append((0, label, r, c, it))
    return sorted(x[1] for x in out)


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_peeling_equals_the_greedy_choice(spark, small):
    rng = random.Random(9)
    rows = [(0, k, rng.random() * 40, rng.random() * 40, float(rng.randrange(30))) for k in range(300)] + [(0, 1000 + k, 3.0 * k, 100.0, float(-k)) for k in range(40)]
    df = spark.createDataFrame(rows, "img long, label long, centroid_r double, centroid_c double, intensity double")
    assert sorted(r.label for r in regions.separated(df, 3.5, small).collect()) == plain_separation(rows, 3.5)
    assert regions.separated(df.limit(1), 3.5, small).count() == 1 and regions.separated(df.limit(0), 3.5, small).count() == 0


def test_windows_join_by_buckets(spark):
    points = spark.range(1, 2001).select(F.lit(1).cast("long").alias("trial"), F.col("id").alias("frame"), F.col("id").cast("double").alias("v"))
    onsets = spark.range(-3, 2010).select(F.lit(1).cast("long").alias("trial"), F.col("id").alias("holo"), F.col("id").cast("double").alias("onset"))
    got = traces.windows(points, onsets, 1.0, 1000.0, 2.0, 3000.0, 4000.0)
    want = sorted((o, f - o + 4, float(f)) for o in range(-3, 2010) for f in range(o - 3, o + 7) if 1 <= f <= 2000)
    assert sorted(map(tuple, got.select("holo", "k", "v").collect())) == want
