"""Stored recordings and whole-session plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import raster
from trialweave.operators.regions import Quality
from trialweave.plans import session as S
from trialweave.sources import records


def test_stacks_and_regions(spark, tmp_path):
    rows = spark.createDataFrame([(1, f, r, [float(f), float(r)]) for f in range(4) for r in range(2)], "trial long, frame long, r long, px array<double>")
    rows.write.parquet(str(tmp_path / "stack"))
    px = records.read_stack(spark, str(tmp_path / "stack"), keep_even_pages=True)
    assert sorted({(r.frame, r.v) for r in px.where("c = 0").collect()}) == [(0, 0.0), (1, 2.0)]
    assert sorted(map(str, records.rows_of_pixels(records.pixels_of_rows(rows)).select("trial", "frame", "r", "px").collect())) == sorted(map(str, rows.collect()))
    records.write_stack(px, str(tmp_path / "out"))
    assert sorted({r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}) == [0, 32768, 65535]
    records.save_regions(spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 1, 1)], "cell long, r long, c long"), str(tmp_path / "roi.parquet"), base=1)
    assert [(r.r, r.c) for r in records.load_regions(spark, str(tmp_path / "roi.parquet")).orderBy("k").collect()] == [(0, 0), (1, 0), (0, 1)]
    folder = tmp_path / "records"
    folder.mkdir()
    for name in ("a_1.rec", "a_3.rec", "a_2.rec"):
        (folder / name).write_text("x")
    assert records.latest_path(spark, str(folder), "*.rec").endswith("a_3.rec") and records.latest_path(spark, str(folder), "*.none") is None
    lists = spark.createDataFrame([(1, [2, 1, 1], [1, 2, 1]), (2, [], []), (3, None, None)], "cell long, x array<int>, y array<int>")
    assert [(r.cell, r.r, r.c, r.k) for r in records.zipped_regions(lists).orderBy("k").collect()] == [(1, 0, 0, 1), (1, 1, 0, 2), (1, 0, 1, 3)]
    with pytest.raises(Exception, match="differ in number in cell 4"):
        records.zipped_regions(spark.createDataFrame([(4, [1], [1, 2])], lists.schema)).collect()
    nested = spark.createDataFrame([(1, [[1.0, 2.0], [], None])], "cell long, m array<array<double>>")
    assert sorted(((r.trial, r.frame or 0, r.v or 0) for r in records.trace_points(nested, "m").collect())) == [(1, 1, 1.0), (1, 2, 2.0), (2, 0, 0), (3, 0, 0)]


@pytest.mark.parametrize("common", [False, True])
def test_responses_match_numpy(spark, common):
    s = S.Session(freq=100.0, ipi=10.0, n_pulses=1.0, pre=50.0, post=30.0, polarity="2", common_baseline=common, baseline_end=0.08, baseline_ms=30.0)
    rng = np.random.default_rng(1)
    x = {t: 2 + rng.random(30) for t in (1, 2, 3)}
    traces = spark.createDataFrame([(7, t, k + 1, float(v), float(v) + 1) for t, a in x.items() for k, v in enumerate(a)], "cell long, trial long, frame long, corr_f double, filt_f double")
    stimuli = spark.createDataFrame([(t, 1, 1, 0.105, t == 3) for t in x], "trial long, cond long, holo long, onset double, excluded boolean")
    got = {(r.trial, r.k): (r.dff, r.filt_dff) for r in S.responses(traces, stimuli, s).collect()}
    lo, hi, pre = 5, 6 + 9, 4
    for t in (1, 2):
        for shift, which in ((0, 0), (1, 1)):
            seg = x[t][lo - 1 : hi] + shift
            if common:
                start = int(np.argmin([np.var(x[t][k : k + 3]) for k in range(6)]))
                f0 = x[t][start : start + 3].mean() + shift
            else:
                f0 = seg[:pre].mean()
            assert [got[t, k + 1][which] for k in range(len(seg))] == pytest.approx((-(seg - f0) / f0).tolist())
    assert [k for t, k in sorted(got) if t == 3] == list(range(1, s.length + 1)) and all(v == (None, None) for (t, _), v in got.items() if t == 3)
    with pytest.raises(ValueError):
        S.Session(freq=100.0, ipi=1.0, n_pulses=1.0, pre=1.0, post=1.0, polarity="3")


def test_sorted_sweeps(spark):
    t = np.arange(60) / 100
    sweeps = spark.createDataFrame([(1, (3 + 2 * t).tolist()), (2, t.tolist())], "trial long, samples array<double>")
    onsets = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.3)], "trial long, holo long, onset double")
    got = S.sorted_sweeps(sweeps, onsets, spark.createDataFrame([(2,)], "trial long"), 100.0, 20.0, 20, 100.0).orderBy("trial", "k").collect()
    # a line passes the filter, and detrending leaves nothing of it
    assert [r.flat for r in got if r.trial == 1] == pytest.approx([0.0] * 20, abs=1e-6)
    assert [r.flat for r in got if r.trial == 2] == [None] * 20


def test_bootstrap(spark):
    grid = spark.range(40).select(F.col("id").alias("r")).crossJoin(spark.range(40).select(F.col("id").alias("c")))
    image = grid.withColumn("v", F.when(F.col("r").between(10, 12) & F.col("c").between(5, 30), 1.0).otherwise(0.1))
    labels = grid.withColumn("label", F.when(F.col("r").between(8, 14) & F.col("c").between(5, 30), 1).otherwise(0).cast("long"))
    got = S.bootstrap_regions(image, labels, Quality(min_area=50, dilation=2), 40, 40)
    assert got["rough"].count() > 7 * 26 and {r.cell for r in got["fine"].collect()} == {1} and got["report"].first().reject_reason is None


def test_run_and_its_snapshot(spark, tmp_path):
    """Given surroundings, bad rows found in each frame, pixels mended for the grand mean; the nested tables hold what run() gives."""
    session = S.Session(freq=100.0, ipi=10.0, n_pulses=1.0, pre=30.0, post=-30.0, cutoff=10.0, bad_rows=(0, 29, "fixed", 50.0), alpha=0.5)
    grid = spark.range(30).select(F.col("id").alias("r")).crossJoin(spark.range(30).select(F.col("id").alias("c")))
    inside = F.col("r").between(12, 16) & F.col("c").between(5, 20)
    times = spark.createDataFrame([(t, f) for t in (1, 2, 3) for f in range(1, 6)], "trial long, frame long")
    noise = F.when(F.col("r") == 14, F.when(F.col("c") % 2 == 0, 500.0).otherwise(0.0))
    pixels = grid.crossJoin(times).withColumn("v", F.coalesce(noise, F.when(inside, 4.0 + F.col("frame")).otherwise(1.0)))
    rough = grid.where(inside).withColumn("cell", F.lit(1).cast("long"))
    rings = grid.where(F.col("r").between(22, 26)).withColumn("cell", F.lit(1).cast("long"))
    stimuli = spark.createDataFrame([(t, 1, 1, 0.05, t == 3) for t in (1, 2, 3)], "trial long, cond long, holo long, onset double, excluded boolean")
    override = rough.select("cell", "r", "c")
    mended = []
    got = S.run(pixels, rough, stimuli, session, 30, 30, override=override, rings=rings, clean=lambda p: mended.append(1) or p.where("r <> 14"))
    traces = got["traces"].orderBy("trial", "frame").collect()
    assert mended and [r.roi_f for r in traces] == pytest.approx([4.0 + r.frame for r in traces])  # the noisy row isn't counted
    assert {r.bk_f for r in traces} == {1.0} and [r.corr_f for r in traces] == pytest.approx([3.5 + r.frame for r in traces])
    assert got["excluded_filtered_means"].count() == got["means"].count() == session.length
    S.write_snapshot(str(tmp_path), got, session.alpha)
    nested = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("trials", "means", "filtered_means", "traces")}
    assert {(r.trial, len(r.roi_f), r.sub_scalar) for r in nested["traces"].collect()} == {(t, 5, 0.5) for t in (1, 2, 3)}
    want = {r.k: r.dff for r in got["responses"].where("trial = 2").collect()}
    assert [r.dff for r in nested["trials"].where("trial = 2").collect()] == [[want[k] for k in sorted(want)]]
    want = {r.k: r.mean for r in got["filtered_means"].collect()}
    assert [r["mean"] for r in nested["filtered_means"].collect()] == [[want[k] for k in sorted(want)]]
    with pytest.raises(ValueError, match="differ in cells"):
        S.check_cells(rough, rings.withColumn("cell", F.lit(2).cast("long")))


def test_errors_say_why_nothing_is_left(spark):
    pixels = spark.createDataFrame([(1, 1, 0, 0, 1.0)], "trial long, frame long, r long, c long, v double")
    rough = spark.createDataFrame([(1, 0, 0)], "cell long, r long, c long")
    stimuli = spark.createDataFrame([(1, 1, 1, 0.0, True)], "trial long, cond long, holo long, onset double, excluded boolean")
    s = S.Session(freq=100.0, ipi=10.0, n_pulses=1.0, pre=30.0, post=-30.0)
    with pytest.raises(ValueError, match="no trial is left"):
        S.run(pixels, rough, stimuli, s, 4, 4)
    grid = [(r, c) for r in range(8) for c in range(8)]
    image = spark.createDataFrame([(r, c, float(r + c)) for r, c in grid], "r long, c long, v double")
    labels = spark.createDataFrame([(r, c, 1 if r < 2 and c < 2 else 0) for r, c in grid], "r long, c long, label long")
    with pytest.raises(ValueError, match="(?s)all labels were rejected.*label 1: area 4 < minAreaPx 9"):
        S.bootstrap_regions(image, labels, Quality(min_area=9), 8, 8)
    with pytest.raises(ValueError, match="no label was found"):
        S.bootstrap_regions(image, labels.withColumn("label", F.lit(0).cast("long")), Quality(), 8, 8)
    with pytest.raises(Exception, match="no finite pixel"):
        S.bootstrap_regions(image.withColumn("v", F.lit(float("nan"))), labels, Quality(min_area=1), 8, 8)
    clean = raster.sanitised(spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, float("inf")), (0, 0, 2, None), (0, 0, 3, float("nan"))], "img long, r long, c long, v double"))
    assert [r.v for r in clean.orderBy("c").collect()] == [2.0] * 4


def test_condition_sorted_inputs_keep_all_trials(spark):
    sweeps = spark.createDataFrame([(t, k, float(t * k)) for t in (1, 2, 3, 4) for k in range(1, 41)], "trial long, frame long, v double")
    trials = spark.createDataFrame([(4, 1, False), (2, 1, True), (1, 2, False), (3, 1, False)], "trial long, cond long, excluded boolean")
    onsets = trials.select("trial", F.lit(1).cast("long").alias("holo"), F.lit(0.04).alias("onset"))
    got = S.condition_sweeps(sweeps, trials, onsets, 500.0, 120.0, 5.0, 1.0, 20.0, 60.0)
    places = {(r.cond, r.place): r.trial for r in got["inputs"].select("cond", "place", "trial").distinct().collect()}
    assert places == {(1, 1): 2, (1, 2): 3, (1, 3): 4, (2, 1): 1} and got["inputs"].count() == 160
    windows = got["windows"].collect()
    lengths = {(r.trial, r.holo) for r in windows if r.flat is None}
    assert lengths == {(2, 1)} and {sum(r.trial == t for r in windows) for t in (1, 2, 3, 4)} == {40 - 10 + 1}
