"""Rules of the trial, raster and region operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import raster as R
from trialweave.operators import regions as G
from trialweave.operators import traces as T
from trialweave.operators import trials as TR


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_interval_counts_missing_columns(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, None), (2, 1, 5.0)], "g int, trial int, dff double")
    got = {r.g: r for r in T.mean_interval(df, ["g"]).collect()}
    sd = np.std([2, 4], ddof=1)
    half = sd / np.sqrt(3) * 4.302652729911275
    assert got[1].n_cols == 3 and got[1].hi == pytest.approx(3 + half) and got[1].ci_lo == pytest.approx(-(3 - half))
    assert got[2].sd == 0 and got[2].lo is None


def test_rejection(spark):
    def trial(t, values, filt=None):
        return [("a", t, k + 1, v, f) for k, (v, f) in enumerate(zip(values, filt or values))]

    flat = [0.1, -0.1] * 25
    late = flat[:45] + [9.0] + flat[46:]
    early = flat[:44] + [9.0] + flat[45:]
    low = [-30.0] + flat[1:]
    schema = "g string, trial int, k int, dff double, filt_dff double"
    data = trial(1, flat) + trial(2, late) + trial(3, early) + trial(4, low)
    got = T.rejected(spark.createDataFrame(data, schema), ["g"]).groupBy("trial").agg(F.count("excl_dff").alias("n"))
    assert rows(got, "trial", "n") == [(1, 50), (2, 0), (3, 50), (4, 0)]
    # one missing value turns the amplitude rule off, and in the filtered column the late rule too
    data[0] = ("a", 1, 1, None, None)
    got = T.rejected(spark.createDataFrame(data, schema), ["g"]).groupBy("trial").agg(F.count("excl_dff").alias("n"))
    assert rows(got, "trial", "n") == [(1, 49), (2, 0), (3, 50), (4, 50)]


def test_rolling_baseline_takes_the_first_of_equal_windows(spark):
    df = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate([5.0, 1.0, 1.0, 3.0, 2.0, 2.0])] + [(2, 1, 7.0)], "trial int, frame int, v double")
    got = {r.trial: (r.start, r.f0_v) for r in T.rolling_baseline(df, ["trial"], 6, 2).collect()}
    assert got[1] == (2, 1.0) and got[2] == (None, 7.0)


def test_windows_at_the_edges(spark):
    t = spark.createDataFrame([(1, k, float(k)) for k in range(1, 11)], "trial int, frame int, v double")
    onsets = spark.createDataFrame([(1, 1, 1.0), (1, 2, 9.0)], "trial int, holo int, onset double")
    cut = T.windows(t, onsets, 1.0, 0.0, 1.0, 2000.0, 2000.0)
    assert rows(cut, "holo", "k", "v") == [(1, 3, 1.0), (1, 4, 2.0), (1, 5, 3.0), (2, 1, 7.0), (2, 2, 8.0), (2, 3, 9.0), (2, 4, 10.0)]
    padded = T.padded_windows(t, onsets.where("holo = 1"), 3, 1.0, 2000.0)
    assert [r.v for r in padded.orderBy("k").collect()] == [None, None, 1.0]


def test_holo_ids(spark):
    df = spark.createDataFrame([(1, [5.0, 3.0, 5.0, 4.0], [1.0]), (2, [], [7.0, 6.0]), (3, None, [])], "trial int, seq array<double>, dummy array<double>")
    assert rows(TR.holo_ids_of_arrays(df), "trial", "position", "holo") == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1)]


def test_priority_and_sampling(spark):
    a, b = spark.createDataFrame([(1, "a")], "cell int, x string"), spark.createDataFrame([(1, "b"), (2, "b")], "cell int, x string")
    assert rows(TR.preferred([a, b], ["cell"]), "cell", "x") == [(1, "a"), (2, "b")]
    trials = spark.range(100).select(F.col("id").alias("trial"), F.lit(False).alias("excluded"))
    assert [r.trial for r in TR.evenly_spaced(trials, 4).orderBy("trial").collect()] == [0, 33, 66, 99]
    assert TR.eligible(trials, 0, 9, 0.5).count() == 5
    drawn = [{r.trial for r in TR.eligible(t, 0, 9, 0.5, seed).collect()} for t, seed in ((trials, 1), (trials.repartition(5), 1), (trials.coalesce(1), 1), (trials, 2))]
    assert drawn[0] == drawn[1] == drawn[2] != drawn[3] and {len(d) for d in drawn} == {5}


def image(spark, a, img=0):
    return spark.createDataFrame([(img, r, c, float(v)) for (r, c), v in np.ndenumerate(a)], "img long, r long, c long, v double")


def test_blur_and_ridge_match_numpy(spark):
    a = np.random.default_rng(2).normal(size=(9, 11))

    def along(x, w, axis, mode):
        h = len(w) // 2
        p = np.pad(x, [(h, h) if k == axis else (0, 0) for k in (0, 1)], mode)
        return sum(wk * np.take(p, range(k, k + x.shape[axis]), axis) for k, wk in enumerate(w))

    k = R.kernel(1.0, 3)
    want = along(along(a, k, 1, "edge"), k, 0, "edge")
    got = {(r.r, r.c): r.g for r in R.blurred(image(spark, a), {"g": (1.0, 3)}).collect()}
    assert np.allclose([[got[r, c] for c in range(11)] for r in range(9)], want)
    g = want
    xx, yy = along(g, R.SECOND, 1, "symmetric"), along(g, R.SECOND, 0, "symmetric")
    xy = along(along(g, R.FIRST, 1, "symmetric"), R.FIRST, 0, "symmetric")
    root = np.sqrt((xx - yy) ** 2 + 4 * xy**2)
    m = np.stack([0.5 * (xx + yy + root), 0.5 * (xx + yy - root)])
    l2 = np.where(abs(m[0]) > abs(m[1]), m[0], m[1])
    got = {(r.r, r.c): r.g_l2 for r in R.hessian(R.blurred(image(spark, a), {"g": (1.0, 3)}), {"g": 1.0}).collect()}
    assert np.allclose([[got[r, c] for c in range(11)] for r in range(9)], l2)


@pytest.mark.parametrize("radius,n", [(2, 13), (3, 25), (5, 69)])
def test_disks(spark, radius, n):
    dot = spark.createDataFrame([(0, 20, 20)], "img long, r long, c long")
    assert R.dilated(dot, radius, 64, 64).count() == n == len(R.disk(radius))


def components_by_search(mask, connectivity):
    left, out = set(mask), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            p = todo.pop()
            own.add(p)
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    q = (p[0] + dr, p[1] + dc)
                    if q in left and (connectivity == 8 or not dr or not dc):
                        left.discard(q)
                        todo.append(q)
        out.append(own)
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_area_open(spark, connectivity):
    rng = np.random.default_rng(3)
    masks = [{(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((20, 23)) < p))} for p in (0.2, 0.4, 0.6)]
    df = spark.createDataFrame([(i, r, c) for i, m in enumerate(masks) for r, c in m], "img long, r long, c long")
    want = sorted((i, *p) for i, m in enumerate(masks) for own in components_by_search(m, connectivity) if len(own) >= 7 for p in own)
    assert rows(R.area_opened(df, 7, connectivity=connectivity), "img", "r", "c") == want


def test_ring(spark):
    a = np.random.default_rng(4).random((40, 40))
    seed = {(20, 20), (20, 21), (3, 38)}
    near = lambda radius: {(r + a, c + b) for r, c in seed for a, b in R.disk(radius) if 0 <= r + a < 40 and 0 <= c + b < 40}
    raw = near(5) - near(2)
    v = sorted(a[p] for p in raw)
    h = min(max(1.0, len(v) * 0.95 + 0.5), len(v))
    cut = v[int(h) - 1] + (h - int(h)) * (v[min(int(h), len(v) - 1)] - v[int(h) - 1])
    clean = {p for own in components_by_search({p for p in raw if a[p] <= cut}, 8) if len(own) >= 7 for p in own}
    mask = spark.createDataFrame([(0, *p) for p in seed], "img long, r long, c long")
    assert rows(R.ring(mask, image(spark, a), 40, 40), "r", "c") == sorted(clean)
    assert rows(R.ring(mask, image(spark, a), 40, 40, least=10_000), "r", "c") == sorted(raw)


def test_artifact_rows(spark):
    a = np.ones((6, 8))
    a[2] = [0, 50] * 4
    a[4] = [np.nan] * 8
    df = image(spark, a).withColumn("v", F.nullif("v", F.lit(float("nan"))))
    found = R.row_artifacts(df, 0, 7, "fixed", 5.0)
    assert [r.r for r in found.where("bad").collect()] == [2]
    filled = R.artifacts_filled(df, found)
    assert {r.v for r in filled.where("r = 2").collect()} == {1.0}
    assert {r.v for r in R.artifacts_filled(df, found, fill=False).where("r = 2").collect()} == {None}
    with pytest.raises(ValueError):
        R.row_artifacts(df, 5, 4, "mad", 1.0)


def test_rescaling(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, float("nan")), (0, float("inf")), (1, 3.0), (1, 3.0)], "img long, v double")
    assert sorted((r.img, r.u) for r in R.rescaled(df).collect()) == [(0, 0), (0, 0), (0, 0), (0, 65535), (1, 0), (1, 0)]


def test_rectangle_weights_repeats(spark):
    a = np.arange(9.0).reshape(3, 3)
    px = image(spark, a).select(F.col("img").alias("trial"), F.lit(1).alias("frame"), "r", "c", "v")
    roi = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1)], "cell long, r long, c long")
    block = a[np.ix_([0, 0, 1], [0, 1, 1])]
    assert R.rectangle_mean(px, roi).first().mean_f == pytest.approx(block.mean())
    assert R.region_mean(px, roi).first().mean_f == pytest.approx(np.mean([0, 1, 4]))


#: Recorded regions of one image: label, area, centroid row and column, mean intensity; and the order of the accepted ones.
RECORDED = [
    (1, 404, 8.180693069306932, 185.14356435643563, 210.24849025772806), (2, 382, 7.392670157068062, 255.6020942408377, 257.81630414064784),
    (3, 172, 6.813953488372093, 386.3779069767442, 179.05837180763754), (4, 402, 13.41044776119403, 125.41791044776119, 227.62280937580235),
    (5, 423, 13.328605200945626, 33.6548463356974, 172.2372236664795), (6, 447, 13.557046979865772, 212.248322147651, 295.17495660237324),
    (7, 176, 14.227272727272727, 153.54545454545453, 167.74906468221357), (8, 263, 16.79467680608365, 293.9239543726236, 175.2997608634009),
    (9, 455, 23.246153846153845, 251.55384615384617, 311.5221687928278), (10, 67, 17.19402985074627, 345.2835820895522, 168.1519129103826),
    (11, 426, 26.023474178403756, 275.2863849765258, 258.8260241212497), (12, 122, 29.852459016393443, 320.5409836065574, 162.45626839136264),
    (13, 619, 41.44749596122779, 107.97253634894992, 223.26084234656494), (14, 438, 40.529680365296805, 219.05251141552512, 231.74660876912907),
    (15, 385, 42.23116883116883, 193.65454545454546, 259.85508084972275), (16, 462, 44.03030303030303, 262.05627705627705, 302.96428911326615),
    (17, 122, 48.057377049180324, 296.3360655737705, 224.9539664917185), (18, 387, 54.23514211886305, 281.41602067183464, 245.75135077439913),
    (19, 225, 56.266666666666666, 395.0622222222222, 153.340669056793), (20, 334, 57.10179640718563, 154.67664670658684, 297.6899597051296),
]


def test_recorded_regions(spark):
    df = spark.createDataFrame([(0, *r) for r in RECORDED], "img long, label long, area long, centroid_r double, centroid_c double, intensity double")
    judged = G.judged(df, G.Quality())
    assert {r.label: r.reject_reason for r in judged.where("reject_reason is not null").collect()} == {10: "area 67 < minAreaPx 150", 12: "area 122 < minAreaPx 150", 17: "area 122 < minAreaPx 150"}
    kept = G.numbered(G.separated(judged.where("reject_reason is null"), 15.0))
    assert [r.label for r in kept.orderBy("cell").collect()] == [3, 2, 1, 5, 4, 6, 7, 8, 9, 11, 14, 13, 15, 16, 18, 19, 20]
    two = G.numbered(G.separated(judged.where("reject_reason is null"), 15.0), 2)
    assert [r.label for r in two.orderBy("cell").collect()] == [9, 16]


def test_fine_regions_fall_back_to_rough_ones(spark):
    flat = image(spark, np.zeros((20, 20))).select("r", "c", "v")
    rough = spark.createDataFrame([(1, r, c) for r in range(5, 9) for c in range(5, 9)], "cell long, r long, c long")
    fine, around = G.fine_regions(flat, rough, 20, 20)
    assert fine.count() == 16 and around.count() == 0
    line = np.zeros((30, 30))
    line[15, 5:25] = 1.0
    rough = spark.createDataFrame([(1, r, c) for r in range(10, 21) for c in range(5, 25)], "cell long, r long, c long")
    fine, _ = G.fine_regions(image(spark, line).select("r", "c", "v"), rough, 30, 30, 0.1)
    found = {r.r for r in fine.collect()}
    assert 15 in found and found <= {13, 14, 15, 16, 17}
