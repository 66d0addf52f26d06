"""A session from trials and frames to per-cell responses, all trials and cells at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import recursive
from ..operators import raster as R
from ..operators import recurrence
from ..operators import regions as G
from ..operators import traces as T
from ..operators.trials import ranked_within
from ..sources.scratch import materialize


@dataclass(frozen=True)
class Session:
    """Times in ms, rates in Hz; onsets in seconds come with the trials."""

    freq: float
    ipi: float
    n_pulses: float
    pre: float
    post: float
    polarity: str = "1"
    cutoff: float = 40.0
    alpha: float = T.ALPHA
    common_baseline: bool = False
    baseline_end: float = 0.0
    baseline_ms: float = 50.0
    exact_regions: bool = False
    rules: G.Quality = field(default_factory=G.Quality)
    #: Where no bad rows are given: how to find them in each frame, as (first column, last column, mode, parameter).
    bad_rows: tuple[int, int, str, float] | None = None

    def __post_init__(self) -> None:
        if self.polarity not in ("1", "2"):
            raise ValueError("polarity is '1' or '2'")
        if min(self.freq, self.n_pulses) <= 0:
            raise ValueError("the frame rate and the number of pulses are positive")

    @property
    def length(self) -> int:
        return N.response_length(self.freq, self.ipi, self.n_pulses, self.pre, self.post)


def check_cells(rough: DataFrame, rings: DataFrame) -> None:
    """Raises if the rough regions and their surroundings aren't of the same cells."""
    one, two = (df.select("cell").distinct() for df in (rough, rings))
    odd = one.join(two, "cell", "left_anti").unionByName(two.join(one, "cell", "left_anti")).limit(3).collect()
    if odd:
        raise ValueError(f"regions and surroundings differ in cells, among them {sorted(r.cell for r in odd)}")


def extracted(pixels: DataFrame, regions: DataFrame, session: Session, bad_rows: DataFrame | None = None) -> DataFrame:
    """(cell, trial, frame, mean_f): exact pixels without bad rows, or the rectangle of a region's rows and columns."""
    return R.region_mean(pixels, regions, bad_rows=bad_rows) if session.exact_regions or bad_rows is not None else R.rectangle_mean(pixels, regions)


def traces_of(pixels: DataFrame, fine: DataFrame, rings: DataFrame, session: Session, bad_rows: DataFrame | None = None) -> DataFrame:
    """(cell, trial, frame, roi_f, bk_f, corr_f, filt_f) of regions and their surroundings.

    A trace is a cell's in a trial. Traces of up to recursive.LONG frames are filtered as arrays, longer ones by blocks.
    """
    roi = extracted(pixels, fine, session, bad_rows).withColumnRenamed("mean_f", "roi_f")
    around = extracted(pixels, rings, session, bad_rows).withColumnRenamed("mean_f", "bk_f")
    rows = T.corrected(roi.join(around, ["cell", "trial", "frame"], "left"), alpha=session.alpha)
    b, a = recursive.low_pass(4, session.cutoff, session.freq)
    last = pixels.agg(F.max("frame")).first()[0] or 0
    if last > recursive.LONG:
        rows = materialize(rows, "corrected").withColumn("_key", F.struct("cell", "trial"))
        places = rows.select("_key", "frame", F.col("corr_f").alias("v"))
        filt = recurrence.causal(places.withColumn("_key", F.to_json("_key")), b, a, "_key", out="filt_f")
        both = rows.withColumn("_key", F.to_json("_key")).join(filt, ["_key", "frame"])
        return both.select("cell", "trial", "frame", "roi_f", "bk_f", "corr_f", "filt_f")
    point = F.struct("frame", "roi_f", "bk_f", "corr_f")
    arrays = rows.groupBy("cell", "trial").agg(F.array_sort(F.collect_list(point)).alias("p"))
    arrays = arrays.withColumn("filt", recursive.causal(F.col("p.corr_f"), b, a))
    return arrays.select("cell", "trial", F.explode(F.arrays_zip("p", F.col("filt").alias("filt_f"))).alias("x")).select("cell", "trial", "x.p.frame", "x.p.roi_f", "x.p.bk_f", "x.p.corr_f", "x.filt_f")


def responses(traces: DataFrame, stimuli: DataFrame, session: Session) -> DataFrame:
    """(cell, cond, holo, trial, k, f0, dff, filt_dff): windows of kept trials relative to their baselines.

    `stimuli` has (trial, cond, holo, onset, excluded). Excluded trials have a row of NULLs for each k.
    """
    kept = stimuli.where("not excluded")
    points = T.windows(traces.select("cell", "trial", "frame", "corr_f", "filt_f"), kept, session.freq, session.ipi, session.n_pulses, session.pre, session.post)
    if session.common_baseline:
        end = max(1, int(session.baseline_end * session.freq))
        base = T.rolling_baseline(traces, ["cell", "trial"], end, min(end, max(2, int(session.baseline_ms / 1000 * session.freq + 0.5))), ("corr_f", "filt_f"))
        out = T.common_baseline_change(points, base.select("cell", "trial", "f0_corr_f", "f0_filt_f"), ["cell", "trial"], session.polarity, "corr_f", "dff")
        out = out.withColumn("filt_dff", N.polarised(F.try_divide(F.col("filt_f") - F.col("f0_filt_f"), F.col("f0_filt_f")), session.polarity)).withColumnRenamed("f0_corr_f", "f0")
    else:
        n = N.pre_length(session.freq, session.pre)
        out = T.relative_change(points, ["cell", "trial", "holo"], n, session.polarity, "corr_f", "dff", "f0")
        out = T.relative_change(out, ["cell", "trial", "holo"], n, session.polarity, "filt_f", "filt_dff", "f0_filt")
    out = out.join(stimuli.select("trial", "holo", "cond").distinct(), ["trial", "holo"]).select("cell", "cond", "holo", "trial", "k", "f0", "dff", "filt_dff")
    lost = T.spine(traces.select("cell").distinct().crossJoin(stimuli.where("excluded").select("cond", "holo", "trial")), session.length)
    null = F.lit(None).cast("double")
    return out.unionByName(lost.select("cell", "cond", "holo", "trial", "k", null.alias("f0"), null.alias("dff"), null.alias("filt_dff")))


def run(pixels: DataFrame, rough: DataFrame, stimuli: DataFrame, session: Session, height: int, width: int, bad_rows: DataFrame | None = None, override: DataFrame | None = None,
        rings: DataFrame | None = None, clean: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All trials of a session: regions, traces, responses, their means and intervals, and those after rejecting trials.

    `rings` are given surroundings (cell, r, c) of the rough regions, by default those in the grand mean image; `clean` mends the pixels that this image is made of.
    """
    if rings is not None:
        check_cells(rough, rings)
    if bad_rows is None and session.bad_rows:
        bad_rows = R.row_artifacts(pixels, *session.bad_rows, groups=("trial", "frame")).where("bad").select("trial", "frame", "r")
    kept = stimuli.where("not excluded").select("trial").distinct()
    if pixels.select("trial").join(kept, "trial", "left_semi").isEmpty():
        raise ValueError("no trial is left for the mean image: none has frames and isn't excluded")
    images = R.trial_images(pixels)
    grand = R.template(R.trial_images(clean(pixels) if clean else pixels, cap=max(1, int(4 * session.freq))).join(kept, "trial", "left_semi"))
    global_rings = G.fine_regions(grand.select("r", "c", "v"), rough, height, width)[1] if rings is None else rings
    fine = materialize(G.trial_fine_regions(images, rough, override=override), "fine")
    around = materialize(G.trial_rings(fine, images, global_rings, height, width), "rings")
    traces = materialize(traces_of(pixels, fine, around, session, bad_rows), "traces")
    out = materialize(responses(traces, stimuli, session), "responses")
    groups = ["cell", "cond", "holo"]
    excl = T.rejected(out, groups)
    return {
        "regions": fine, "rings": around, "traces": traces, "responses": out,
        "means": T.mean_interval(out, [*groups, "k"], "dff", session.polarity), "filtered_means": T.mean_interval(out, [*groups, "k"], "filt_dff", session.polarity),
        "excluded_means": T.mean_interval(excl, [*groups, "k"], "excl_dff", session.polarity),
        "excluded_filtered_means": T.mean_interval(excl, [*groups, "k"], "excl_filt_dff", session.polarity), "rejected": excl,
    }


def snapshot(responses: DataFrame, means: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nested results as two tables, of which no row grows with the number of trials: (cell, cond, holo, trial, f0, dff, filt_dff) with a trial's
    short window as arrays, and (cell, cond, holo, n_cols, mean, ci_lo, ci_hi) with the means' arrays, all in the order of k."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("x")))), lambda p: p["x"]).alias(c)
    trials = responses.groupBy("cell", "cond", "holo", "trial").agg(F.max("f0").alias("f0"), in_order("dff"), in_order("filt_dff"))
    return trials, means.groupBy("cell", "cond", "holo").agg(F.max("n_cols").alias("n_cols"), *[in_order(c) for c in ("mean", "ci_lo", "ci_hi")])


def trace_snapshot(traces: DataFrame, alpha: float = T.ALPHA) -> DataFrame:
    """(cell, trial, roi_f, bk_f, corr_f, sub_scalar): a trial's traces as arrays in the order of frames, and the share of the
    surroundings that was taken off, NULL where no frame is corrected."""
    points = F.array_sort(F.collect_list(F.struct("frame", "roi_f", "bk_f", "corr_f")))
    share = F.when(F.count("corr_f") > 0, F.lit(alpha)).alias("sub_scalar")
    return traces.groupBy("cell", "trial").agg(points.alias("p"), share).select("cell", "trial", *[F.col(f"p.{c}").alias(c) for c in ("roi_f", "bk_f", "corr_f")], "sub_scalar")


def write_snapshot(folder: str, results: dict[str, DataFrame], alpha: float = T.ALPHA) -> None:
    """The results of run() as nested tables, in a folder a cell: trials and means as snapshot() has them, the filtered means, and traces."""
    trials, means = snapshot(results["responses"], results["means"])
    nested = {"trials": trials, "means": means, "filtered_means": snapshot(results["responses"], results["filtered_means"])[1], "traces": trace_snapshot(results["traces"], alpha)}
    for name, rows in nested.items():
        rows.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/{name}")


def sorted_sweeps(sweeps: DataFrame, onsets: DataFrame, excluded: DataFrame, freq: float, cutoff: float, length: int, pre: float) -> DataFrame:
    """(trial, holo, k, flat): each trial's sweep filtered without phase, cut around its onsets, detrended and set to zero
    by the points before the stimulus. Excluded trials have NULLs.

    `sweeps` has (trial, samples array), or (trial, frame, v) for sweeps of any length; `onsets` (trial, holo, onset in seconds), `excluded` the trials.
    """
    kept = sweeps.join(excluded.select("trial").distinct(), "trial", "left_anti")
    b, a = recursive.low_pass(4, cutoff, freq)
    if "samples" in sweeps.columns:
        filtered = kept.select("trial", F.posexplode(recursive.zero_phase(F.col("samples"), b, a)).alias("p", "v")).select("trial", (F.col("p") + 1).cast("long").alias("frame"), "v")
    else:
        filtered = recurrence.zero_phase(kept, b, a, out="filt").withColumnRenamed("filt", "v")
    points = T.padded_windows(filtered, onsets, length, freq, pre)
    return T.detrended(points, ["trial", "holo"], max(1, int(pre / 1000 * freq + 0.5) - 1), freq)


def condition_sweeps(sweeps: DataFrame, trials: DataFrame, onsets: DataFrame, freq: float, cutoff: float, ipi: float, n_pulses: float, pre: float, post: float) -> dict[str, DataFrame]:
    """Sweeps sorted by condition: `sweeps` has (trial, frame, v), `trials` (trial, cond, excluded), `onsets` (trial, holo, onset).

    Gives "inputs" (cond, place, trial, frame, v): whole sweeps, a condition's trials in their order, excluded ones too; and "windows"
    (cond, holo, place, trial, k, flat): those cut around the stimuli, all of one length, the smallest that the kept trials' sweeps
    have (traces.window_lengths). Excluded trials have windows of NULLs.
    """
    size = sweeps.join(trials.where("not excluded").select("trial"), "trial", "left_semi").groupBy("trial").agg(F.max("frame").alias("n"))
    length = T.window_lengths(size, onsets.join(trials.select("trial"), "trial", "left_semi"), freq, ipi, n_pulses, pre, post).first().used
    flat = sorted_sweeps(sweeps, onsets, trials.where("excluded").select("trial"), freq, cutoff, length, pre)
    place = materialize(ranked_within(trials.select("cond", "trial").distinct(), ["cond"], ["trial"], "place"), "places")
    return {"inputs": sweeps.join(place, "trial").select("cond", "place", "trial", "frame", "v"), "windows": flat.join(place, "trial").select("cond", "holo", "place", "trial", "k", "flat")}


def bootstrap_regions(image: DataFrame, labels: DataFrame, rules: G.Quality, height: int, width: int) -> dict[str, DataFrame]:
    """Rough regions of one image's label raster (r, c, label), their fine regions and surroundings in the image (r, c, v), and the report.

    An image without a finite pixel, one without a label and one whose labels are all rejected are errors; the last names why.
    """
    clean = R.sanitised(image.withColumn("img", F.lit(0).cast("long")))
    raster = labels.join(clean, ["r", "c"]).select("img", "r", "c", "label", F.col("v").alias("intensity"))
    rough, report = G.rough_regions(raster, rules, height, width)
    if rough.isEmpty():
        told = report.orderBy("label").limit(20).collect()
        raise ValueError("no label was found" if not told else "all labels were rejected:\n" + "\n".join(f"  label {r.label}: {r.reject_reason}" for r in told))
    fine, rings = G.fine_regions(image, rough, height, width)
    return {"rough": rough, "fine": fine, "rings": rings, "report": report}
