"""Operators on traces: rows (trial, frame, v) and stimulus windows (trial, k, ...), k counted from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.scratch import sized
from .trials import ranked_within

#: Share of the surrounding signal that is taken off a region's.
ALPHA = 0.85


def corrected(df: DataFrame, signal: str = "roi_f", background: str = "bk_f", alpha: float = ALPHA) -> DataFrame:
    """Adds corr_f: the region's signal less its surrounding's share."""
    return df.withColumn("corr_f", F.col(signal) - alpha * F.col(background))


def windows(traces: DataFrame, onsets: DataFrame, freq: float, ipi: float, n_pulses: float, pre: float, post: float) -> DataFrame:
    """(trial, holo, k, v...) of the frames within each onset's window; windows are cut at the trace's ends.

    `onsets` has (trial, holo, onset) in seconds. The join is on the trial and a bucket of frames as long as a window: a window lies in two of them at most,
    so whatever the number of onsets, the join makes no more than twice the rows that stay, and a long trace is dealt out by buckets.
    """
    low, high = N.window_bounds(F.col("onset"), freq, ipi, n_pulses, pre, post)
    length = max(1, N.response_length(freq, ipi, n_pulses, pre, post))
    bucket = lambda x: F.floor(x / length).cast("long")
    spans = onsets.select("trial", "holo", low.alias("lo"), high.alias("hi")).where("lo <= hi")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    points = traces.withColumn("_bucket", bucket(F.col("frame"))).join(spans, ["trial", "_bucket"]).where("frame between lo and hi")
    return points.withColumn("k", F.col("frame") - F.col("lo") + 1).drop("lo", "hi", "_bucket")


def padded_windows(traces: DataFrame, onsets: DataFrame, length: int, freq: float, pre: float) -> DataFrame:
    """(trial, holo, k, v) for every k of 1..length; points outside the trace are NULL."""
    low = F.floor((F.col("onset") - pre / 1000) * freq).cast("long")
    spine = onsets.select("trial", "holo", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long"))).alias("k"), low.alias("lo"))
    return spine.withColumn("frame", F.col("lo") + F.col("k") - 1).join(traces, ["trial", "frame"], "left").select("trial", "holo", "k", "v")


def window_lengths(sweeps: DataFrame, onsets: DataFrame, freq: float, ipi: float, n_pulses: float, pre: float, post: float) -> DataFrame:
    """One row: nominal length (the smallest window), the smallest overlap with a real sweep, and what is used.

    `sweeps` has (trial, n); `onsets` (trial, holo, onset). No overlap: the nominal length; no onset: the formula; 1 at least.
    """
    low, high = N.window_bounds(F.col("onset"), freq, ipi, n_pulses, pre, post)
    spans = onsets.select("trial", low.alias("lo"), high.alias("hi"))
    overlap = F.least(F.col("n"), F.col("hi")) - F.greatest(F.lit(1), F.col("lo")) + 1
    got = spans.join(sweeps, "trial", "left").agg(F.min(F.col("hi") - F.col("lo") + 1).alias("nominal"), F.min(F.when(overlap > 0, overlap)).alias("overlap"))
    nominal = F.when(F.col("nominal") >= 1, F.col("nominal")).otherwise(N.response_length(freq, ipi, n_pulses, pre, post))
    return got.select(nominal.cast("long").alias("nominal"), F.col("overlap").cast("long").alias("overlap"), F.greatest(F.least(nominal, F.coalesce("overlap", nominal)), F.lit(1)).cast("long").alias("used"))


def relative_change(points: DataFrame, keys: Sequence[str], pre_points: int, polarity: str = "1", value: str = "v", out: str = "dff", f0: str = "f0") -> DataFrame:
    """Adds the baseline (mean of the first points of each window) and the change relative to it; NULL where that is 0."""
    base = F.avg(F.when(F.col("k") <= pre_points, F.col(value))).over(Window.partitionBy(*keys))
    return points.withColumn(f0, base).withColumn(out, N.polarised(F.try_divide(F.col(value) - F.col(f0), F.col(f0)), polarity))


def rolling_baseline(traces: DataFrame, keys: Sequence[str], pre_end: int, width: int, values: Sequence[str] = ("v",)) -> DataFrame:
    """One row a trace: the mean of the window of `width` frames with the least variance within the first `pre_end`.

    The first of equal variances counts. The variance is of the first column, whose window serves all columns. Traces
    shorter than the window, and those without a full window of values, take the mean of what is there.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    ahead = w.rowsBetween(0, width - 1)
    pre = traces.where(F.col("frame") <= pre_end)
    lead = pre.select(*keys, "frame", *values, F.var_pop(values[0]).over(ahead).alias("var"), F.count(values[0]).over(ahead).alias("n"), *[F.avg(v).over(ahead).alias(f"mean_{v}") for v in values])
    full = F.when(F.col("n") == width, F.struct("var", "frame"))
    picked = [F.coalesce(F.min_by(f"mean_{v}", full), F.avg(v)).alias(f"f0_{v}") for v in values]
    return lead.groupBy(*keys).agg(F.min(full)["frame"].alias("start"), *picked)


def common_baseline_change(points: DataFrame, baselines: DataFrame, keys: Sequence[str], polarity: str = "1", value: str = "v", out: str = "dff") -> DataFrame:
    """The change relative to a trace's common baseline (rolling_baseline's row)."""
    f0 = F.col(f"f0_{value}")
    return points.join(baselines, list(keys)).withColumn(out, N.polarised(F.try_divide(F.col(value) - f0, f0), polarity))


def baselined(sweeps: DataFrame, first: int, threshold: float, recorded: bool = True) -> DataFrame:
    """Adds baseline (mean of a trial's first samples), corrected, and excluded (the baseline lies above the threshold).

    Without a recording, nothing is excluded.
    """
    base = F.avg(F.when(F.col("i") <= first, F.col("v"))).over(Window.partitionBy("trial"))
    excluded = F.coalesce(F.col("baseline") > threshold, F.lit(False)) if recorded else F.lit(False)
    return sweeps.withColumn("baseline", base).withColumn("corrected", F.col("v") - F.col("baseline")).withColumn("excluded", excluded)


def detrended(points: DataFrame, keys: Sequence[str], pre_points: int, freq: float) -> DataFrame:
    """Adds flat: v less the line through the first points of its window (with three at least), less their median then."""
    w = Window.partitionBy(*keys)
    t = (F.col("k") - (1 + pre_points) / 2) / freq
    pre = lambda x: F.when(F.col("k") <= pre_points, x)
    line = points.withColumn("t", t)
    if pre_points >= 3:
        line = line.withColumn("slope", F.regr_slope(pre(F.col("v")), pre(F.col("t"))).over(w)).withColumn("level", F.regr_intercept(pre(F.col("v")), pre(F.col("t"))).over(w))
        line = line.withColumn("line", F.coalesce(F.col("slope") * F.col("t") + F.col("level"), F.lit(0.0)))
    else:
        line = line.withColumn("slope", F.lit(None).cast("double")).withColumn("level", F.lit(None).cast("double")).withColumn("line", F.lit(0.0))
    line = line.withColumn("rest", F.col("v") - F.col("line"))
    return line.withColumn("flat", F.col("rest") - F.median(pre(F.col("rest"))).over(w)).drop("t", "slope", "level", "line", "rest")


def spine(groups: DataFrame, length: int) -> DataFrame:
    """Every (group, k) of 1..length."""
    return groups.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(length).cast("long"))))


def mean_interval(points: DataFrame, groups: Sequence[str], value: str = "dff", polarity: str = "1", level: float = 0.95) -> DataFrame:
    """Mean, standard deviation and Student-t interval of each group's values.

    n_cols counts rows, missing values included; the standard error divides by its root and the degrees of freedom are
    n_cols - 1, while the deviation is of the values present. For polarity '1' the interval's signs are turned, as the
    recordings' convention has it; lo and hi are the plain ends.
    """
    x = F.col(value)
    got = points.groupBy(*groups).agg(F.avg(x).alias("mean"), N.single_safe_sd(x).alias("sd"), F.count(F.lit(1)).alias("n_cols"), F.count(x).alias("n"))
    half = F.col("sd") / F.sqrt(F.col("n_cols").cast("double")) * N.t_column(1 - (1 - level) / 2, F.col("n_cols") - 1)
    got = got.withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half)
    sign = -1.0 if polarity == "1" else 1.0
    return got.withColumn("ci_lo", sign * F.col("lo")).withColumn("ci_hi", sign * F.col("hi"))


def rejected(points: DataFrame, groups: Sequence[str], values: Sequence[str] = ("dff", "filt_dff"), amplitude: float = 2.5, late: int = 45) -> DataFrame:
    """Adds sd_* and excl_* of two value columns (the second is the filtered one): outlying trials' values become NULL.

    A trial goes, per column, if a value lies below -amplitude times the deviation of all its group's values (which is missing,
    and rejects nothing, as soon as one of them is). Then it goes if its first maximum comes after `late`; this is skipped for
    both columns if the filtered one has a missing value.
    """
    trial = Window.partitionBy(*groups, "trial")
    # deviations are added up before they are dealt out by group; only a trial's own points come together in a task
    spread = points.groupBy(*groups).agg(*[N.strict_sd(F.col(v)).alias(f"sd_{v}") for v in values])
    spread = spread.select(*[F.col(g).alias(f"_{g}") for g in groups], *[f"sd_{v}" for v in values])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = points.join(spread, same).drop(*[f"_{g}" for g in groups])
    for v in values:
        low = F.max(F.coalesce(F.col(v) < -amplitude * F.col(f"sd_{v}"), F.lit(False))).over(trial)
        out = out.withColumn(f"_1_{v}", F.when(~low, F.col(v)))
    complete = F.count(F.lit(1)).over(trial) == F.count(f"_1_{values[1]}").over(trial)
    out = out.withColumn("_whole", complete)
    for v in values:
        peak = F.coalesce(F.min_by("k", F.when(F.col(f"_1_{v}").isNotNull(), F.struct(-F.col(f"_1_{v}"), F.col("k")))).over(trial), F.lit(1))
        out = out.withColumn(f"excl_{v}", F.when(~(F.col("_whole") & (peak > late)), F.col(f"_1_{v}")))
    return out.drop("_whole", *[f"_1_{v}" for v in values])


def deviation_outliers(df: DataFrame, groups: Sequence[str], value: str = "v", k: float = 3.0) -> DataFrame:
    """Adds med, mad (median absolute deviation, unscaled) and outlier (above med + k * mad)."""
    w = Window.partitionBy(*groups)
    df = df.withColumn("med", F.median(value).over(w))
    df = df.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(w))
    return df.withColumn("outlier", F.coalesce(F.col(value) > F.col("med") + k * F.col("mad"), F.lit(False)))


def _safe_corr(x: Column, y: Column) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(both == 1, x)) * F.var_pop(F.when(both == 1, y))))


def interleave_metrics(pages: DataFrame, groups: Sequence[str], pixels: Sequence[str], first_pages: int = 120) -> DataFrame:
    """One row a recording: whether its pages alternate between two channels, and the metrics that say so.

    `pages` has (groups, page from 0, pixels, v). Two channels: the mean images of odd and even pages correlate below 0.9 and the page means
    resemble those two pages on more than the next ones. Fewer than four pages, or no variance: one channel.
    """
    used = pages.where(F.col("page") < first_pages)
    image = used.groupBy(*groups, *pixels).agg(F.avg(F.when(F.col("page") % 2 == 0, F.col("v"))).alias("odd"), F.avg(F.when(F.col("page") % 2 == 1, F.col("v"))).alias("even"))
    corr = image.groupBy(*groups).agg(_safe_corr(F.col("odd"), F.col("even")).alias("image_corr"))
    w = Window.partitionBy(*groups).orderBy("page")
    means = used.groupBy(*groups, "page").agg(F.avg("v").alias("m")).withColumn("m1", F.lag("m", 1).over(w)).withColumn("m2", F.lag("m", 2).over(w))
    steps = means.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_pages"), _safe_corr(F.col("m"), F.col("m1")).alias("lag1"), _safe_corr(F.col("m"), F.col("m2")).alias("lag2"),
        F.avg(F.abs(F.col("m") - F.col("m1"))).alias("step1"), F.avg(F.abs(F.col("m") - F.col("m2"))).alias("step2"))
    two = (F.col("image_corr") < 0.9) & (F.coalesce(F.col("lag2") > F.col("lag1") + 0.1, F.lit(False)) | (F.col("step1") > 1.15 * F.greatest(F.col("step2"), F.lit(N.EPS))))
    return corr.join(steps, list(groups)).withColumn("n_channels", F.when((F.col("n_pages") >= 4) & F.coalesce(two, F.lit(False)), 2).otherwise(1).cast("long"))


def difference_report(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """One row: points, largest absolute and relative difference where both have values, and whether values are missing alike."""
    both = ours.select(*keys, F.col(value).alias("x")).join(theirs.select(*keys, F.col(value).alias("y")), list(keys), "full_outer")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(gap).alias("n_both"), F.max(gap).alias("max_abs"), F.max(F.try_divide(gap, F.abs("y"))).alias("max_rel"), F.bool_and(F.col("x").isNull() == F.col("y").isNull()).alias("same_layout"))


def placed_by_trial(points: DataFrame, groups: Sequence[str], value: str = "v") -> DataFrame:
    """(groups, k, place, trial, value): a group's trials numbered in their order, whatever order they came in. Rows, where ordered_by_trial() has arrays that grow with the trials."""
    place = sized(ranked_within(points.select(*groups, "trial").distinct(), list(groups), ["trial"], "place"))
    return points.join(place, [*groups, "trial"]).select(*groups, "k", "place", "trial", value)


def ordered_by_trial(points: DataFrame, groups: Sequence[str], value: str = "v") -> DataFrame:
    """One row a (group, k) with its values as an array in the order of trials, whatever order they came in."""
    got = points.groupBy(*groups, "k").agg(F.array_sort(F.collect_list(F.struct("trial", F.col(value).alias("v")))).alias("cols"))
    return got.select(*groups, "k", F.col("cols.trial").alias("trials"), F.col("cols.v").alias("values"))
