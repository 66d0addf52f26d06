"""Operators on images: rows (img, r, c, v), r and c counted from 0; masks are the rows of their pixels.

Whole-image passes deal rows out by image once; the windows over rows and columns of an image then need sorts only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EPS
from ..sources.scratch import sized

#: Stencils of the second derivative (central first difference twice) and of the first.
SECOND, FIRST = (0.25, 0.0, -0.5, 0.0, 0.25), (0.5, 0.0, -0.5)


def stencil(df: DataFrame, line: Sequence[str], order: str, sums: dict[str, tuple[str, Sequence[float]]], edge: str = "replicate") -> DataFrame:
    """Adds weighted sums of neighbours along a line of pixels: sums[out] = (column, weights around the pixel).

    Edges: 'replicate' repeats the end pixel, 'mirror' reflects about the border between pixels (up to two beyond it).
    """
    w = Window.partitionBy(*line).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {c for c, _ in sums.values()}
    if edge == "replicate":
        df = df.withColumns({f"_a_{c}": F.first(c).over(whole) for c in ends} | {f"_z_{c}": F.last(c).over(whole) for c in ends})

    def at(c: str, o: int) -> Column:
        if o == 0:
            return F.col(c)
        step, back = (F.lag, F.lead) if o < 0 else (F.lead, F.lag)
        far = step(c, abs(o)).over(w)
        if edge == "replicate":
            return F.coalesce(far, F.col(f"_a_{c}" if o < 0 else f"_z_{c}"))
        return F.coalesce(far, F.col(c)) if abs(o) == 1 else F.coalesce(far, step(c, 1).over(w), back(c, 1).over(w), F.col(c))

    reach = {c: max(len(k) // 2 for d, k in sums.values() if d == c) for c in ends}
    df = df.withColumns({f"_{c}_{o}": at(c, o) for c in ends for o in range(-reach[c], reach[c] + 1)})
    total = {}
    for out, (c, weights) in sums.items():
        x = F.lit(0.0)
        for o, weight in zip(range(-(len(weights) // 2), len(weights) // 2 + 1), weights):
            if weight:
                x = x + F.lit(float(weight)) * F.col(f"_{c}_{o}")
        total[out] = x
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*[c for c in keep if c not in total], *[x.alias(out) for out, x in total.items()])


def kernel(sigma: float, radius: int | None = None) -> list[float]:
    radius = math.ceil(2 * sigma) if radius is None else radius
    w = [math.exp(-x * x / (2 * sigma * sigma)) for x in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def by_image(pixels: DataFrame, key: str = "img") -> DataFrame:
    return pixels.repartition(key)


def blurred(pixels: DataFrame, sigmas: dict[str, tuple[float, int | None]], value: str = "v", key: str = "img") -> DataFrame:
    """Adds Gaussian blurs: sigmas[out] = (sigma, half width; by default 2 sigma rounded up)."""
    rows = stencil(by_image(pixels, key), [key, "r"], "c", {f"h{out}": (value, kernel(*s)) for out, s in sigmas.items()})
    done = stencil(rows, [key, "c"], "r", {out: (f"h{out}", kernel(*s)) for out, s in sigmas.items()})
    return done.drop(*[f"h{out}" for out in sigmas])


def hessian(pixels: DataFrame, columns: dict[str, float], key: str = "img") -> DataFrame:
    """Adds <column>_l1 and <column>_l2, the eigenvalues (|l1| <= |l2|) of the Hessian of smoothed columns, times sigma squared."""
    across = stencil(pixels, [key, "r"], "c", {f"xx{c}": (c, SECOND) for c in columns} | {f"x{c}": (c, FIRST) for c in columns}, "mirror")
    down = stencil(across, [key, "c"], "r", {f"yy{c}": (c, SECOND) for c in columns} | {f"xy{c}": (f"x{c}", FIRST) for c in columns}, "mirror")
    out = {}
    for c, sigma in columns.items():
        xx, yy, xy = (F.lit(sigma * sigma) * F.col(f"{n}{c}") for n in ("xx", "yy", "xy"))
        root = F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy)
        a, b = 0.5 * (xx + yy + root), 0.5 * (xx + yy - root)
        swap = F.abs(a) > F.abs(b)
        out |= {f"{c}_l1": F.when(swap, b).otherwise(a), f"{c}_l2": F.when(swap, a).otherwise(b)}
    return down.withColumns(out).drop(*[f"{n}{c}" for c in columns for n in ("xx", "x", "yy", "xy")])


def ridge_response(l1: Column, l2: Column, sensitivity: float, bright: bool = True) -> Column:
    """Response to ridges of one scale; those of the other polarity have none."""
    blob = l1 * l1 / F.when(l2 == 0, F.lit(EPS)).otherwise(l2 * l2)
    v = F.exp(-blob / 0.5) * (1.0 - F.exp(-(l1 * l1 + l2 * l2) / (2.0 * sensitivity * sensitivity)))
    return F.when(l2 >= 0 if bright else l2 <= 0, 0.0).otherwise(v)


def ridge(pixels: DataFrame, sensitivity: float = 2.0, thickness: Sequence[int] = (4, 6, 8, 10, 12, 14), bright: bool = True, value: str = "v", key: str = "img") -> DataFrame:
    """Adds ridge: the largest response over scales of sigma = thickness / 6; all scales share the same window passes."""
    scales = {f"g{t}": t / 6.0 for t in thickness}
    smooth = blurred(pixels, {c: (s, math.ceil(3.0 * s)) for c, s in scales.items()}, value, key)
    found = hessian(smooth, scales, key)
    best = F.greatest(F.lit(0.0), *[ridge_response(F.col(f"{c}_l1"), F.col(f"{c}_l2"), sensitivity, bright) for c in scales])
    return found.withColumn("ridge", best).drop(*scales, *[f"{c}_l{k}" for c in scales for k in (1, 2)])


def percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: dict[str, float]) -> DataFrame:
    """One row a group: percentiles by the midpoint rule, from ranks within the group. Missing values are left out."""
    w = Window.partitionBy(*groups)
    ranked = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    out = []
    for name, p in percents.items():
        h = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * (p / 100) + 0.5))
        low = F.floor(h)
        at = lambda k: F.max(F.when(F.col("k") == F.least(k, F.col("n")), F.col("x")))  # noqa: E731, B023
        a, b, share = at(low), at(low + 1), F.max(h - low)
        out.append((a + share * (b - a)).alias(name))
    return ranked.groupBy(*groups).agg(*out)


def normalised(pixels: DataFrame, value: str = "v", key: str = "img") -> DataFrame:
    """Adds filt (blurred by 0.7) and norm: filt scaled by its 10th and 99th percentile over positive pixels, within 0..1.

    Images without a positive pixel keep filt.
    """
    filt = blurred(pixels, {"filt": (0.7, None)}, value, key)
    return scaled_between(filt, percentiles(filt.where(F.col(value) > 0), [key], "filt", {"p_lo": 10, "p_hi": 99}), key)


def scaled_between(filt: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Adds norm, filt between its image's p_lo and p_hi; images without them keep filt."""
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("filt") - F.col("p_lo")) / F.greatest(F.col("p_hi") - F.col("p_lo"), F.lit(EPS))))
    return filt.join(ends, key, "left").withColumn("norm", F.coalesce(scaled, "filt")).drop("p_lo", "p_hi")


def scaled_input(v: Column, dtype: str) -> Column:
    """Integer pixels to 0..1 by their type; others stay."""
    return {"uint16": v / 65535.0, "uint8": v / 255.0}.get(dtype, v)


# Masks


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of a disk: Euclidean below 3; 3 is a square of side 5, 5 a square of side 9 without three pixels at each corner."""
    if radius < 3:
        span = range(-radius, radius + 1)
        return [(r, c) for r in span for c in span if r * r + c * c <= radius * radius]
    if radius not in (3, 5):
        raise ValueError(f"no disk of radius {radius}")
    span = range(1 - radius, radius)
    return [(r, c) for r in span for c in span if radius == 3 or abs(r) + abs(c) <= 6]


def dilated(mask: DataFrame, radius: int, height: int | None, width: int | None, groups: Sequence[str] = ("img",)) -> DataFrame:
    """The pixels within the disk around any of the mask's, inside the image."""
    offsets = F.array(*[F.struct(F.lit(r).cast("long").alias("dr"), F.lit(c).cast("long").alias("dc")) for r, c in disk(radius)])
    near = mask.select(*groups, "r", "c", F.explode(offsets).alias("o")).select(*groups, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    inside = (F.col("r") >= 0) & (F.col("c") >= 0)
    for name, end in (("r", height), ("c", width)):
        inside = inside if end is None else inside & (F.col(name) < end)
    return near.where(inside).distinct()


def joined_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Gives the runs (r, c0, c1) of one mask the number of their component."""
    pdf = pdf.sort_values(["r", "c0"]).reset_index(drop=True)
    parent = list(range(len(pdf)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    r, a, b = (pdf[c].to_numpy() for c in ("r", "c0", "c1"))
    reach = int(pdf["reach"].iloc[0])
    above = 0
    for k in range(len(pdf)):
        while above < k and (r[above] < r[k] - 1 or r[above] == r[k] - 1 and b[above] + reach < a[k]):
            above += 1
        j = above
        while j < k and r[j] == r[k] - 1 and a[j] <= b[k] + reach:
            if b[j] + reach >= a[k]:
                x, y = root(j), root(k)
                parent[max(x, y)] = min(x, y)
            j += 1
    pdf["component"] = np.array([root(k) for k in range(len(pdf))], dtype="int64")
    return pdf.drop(columns="reach")


def runs_of(mask: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, r, c0, c1): the runs of pixels along the rows of each mask, made by windows over a row."""
    w = Window.partitionBy(*groups, "r").orderBy("c")
    return mask.select(*groups, "r", "c").distinct().withColumn("island", F.col("c") - F.row_number().over(w)).groupBy(*groups, "r", "island").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("island")


def components(mask: DataFrame, groups: Sequence[str] = ("img",), connectivity: int = 8) -> DataFrame:
    """The mask's runs of pixels along rows, (groups, r, c0, c1, component): touching runs have one component.

    Only runs, not pixels, go to the grouped union-find, one mask at a time; tiles.area_opened() is for masks that no task holds.
    """
    runs = runs_of(mask, groups).withColumn("reach", F.lit(1 if connectivity == 8 else 0))
    kinds = dict(runs.dtypes)
    return runs.groupBy(*groups).applyInPandas(joined_runs, ", ".join(f"{c} {kinds[c]}" for c in (*groups, "r", "c0", "c1")) + ", component long")


def area_opened(mask: DataFrame, least: int, groups: Sequence[str] = ("img",), connectivity: int = 8) -> DataFrame:
    """The mask without components of fewer pixels than `least`."""
    runs = components(mask, groups, connectivity)
    size = F.sum(F.col("c1") - F.col("c0") + 1).over(Window.partitionBy(*groups, "component"))
    return runs.withColumn("size", size).where(F.col("size") >= least).select(*groups, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def ring(seed: DataFrame, pixels: DataFrame, height: int | None, width: int | None, groups: Sequence[str] = ("img",), image: str = "img", inner: int = 2, outer: int = 5,
         without: DataFrame | None = None, bright_percent: float = 95, least_component: int = 7, least: int = 50) -> DataFrame:
    """The surrounding of each seed mask: dilated by `outer`, not by `inner`, without the pixels of `without`.

    The brightest pixels and small components are cut off; where fewer than `least` pixels remain, the whole ring stands.
    """
    keys = [*groups, "r", "c"]
    raw = dilated(seed, outer, height, width, groups).join(dilated(seed, inner, height, width, groups), keys, "left_anti")
    if without is not None:
        raw = raw.join(without, [c for c in keys if c in without.columns], "left_anti")
    lit = raw.join(pixels.select(image, "r", "c", "v"), [image, "r", "c"])
    cut = percentiles(lit, groups, "v", {"cut": bright_percent})
    clean = area_opened(lit.join(cut, list(groups)).where("v <= cut").select(*keys), least_component, groups)
    both = clean.withColumn("clean", F.lit(1)).unionByName(raw.select(*keys).withColumn("clean", F.lit(0)))
    enough = F.sum("clean").over(Window.partitionBy(*groups)) >= least
    return both.withColumn("enough", enough).where(F.col("clean") == F.col("enough").cast("int")).select(*keys)


# Row artefacts


def row_artifacts(pixels: DataFrame, first: int, last: int, mode: str, parameter: float, groups: Sequence[str] = ("img",)) -> DataFrame:
    """(groups, r, line_var, threshold, bad): a row is bad if its variance over the columns first..last lies above the threshold.

    Modes: 'fixed' (the parameter), 'mad' (median + parameter * median absolute deviation), 'percentile' (midpoint rule).
    """
    if last < first:
        raise ValueError("the gate has no column")
    rows = pixels.where(F.col("c").between(first, last)).groupBy(*groups, "r").agg(F.var_samp("v").alias("line_var"))
    w = Window.partitionBy(*groups)
    if mode == "fixed":
        rows = rows.withColumn("threshold", F.lit(float(parameter)))
    elif mode == "mad":
        rows = rows.withColumn("med", F.median("line_var").over(w)).withColumn("mad", F.median(F.abs(F.col("line_var") - F.col("med"))).over(w))
        rows = rows.withColumn("threshold", F.col("med") + parameter * F.col("mad")).drop("med", "mad")
    elif mode == "percentile":
        rows = rows.join(percentiles(rows, groups, "line_var", {"threshold": parameter}), list(groups))
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.withColumn("bad", F.coalesce(F.col("line_var") > F.col("threshold"), F.lit(False)))


def artifacts_filled(pixels: DataFrame, rows: DataFrame, fill: bool = True, integer: bool = False, groups: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels with bad rows filled by `level`, the median of the good rows (all bad: of the image; missing: 0), or NULL without `fill`."""
    joined = pixels.join(rows.select(*groups, "r", "bad"), [*groups, "r"])
    if not fill:
        return joined.withColumn("v", F.when(~F.col("bad"), F.col("v"))).drop("bad")
    w = Window.partitionBy(*groups)
    level = F.coalesce(F.median(F.when(~F.col("bad"), F.col("v"))).over(w), F.median("v").over(w), F.lit(0.0))
    level = F.round(level) if integer else level
    return joined.withColumn("level", level).withColumn("v", F.when(F.col("bad"), F.col("level")).otherwise(F.col("v"))).drop("bad")


def _finite(v: str) -> Column:
    return F.when(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.col(v))


def sanitised(pixels: DataFrame, groups: Sequence[str] = ("img",)) -> DataFrame:
    """Missing and non-finite values become their group's least finite one; a group without any is an error."""
    least = pixels.groupBy(*groups).agg(F.min(_finite("v")).alias("_least"))
    least = least.withColumn("_least", F.coalesce("_least", F.raise_error(F.lit("an image has no finite pixel")).cast("double")))
    return pixels.join(least, list(groups)).withColumn("v", F.coalesce(_finite("v"), "_least")).drop("_least")


def rescaled(pixels: DataFrame, groups: Sequence[str] = ("img",), top: int = 65535) -> DataFrame:
    """Adds u: values between each group's least and greatest scaled to 0..top and rounded; constant groups are 0, missing
    and non-finite values count as the least finite one. A group without any is 0; sanitised() raises there."""
    finite = _finite("v")
    w = Window.partitionBy(*groups)
    ends = pixels.withColumn("_lo", F.min(finite).over(w)).withColumn("_hi", F.max(finite).over(w)).withColumn("_x", F.coalesce(finite, "_lo"))
    return ends.withColumn("u", F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * top + 0.5), F.lit(0)).cast("long")).drop("_lo", "_hi", "_x")


# Regions over frames


def region_mean(pixels: DataFrame, regions: DataFrame, frame: Sequence[str] = ("trial", "frame"), bad_rows: DataFrame | None = None) -> DataFrame:
    """(cell, frame keys, mean_f): the mean over a region's pixels, missing values and bad rows (frame keys, r) left out.

    Regions (cell, r, c, and trial if they differ by trial) join on the pixel, broadcast if they are few; every region has a row in every frame.
    """
    if bad_rows is not None:
        pixels = pixels.join(bad_rows.select(*frame, "r").distinct().withColumn("_bad", F.lit(True)), [*frame, "r"], "left").withColumn("v", F.when(F.col("_bad").isNull(), F.col("v"))).drop("_bad")
    return pixels.join(sized(regions), [c for c in ("trial", "r", "c") if c in regions.columns]).groupBy("cell", *frame).agg(F.avg("v").alias("mean_f"))


def rectangle_mean(pixels: DataFrame, regions: DataFrame, frame: Sequence[str] = ("trial", "frame")) -> DataFrame:
    """(cell, frame keys, mean_f): the mean over all combinations of a region's rows and columns, repeated as they repeat.

    The combinations are never made: rows and columns carry how often they occur, and pixels are weighted by the product. The two lists
    are broadcast if they are short, so that frames aren't dealt out by row.
    """
    keys = [c for c in ("cell", "trial") if c in regions.columns]
    rows, cols = regions.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("wr")), regions.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("wc"))
    same = [c for c in keys if c != "cell"]
    joined = pixels.join(sized(rows), [*same, "r"]).join(sized(cols), [*keys, "c"])
    weight = F.col("wr") * F.col("wc")
    return joined.groupBy("cell", *frame).agg((F.sum(weight * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), weight))).alias("mean_f"))


def trial_images(pixels: DataFrame, cap: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(trial, r, c, v): each trial's mean image, of its first `cap` frames, without the trials of `exclude`."""
    kept = pixels if cap is None else pixels.where(F.col("frame") <= cap)
    kept = kept if exclude is None else kept.join(exclude, "trial", "left_anti")
    return kept.groupBy("trial", "r", "c").agg(F.avg("v").alias("v"))


def template(images: DataFrame) -> DataFrame:
    """(r, c, v, n_trials): the mean of trials' mean images."""
    return images.groupBy("r", "c").agg(F.avg("v").alias("v"), F.count("v").alias("n_trials"))


def column_major(mask: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds k, a pixel's number down the columns of its mask."""
    return mask.withColumn("k", F.row_number().over(Window.partitionBy(*groups).orderBy("c", "r")).cast("long"))
