"""Images too large for a task: the unit of work is a tile and its margin."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EPS
from ..sources.scratch import materialize
from . import graphs, raster, selection

#: Side of a tile in pixels.
SIDE = 512


def with_margins(pixels: DataFrame, margin: int, side: int = SIDE, key: str = "img", out: str = "tile") -> DataFrame:
    """Pixels with `out`, a struct (key, tr, tc), once for each tile that they are in or within `margin` of."""
    span = lambda c: F.sequence(F.floor((F.col(c) - margin) / side).cast("long"), F.floor((F.col(c) + margin) / side).cast("long"))
    spread = pixels.withColumn("_tr", F.explode(span("r"))).withColumn("_tc", F.explode(span("c")))
    return spread.withColumn(out, F.struct(F.col(key).alias("key"), F.col("_tr").alias("tr"), F.col("_tc").alias("tc"))).drop("_tr", "_tc")


def inner(pixels: DataFrame, side: int = SIDE, tile: str = "tile") -> DataFrame:
    """Without the margins: each pixel once."""
    return pixels.where((F.floor(F.col("r") / side) == F.col(f"{tile}.tr")) & (F.floor(F.col("c") / side) == F.col(f"{tile}.tc")))


def tiled(pixels: DataFrame, work: Callable[[DataFrame], DataFrame], margin: int, side: int = SIDE, key: str = "img") -> DataFrame:
    """`work`, an operator on images of the key `tile` whose result at a pixel depends on pixels within `margin`, applied to tiles.

    An image's own edges are edges of its tiles; a tile's other edges are at least `margin` off its pixels, so the result is that of the whole image.
    Tiles without a pixel of their own are empty: nothing is made of margins alone.
    """
    done = work(with_margins(pixels, margin, side, key))
    return inner(done, side).drop("tile")


def _line(a: np.ndarray, weights: Sequence[float], axis: int, edge: str) -> np.ndarray:
    """Weighted sums along an axis, as raster.stencil() has them."""
    half = len(weights) // 2
    ends = [(0, 0), (0, 0)]
    ends[axis] = (half, half)
    padded = np.pad(a, ends, mode="edge" if edge == "replicate" else "symmetric")
    size = a.shape[axis]
    total = np.zeros_like(a)
    for k, w in enumerate(weights):
        if w:
            total += w * (padded[k : k + size] if axis == 0 else padded[:, k : k + size])
    return total


def _ridges(a: np.ndarray, sensitivity: float, thickness: Sequence[int], bright: bool) -> np.ndarray:
    """The largest ridge response over scales of one tile, by the formulas of raster.ridge()."""
    best = np.zeros_like(a)
    for t in thickness:
        s = t / 6.0
        smooth = raster.kernel(s, math.ceil(3.0 * s))
        g = _line(_line(a, smooth, 1, "replicate"), smooth, 0, "replicate")
        xx, yy = (s * s * _line(g, raster.SECOND, axis, "mirror") for axis in (1, 0))
        xy = s * s * _line(_line(g, raster.FIRST, 1, "mirror"), raster.FIRST, 0, "mirror")
        root = np.sqrt((xx - yy) ** 2 + 4.0 * xy * xy)
        one, two = 0.5 * (xx + yy + root), 0.5 * (xx + yy - root)
        swap = np.abs(one) > np.abs(two)
        l1, l2 = np.where(swap, two, one), np.where(swap, one, two)
        v = np.exp(-(l1 * l1 / np.where(l2 == 0, EPS, l2 * l2)) / 0.5) * (1.0 - np.exp(-(l1 * l1 + l2 * l2) / (2.0 * sensitivity * sensitivity)))
        best = np.maximum(best, np.where(l2 >= 0 if bright else l2 <= 0, 0.0, v))
    return best


def ridge(pixels: DataFrame, sensitivity: float = 2.0, thickness: Sequence[int] = (4, 6, 8, 10, 12, 14), bright: bool = True, value: str = "v", side: int = SIDE, key: str = "img") -> DataFrame:
    """(key, r, c, value, ridge): raster.ridge() by tiles, each an array of numbers; images are full rectangles, which is checked.

    The blurs reach three sigmas and the derivatives two pixels further; that is a tile's margin.
    """
    reach = max(math.ceil(3.0 * (t / 6.0)) for t in thickness) + 2
    kinds = dict(pixels.dtypes)
    spread = with_margins(pixels.select(key, "r", "c", F.col(value).cast("double").alias(value)), reach, side, key)
    spread = spread.select(key, "r", "c", value, F.col("tile.tr").alias("_tr"), F.col("tile.tc").alias("_tc"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        own = (r // side == pdf["_tr"].to_numpy()) & (c // side == pdf["_tc"].to_numpy())
        if own.any():
            at = (r - r.min(), c - c.min())
            image = np.full((at[0].max() + 1, at[1].max() + 1), np.nan)
            if len(pdf) != image.size:
                raise ValueError("an image isn't a full rectangle of pixels")
            image[at] = pdf[value].to_numpy()
            pdf = pdf.assign(ridge=_ridges(image, sensitivity, thickness, bright)[at])
        else:
            pdf = pdf.assign(ridge=0.0)
        return pdf.loc[own, [key, "r", "c", value, "ridge"]]

    return spread.groupBy(key, "_tr", "_tc").applyInPandas(work, f"{key} {kinds[key]}, r {kinds['r']}, c {kinds['c']}, {value} double, ridge double")


def normalised(pixels: DataFrame, value: str = "v", side: int = SIDE, fit: int = selection.FIT) -> DataFrame:
    """As raster.normalised(), by tiles; the percentiles of an image come from counts."""
    filt = materialize(tiled(pixels, lambda p: raster.blurred(p, {"filt": (0.7, None)}, value, "tile"), 2, side), "filt")
    ends = selection.percentiles(filt.where(F.col(value) > 0), ["img"], "filt", {"p_lo": 10, "p_hi": 99}, fit)
    return raster.scaled_between(filt, ends, "img")


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one tile with the place of their component's first run, in the order of rows and columns."""
    named = raster.joined_runs(pdf)
    first = named.groupby("component")[["r", "c0"]].transform("first")
    return named.assign(fr=first["r"], fc=first["c0"]).drop(columns="component")


def area_opened(mask: DataFrame, least: int, side: int = SIDE, key: str = "img", connectivity: int = 8, small: int = graphs.SMALL_EDGES) -> DataFrame:
    """As raster.area_opened(), of masks of any size: (key, r, c) of the pixels of components of at least `least` pixels.

    Components are found within tiles, then joined over the tiles' borders: a table of labels that touch, not of pixels, is contracted. A label is the
    place of its first pixel.
    """
    kind = dict(mask.dtypes)[key]
    at = mask.select(key, "r", "c").distinct().withColumn("tr", F.expr(f"r div {side}").cast("long")).withColumn("tc", F.expr(f"c div {side}").cast("long"))
    runs = raster.runs_of(at, (key, "tr", "tc")).withColumn("reach", F.lit(1 if connectivity == 8 else 0))
    schema = f"{key} {kind}, tr long, tc long, r long, c0 long, c1 long, fr long, fc long"
    runs = materialize(runs.select(key, "tr", "tc", F.col("r").cast("long"), F.col("c0").cast("long"), F.col("c1").cast("long"), "reach").groupBy(key, "tr", "tc").applyInPandas(_labelled, schema), "runs")
    label = F.struct(key, "fr", "fc")
    # pixels at the borders, and their neighbours in other tiles
    last = side - 1
    edge = runs.where(f"r % {side} in (0, {last})").select(label.alias("label"), "tr", "tc", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    sides = runs.where(f"r % {side} not in (0, {last})").select(label.alias("label"), "tr", "tc", "r", F.explode(F.filter(F.array("c0", "c1"), lambda c: (c % side == 0) | (c % side == last))).alias("c"))
    border = materialize(edge.unionByName(sides.distinct()), "border")
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (connectivity == 8 or not dr or not dc)]
    near = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in steps])
    beside = border.select(F.col("label").alias("a"), F.col(f"label.{key}").alias(key), "tr", "tc", F.explode(near).alias("o"), "r", "c")
    beside = beside.select("a", key, "tr", "tc", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).where(f"r div {side} <> tr or c div {side} <> tc").drop("tr", "tc")
    touching = beside.join(border.select(F.col("label").alias("b"), F.col(f"label.{key}").alias(key), "r", "c"), [key, "r", "c"]).select("a", "b").distinct()
    packed = lambda x: F.struct(F.col(f"{x}.{key}").alias(key), F.col(f"{x}.fr").alias("fr"), F.col(f"{x}.fc").alias("fc"))
    numbered = materialize(touching.select(packed("a").alias("a"), packed("b").alias("b")), "touching")
    names = _components_of_structs(numbered, small)
    size = runs.groupBy(label.alias("label")).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    whole = size.join(names.withColumnRenamed("node", "label"), "label", "left").withColumn("component", F.coalesce("component", "label"))
    total = whole.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    kept = whole.join(total, "component", "left_semi").select("label")
    return runs.withColumn("label", label).join(kept, "label", "left_semi").select(key, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def _components_of_structs(edges: DataFrame, small: int) -> DataFrame:
    """Components of edges between structs: they are named by strings whose order is that of some total order, which is all that is needed."""
    text = lambda x: F.to_json(F.col(x))
    nodes = materialize(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("name", text("node")), "nodes")
    found = graphs.components(edges.select(text("a").alias("a"), text("b").alias("b")), small)
    named = found.select(F.col("node").alias("name"), F.col("component").alias("top")).join(nodes, "name")
    return named.join(nodes.select(F.col("name").alias("top"), F.col("node").alias("component")), "top").select("node", "component")
