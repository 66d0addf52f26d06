"""Operators on labelled regions of images and on fine regions within them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize, sized
from . import graphs, raster
from .trials import preferred


@dataclass(frozen=True)
class Quality:
    """Rules for regions; max_cells None keeps all. Distances in pixels."""

    min_area: int = 150
    max_area: int = 5000
    separation: float = 15.0
    border: int = 0
    max_cells: int | None = None
    dilation: int = 3


def label_statistics(labels: DataFrame, complete: bool = False) -> DataFrame:
    """(img, label, area, centroid_r, centroid_c, intensity, box) of label rasters (img, r, c, label, intensity); label 0 is background.

    With `complete`, labels up to an image's greatest that have no pixel are listed with area 0.
    """
    got = labels.where("label > 0").groupBy("img", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"), F.avg("intensity").alias("intensity"),
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    if not complete:
        return got
    all_labels = got.groupBy("img").agg(F.max("label").alias("top")).select("img", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias("label"))
    return all_labels.join(got.withColumn("label", F.col("label").cast("long")), ["img", "label"], "left").withColumn("area", F.coalesce("area", F.lit(0)))


def judged(stats: DataFrame, rules: Quality, height: int | None = None, width: int | None = None) -> DataFrame:
    """Adds reject_reason, NULL for regions that pass the rules of area and border; the first that applies is named."""
    reason = F.when(F.col("area") == 0, "empty label")
    if rules.border:
        n = rules.border
        near = (F.col("r0") < n) | (F.col("c0") < n) | (F.col("r1") >= height - n) | (F.col("c1") >= width - n)
        reason = reason.when(near, f"within {n} px of border")
    # fixed values: the texts of reports
    reason = reason.when(F.col("area") < rules.min_area, F.format_string(f"area %d < minAreaPx {rules.min_area}", "area"))
    reason = reason.when(F.col("area") > rules.max_area, F.format_string(f"area %d > maxAreaPx {rules.max_area}", "area"))
    return stats.withColumn("reject_reason", reason)


def separated(regions: DataFrame, separation: float, small: int = graphs.SMALL_EDGES) -> DataFrame:
    """Regions (img, label, centroid_r, centroid_c, intensity) kept from the brightest down, unless nearer than `separation` to a kept one.

    Regions conflict in pairs, found by grid cells; what goes is found by rounds over the pairs (graphs.beaten), so one image's regions spread over all tasks.
    Of equally bright regions the one with the smaller label comes first.
    """
    first = (F.col("ai") > F.col("bi")) | (F.col("ai") == F.col("bi")) & (F.col("a") < F.col("b"))
    pairs = _near(regions, separation).where(F.col("square") < separation * separation)
    lost = graphs.beaten(pairs.select("img", F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), ["img"], small)
    return regions.join(lost.withColumnRenamed("node", "label"), ["img", "label"], "left_anti")


def close_pairs(regions: DataFrame, separation: float) -> DataFrame:
    """(img, a, b, distance) of regions nearer than `separation`, a < b, found by grid cells of that size."""
    return _near(regions, separation).select("img", "a", "b", F.sqrt("square").alias("distance")).where(F.col("distance") < separation)


def _near(regions: DataFrame, separation: float) -> DataFrame:
    """(img, a, b, ai, bi, square) of regions in the same or adjoining grid cells, a < b: their intensities and squared distance."""
    cell = lambda c: F.floor(F.col(c) / separation).cast("long")
    own = regions.select("img", "label", "centroid_r", "centroid_c", "intensity", cell("centroid_r").alias("gr"), cell("centroid_c").alias("gc"))
    near = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    spread = own.withColumn("o", F.explode(near)).select("img", (F.col("gr") + F.col("o.r")).alias("gr"), (F.col("gc") + F.col("o.c")).alias("gc"), F.col("label").alias("a"), F.col("centroid_r").alias("ar"), F.col("centroid_c").alias("ac"), F.col("intensity").alias("ai"))
    square = (F.col("ar") - F.col("centroid_r")) * (F.col("ar") - F.col("centroid_r")) + (F.col("ac") - F.col("centroid_c")) * (F.col("ac") - F.col("centroid_c"))
    return spread.join(own, ["img", "gr", "gc"]).where("a < label").select("img", "a", F.col("label").alias("b"), "ai", F.col("intensity").alias("bi"), square.alias("square"))


def numbered(regions: DataFrame, max_cells: int | None = None) -> DataFrame:
    """The brightest `max_cells` regions of each image, numbered as cells by centroid row, then column."""
    w = Window.partitionBy("img")
    if max_cells is not None:
        regions = regions.withColumn("_k", F.row_number().over(w.orderBy(F.desc("intensity"), "label"))).where(F.col("_k") <= max_cells).drop("_k")
    return regions.withColumn("cell", F.row_number().over(w.orderBy("centroid_r", "centroid_c", "label")).cast("long"))


def rough_regions(labels: DataFrame, rules: Quality, height: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells' pixels (img, cell, r, c, k) and the report of all labels (img, label, area, ..., cell, reject_reason)."""
    report = materialize(judged(label_statistics(labels), rules, height, width), "judged")
    passed = separated(report.where("reject_reason is null"), rules.separation)
    cells = numbered(passed, rules.max_cells).select("img", "label", "cell")
    pixels = labels.join(cells, ["img", "label"]).select("img", "cell", "r", "c")
    if rules.dilation:
        pixels = raster.dilated(pixels, rules.dilation, height, width, ("img", "cell"))
    apart = passed.select("img", "label", F.lit(True).alias("apart"))
    full = report.join(apart, ["img", "label"], "left").join(cells, ["img", "label"], "left")
    reason = F.coalesce("reject_reason", F.when(F.col("apart").isNull(), F.lit(f"centroid < minSeparationPx ({rules.separation:g} px) from a kept cell")), F.when(F.col("cell").isNull(), F.lit(f"beyond maxCells cap ({rules.max_cells})")))
    return raster.column_major(pixels, ("img", "cell")), full.withColumn("reject_reason", reason).drop("apart")


def report_json(report: DataFrame) -> DataFrame:
    """One row an image: counts, the accepted labels in the cells' order and each label's record, as JSON."""
    order = F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "label"))))
    got = report.groupBy("img").agg(F.count(F.lit(1)).alias("raw"), F.count("cell").alias("accepted"), order.alias("o"), F.array_sort(F.collect_list(F.struct("label", "area", "reject_reason"))).alias("labels"))
    return got.select("img", "raw", "accepted", F.to_json(F.struct("raw", "accepted", F.col("o.label").alias("order"), "labels")).alias("report"))


def _thresholded(ridge: DataFrame, groups: list[str], percent: float) -> DataFrame:
    """Pixels whose ridge response is at least the percentile of the positive responses of their group."""
    lit = ridge.where("ridge > 0")
    return lit.join(raster.percentiles(lit, groups, "ridge", {"cut": percent}), groups).where("ridge >= cut").select(*groups, "r", "c")


#: How far from a region blurs, derivatives (7 + 2 + 2 pixels) and a ring's disk (5) reach.
REACH = 16


def boxes(rough: DataFrame, pad: int) -> DataFrame:
    """(cell, r, c): the pixels of each cell's bounding box with a margin, also those outside of the image."""
    box = rough.groupBy("cell").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = box.withColumn("r", F.explode(F.sequence(F.col("r0") - pad, F.col("r1") + pad)))
    return rows.select("cell", "r", F.explode(F.sequence(F.col("c0") - pad, F.col("c1") + pad)).alias("c"))


def _in_all_trials(regions: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """(cell, trial, r, c) of regions (cell, r, c) for the trials of which a cell isn't in `found`. The pairs of cells and trials are as many as the result has."""
    pairs = regions.select("cell").distinct().crossJoin(images.select("trial").distinct())
    return pairs.join(found.select("cell", "trial").distinct(), ["cell", "trial"], "left_anti").join(regions.select("cell", "r", "c").distinct(), "cell").select("cell", "trial", "r", "c")


def fine_regions(image: DataFrame, rough: DataFrame, height: int | None, width: int | None, sensitivity: float = 2.0, percent: float = 50) -> tuple[DataFrame, DataFrame]:
    """Fine regions and rings (cell, r, c) of cells within one image (r, c, v): the session's global ones.

    Each cell's image is the given one at its rough pixels and 0 elsewhere; ridges of at least the median response are the
    region, all ridges seed the ring. A cell without ridges keeps its rough pixels. Beyond REACH of a cell's box all responses are 0 and no ring
    passes, so only the box and that margin are looked at. Cells run in parallel.
    """
    grid = boxes(rough, REACH).join(image.select("r", "c"), ["r", "c"])
    own = rough.select("cell", "r", "c").distinct().join(image, ["r", "c"])
    masked = grid.join(own, ["cell", "r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    # written, as a filter on the response would otherwise unfold all its stencils into one predicate
    norm = materialize(raster.normalised(masked, key="cell"), "norm")
    found = materialize(raster.ridge(norm, sensitivity, value="norm", key="cell").select("cell", "r", "c", "v", "ridge"), "ridge")
    fine = preferred([_thresholded(found, ["cell"], percent), rough.select("cell", "r", "c").distinct()], ["cell"])
    around = raster.ring(found.where("ridge <> 0").select("cell", "r", "c"), found, height, width, ("cell",), "cell")
    return fine, around


def trial_fine_regions(images: DataFrame, rough: DataFrame, sensitivity: float = 2.0, percent: float = 60, pad: int = 2, override: DataFrame | None = None) -> DataFrame:
    """(cell, trial, r, c): fine regions in each trial's mean image (trial, r, c, v).

    The whole image is normalised; ridges are sought in the cell's bounding box and a margin, whose edges count as the image's,
    and kept inside its rough pixels. Without ridges the rough pixels stand; `override` (cell, r, c) comes before all.
    """
    norm = materialize(raster.normalised(images, key="trial").select("trial", "r", "c", "norm"), "norm")
    boxed = norm.join(sized(boxes(rough, pad)), ["r", "c"]).withColumn("key", F.struct("cell", "trial")).select("key", "r", "c", "norm")
    found = materialize(raster.ridge(boxed, sensitivity, value="norm", key="key").select("key.cell", "key.trial", "r", "c", "ridge"), "ridge").join(rough.select("cell", "r", "c").distinct(), ["cell", "r", "c"], "left_semi")
    fine = materialize(_thresholded(found, ["cell", "trial"], percent).select("cell", "trial", "r", "c"), "fine")
    sources = [fine, _in_all_trials(rough, images, fine)]
    if override is not None:
        sources.insert(0, override.select("cell", "r", "c").crossJoin(images.select("trial").distinct()).select("cell", "trial", "r", "c"))
    return preferred(sources, ["cell", "trial"])


def trial_rings(fine: DataFrame, images: DataFrame, global_rings: DataFrame, height: int | None, width: int | None) -> DataFrame:
    """(cell, trial, r, c): the surrounding of each trial's fine region without the pixels of any cell's; if none remain,
    the global ring's without them."""
    taken = fine.select("trial", "r", "c").distinct()
    own = raster.ring(fine, images, height, width, ("cell", "trial"), "trial", without=taken)
    own = materialize(own.select("cell", "trial", "r", "c"), "rings")
    spare = _in_all_trials(global_rings, images, own).join(taken, ["trial", "r", "c"], "left_anti")
    return own.unionByName(spare.select("cell", "trial", "r", "c"))
