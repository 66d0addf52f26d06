"""Queries on stored stacks, records and regions: what is written is read again, and nested or faulty inputs get their defined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import raster as R
from ..operators import regions as G
from ..operators import trials as TR
from ..sources import bindings as B
from ..sources import records
from ..sources.scratch import scratch_dir
from ..streaming import live
from .raster_queries import _VAR_SQL, FRAMES_SQL, LABELS_SQL, PIXELS_SQL, REGIONS_SQL, frames, labels, regions
from .trace_queries import r6


def stack_even_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as compact rows, a folder a trial, scaled to 16 bits, and read again, of interleaved pages the first channel only."""
    path = scratch_dir(spark, "stack")
    scaled = frames(spark, sf_dir).withColumn("frame", F.col("frame") - 1)
    records.rows_of_pixels(R.rescaled(scaled, ["trial"]).withColumn("v", F.col("u"))).write.partitionBy("trial").parquet(path)
    got = records.read_stack(spark, path, keep_even_pages=True)
    return got.select(F.col("trial").cast("long").alias("trial"), F.col("frame").cast("long").alias("frame"), "r", "c", F.col("v").alias("u"))


STACK_SQL = f"""
WITH {FRAMES_SQL}, m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM f WINDOW w AS (PARTITION BY trial))
SELECT trial, (frame - 1) // 2 AS frame, r, c, CAST(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 65535 + 0.5), 0) AS BIGINT) AS u FROM m WHERE (frame - 1) % 2 = 0
"""


def saved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that count pixels from 1, saved and loaded to count from 0, with the mean of each trial's first frame in them."""
    path = scratch_dir(spark, "regions")
    records.save_regions(regions(spark).withColumns({"r": F.col("r") + 1, "c": F.col("c") + 1}), path, base=1)
    first = frames(spark, sf_dir).where("frame = 1").drop("frame")
    return first.join(records.load_regions(spark, path), ["r", "c"]).groupBy("trial", "cell").agg(F.avg("v").alias("mean"), F.max("k").alias("pixels")).select("trial", "cell", *r6("mean"), "pixels")


SAVED_SQL = f"WITH {FRAMES_SQL}, {REGIONS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY c, r) AS k FROM roi) SELECT trial, cell, round(avg(v), 6) + 0.0 AS mean, max(k) AS pixels FROM f JOIN k USING (r, c) WHERE frame = 1 GROUP BY 1, 2"


def nested_trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a matrix of eight trials of eight frames; every fifth vector's third trial is empty, every seventh vector has no matrix."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") % 5 == 0) & (i == 2), F.array().cast("array<double>")).otherwise(F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8))))
    nested = B.stored(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.when(F.col("vec_id") % 7 != 0, rows).alias("matrix"))
    return records.trace_points(nested, "matrix").select("cell", "trial", "frame", *r6("v"))


NESTED_SQL = """
WITH m AS (SELECT vec_id AS cell, t, embedding AS e FROM embeddings, range(0, 8) g(t) WHERE vec_id % 7 <> 0)
SELECT cell, t + 1 AS trial, CAST(i + 1 AS BIGINT) AS frame, round(CAST(e[t * 8 + i + 1] AS DOUBLE), 6) + 0.0 AS v FROM m, range(0, 8) h(i) WHERE NOT (cell % 5 = 0 AND t = 2)
UNION ALL SELECT DISTINCT cell, t + 1, NULL, NULL FROM m WHERE cell % 5 = 0 AND t = 2
UNION ALL SELECT vec_id, NULL, NULL, NULL FROM embeddings WHERE vec_id % 7 = 0
"""


def sanitised_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with missing, infinite and undefined pixels, mended and scaled to 16 bits."""
    bad = F.when((F.col("r") + F.col("c")) % 13 == 0, F.lit(float("nan"))).when((F.col("r") * 3 + F.col("c")) % 17 == 0, F.lit(float("-inf"))).when((F.col("r") + 2 * F.col("c")) % 19 != 0, F.col("v"))
    mended = R.sanitised(B.image_pixels(spark, sf_dir).withColumn("v", bad))
    return R.rescaled(mended).select("img", "r", "c", *r6("v"), "u")


SANITISED_SQL = f"""
WITH {PIXELS_SQL}, b AS (SELECT img, r, c, CASE WHEN (r + c) % 13 = 0 OR (r * 3 + c) % 17 = 0 OR (r + 2 * c) % 19 = 0 THEN NULL ELSE v END AS x FROM px),
m AS (SELECT img, r, c, coalesce(x, min(x) OVER w) AS v, min(x) OVER w AS lo, max(x) OVER w AS hi FROM b WINDOW w AS (PARTITION BY img))
SELECT img, r, c, round(v, 6) + 0.0 AS v, CAST(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 65535 + 0.5), 0) AS BIGINT) AS u FROM m
"""


def label_stats_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every third label, with all labels up to an image's greatest; those without a pixel have none."""
    some = labels(spark, sf_dir).withColumn("label", F.when(F.col("label") % 3 == 0, F.col("label")).otherwise(0))
    return G.label_statistics(some, complete=True).select("img", "label", "area", *r6("centroid_r", "centroid_c", "intensity"))


COMPLETE_SQL = f"""
WITH {LABELS_SQL}, s AS (SELECT img, label, count(*) AS area, avg(r) AS cr, avg(c) AS cc, avg(intensity) AS it FROM lb WHERE label > 0 AND label % 3 = 0 GROUP BY 1, 2),
a AS (SELECT img, unnest(range(1, max(label) + 1)) AS label FROM s GROUP BY img)
SELECT a.img, a.label, coalesce(area, 0) AS area, round(cr, 6) + 0.0 AS centroid_r, round(cc, 6) + 0.0 AS centroid_c, round(it, 6) + 0.0 AS intensity FROM a LEFT JOIN s ON a.img = s.img AND a.label = s.label
"""


def artifact_fill_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows of 16-bit images filled by the good rows' median, rounded half away from zero."""
    p = B.image_pixels(spark, sf_dir)
    whole = R.rescaled(p).select("img", "r", "c", F.col("u").cast("double").alias("v"))
    return R.artifacts_filled(whole, R.row_artifacts(p, 8, 55, "mad", 2.0), integer=True).select("img", "r", "c", "v", "level")


INTEGER_SQL = f"""
WITH {_VAR_SQL}, e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY img)), u AS (SELECT img, r, c, coalesce(floor((v - lo) / nullif(hi - lo, 0) * 65535 + 0.5), 0) AS v FROM e),
j AS (SELECT u.*, line_var > threshold AS bad FROM u JOIN m2 USING (img, r)), k AS (SELECT *, round(median(CASE WHEN NOT bad THEN v END) OVER (PARTITION BY img)) AS level FROM j)
SELECT img, r, c, CASE WHEN bad THEN level ELSE v END AS v, level FROM k
"""


def preferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's returned lines, else its finished ones, else all."""
    lines = B.stored(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("long").alias("pos"), "l_returnflag", "l_linestatus")
    sources = [lines.where("l_returnflag = 'R'"), lines.where("l_linestatus = 'F'"), lines]
    return TR.preferred([s.select("trial", "pos", F.lit(k).cast("long").alias("source")) for k, s in enumerate(sources)], ["trial"])


PREFERRED_SQL = """
WITH a AS (SELECT l_orderkey AS trial, CAST(l_linenumber AS BIGINT) AS pos, CAST(s AS BIGINT) AS source FROM lineitem, range(0, 3) g(s) WHERE s = 2 OR s = 0 AND l_returnflag = 'R' OR s = 1 AND l_linestatus = 'F')
SELECT trial, pos, source FROM a QUALIFY source = min(source) OVER (PARTITION BY trial)
"""


def planned_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many planned trials as the greatest order's number and ten more, with the orders' totals, missing where none has come."""
    orders = B.stored(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("price"))
    planned = (orders.agg(F.max("trial")).first()[0] or 0) + 10
    return live.complete_trials(orders, planned).select("trial", *r6("price"))


PLANNED_SQL = "SELECT g.trial, round(o_totalprice, 6) + 0.0 AS price FROM (SELECT unnest(range(1, max(o_orderkey) + 11)) AS trial FROM orders) g LEFT JOIN orders ON o_orderkey = g.trial"


def inclusive_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples 5 to 20 of each trace, both included, and whole steps of a fractional length."""
    part = N.slice_inclusive(F.col("samples"), 5, 20)
    got = B.trace_arrays(spark, sf_dir).select("trial", F.size(part).cast("long").alias("n"), F.aggregate(part, F.lit(0.0), lambda a, x: a + x).alias("total"), N.colon_counts(F.col("trial") * 0.3 - 1).alias("steps"))
    return got.select("trial", "n", *r6("total"), "steps")


SLICES_SQL = """
SELECT vec_id AS trial, CAST(len(embedding[5:20]) AS BIGINT) AS n, round(list_sum(list_transform(embedding[5:20], lambda x: CAST(x AS DOUBLE) + 1.0)), 6) + 0.0 AS total,
  greatest(0, (3 * vec_id - 10) // 10 - CASE WHEN 3 * vec_id - 10 < 0 THEN 1 ELSE 0 END) AS steps FROM embeddings
"""

QUERIES = {f.__name__: f for f in (stack_even_pages, saved_regions, nested_trace_points, sanitised_image, label_stats_complete, artifact_fill_integer, preferred_sources, planned_trials, inclusive_slices)}
ORACLE_SQL = {
    "stack_even_pages": STACK_SQL, "saved_regions": SAVED_SQL, "nested_trace_points": NESTED_SQL, "sanitised_image": SANITISED_SQL, "label_stats_complete": COMPLETE_SQL, "artifact_fill_integer": INTEGER_SQL,
    "preferred_sources": PREFERRED_SQL, "planned_trials": PLANNED_SQL, "inclusive_slices": SLICES_SQL,
}
