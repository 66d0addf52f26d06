"""Whole-session queries over images as trials' frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as T
from ..sources import bindings as B
from . import session as S
from .raster_queries import FRAMES_SQL, REGIONS_SQL, _cells, frames, regions
from .trace_queries import T95_SQL, ZERO_PHASE_SQL, r6

#: Four frames are a trial: its window has the frames 2 to 4, of which two are the baseline.
RUN = S.Session(freq=100.0, ipi=10.0, n_pulses=1.0, pre=30.0, post=-30.0, cutoff=10.0)
ONSET = 0.05


def _stimuli(pixels: DataFrame) -> DataFrame:
    t = pixels.select("trial").distinct()
    return t.select("trial", (F.col("trial") % 2 + 1).alias("cond"), F.lit(1).cast("long").alias("holo"), F.lit(ONSET).alias("onset"), (F.col("trial") % 5 == 3).alias("excluded"))


def region_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of given regions without surroundings: means and intervals by condition."""
    pixels = frames(spark, sf_dir).withColumn("v", F.col("v") + 1.0)
    roi = S.extracted(pixels, regions(spark), RUN).select("cell", "trial", "frame", F.col("mean_f").alias("corr_f"), F.col("mean_f").alias("filt_f"))
    out = S.responses(roi, _stimuli(pixels), RUN)
    return T.mean_interval(out, ["cell", "cond", "holo", "k"]).select("cell", "cond", "holo", "k", "n_cols", "n", *r6("mean", "ci_lo", "ci_hi"))


REGION_RESPONSES_SQL = f"""
WITH {FRAMES_SQL}, {REGIONS_SQL}, wr AS (SELECT cell, r, count(*) AS a FROM roi GROUP BY 1, 2), wc AS (SELECT cell, c, count(*) AS b FROM roi GROUP BY 1, 2),
m AS (SELECT cell, trial, frame, sum(a * b * (v + 1.0)) / sum(a * b) AS x FROM f JOIN wr USING (r) JOIN wc USING (cell, c) GROUP BY 1, 2, 3),
w AS (SELECT cell, trial, frame - 1 AS k, x FROM m WHERE trial % 5 <> 3 AND frame BETWEEN 2 AND 4),
d AS (SELECT w.cell, w.trial, k, (x - f0) / nullif(f0, 0) AS dff FROM w JOIN (SELECT cell, trial, avg(x) AS f0 FROM w WHERE k <= 2 GROUP BY 1, 2) b ON w.cell = b.cell AND w.trial = b.trial
      UNION ALL SELECT cell, trial, k, NULL FROM (SELECT DISTINCT cell FROM roi), (SELECT DISTINCT trial FROM f WHERE trial % 5 = 3), range(1, {RUN.length} + 1) g(k)),
{T95_SQL}, g AS (SELECT cell, trial % 2 + 1 AS cond, k, avg(dff) AS mean, CASE WHEN count(dff) = 1 THEN 0.0 ELSE stddev_samp(dff) END AS sd, count(*) AS n_cols, count(dff) AS n FROM d GROUP BY 1, 2, 3),
h AS (SELECT g.*, sd / sqrt(n_cols) * t AS half FROM g LEFT JOIN q ON q.df = n_cols - 1)
SELECT cell, cond, CAST(1 AS BIGINT) AS holo, CAST(k AS BIGINT) AS k, n_cols, n, round(mean, 6) + 0.0 AS mean, round(-(mean - half), 6) + 0.0 AS ci_lo, round(-(mean + half), 6) + 0.0 AS ci_hi FROM h
"""


def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine regions, surroundings, traces and responses of all trials; the means of each cell and condition."""
    pixels = frames(spark, sf_dir).withColumn("v", F.col("v") + 1.0)
    got = S.run(pixels, _cells(spark), _stimuli(pixels), RUN, 64, 64)
    return got["means"].select("cell", "cond", "holo", "k", "n_cols", "n", *r6("mean", "ci_lo", "ci_hi"))


def nested_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = frames(spark, sf_dir).withColumn("v", F.col("v") + 1.0)
    roi = S.extracted(pixels, regions(spark), RUN).select("cell", "trial", "frame", F.col("mean_f").alias("corr_f"), F.col("mean_f").alias("filt_f"))
    out = S.responses(roi, _stimuli(pixels), RUN)
    trials, means = S.snapshot(out, T.mean_interval(out, ["cell", "cond", "holo", "k"]))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",", "none").alias("micros")
    return trials.select("cell", "cond", "holo", "trial", F.size("dff").cast("long").alias("n_points"), text("dff")).unionByName(
        means.select("cell", "cond", "holo", F.lit(None).cast("long").alias("trial"), F.size("mean").cast("long").alias("n_points"), text("mean")))


_RESPONSES_SQL = REGION_RESPONSES_SQL.split(f"{T95_SQL}, g AS")[0].rstrip().rstrip(",")
SNAPSHOT_SQL = f"""
{_RESPONSES_SQL}, s AS (SELECT cell, trial % 2 + 1 AS cond, trial, CAST(k AS BIGINT) AS k, dff AS x FROM d),
a AS (SELECT cell, trial % 2 + 1 AS cond, NULL AS trial, CAST(k AS BIGINT) AS k, avg(dff) AS x FROM d GROUP BY 1, 2, k),
u AS (SELECT * FROM s UNION ALL SELECT * FROM a)
SELECT cell, cond, CAST(1 AS BIGINT) AS holo, CAST(trial AS BIGINT) AS trial, count(*) AS n_points, string_agg(coalesce(CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR), 'none'), ',' ORDER BY k) AS micros FROM u GROUP BY cell, cond, trial
"""


def sorted_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of all trials by condition: filtered, cut, detrended; trials of a high baseline are excluded."""
    arrays = B.trace_arrays(spark, sf_dir)
    high = T.baselined(B.traces(spark, sf_dir).withColumnRenamed("frame", "i"), 16, 1.06).where("excluded").select("trial").distinct()
    onsets = arrays.select("trial", F.col("cond").alias("holo"), F.lit(0.066).alias("onset"))
    points = S.sorted_sweeps(arrays, onsets, high, 500.0, 120.0, 32, 34.0)
    return T.mean_interval(points, ["holo", "k"], "flat", "2").select(F.col("holo").alias("cond"), "k", "n_cols", "n", *r6("mean", "ci_lo", "ci_hi"))


#: The first frame of each window, by the rule of the operator.
_LOW = math.floor((0.066 - 34.0 / 1000) * 500.0)
SORTED_SWEEPS_SQL = f"""
{ZERO_PHASE_SQL.rsplit("SELECT trial, 77", 1)[0]}, z AS (SELECT trial, 77 - frame AS frame, y FROM g WHERE frame BETWEEN 13 AND 76),
p AS (SELECT x.trial, x.cond, k, CASE WHEN list_avg(x.s[1:16]) <= 1.06 THEN y END AS v, (k - 8.5) / 500.0 AS t FROM x CROSS JOIN range(1, 33) r(k) LEFT JOIN z ON z.trial = x.trial AND z.frame = {_LOW} + k - 1),
l AS (SELECT trial, regr_slope(v, t) AS a, regr_intercept(v, t) AS b FROM p WHERE k <= 16 GROUP BY trial),
o AS (SELECT p.trial, cond, k, v - coalesce(a * t + b, 0.0) AS rest FROM p LEFT JOIN l ON p.trial = l.trial),
m AS (SELECT cond, k, rest - median(CASE WHEN k <= 16 THEN rest END) OVER (PARTITION BY trial) AS flat FROM o),
{T95_SQL}, c AS (SELECT cond, k, avg(flat) AS mean, CASE WHEN count(flat) = 1 THEN 0.0 ELSE stddev_samp(flat) END AS sd, count(*) AS n_cols, count(flat) AS n FROM m GROUP BY cond, k),
h AS (SELECT c.*, sd / sqrt(n_cols) * q.t AS half FROM c LEFT JOIN q ON q.df = n_cols - 1)
SELECT cond, CAST(k AS BIGINT) AS k, n_cols, n, round(mean, 6) + 0.0 AS mean, round(mean - half, 6) + 0.0 AS ci_lo, round(mean + half, 6) + 0.0 AS ci_hi FROM h
"""

#: Windows that reach beyond the sweeps' ends, so that they are cut to what all sweeps have.
_POST = 80.0


def condition_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of all trials sorted by condition and place: filtered by blocks, cut to one length, detrended; trials of a high baseline have NULLs."""
    sweeps = B.traces(spark, sf_dir)
    high = T.baselined(sweeps.withColumnRenamed("frame", "i"), 16, 1.06).select("trial", "cond", "excluded").distinct()
    onsets = high.select("trial", F.col("cond").alias("holo"), F.lit(0.066).alias("onset"))
    got = S.condition_sweeps(sweeps.select("trial", "frame", "v"), high, onsets, 500.0, 120.0, 5.0, 1.0, 34.0, _POST)
    return got["windows"].select("cond", "holo", "place", "trial", "k", *r6("flat"))


def _used_length() -> int:
    start = (0.066 - 34.0 / 1000) * 500.0
    high = math.ceil(start) + math.ceil((5.0 * 1 + 34.0 + _POST) / 1000 * 500.0)
    return min(high - _LOW + 1, min(64, high) - max(1, _LOW) + 1)


CONDITION_SWEEPS_SQL = SORTED_SWEEPS_SQL.split("m AS (SELECT cond")[0].replace("range(1, 33)", f"range(1, {_used_length() + 1})").replace("SELECT p.trial, cond, k, v - ", "SELECT p.trial, p.cond, k, v - ") + """
s AS (SELECT trial, row_number() OVER (PARTITION BY cond ORDER BY trial) AS place FROM x)
SELECT cond, cond AS holo, place, o.trial, CAST(k AS BIGINT) AS k, round(rest - median(CASE WHEN k <= 16 THEN rest END) OVER (PARTITION BY o.trial), 6) + 0.0 AS flat FROM o JOIN s ON o.trial = s.trial
"""

QUERIES = {f.__name__: f for f in (region_responses, batch_run, nested_snapshot, sorted_sweeps, condition_sweeps)}
ORACLE_SQL = {"condition_sweeps": CONDITION_SWEEPS_SQL, "region_responses": REGION_RESPONSES_SQL, "nested_snapshot": SNAPSHOT_SQL, "sorted_sweeps": SORTED_SWEEPS_SQL}
