"""Queries on single traces, groups and images that no task could hold: whole tables as one trace, one group or one strip of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recurrence, selection, tiles
from ..operators import regions as G
from ..operators import traces as T
from ..operators import trials as TR
from ..sources import bindings as B
from .raster_queries import _KEPT_SQL, _REASON_SQL, ABOVE, AREA_OPEN_SQL, PIXELS_SQL, _norm_sql, _ridge_sql
from .trace_queries import _STEADY, CAUSAL, SWEEP, SWEEPS_SQL, _hazen_sql, _recursion_sql, r6

#: Side of a tile and values that a task sorts: small ones, so that tiles and passes are many on small tables too.
SIDE, FIT = 48, 10_000


def iir_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a type, by time, as one trace: filtered causally, and forward and backward."""
    events = B.stored(spark, sf_dir, "events").select(F.col("event_type").alias("trial"), "ts", "event_id", F.col("value").alias("v"))
    points = TR.ranked_within(events, ["trial"], ["ts", "event_id"], "frame").select("trial", "frame", "v")
    one_way = recurrence.causal(points, *CAUSAL, out="causal")
    return one_way.join(recurrence.zero_phase(points, *SWEEP, out="smooth"), ["trial", "frame"]).select("trial", "frame", *r6("causal", "smooth"))


IIR_LONG_SQL = f"""
WITH RECURSIVE x AS (SELECT event_type AS trial, list(value ORDER BY ts, event_id) AS s FROM events GROUP BY 1),
{_recursion_sql("f", "x", "len(s)", CAUSAL, [0.0] * 4)},
w AS (SELECT trial, list_concat(list_concat(list_transform(range(1, 13), lambda j: 2 * s[1] - s[14 - j]), s), list_transform(range(1, 13), lambda j: 2 * s[len(s)] - s[len(s) - j])) AS s FROM x),
{_recursion_sql("g", "w", "len(s)", SWEEP, _STEADY)},
u AS (SELECT trial, list(y ORDER BY frame DESC) AS s FROM g WHERE frame > 0 GROUP BY trial),
{_recursion_sql("h", "u", "len(s)", SWEEP, _STEADY)},
z AS (SELECT trial, len(s) - 11 - frame AS frame, y FROM h WHERE frame BETWEEN 13 AND len(s) - 12)
SELECT f.trial, f.frame, round(f.y, 6) + 0.0 AS causal, round(z.y, 6) + 0.0 AS smooth FROM f JOIN z ON f.trial = z.trial AND f.frame = z.frame
"""


def purchase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around every purchase of a user: three events before it to six after."""
    sweeps = B.sweeps(spark, sf_dir)
    onsets = sweeps.where("cond = 'purchase'").select("trial", F.col("event_id").alias("holo"), F.col("i").cast("double").alias("onset"))
    return T.windows(sweeps.select("trial", F.col("i").alias("frame"), "v"), onsets, 1.0, 1000.0, 2.0, 3000.0, 4000.0).select("trial", "holo", "k", "v")


PURCHASE_SQL = f"WITH {SWEEPS_SQL} SELECT p.trial, p.event_id AS holo, q.i - p.i + 4 AS k, q.v FROM e p JOIN e q ON q.trial = p.trial AND q.i BETWEEN p.i - 3 AND p.i + 6 WHERE p.cond = 'purchase'"


def large_group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and the median deviation of all lines' prices, as one group and by their return flags."""
    rows = B.stored(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("grp"), F.col("l_extendedprice").cast("double").alias("v"))
    ranks = selection.percentiles(rows, ["grp"], "v", {"p10": 10, "p50": 50, "p95": 95}, FIT)
    return ranks.join(selection.deviations(rows, ["grp"], "v", FIT), "grp").select("grp", *r6("p10", "p50", "p95", "mad"))


LARGE_GROUP_SQL = f"""
WITH r AS (SELECT unnest(['all', l_returnflag]) AS grp, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), l AS (SELECT grp, list_sort(list(v)) AS v, count(*) AS n FROM r GROUP BY 1),
m AS (SELECT grp, median(v) AS med FROM r GROUP BY 1), d AS (SELECT grp, median(abs(v - med)) AS mad FROM r JOIN m USING (grp) GROUP BY 1)
SELECT grp, round({_hazen_sql(10)}, 6) + 0.0 AS p10, round({_hazen_sql(50)}, 6) + 0.0 AS p50, round({_hazen_sql(95)}, 6) + 0.0 AS p95, round(mad, 6) + 0.0 AS mad FROM l JOIN d USING (grp)
"""


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image whose rows are all vectors."""
    return B.stored(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("img"), F.col("vec_id").alias("r"), F.posexplode("embedding").alias("p", "x")).select("img", "r", F.col("p").cast("long").alias("c"), F.col("x").cast("double").alias("v"))


STRIP_SQL = "px AS (SELECT CAST(0 AS BIGINT) AS img, vec_id AS r, CAST(i - 1 AS BIGINT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) g(i))"


def strip_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.ridge(strip(spark, sf_dir), 0.1, side=SIDE).select("img", "r", "c", *r6("ridge"))


def strip_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.normalised(strip(spark, sf_dir), side=SIDE, fit=FIT).select("img", "r", "c", *r6("filt", "norm"))


def strip_area_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.area_opened(strip(spark, sf_dir).where(F.col("v") > ABOVE), 4, SIDE)


def strip_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 pixels of the strip as labels; of those of a middling area the brightest stay."""
    labels = strip(spark, sf_dir).select("img", "r", "c", F.when(F.col("v") > -0.05, F.expr("(r div 8) * 8 + c div 8 + 1")).otherwise(0).cast("long").alias("label"), F.col("v").alias("intensity"))
    return G.separated(G.label_statistics(labels).where("area between 40 and 46"), 12.0).select("img", "label", *r6("intensity"))


STRIP_SEPARATION_SQL = f"WITH RECURSIVE {_KEPT_SQL} SELECT last.img, last.label, round(it, 6) + 0.0 AS intensity FROM last JOIN ok ON ok.img = last.img AND ok.label = last.label".replace(PIXELS_SQL, STRIP_SQL).replace(f"{_REASON_SQL} IS NULL", "area BETWEEN 40 AND 46")

QUERIES = {f.__name__: f for f in (iir_long, purchase_windows, large_group_quantiles, strip_ridge, strip_normalised, strip_area_open, strip_separation)}
ORACLE_SQL = {
    "iir_long": IIR_LONG_SQL, "purchase_windows": PURCHASE_SQL, "large_group_quantiles": LARGE_GROUP_SQL, "strip_ridge": _ridge_sql().replace(PIXELS_SQL, STRIP_SQL), "strip_normalised": _norm_sql().replace(PIXELS_SQL, STRIP_SQL),
    "strip_area_open": AREA_OPEN_SQL.replace(PIXELS_SQL, STRIP_SQL), "strip_separation": STRIP_SEPARATION_SQL,
}
