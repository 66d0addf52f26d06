"""Queries on images, each with DuckDB SQL over the stored tables where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators import regions as G
from ..operators import tiles
from ..sources import bindings as B
from ..sources.records import zipped_regions
from .trace_queries import r6

PIXELS_SQL = "px AS (SELECT vec_id // 64 AS img, vec_id % 64 AS r, CAST(i - 1 AS BIGINT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) g(i))"
FRAMES_SQL = f"{PIXELS_SQL}, f AS (SELECT img // 4 AS trial, img % 4 + 1 AS frame, r, c, v FROM px)"
#: Cells' regions: a diagonal band each, whose rows and columns repeat.
REGIONS_SQL = "roi AS (SELECT cell, r, c FROM range(0, 4) a(cell), range(0, 64) b(r), range(0, 64) d(c) WHERE r // 16 = cell AND (c - 2 * r) % 64 BETWEEN 0 AND 5 AND c < 40)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, frame, r, c, v): four images are a trial's frames."""
    return B.image_pixels(spark, sf_dir).select(F.expr("img div 4").alias("trial"), (F.col("img") % 4 + 1).alias("frame"), "r", "c", "v")


def regions(spark: SparkSession) -> DataFrame:
    grid = spark.range(64).select(F.col("id").alias("r")).crossJoin(spark.range(40).select(F.col("id").alias("c")))
    return grid.where("(c - 2 * r) % 64 between 0 and 5").select(F.expr("r div 16").alias("cell"), "r", "c")


def mask(spark: SparkSession, sf_dir: str, above: float) -> DataFrame:
    return B.image_pixels(spark, sf_dir).where(F.col("v") > above).select("img", "r", "c")


def roi_exact_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 20 of every second frame is bad."""
    f = frames(spark, sf_dir)
    bad = f.where("r = 20 and frame % 2 = 0").select("trial", "frame", "r").distinct()
    return R.region_mean(f, regions(spark), bad_rows=bad).select("cell", "trial", "frame", *r6("mean_f"))


ROI_EXACT_SQL = f"WITH {FRAMES_SQL}, {REGIONS_SQL} SELECT cell, trial, frame, round(avg(CASE WHEN r = 20 AND frame % 2 = 0 THEN NULL ELSE v END), 6) + 0.0 AS mean_f FROM f JOIN roi USING (r, c) GROUP BY 1, 2, 3"


def roi_rectangle_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rectangle_mean(frames(spark, sf_dir), regions(spark)).select("cell", "trial", "frame", *r6("mean_f"))


ROI_RECTANGLE_SQL = f"""
WITH {FRAMES_SQL}, {REGIONS_SQL}, wr AS (SELECT cell, r, count(*) AS a FROM roi GROUP BY 1, 2), wc AS (SELECT cell, c, count(*) AS b FROM roi GROUP BY 1, 2)
SELECT cell, trial, frame, round(sum(a * b * v) / sum(a * b), 6) + 0.0 AS mean_f FROM f JOIN wr USING (r) JOIN wc USING (cell, c) GROUP BY 1, 2, 3
"""


def template_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    got = R.template(R.trial_images(f, exclude=f.where("trial = 1").select("trial").distinct()))
    return got.select("r", "c", *r6("v"), "n_trials")


TEMPLATE_SQL = f"WITH {FRAMES_SQL}, m AS (SELECT trial, r, c, avg(v) AS v FROM f WHERE trial <> 1 GROUP BY 1, 2, 3) SELECT r, c, round(avg(v), 6) + 0.0 AS v, count(v) AS n_trials FROM m GROUP BY 1, 2"


def capped_mean_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trial_images(frames(spark, sf_dir), cap=3).select("trial", "r", "c", *r6("v"))


CAPPED_SQL = f"WITH {FRAMES_SQL} SELECT trial, r, c, round(avg(v), 6) + 0.0 AS v FROM f WHERE frame <= 3 GROUP BY 1, 2, 3"


def rescale_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rescaled(B.image_pixels(spark, sf_dir)).select("img", "r", "c", "u", F.round(R.scaled_input(F.col("u"), "uint16"), 6).alias("scaled"))


RESCALE_SQL = f"""
WITH {PIXELS_SQL}, m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY img)),
u AS (SELECT img, r, c, CAST(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 65535 + 0.5), 0) AS BIGINT) AS u FROM m)
SELECT img, r, c, u, round(u / 65535.0, 6) AS scaled FROM u
"""


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.image_pixels(spark, sf_dir)
    by_mad, by_rank = R.row_artifacts(p, 8, 55, "mad", 2.0), R.row_artifacts(p, 8, 55, "percentile", 95)
    return by_mad.select("img", "r", *r6("line_var", "threshold"), "bad").join(by_rank.select("img", "r", F.col("bad").alias("bad_percentile"), F.round("threshold", 6).alias("cut")), ["img", "r"])


_VAR_SQL = f"{PIXELS_SQL}, lv AS (SELECT img, r, var_samp(v) AS line_var FROM px WHERE c BETWEEN 8 AND 55 GROUP BY 1, 2), m1 AS (SELECT *, median(line_var) OVER (PARTITION BY img) AS med FROM lv), m2 AS (SELECT *, med + 2.0 * median(abs(line_var - med)) OVER (PARTITION BY img) AS threshold FROM m1)"
_H = "greatest(1.0, least(n * 1.0, n * 0.95 + 0.5))"
BAD_ROWS_SQL = f"""
WITH {_VAR_SQL}, l AS (SELECT img, list_sort(list(line_var)) AS v, count(*) AS n FROM lv GROUP BY 1),
p AS (SELECT img, v[CAST(floor({_H}) AS INT)] + ({_H} - floor({_H})) * (v[least(CAST(floor({_H}) AS INT) + 1, n)] - v[CAST(floor({_H}) AS INT)]) AS cut FROM l)
SELECT img, r, round(line_var, 6) + 0.0 AS line_var, round(threshold, 6) + 0.0 AS threshold, line_var > threshold AS bad, line_var > cut AS bad_percentile, round(cut, 6) AS cut FROM m2 JOIN p USING (img)
"""


def artifact_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.image_pixels(spark, sf_dir)
    return R.artifacts_filled(p, R.row_artifacts(p, 8, 55, "mad", 2.0)).select("img", "r", "c", *r6("v", "level"))


ARTIFACT_FILL_SQL = f"""
WITH {_VAR_SQL}, j AS (SELECT px.*, line_var > threshold AS bad FROM px JOIN m2 USING (img, r)), k AS (SELECT *, median(CASE WHEN NOT bad THEN v END) OVER (PARTITION BY img) AS good FROM j)
SELECT img, r, c, round(CASE WHEN bad THEN good ELSE v END, 6) + 0.0 AS v, round(good, 6) + 0.0 AS level FROM k
"""


# SQL of the stencils


def _sql_at(c: str, o: int, edge: str, w: str) -> str:
    if o == 0:
        return c
    step, back = ("lag", "lead") if o < 0 else ("lead", "lag")
    far = f"{step}({c}, {abs(o)}) OVER {w}"
    if edge == "replicate":
        end = f"first_value({c}) OVER ({w[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if o < 0 else f"last_value({c}) OVER ({w[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"coalesce({far}, {end})"
    return f"coalesce({far}, {c})" if abs(o) == 1 else f"coalesce({far}, {step}({c}, 1) OVER {w}, {back}({c}, 1) OVER {w}, {c})"


def _sql_sum(c: str, weights, edge: str, line: str, order: str) -> str:
    w = f"(PARTITION BY img, {line} ORDER BY {order})"
    half = len(weights) // 2
    return " + ".join(f"({x!r}) * {_sql_at(c, o, edge, w)}" for o, x in zip(range(-half, half + 1), weights) if x)


def _sql_blur(source: str, out: dict[str, tuple[float, int | None]], value: str = "v") -> str:
    h = ", ".join(f"{_sql_sum(value, R.kernel(*s), 'replicate', 'r', 'c')} AS h{o}" for o, s in out.items())
    v = ", ".join(f"{_sql_sum(f'h{o}', R.kernel(*s), 'replicate', 'c', 'r')} AS {o}" for o, s in out.items())
    return f"(SELECT *, {v} FROM (SELECT *, {h} FROM {source}))"


def _sql_hessian(source: str, columns: dict[str, float]) -> str:
    a = ", ".join(f"{_sql_sum(c, R.SECOND, 'mirror', 'r', 'c')} AS xx{c}, {_sql_sum(c, R.FIRST, 'mirror', 'r', 'c')} AS x{c}" for c in columns)
    d = ", ".join(f"{s * s!r} * xx{c} AS gxx{c}, {s * s!r} * ({_sql_sum(c, R.SECOND, 'mirror', 'c', 'r')}) AS gyy{c}, {s * s!r} * ({_sql_sum(f'x{c}', R.FIRST, 'mirror', 'c', 'r')}) AS gxy{c}" for c, s in columns.items())
    m = ", ".join(f"0.5 * (gxx{c} + gyy{c} + sqrt((gxx{c} - gyy{c}) * (gxx{c} - gyy{c}) + 4.0 * gxy{c} * gxy{c})) AS ma{c}, 0.5 * (gxx{c} + gyy{c} - sqrt((gxx{c} - gyy{c}) * (gxx{c} - gyy{c}) + 4.0 * gxy{c} * gxy{c})) AS mb{c}" for c in columns)
    e = ", ".join(f"CASE WHEN abs(ma{c}) > abs(mb{c}) THEN mb{c} ELSE ma{c} END AS {c}_l1, CASE WHEN abs(ma{c}) > abs(mb{c}) THEN ma{c} ELSE mb{c} END AS {c}_l2" for c in columns)
    return f"(SELECT *, {e} FROM (SELECT *, {m} FROM (SELECT *, {d} FROM (SELECT *, {a} FROM {source}))))"


def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blurred(B.image_pixels(spark, sf_dir), {"narrow": (0.7, None), "wide": (2.0, None)}).select("img", "r", "c", *r6("narrow", "wide"))


BLUR_SQL = f"WITH {PIXELS_SQL} SELECT img, r, c, round(narrow, 6) + 0.0 AS narrow, round(wide, 6) + 0.0 AS wide FROM {_sql_blur('px', {'narrow': (0.7, None), 'wide': (2.0, None)})}"


def hessian_eig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hessian(R.blurred(B.image_pixels(spark, sf_dir), {"g": (1.0, 3)}), {"g": 1.0}).select("img", "r", "c", *r6("g_l1", "g_l2"))


HESSIAN_SQL = f"WITH {PIXELS_SQL}, b AS {_sql_blur('px', {'g': (1.0, 3)})} SELECT img, r, c, round(g_l1, 6) + 0.0 AS g_l1, round(g_l2, 6) + 0.0 AS g_l2 FROM {_sql_hessian('b', {'g': 1.0})}"


def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tiles in arrays; strip_ridge has one image of many tiles, tests hold both against the window expressions."""
    return tiles.ridge(B.image_pixels(spark, sf_dir), 0.1).select("img", "r", "c", *r6("ridge"))


def _ridge_sql() -> str:
    scales = {f"g{t}": t / 6.0 for t in (4, 6, 8, 10, 12, 14)}
    v = [f"CASE WHEN {c}_l2 >= 0 THEN 0.0 ELSE exp(-({c}_l1 * {c}_l1 / CASE WHEN {c}_l2 = 0 THEN {R.EPS!r} ELSE {c}_l2 * {c}_l2 END) / 0.5) * (1.0 - exp(-({c}_l1 * {c}_l1 + {c}_l2 * {c}_l2) / {2.0 * 0.1 * 0.1!r})) END" for c in scales]
    return f"WITH {PIXELS_SQL}, b AS {_sql_blur('px', {c: (s, math.ceil(3.0 * s)) for c, s in scales.items()})} SELECT img, r, c, round(greatest(0.0, {', '.join(v)}), 6) + 0.0 AS ridge FROM {_sql_hessian('b', scales)}"


def normalised_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalised(B.image_pixels(spark, sf_dir)).select("img", "r", "c", *r6("filt", "norm"))


def _norm_sql() -> str:
    def at(p):
        h = f"greatest(1.0, least(n * 1.0, n * {p / 100!r} + 0.5))"
        return f"x[CAST(floor({h}) AS INT)] + ({h} - floor({h})) * (x[least(CAST(floor({h}) AS INT) + 1, n)] - x[CAST(floor({h}) AS INT)])"

    return f"""
WITH {PIXELS_SQL}, b AS {_sql_blur('px', {'filt': (0.7, None)})}, l AS (SELECT img, list_sort(list(filt)) AS x, count(*) AS n FROM b WHERE v > 0 GROUP BY img),
p AS (SELECT img, {at(10)} AS lo, {at(99)} AS hi FROM l)
SELECT img, r, c, round(filt, 6) + 0.0 AS filt, round(coalesce(least(1.0, greatest(0.0, (filt - lo) / greatest(hi - lo, {R.EPS!r}))), filt), 6) + 0.0 AS norm FROM b LEFT JOIN p USING (img)
"""


def _disk_sql(radius: int) -> str:
    return ", ".join(f"({r}, {c})" for r, c in R.disk(radius))


ABOVE, RING_ABOVE = 0.2, 0.3


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dilated(mask(spark, sf_dir, RING_ABOVE), 3, 64, 64)


def _dilate_sql(name: str, radius: int, source: str = "m") -> str:
    return f"{name} AS (SELECT DISTINCT img, r + dr AS r, c + dc AS c FROM {source}, (VALUES {_disk_sql(radius)}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 63 AND c + dc BETWEEN 0 AND 63)"


DILATE_SQL = f"WITH {PIXELS_SQL}, m AS (SELECT img, r, c FROM px WHERE v > {RING_ABOVE}), {_dilate_sql('d', 3)} SELECT img, r, c FROM d"


def area_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.area_opened(mask(spark, sf_dir, ABOVE), 4)


def _open_sql(source: str, least: int) -> str:
    # the pixels that each pixel's component reaches
    return f"reach AS (SELECT img, r, c, r AS r2, c AS c2 FROM {source} UNION SELECT reach.img, reach.r, reach.c, o.r, o.c FROM reach JOIN {source} o ON o.img = reach.img AND o.r BETWEEN reach.r2 - 1 AND reach.r2 + 1 AND o.c BETWEEN reach.c2 - 1 AND reach.c2 + 1), opened AS (SELECT img, r, c FROM reach GROUP BY 1, 2, 3 HAVING count(*) >= {least})"


AREA_OPEN_SQL = f"WITH RECURSIVE {PIXELS_SQL}, m AS (SELECT img, r, c FROM px WHERE v > {ABOVE}), {_open_sql('m', 4)} SELECT img, r, c FROM opened"


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.image_pixels(spark, sf_dir)
    return R.ring(mask(spark, sf_dir, 0.42), p, 64, 64, least_component=3)


_RH = "greatest(1.0, least(n * 1.0, n * 0.95 + 0.5))"
RING_SQL = f"""
WITH RECURSIVE {PIXELS_SQL}, seed AS (SELECT img, r, c FROM px WHERE v > 0.42), {_dilate_sql('far', 5, 'seed')}, {_dilate_sql('near', 2, 'seed')},
raw AS (SELECT far.img, far.r, far.c, v FROM far JOIN px USING (img, r, c) ANTI JOIN near USING (img, r, c)),
l AS (SELECT img, list_sort(list(v)) AS v, count(*) AS n FROM raw GROUP BY 1),
cut AS (SELECT img, v[CAST(floor({_RH}) AS INT)] + ({_RH} - floor({_RH})) * (v[least(CAST(floor({_RH}) AS INT) + 1, n)] - v[CAST(floor({_RH}) AS INT)]) AS cut FROM l),
m AS (SELECT raw.img, r, c FROM raw JOIN cut USING (img) WHERE v <= cut), {_open_sql('m', 3)},
big AS (SELECT img FROM opened GROUP BY 1 HAVING count(*) >= 50)
SELECT img, r, c FROM opened SEMI JOIN big USING (img) UNION ALL SELECT img, r, c FROM raw ANTI JOIN big USING (img)
"""


def union_and_ring_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of any cell's region, numbered down the columns, and how many of each image's bright pixels lie outside."""
    own = R.column_major(regions(spark).select(F.lit(0).cast("long").alias("g"), "r", "c").distinct(), ["g"])
    outside = mask(spark, sf_dir, ABOVE).join(own, ["r", "c"], "left_anti").groupBy("img").agg(F.count(F.lit(1)).alias("outside"))
    inside = mask(spark, sf_dir, ABOVE).join(own, ["r", "c"]).groupBy("img").agg(F.sum("k").alias("numbers"))
    return outside.join(inside, "img", "left")


UNION_SQL = f"""
WITH {PIXELS_SQL}, {REGIONS_SQL}, u AS (SELECT r, c, row_number() OVER (ORDER BY c, r) AS k FROM (SELECT DISTINCT r, c FROM roi)), m AS (SELECT img, r, c FROM px WHERE v > {ABOVE})
SELECT img, count(*) FILTER (WHERE k IS NULL) AS outside, CAST(sum(k) AS BIGINT) AS numbers FROM m LEFT JOIN u USING (r, c) GROUP BY img
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 pixels as labels; their dim pixels are background."""
    return B.image_pixels(spark, sf_dir).select("img", "r", "c", F.when(F.col("v") > -0.05, F.expr("(r div 8) * 8 + c div 8 + 1")).otherwise(0).cast("long").alias("label"), F.col("v").alias("intensity"))


LABELS_SQL = f"{PIXELS_SQL}, lb AS (SELECT img, r, c, CAST(CASE WHEN v > -0.05 THEN (r // 8) * 8 + c // 8 + 1 ELSE 0 END AS BIGINT) AS label, v AS intensity FROM px)"
STATS_SQL = f"{LABELS_SQL}, st AS (SELECT img, label, count(*) AS area, avg(r) AS cr, avg(c) AS cc, avg(intensity) AS it, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lb WHERE label > 0 GROUP BY 1, 2)"
RULES = G.Quality(min_area=40, max_area=46, separation=12.0, border=2, max_cells=6, dilation=2)


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_statistics(labels(spark, sf_dir)).select("img", "label", "area", *r6("centroid_r", "centroid_c", "intensity"))


LABEL_STATS_SQL = f"WITH {STATS_SQL} SELECT img, label, area, round(cr, 6) + 0.0 AS centroid_r, round(cc, 6) + 0.0 AS centroid_c, round(it, 6) + 0.0 AS intensity FROM st"


def roi_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judged(G.label_statistics(labels(spark, sf_dir)), RULES, 64, 64).select("img", "label", "area", "reject_reason")


_REASON_SQL = "CASE WHEN r0 < 2 OR c0 < 2 OR r1 >= 62 OR c1 >= 62 THEN 'within 2 px of border' WHEN area < 40 THEN 'area ' || area || ' < minAreaPx 40' WHEN area > 46 THEN 'area ' || area || ' > maxAreaPx 46' END"
QUALITY_SQL = f"WITH {STATS_SQL} SELECT img, label, area, {_REASON_SQL} AS reject_reason FROM st"


def roi_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.close_pairs(G.label_statistics(labels(spark, sf_dir)), RULES.separation).select("img", "a", "b", *r6("distance"))


CONFLICTS_SQL = f"WITH {STATS_SQL} SELECT x.img, x.label AS a, y.label AS b, round(sqrt((x.cr - y.cr) ** 2 + (x.cc - y.cc) ** 2), 6) + 0.0 AS distance FROM st x JOIN st y ON x.img = y.img AND x.label < y.label WHERE sqrt((x.cr - y.cr) ** 2 + (x.cc - y.cc) ** 2) < 12.0"


def roi_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = G.judged(G.label_statistics(labels(spark, sf_dir)), RULES, 64, 64).where("reject_reason is null")
    return G.separated(passed, RULES.separation).select("img", "label", *r6("intensity"))


#: A region stays once all brighter ones have been looked at and none that stays is too near: one step a rank.
_KEPT_SQL = f"""{STATS_SQL}, ok AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY it DESC, label) AS rk FROM st WHERE {_REASON_SQL} IS NULL),
kept(img, rk, chosen) AS (SELECT img, CAST(0 AS BIGINT), [{{'label': CAST(0 AS BIGINT), 'r': CAST(-1e9 AS DOUBLE), 'c': CAST(-1e9 AS DOUBLE)}}] FROM (SELECT DISTINCT img FROM ok)
  UNION ALL SELECT k.img, k.rk + 1, CASE WHEN len(list_filter(chosen, lambda x: (x.r - cr) ** 2 + (x.c - cc) ** 2 < 144.0)) = 0 THEN list_append(chosen, {{'label': label, 'r': cr, 'c': cc}}) ELSE chosen END FROM kept k JOIN ok ON ok.img = k.img AND ok.rk = k.rk + 1),
last AS (SELECT img, unnest(chosen).label AS label FROM kept QUALIFY row_number() OVER (PARTITION BY img ORDER BY rk DESC) = 1)"""
SEPARATION_SQL = f"WITH RECURSIVE {_KEPT_SQL} SELECT last.img, last.label, round(it, 6) + 0.0 AS intensity FROM last JOIN ok ON ok.img = last.img AND ok.label = last.label"


def rough_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, _ = G.rough_regions(labels(spark, sf_dir), RULES, 64, 64)
    return pixels.select("img", "cell", "r", "c", "k")


ROUGH_SQL = f"""
WITH RECURSIVE {_KEPT_SQL}, top AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.img ORDER BY it DESC, ok.label) AS b FROM ok JOIN last ON ok.img = last.img AND ok.label = last.label),
cell AS (SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY cr, cc, label) AS cell FROM top WHERE b <= 6),
grown AS (SELECT DISTINCT lb.img, cell, r + dr AS r, c + dc AS c FROM lb JOIN cell ON lb.img = cell.img AND lb.label = cell.label, (VALUES {_disk_sql(2)}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 63 AND c + dc BETWEEN 0 AND 63)
SELECT img, cell, r, c, row_number() OVER (PARTITION BY img, cell ORDER BY c, r) AS k FROM grown
"""


def roi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = G.rough_regions(labels(spark, sf_dir), RULES, 64, 64)
    return report.select("img", "label", "area", "cell", "reject_reason")


REPORT_SQL = f"""
WITH RECURSIVE {_KEPT_SQL}, top AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.img ORDER BY it DESC, ok.label) AS b FROM ok JOIN last ON ok.img = last.img AND ok.label = last.label),
cell AS (SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY cr, cc, label) AS cell FROM top WHERE b <= 6)
SELECT st.img, st.label, st.area, cell, coalesce(why, CASE WHEN top.label IS NULL THEN 'centroid < minSeparationPx (12 px) from a kept cell' WHEN cell IS NULL THEN 'beyond maxCells cap (6)' END) AS reject_reason
FROM (SELECT img, label, area, {_REASON_SQL} AS why FROM st) st LEFT JOIN top ON st.img = top.img AND st.label = top.label LEFT JOIN cell ON st.img = cell.img AND st.label = cell.label
"""


REPORT_JSON_SQL = f"""
{REPORT_SQL.rsplit("SELECT st.img", 1)[0]}, rep AS (SELECT st.img{REPORT_SQL.rsplit("SELECT st.img", 1)[1]})
SELECT img, count(*) AS raw, count(cell) AS accepted, '{{"raw":' || count(*) || ',"accepted":' || count(cell) || ',"order":[' || coalesce(string_agg(CAST(label AS VARCHAR), ',' ORDER BY cell) FILTER (WHERE cell IS NOT NULL), '') || '],"labels":['
  || string_agg('{{"label":' || label || ',"area":' || area || CASE WHEN reject_reason IS NULL THEN '' ELSE ',"reject_reason":"' || reject_reason || '"' END || '}}', ',' ORDER BY label) || ']}}' AS report
FROM rep GROUP BY img
"""


def roi_zip_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of rows and columns, counted from 1, as a vector's positions and the sizes of its elements give them."""
    lists = B.stored(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 64) + 1).alias("x"), F.transform("embedding", lambda e, i: i + 1).alias("y"))
    return zipped_regions(lists)


ZIP_SQL = """
WITH p AS (SELECT vec_id AS cell, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 64) AS BIGINT) AS r, CAST(i - 1 AS BIGINT) AS c FROM embeddings, range(1, 65) g(i))
SELECT cell, r, c, row_number() OVER (PARTITION BY cell ORDER BY c, r) AS k FROM p
"""


def roi_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = G.rough_regions(labels(spark, sf_dir), RULES, 64, 64)
    return G.report_json(report)


def _cells(spark: SparkSession) -> DataFrame:
    """Rough cells: three squares of 16 pixels."""
    grid = spark.range(16).select(F.col("id").alias("i")).crossJoin(spark.range(16).select(F.col("id").alias("j"))).crossJoin(spark.range(3).select(F.col("id").alias("cell")))
    return grid.select("cell", (F.col("i") + 4 + F.col("cell") * 20).alias("r"), (F.col("j") + 6 + F.col("cell") * 18).alias("c"))


def fine_roi_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine regions and rings of the mean of all images."""
    mean = R.template(B.image_pixels(spark, sf_dir).withColumnRenamed("img", "trial")).select("r", "c", (F.col("v") + 0.5).alias("v"))
    fine, around = G.fine_regions(mean, _cells(spark), 64, 64, 0.1)
    return fine.withColumn("kind", F.lit("fine")).unionByName(around.withColumn("kind", F.lit("ring"))).select("kind", "cell", "r", "c")


def fine_roi_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine regions and rings of each trial's mean image."""
    images = R.trial_images(frames(spark, sf_dir)).withColumn("v", F.col("v") + 0.5)
    fine = G.trial_fine_regions(images, _cells(spark), 0.1)
    rings = G.trial_rings(fine, images, R.dilated(_cells(spark), 5, 64, 64, ("cell",)), 64, 64)
    return fine.withColumn("kind", F.lit("fine")).unionByName(rings.withColumn("kind", F.lit("ring"))).select("kind", "cell", "trial", "r", "c")


QUERIES = {f.__name__: f for f in (
    roi_exact_mean, roi_rectangle_mean, template_image, capped_mean_image, rescale_u16, bad_rows, artifact_fill, gaussian_blur, hessian_eig, ridge, normalised_image, dilate, area_open, ring, union_and_ring_pixels,
    label_stats, roi_quality, roi_conflicts, roi_separation, rough_rois, roi_report, roi_report_json, roi_zip_load, fine_roi_global, fine_roi_trial)}
ORACLE_SQL = {
    "roi_exact_mean": ROI_EXACT_SQL, "roi_rectangle_mean": ROI_RECTANGLE_SQL, "template_image": TEMPLATE_SQL, "capped_mean_image": CAPPED_SQL, "rescale_u16": RESCALE_SQL, "bad_rows": BAD_ROWS_SQL,
    "artifact_fill": ARTIFACT_FILL_SQL, "gaussian_blur": BLUR_SQL, "hessian_eig": HESSIAN_SQL, "ridge": _ridge_sql(), "normalised_image": _norm_sql(), "dilate": DILATE_SQL, "area_open": AREA_OPEN_SQL, "ring": RING_SQL,
    "union_and_ring_pixels": UNION_SQL, "label_stats": LABEL_STATS_SQL, "roi_quality": QUALITY_SQL, "roi_conflicts": CONFLICTS_SQL, "roi_separation": SEPARATION_SQL, "rough_rois": ROUGH_SQL, "roi_report": REPORT_SQL,
    "roi_report_json": REPORT_JSON_SQL, "roi_zip_load": ZIP_SQL,
}
