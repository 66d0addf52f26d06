"""Queries on trials, traces and sweeps, each with DuckDB SQL over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import recursive
from ..operators import traces as T
from ..operators import trials as TR
from ..sources import bindings as B

#: A session's parameters: frames a second, pulses, and the window in ms; windows hold 32 frames, 16 of them before the stimulus.
FREQ, IPI, PULSES, PRE, POST = 500.0, 5.0, 1.0, 33.0, 24.0
#: Onset of the one stimulus of a trial (s), so that its window starts at frame 17; every 50th trial is excluded.
ONSET, WINDOW, PRE_POINTS, SKIPPED = 0.0675, 32, 16, 50

TRACES_SQL = "t AS (SELECT vec_id AS trial, CAST(label AS BIGINT) + 1 AS cond, CAST(i AS BIGINT) AS frame, CAST(embedding[i] AS DOUBLE) + 1.0 AS v FROM embeddings, range(1, 65) g(i))"
SWEEPS_SQL = "e AS (SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS cond, value AS v, event_id FROM events)"
T95_SQL = "q(df, t) AS (VALUES " + ", ".join(f"({k}, {N.t_quantile(0.975, k)!r})" for k in range(1, 401)) + ")"


def r6(*columns: str) -> list:
    """Rounded to six decimals, without negative zeros, as sums differ in order."""
    return [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns]


def _holo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, cond, k, v) of the stimulus window; excluded trials' values are NULL."""
    points = B.traces(spark, sf_dir).where(F.col("frame").between(17, 16 + WINDOW)).withColumn("k", F.col("frame") - 16)
    return points.withColumn("v", F.when(F.col("trial") % SKIPPED != 0, F.col("v")))


WINDOWS_SQL = f"{TRACES_SQL}, w AS (SELECT trial, cond, frame - 16 AS k, CASE WHEN trial % {SKIPPED} <> 0 THEN v END AS v FROM t WHERE frame BETWEEN 17 AND {16 + WINDOW})"
DFF_SQL = f"{WINDOWS_SQL}, b AS (SELECT trial, avg(v) AS f0 FROM w WHERE k <= {PRE_POINTS} GROUP BY trial), d AS (SELECT w.trial, cond, k, v, f0, (v - f0) / nullif(f0, 0) AS dff FROM w JOIN b ON w.trial = b.trial)"


def holo_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = T.relative_change(_holo_windows(spark, sf_dir), ["trial"], PRE_POINTS)
    return T.mean_interval(change, ["cond", "k"]).select("cond", "k", "n_cols", "n", *r6("mean", "sd", "lo", "hi", "ci_lo", "ci_hi"))


HOLO_MEAN_CI_SQL = f"""
WITH {DFF_SQL}, {T95_SQL},
g AS (SELECT cond, k, avg(dff) AS mean, CASE WHEN count(dff) = 1 THEN 0.0 ELSE stddev_samp(dff) END AS sd, count(*) AS n_cols, count(dff) AS n FROM d GROUP BY cond, k),
h AS (SELECT g.*, sd / sqrt(n_cols) * t AS half FROM g LEFT JOIN q ON q.df = n_cols - 1)
SELECT cond, k, n_cols, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(mean - half, 6) + 0.0 AS lo, round(mean + half, 6) + 0.0 AS hi,
       round(-(mean - half), 6) + 0.0 AS ci_lo, round(-(mean + half), 6) + 0.0 AS ci_hi FROM h
"""


def trial_dff(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = B.traces(spark, sf_dir).select("trial").distinct().select("trial", F.lit(1).cast("long").alias("holo"), F.lit(ONSET).alias("onset"))
    points = T.windows(B.traces(spark, sf_dir), onsets, FREQ, IPI, PULSES, PRE, POST)
    return T.relative_change(points, ["trial", "holo"], N.pre_length(FREQ, PRE), "2").select("trial", "cond", "holo", "k", *r6("v", "f0", "dff"))


_LO, _HI = "CAST(floor((0.0675 - 33.0 / 1000) * 500.0) AS BIGINT)", "CAST(ceil((0.0675 - 33.0 / 1000) * 500.0) + ceil((5.0 * 1 + 33.0 + 24.0) / 1000 * 500.0) AS BIGINT)"
TRIAL_DFF_SQL = f"""
WITH {TRACES_SQL}, s AS (SELECT trial, cond, CAST(1 AS BIGINT) AS holo, frame - {_LO} + 1 AS k, v FROM t WHERE frame BETWEEN {_LO} AND {_HI}),
b AS (SELECT trial, avg(v) AS f0 FROM s WHERE k <= {N.pre_length(FREQ, PRE)} GROUP BY trial)
SELECT s.trial, cond, holo, k, round(v, 6) + 0.0 AS v, round(f0, 6) + 0.0 AS f0, round(-((v - f0) / nullif(f0, 0)), 6) + 0.0 AS dff FROM s JOIN b ON s.trial = b.trial
"""

PRE_END, WIDTH = 24, 5


def trial_dff_common_f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.traces(spark, sf_dir)
    base = T.rolling_baseline(rows, ["trial"], PRE_END, WIDTH)
    points = rows.where(F.col("frame").between(17, 16 + WINDOW)).withColumn("k", F.col("frame") - 16)
    return T.common_baseline_change(points, base, ["trial"]).select("trial", "cond", "k", "start", F.col("f0_v").alias("f0"), "dff").select("trial", "cond", "k", "start", *r6("f0", "dff"))


TRIAL_DFF_COMMON_SQL = f"""
WITH {TRACES_SQL},
a AS (SELECT * FROM (SELECT trial, frame AS start, var_pop(v) OVER w AS var, avg(v) OVER w AS f0 FROM t WINDOW w AS (PARTITION BY trial ORDER BY frame ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) WHERE start <= {PRE_END - WIDTH + 1}),
b AS (SELECT trial, arg_min(start, var) AS start, arg_min(f0, var) AS f0 FROM a GROUP BY trial)
SELECT t.trial, cond, frame - 16 AS k, start, round(f0, 6) + 0.0 AS f0, round((v - f0) / nullif(f0, 0), 6) + 0.0 AS dff
FROM t JOIN b ON t.trial = b.trial WHERE frame BETWEEN 17 AND {16 + WINDOW}
"""


def pulse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: a pulse for each purchase, where the first and the last stand after a lead of 1 ms an event, and the trimmed range before the first."""
    counts = B.sweeps(spark, sf_dir).groupBy("trial").agg(F.count_if(F.col("cond") == "purchase").alias("n_pulses"), F.count(F.lit(1)).alias("lead"))
    got = counts.withColumn("at", N.pulse_positions(F.col("n_pulses"), IPI, 0.0, FREQ)).where("at is not null")
    first = F.get("at", F.lit(0)) + F.col("lead") / 1000 * FREQ
    low, high = N.trimmed_range(first, FREQ)
    return got.select("trial", "n_pulses", *[(F.round(x, 6) + 0.0).alias(n) for n, x in (("first_at", first), ("last_at", F.element_at("at", -1) + F.col("lead") / 1000 * FREQ))], low.alias("low"), high.alias("high"))


PULSES_SQL = f"""
WITH {SWEEPS_SQL}, n AS (SELECT trial, count(*) FILTER (WHERE cond = 'purchase') AS n_pulses, count(*) AS lead FROM e GROUP BY trial),
p AS (SELECT *, lead / 1000 * {FREQ} AS first_at, (n_pulses - 1) * {IPI} / 1000 * {FREQ} + lead / 1000 * {FREQ} AS last_at FROM n WHERE n_pulses > 0),
q AS (SELECT *, greatest(1, CAST(round(first_at) AS BIGINT) - 1) AS last_before FROM p)
SELECT trial, n_pulses, round(first_at, 6) + 0.0 AS first_at, round(last_at, 6) + 0.0 AS last_at, least(last_before, 2) AS low, greatest(least(last_before, 2), last_before - 1) AS high FROM q
"""


def window_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps: padded windows of 40 points from 15 before a user's first purchase."""
    sweeps = B.sweeps(spark, sf_dir)
    onsets = sweeps.where("cond = 'purchase'").groupBy("trial").agg(F.min("i").cast("double").alias("onset")).withColumn("holo", F.lit(1).cast("long"))
    return T.padded_windows(sweeps.select("trial", F.col("i").alias("frame"), "v"), onsets, 40, 1.0, 15000.0).select("trial", "holo", "k", "v")


WINDOW_EXTRACT_SQL = f"""
WITH {SWEEPS_SQL}, o AS (SELECT trial, min(i) - 15 AS lo FROM e WHERE cond = 'purchase' GROUP BY trial),
s AS (SELECT trial, lo, CAST(k AS BIGINT) AS k FROM o, range(1, 41) g(k))
SELECT s.trial, CAST(1 AS BIGINT) AS holo, s.k, e.v FROM s LEFT JOIN e ON e.trial = s.trial AND e.i = s.lo + s.k - 1
"""


def window_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweeps = B.sweeps(spark, sf_dir)
    onsets = sweeps.groupBy("trial", F.col("cond").alias("holo")).agg((F.min("i") / 10.0).alias("onset"))
    return T.window_lengths(sweeps.groupBy("trial").agg(F.count(F.lit(1)).alias("n")), onsets, 10.0, 100.0, 3.0, 450.0, 1200.0)


WINDOW_LENGTHS_SQL = f"""
WITH {SWEEPS_SQL}, n AS (SELECT trial, count(*) AS n FROM e GROUP BY trial), o AS (SELECT trial, cond, min(i) / 10.0 AS onset FROM e GROUP BY 1, 2),
b AS (SELECT trial, CAST(floor((onset - 450.0 / 1000) * 10.0) AS BIGINT) AS lo, CAST(ceil((onset - 450.0 / 1000) * 10.0) + ceil((100.0 * 3 + 450.0 + 1200.0) / 1000 * 10.0) AS BIGINT) AS hi FROM o),
r AS (SELECT min(hi - lo + 1) AS nominal, min(CASE WHEN least(n, hi) - greatest(1, lo) + 1 > 0 THEN least(n, hi) - greatest(1, lo) + 1 END) AS overlap FROM b JOIN n USING (trial))
SELECT nominal, overlap, greatest(least(nominal, coalesce(overlap, nominal)), 1) AS used FROM r
"""


def baseline_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.baselined(B.sweeps(spark, sf_dir), 20, 55.0).select("event_id", "trial", *r6("baseline", "corrected"), "excluded")


BASELINE_SQL = f"""
WITH {SWEEPS_SQL}, b AS (SELECT *, avg(CASE WHEN i <= 20 THEN v END) OVER (PARTITION BY trial) AS baseline FROM e)
SELECT event_id, trial, round(baseline, 6) + 0.0 AS baseline, round(v - baseline, 6) + 0.0 AS corrected, coalesce(baseline > 55.0, false) AS excluded FROM b
"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrended(_holo_windows(spark, sf_dir), ["trial"], PRE_POINTS, FREQ)


FLAT_SQL = f"""{WINDOWS_SQL}, x AS (SELECT *, (k - {(1 + PRE_POINTS) / 2}) / {FREQ} AS s FROM w),
l AS (SELECT trial, regr_slope(v, s) AS a, regr_intercept(v, s) AS b FROM x WHERE k <= {PRE_POINTS} GROUP BY trial),
y AS (SELECT x.trial, cond, k, v - coalesce(a * s + b, 0.0) AS rest FROM x LEFT JOIN l ON x.trial = l.trial),
f AS (SELECT trial, cond, k, rest - median(CASE WHEN k <= {PRE_POINTS} THEN rest END) OVER (PARTITION BY trial) AS flat FROM y)"""


def detrended_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("trial", "cond", "k", *r6("flat"))


def sweep_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mean_interval(_flat(spark, sf_dir), ["cond", "k"], "flat", "2").select("cond", "k", "n_cols", "n", *r6("mean", "ci_lo", "ci_hi"))


SWEEP_CI_SQL = f"""
WITH {FLAT_SQL}, {T95_SQL},
g AS (SELECT cond, k, avg(flat) AS mean, CASE WHEN count(flat) = 1 THEN 0.0 ELSE stddev_samp(flat) END AS sd, count(*) AS n_cols, count(flat) AS n FROM f GROUP BY cond, k),
h AS (SELECT g.*, sd / sqrt(n_cols) * t AS half FROM g LEFT JOIN q ON q.df = n_cols - 1)
SELECT cond, k, n_cols, n, round(mean, 6) + 0.0 AS mean, round(mean - half, 6) + 0.0 AS ci_lo, round(mean + half, 6) + 0.0 AS ci_hi FROM h
"""

#: Groups of trials for the excluder: a condition's trials in tens; its filtered column is a mean of three points.
def _change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = T.relative_change(_holo_windows(spark, sf_dir), ["trial"], PRE_POINTS).withColumn("holo", F.expr("trial div 100"))
    return d.withColumn("filt_dff", F.avg("dff").over(Window.partitionBy("trial").orderBy("k").rowsBetween(-1, 1)))


def trial_excluder(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.rejected(_change(spark, sf_dir), ["cond", "holo"], late=25)
    return got.select("cond", "holo", "trial", "k", *r6("sd_dff", "sd_filt_dff", "excl_dff", "excl_filt_dff"))


TRIAL_EXCLUDER_SQL = f"""
WITH {DFF_SQL}, z AS (SELECT cond, trial // 100 AS holo, trial, k, dff, avg(dff) OVER (PARTITION BY trial ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM d),
s AS (SELECT *, CASE WHEN count(*) OVER g = count(dff) OVER g THEN stddev_samp(dff) OVER g END AS sd, CASE WHEN count(*) OVER g = count(f) OVER g THEN stddev_samp(f) OVER g END AS sf FROM z WINDOW g AS (PARTITION BY cond, holo)),
a AS (SELECT *, CASE WHEN bool_or(coalesce(dff < -2.5 * sd, false)) OVER t THEN NULL ELSE dff END AS x, CASE WHEN bool_or(coalesce(f < -2.5 * sf, false)) OVER t THEN NULL ELSE f END AS y FROM s WINDOW t AS (PARTITION BY cond, holo, trial)),
p AS (SELECT cond, holo, trial, count(*) = count(y) AS whole, coalesce(arg_min(k, (-x, k)) FILTER (WHERE x IS NOT NULL), 1) AS px, coalesce(arg_min(k, (-y, k)) FILTER (WHERE y IS NOT NULL), 1) AS py FROM a GROUP BY 1, 2, 3)
SELECT cond, holo, trial, k, round(sd, 6) + 0.0 AS sd_dff, round(sf, 6) + 0.0 AS sd_filt_dff, round(CASE WHEN whole AND px > 25 THEN NULL ELSE x END, 6) + 0.0 AS excl_dff, round(CASE WHEN whole AND py > 25 THEN NULL ELSE y END, 6) + 0.0 AS excl_filt_dff
FROM a JOIN p USING (cond, holo, trial)
"""


def hazen_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.raster import percentiles

    got = percentiles(B.sweeps(spark, sf_dir), ["trial", "cond"], "v", {"p10": 10, "p50": 50, "p95": 95})
    return got.select("trial", "cond", *r6("p10", "p50", "p95"))


def _hazen_sql(p: float) -> str:
    h = f"greatest(1.0, least(n * 1.0, n * {p / 100!r} + 0.5))"
    return f"v[CAST(floor({h}) AS INT)] + ({h} - floor({h})) * (v[least(CAST(floor({h}) AS INT) + 1, n)] - v[CAST(floor({h}) AS INT)])"


HAZEN_SQL = f"""
WITH {SWEEPS_SQL}, l AS (SELECT trial, cond, list_sort(list(v)) AS v, count(*) AS n FROM e GROUP BY 1, 2)
SELECT trial, cond, round({_hazen_sql(10)}, 6) + 0.0 AS p10, round({_hazen_sql(50)}, 6) + 0.0 AS p50, round({_hazen_sql(95)}, 6) + 0.0 AS p95 FROM l
"""


def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.deviation_outliers(B.sweeps(spark, sf_dir), ["trial", "cond"])
    return got.groupBy("trial", "cond").agg(F.max("med").alias("med"), F.max("mad").alias("mad"), F.count_if("outlier").alias("outliers"), F.var_pop("v").alias("variance")).select("trial", "cond", *r6("med", "mad"), F.round("variance", 3).alias("variance"), "outliers")


MAD_SQL = f"""
WITH {SWEEPS_SQL}, m AS (SELECT *, median(v) OVER (PARTITION BY trial, cond) AS med FROM e), a AS (SELECT *, median(abs(v - med)) OVER (PARTITION BY trial, cond) AS mad FROM m)
SELECT trial, cond, round(max(med), 6) + 0.0 AS med, round(max(mad), 6) + 0.0 AS mad, round(var_pop(v), 3) AS variance, count_if(v > med + 3.0 * mad) AS outliers FROM a GROUP BY trial, cond
"""


def interleave_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.traces(spark, sf_dir).select("cond", (F.col("frame") - 1).alias("page"), F.col("trial").alias("pixel"), "v")
    return T.interleave_metrics(pages, ["cond"], ["pixel"]).select("cond", "n_pages", "n_channels", *r6("image_corr", "lag1", "lag2", "step1", "step2"))


INTERLEAVE_SQL = f"""
WITH {TRACES_SQL}, p AS (SELECT cond, frame - 1 AS page, trial AS pixel, v FROM t WHERE frame - 1 < 120),
i AS (SELECT cond, pixel, avg(CASE WHEN page % 2 = 0 THEN v END) AS o, avg(CASE WHEN page % 2 = 1 THEN v END) AS e FROM p GROUP BY 1, 2),
c AS (SELECT cond, corr(o, e) AS image_corr FROM i GROUP BY cond),
m AS (SELECT cond, page, avg(v) AS m FROM p GROUP BY 1, 2), l AS (SELECT *, lag(m, 1) OVER w AS m1, lag(m, 2) OVER w AS m2 FROM m WINDOW w AS (PARTITION BY cond ORDER BY page)),
s AS (SELECT cond, count(*) AS n_pages, corr(m, m1) AS lag1, corr(m, m2) AS lag2, avg(abs(m - m1)) AS step1, avg(abs(m - m2)) AS step2 FROM l GROUP BY cond)
SELECT cond, n_pages, CAST(CASE WHEN n_pages >= 4 AND image_corr < 0.9 AND (lag2 > lag1 + 0.1 OR step1 > 1.15 * step2) THEN 2 ELSE 1 END AS BIGINT) AS n_channels,
       round(image_corr, 6) + 0.0 AS image_corr, round(lag1, 6) + 0.0 AS lag1, round(lag2, 6) + 0.0 AS lag2, round(step1, 6) + 0.0 AS step1, round(step2, 6) + 0.0 AS step2 FROM c JOIN s USING (cond)
"""


def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.traces(spark, sf_dir).select("trial", (F.col("frame") - 1).alias("page"), "v")
    return TR.one_channel(pages, ["trial"])


CHANNEL_SPLIT_SQL = f"WITH {TRACES_SQL} SELECT trial, (frame - 1) // 2 AS page, v FROM t WHERE (frame - 1) % 2 = 0"

#: Coefficients of the imaging and the sweep filter.
CAUSAL = recursive.low_pass(4, 40.0, FREQ)
SWEEP = recursive.low_pass(4, 120.0, FREQ)


def iir_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.trace_arrays(spark, sf_dir).select("trial", recursive.causal(F.col("samples"), *CAUSAL).alias("y"))
    return rows.select("trial", F.posexplode("y").alias("p", "y")).select("trial", (F.col("p") + 1).cast("long").alias("frame"), *r6("y"))


def _recursion_sql(name: str, source: str, n: int, coefficients, start: list[float]) -> str:
    """A CTE name(trial, s, frame, y, z0..z3): the filter run over the arrays s of source(trial, s), from a state of `start` times the first sample."""
    b, a = coefficients
    state = lambda k, prev: f"{prev} + v * {b[k]!r} - ({a[k]!r}) * (v * {b[0]!r} + z0)"
    step = ", ".join(state(k, f"z{k}" if k < 4 else "0.0") + f" AS n{k - 1}" for k in range(1, 5))
    first = ", ".join(f"CAST({z!r} * s[1] AS DOUBLE)" for z in start)
    return f"""{name}(trial, s, frame, y, z0, z1, z2, z3) AS (
  SELECT trial, s, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), {first} FROM {source}
  UNION ALL SELECT trial, s, frame + 1, v * {b[0]!r} + z0, n0, n1, n2, n3 FROM (SELECT trial, s, frame, z0, v, {step} FROM (SELECT *, s[frame + 1] AS v FROM {name} WHERE frame < {n})))"""


SAMPLES_SQL = "x AS (SELECT vec_id AS trial, CAST(label AS BIGINT) + 1 AS cond, list_transform(embedding, lambda e: CAST(e AS DOUBLE) + 1.0) AS s FROM embeddings)"
CAUSAL_SQL = f"""
WITH RECURSIVE {SAMPLES_SQL}, {_recursion_sql("f", "x", 64, CAUSAL, [0.0] * 4)}
SELECT trial, frame, round(y, 6) + 0.0 AS y FROM f WHERE frame > 0
"""
_STEADY = recursive.steady_state(*SWEEP)
ZERO_PHASE_SQL = f"""
WITH RECURSIVE {SAMPLES_SQL},
w AS (SELECT trial, list_concat(list_concat(list_transform(range(1, 13), lambda j: 2 * s[1] - s[14 - j]), s), list_transform(range(1, 13), lambda j: 2 * s[64] - s[64 - j])) AS s FROM x),
{_recursion_sql("f", "w", 88, SWEEP, _STEADY)},
u AS (SELECT trial, list(y ORDER BY frame DESC) AS s FROM f WHERE frame > 0 GROUP BY trial),
{_recursion_sql("g", "u", 88, SWEEP, _STEADY)}
SELECT trial, 77 - frame AS frame, round(y, 6) + 0.0 AS y FROM g WHERE frame BETWEEN 13 AND 76
"""
FILTERED_SQL = f"""
WITH RECURSIVE {SAMPLES_SQL},
w AS (SELECT p.trial, p.cond, list_transform(range(1, 65), lambda i: p.s[i] - 0.85 * (q.s[i] * 0.5)) AS s FROM x p JOIN x q ON q.trial + 1 = p.trial),
{_recursion_sql("f", "w", 64, CAUSAL, [0.0] * 4)},
k AS (SELECT f.trial, cond, frame - 16 AS k, w.s[frame] AS c, y FROM f JOIN w ON f.trial = w.trial WHERE frame BETWEEN 17 AND {16 + WINDOW}),
b AS (SELECT trial, avg(c) AS f0, avg(y) AS g0 FROM k WHERE k <= {PRE_POINTS} GROUP BY trial)
SELECT k.trial, cond, k, round(f0, 6) + 0.0 AS f0, round((c - f0) / nullif(f0, 0), 6) + 0.0 AS dff, round((y - g0) / nullif(g0, 0), 6) + 0.0 AS filt_dff FROM k JOIN b ON k.trial = b.trial
"""


def iir_zero_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.trace_arrays(spark, sf_dir).select("trial", recursive.zero_phase(F.col("samples"), *SWEEP).alias("y"))
    return rows.select("trial", F.posexplode("y").alias("p", "y")).select("trial", (F.col("p") + 1).cast("long").alias("frame"), *r6("y"))


def trial_dff_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfiltered and filtered change of each trial's window, with each trial's neighbour as its surrounding."""
    rows = B.trace_arrays(spark, sf_dir)
    around = rows.select((F.col("trial") + 1).alias("trial"), F.transform("samples", lambda x: x * 0.5).alias("bk"))
    both = rows.join(around, "trial").select("trial", "cond", F.zip_with("samples", "bk", lambda x, y: x - T.ALPHA * y).alias("corr"))
    both = both.withColumn("filt", recursive.causal(F.col("corr"), *CAUSAL))
    points = both.select("trial", "cond", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("corr")).alias("frame"), "corr", "filt")).alias("x")).select("trial", "cond", F.col("x.frame").cast("long").alias("frame"), "x.corr", "x.filt")
    points = points.where(F.col("frame").between(17, 16 + WINDOW)).withColumn("k", F.col("frame") - 16)
    out = T.relative_change(points, ["trial"], PRE_POINTS, "1", "corr", "dff", "f0")
    out = T.relative_change(out, ["trial"], PRE_POINTS, "1", "filt", "filt_dff", "f0_filt")
    return out.select("trial", "cond", "k", *r6("f0", "dff", "filt_dff"))


# Trials


def holo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.stored(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("long").alias("value"), "l_partkey", "l_suppkey")
    return TR.holo_ids(lines, ["l_partkey", "l_suppkey", "value"])


HOLO_IDS_SQL = """
WITH p AS (SELECT l_orderkey AS trial, l_linenumber AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem),
f AS (SELECT trial, value, min(place) AS place FROM p GROUP BY 1, 2)
SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY place) AS position, CAST(value - min(value) OVER (PARTITION BY trial) + 1 AS BIGINT) AS holo FROM f
"""


def session_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = B.trials(spark, sf_dir).join(B.trial_points(spark, sf_dir), "trial").where("cond <> '1-URGENT' or pos <= 4")
    return TR.condition_counts(points, "1-URGENT").select("cond", "n_holos", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


SESSION_SQL = """
WITH p AS (SELECT DISTINCT o_orderpriority AS cond, l_linenumber AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority <> '1-URGENT' OR l_linenumber <= 4),
c AS (SELECT cond, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM p WHERE pos <> 0 GROUP BY cond)
SELECT cond, CASE WHEN cond = '1-URGENT' THEN max(n) OVER () ELSE n END AS n_holos, positions FROM c
"""


def session_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a session's record: each order is a trial and a condition, its lines give the sequence."""
    lines = B.stored(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("seq"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    orders = B.stored(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    own = orders.groupBy(F.col("o_custkey").alias("session")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "seq", "n", "quantity", F.substring("o_orderpriority", 1, 1).alias("p")))).alias("o"))
    raw = own.select(
        "session", F.lit(30).alias("imaging_freq"), F.lit(20000).alias("fs"), F.lit(2).alias("trial_time"), (F.size("o") * 250).alias("start_time_ms"), F.col("session").cast("string").alias("mouse_id"), F.col("o.p").alias("trial_cond"),
        F.col("o.quantity").alias("powers"), F.col("o.seq").alias("sequence"), F.col("o.seq").alias("sequence_this_trial"), F.transform("o.seq", lambda s: F.slice(s, 1, 1)).alias("first_stim_times"), F.col("o.n").alias("n_holos"),
        F.transform("o.quantity", lambda q: q % 3).alias("pulse_dur"), F.transform("o.n", lambda n: n % 4).alias("n_pulses"), F.col("o.p").alias("ipi"), F.transform("o.quantity", lambda q: q % 2).alias("next_holo_delay"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("none"))), ",").alias(c)
    got = TR.session_fields(raw).withColumns({"n_points": F.aggregate("sequence", F.lit(0).cast("long"), lambda s, x: s + F.size(x)), "n_onsets": F.aggregate("first_stim_times", F.lit(0).cast("long"), lambda s, x: s + F.size(x))})
    return got.select("session", "mouse_id", "imaging_freq", "start_time", "n_trials", "n_conds", "n_points", "n_onsets", *map(text, ("trial_cond", "powers", "n_holos", "pulse_durs")), "n_pulses", "ipi", "next_holo_delay")


SESSION_RECORD_SQL = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS session, o_orderkey AS k, n, q, CAST(left(o_orderpriority, 1) AS BIGINT) AS p FROM orders LEFT JOIN l ON k = o_orderkey),
r AS (SELECT session, count(*) AS n_trials, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_points, count(n) AS n_onsets, string_agg(CAST(p AS VARCHAR), ',' ORDER BY k) AS trial_cond, string_agg(coalesce(CAST(q AS VARCHAR), 'none'), ',' ORDER BY k) AS powers,
  list(n ORDER BY k) AS ns, max(n) AS most, string_agg(DISTINCT CAST(q % 3 AS VARCHAR), ',' ORDER BY CAST(q % 3 AS VARCHAR)) FILTER (WHERE q % 3 <> 0) AS durs,
  CAST(min(n % 4) FILTER (WHERE n % 4 <> 0) AS DOUBLE) AS n_pulses, CAST(min(p) FILTER (WHERE p <> 0) AS DOUBLE) AS ipi, CAST(min(q % 2) FILTER (WHERE q % 2 <> 0) AS DOUBLE) AS delay FROM o GROUP BY 1)
SELECT session, CAST(session AS VARCHAR) AS mouse_id, CAST(30 AS DOUBLE) AS imaging_freq, n_trials * 0.25::DOUBLE AS start_time, n_trials, n_trials AS n_conds, n_points, n_onsets, trial_cond, powers,
  array_to_string(list_transform(list_concat([most], ns[2:]), lambda x: coalesce(CAST(x AS VARCHAR), 'none')), ',') AS n_holos, coalesce(durs, '') AS pulse_durs, n_pulses, ipi, delay AS next_holo_delay FROM r
"""


def trial_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions known by the late half of the parts of their line numbers; one has no onsets and one isn't known at all."""
    points = B.trials(spark, sf_dir).join(B.trial_points(spark, sf_dir), "trial").where("cond <> '5-LOW'")
    conds = points.groupBy("cond").agg(F.count_distinct("pos").alias("n_holos"), F.array_sort(F.collect_set(F.when(F.col("cond") != "3-MEDIUM", F.col("pos") / 10.0))).alias("first_stim"))
    joined = TR.with_conditions(B.trials(spark, sf_dir), conds, "2-HIGH")
    return joined.select("trial", "cond", "excluded", "n_holos", F.array_join(F.transform("first_stim", lambda x: F.round(x * 10).cast("long").cast("string")), ",").alias("onsets"), "has_metadata")


METADATA_SQL = """
WITH p AS (SELECT o_orderpriority AS cond, l_linenumber AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2),
c AS (SELECT cond, count(*) AS n_holos, string_agg(CASE WHEN cond <> '3-MEDIUM' THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos) AS onsets FROM p GROUP BY cond),
d AS (SELECT onsets AS spare FROM c WHERE cond = '2-HIGH')
SELECT o_orderkey AS trial, o_orderpriority AS cond, o_orderstatus = 'F' AS excluded, n_holos, CASE WHEN n_holos IS NOT NULL THEN coalesce(onsets, (SELECT spare FROM d)) END AS onsets, n_holos IS NOT NULL AS has_metadata
FROM orders LEFT JOIN c ON cond = o_orderpriority
"""


def eligible_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.eligible(B.trials(spark, sf_dir), 100, 9000)


ELIGIBLE_SQL = "SELECT DISTINCT o_orderkey AS trial FROM orders WHERE o_orderkey BETWEEN 100 AND 9000 AND o_orderstatus <> 'F'"


def trial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.evenly_spaced(B.trials(spark, sf_dir), 25)


TRIAL_SAMPLE_SQL = """
WITH r AS (SELECT trial, row_number() OVER (ORDER BY trial) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey AS trial FROM orders))
SELECT trial, rank FROM r WHERE rank IN (SELECT 1 + CAST(floor(i * (n - 1) / 24) AS BIGINT) FROM range(0, 25) g(i), (SELECT max(n) AS n FROM r))
"""


def trial_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.progress(B.trials(spark, sf_dir))


PROGRESS_SQL = "SELECT o_orderpriority AS cond, count(*) AS n_trials, count_if(o_orderstatus = 'F') AS n_excluded, min(o_orderkey) AS first_trial, max(o_orderkey) AS last_trial FROM orders GROUP BY 1"


def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order as its record."""
    rows = B.stored(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.struct("o_orderdate", "o_orderkey").alias("name"), F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("price"))
    return TR.latest(rows, ["folder"], "name").select("folder", "record", "price")


LATEST_SQL = "SELECT o_custkey AS folder, o_orderkey AS record, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def trial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without leading zeros, so that the alphabetical number isn't the order's."""
    rows = B.stored(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.concat(F.lit("t_"), F.col("o_orderkey").cast("string"), F.lit("_mc.tif")).alias("path"))
    return TR.index_by_name(rows, ["folder"]).withColumn("parsed", F.regexp_extract("path", r"_(\d+)_mc\.tif$", 1).cast("long"))


TRIAL_INDEX_SQL = "SELECT o_custkey AS folder, 't_' || o_orderkey || '_mc.tif' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY 't_' || o_orderkey || '_mc.tif') AS trial, o_orderkey AS parsed FROM orders"


def electrode_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.sweeps(spark, sf_dir)
    both = TR.electrodes(e.where("cond <> 'click'"), e.where("cond = 'click'"))
    return both.groupBy("electrode", "trial").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).select("electrode", "trial", "n", *r6("mean"))


ELECTRODE_SQL = "SELECT CAST(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS BIGINT) AS electrode, user_id AS trial, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2"


def parity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces against a copy with one value in a hundred shifted and one trial in forty missing."""
    ours = B.traces(spark, sf_dir)
    theirs = ours.withColumn("v", F.when(F.col("trial") % 40 == 0, F.lit(None).cast("double")).when((F.col("trial") + F.col("frame")) % 100 == 0, F.col("v") + 0.001 * F.col("frame")).otherwise(F.col("v")))
    return T.difference_report(ours, theirs, ["trial", "frame"]).select("n", "n_both", *r6("max_abs", "max_rel"), "same_layout")


PARITY_SQL = f"""
WITH {TRACES_SQL}, u AS (SELECT v AS x, CASE WHEN trial % 40 = 0 THEN NULL WHEN (trial + frame) % 100 = 0 THEN v + 0.001 * frame ELSE v END AS y FROM t)
SELECT count(*) AS n, count(abs(x - y)) AS n_both, round(max(abs(x - y)), 6) + 0.0 AS max_abs, round(max(abs(x - y) / nullif(abs(y), 0)), 6) + 0.0 AS max_rel, bool_and((x IS NULL) = (y IS NULL)) AS same_layout FROM u
"""


def condition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of a group's values in the order of trials."""
    got = T.ordered_by_trial(_holo_windows(spark, sf_dir).withColumn("holo", F.expr("trial div 100")), ["cond", "holo"])
    return got.select("cond", "holo", "k", F.array_join(F.transform("trials", lambda x: x.cast("string")), ",").alias("trials"), F.size("values").cast("long").alias("n"))


COLUMNS_SQL = f"WITH {WINDOWS_SQL} SELECT cond, trial // 100 AS holo, k, string_agg(CAST(trial AS VARCHAR), ',' ORDER BY trial) AS trials, count(*) AS n FROM w GROUP BY 1, 2, 3"

def condition_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's values as rows, with the place of each trial among the group's."""
    points = _holo_windows(spark, sf_dir).withColumn("holo", F.expr("trial div 100"))
    return T.placed_by_trial(points, ["cond", "holo"]).select("cond", "holo", "k", "place", "trial", *r6("v"))


PLACES_SQL = f"WITH {WINDOWS_SQL} SELECT cond, trial // 100 AS holo, k, dense_rank() OVER (PARTITION BY cond, trial // 100 ORDER BY trial) AS place, trial, round(v, 6) + 0.0 AS v FROM w"

QUERIES = {f.__name__: f for f in (
    pulse_ranges, holo_mean_ci, trial_dff, trial_dff_common_f0, trial_dff_filtered, window_extract, window_lengths, baseline_exclude, detrended_sweeps, sweep_ci, trial_excluder, hazen_percentile, mad_outliers,
    interleave_metrics, channel_split, iir_causal, iir_zero_phase, holo_ids, session_normalise, session_record, trial_metadata_join, eligible_trials, trial_sample, trial_progress, latest_record, trial_index,
    electrode_union, parity_report, condition_columns, condition_places)}
ORACLE_SQL = {
    "pulse_ranges": PULSES_SQL,
    "holo_mean_ci": HOLO_MEAN_CI_SQL, "trial_dff": TRIAL_DFF_SQL, "trial_dff_common_f0": TRIAL_DFF_COMMON_SQL, "window_extract": WINDOW_EXTRACT_SQL, "window_lengths": WINDOW_LENGTHS_SQL, "baseline_exclude": BASELINE_SQL,
    "detrended_sweeps": f"WITH {FLAT_SQL} SELECT trial, cond, k, round(flat, 6) + 0.0 AS flat FROM f", "sweep_ci": SWEEP_CI_SQL, "trial_excluder": TRIAL_EXCLUDER_SQL, "hazen_percentile": HAZEN_SQL, "mad_outliers": MAD_SQL,
    "interleave_metrics": INTERLEAVE_SQL, "channel_split": CHANNEL_SPLIT_SQL, "iir_causal": CAUSAL_SQL, "iir_zero_phase": ZERO_PHASE_SQL, "trial_dff_filtered": FILTERED_SQL, "holo_ids": HOLO_IDS_SQL, "session_normalise": SESSION_SQL, "session_record": SESSION_RECORD_SQL, "trial_metadata_join": METADATA_SQL,
    "eligible_trials": ELIGIBLE_SQL, "trial_sample": TRIAL_SAMPLE_SQL, "trial_progress": PROGRESS_SQL, "latest_record": LATEST_SQL, "trial_index": TRIAL_INDEX_SQL, "electrode_union": ELECTRODE_SQL,
    "parity_report": PARITY_SQL, "condition_columns": COLUMNS_SQL, "condition_places": PLACES_SQL,
}
