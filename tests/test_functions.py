"""Scalars and filters against hand-computed and numpy values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import numeric as N
from trialweave.functions import recursive as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hazen(spark):
    values = F.array(*map(F.lit, [4.0, 1.0, 10.0, 3.0, 2.0]))
    for p, want in ((10, 1.0), (50, 3.0), (60, 3.5), (95, 10.0)):
        assert one(spark, N.hazen(values, p)) == pytest.approx(want)
    assert one(spark, N.hazen(F.array().cast("array<double>"), 50)) is None


def test_counts_and_rounding(spark):
    assert N.colon_count(0.29 * 100) == 29 and N.colon_count(3.7) == 3 and N.colon_count(-2) == 0
    assert one(spark, N.half_away(F.lit(50.5))) == 51 and one(spark, N.half_away(F.lit(-2.5))) == -3
    assert one(spark, N.slice_inclusive(F.array(*map(F.lit, range(10, 20))), 2, 4)) == [11, 12, 13]
    assert one(spark, N.missing(F.lit(float("nan")))) is None


def test_student(spark):
    for p, df, want in ((0.975, 10, 2.228138852), (0.975, 1, 12.706204736), (0.95, 30, 1.697260887)):
        assert N.t_quantile(p, df) == pytest.approx(want, abs=1e-8)
    assert N.t_quantile(0.975, 0) is None
    for df in (5, 200, 201, 5000):
        assert one(spark, N.t_column(0.975, F.lit(df))) == pytest.approx(N.t_quantile(0.975, df), abs=1e-8)
    assert one(spark, N.t_column(0.975, F.lit(0))) is None


def lfilter(b, a, x, z=None):
    z = list(z or [0.0] * (len(a) - 1))
    out = []
    for v in x:
        y = b[0] * v + z[0]
        z = [(z[k + 1] if k + 1 < len(z) else 0.0) + b[k + 1] * v - a[k + 1] * y for k in range(len(z))]
        out.append(y)
    return out


def test_low_pass_has_unit_gain_and_half_power_at_the_cutoff():
    b, a = R.low_pass(4, 40.0, 500.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * math.pi * f / 500)) / np.polyval(a, np.exp(2j * math.pi * f / 500)))
    assert gain(0) == pytest.approx(1) and gain(40) == pytest.approx(math.sqrt(0.5), abs=1e-9)


def test_filters(spark):
    x = np.random.default_rng(1).normal(size=50).tolist()
    b, a = R.low_pass(4, 40.0, 500.0)
    df = spark.createDataFrame([(1, x), (2, x[:20]), (3, None)], "trial long, samples array<double>")
    got = {r.trial: r for r in df.select("trial", R.causal(F.col("samples"), b, a).alias("y"), R.zero_phase(F.col("samples"), b, a).alias("z")).collect()}
    assert got[1].y == pytest.approx(lfilter(b, a, x)) and got[3].y is None
    pad, zi = 12, R.steady_state(b, a)
    long = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    once = lfilter(b, a, long, [s * long[0] for s in zi])[::-1]
    twice = lfilter(b, a, once, [s * once[0] for s in zi])[::-1]
    assert got[1].z == pytest.approx(twice[pad : pad + len(x)])
    assert got[2].y == pytest.approx(lfilter(b, a, x[:20]))


def test_counts_of_a_range_as_columns(spark):
    values = [0.0, -1.5, 0.9999999999999999, 1.0, 2.0000000000000004, 2.9999999999999996, 15.5, 16.0, 1e9 + 0.4999999, 123456.99999999999]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(N.colon_counts(F.col("x"))).collect()
    assert [r[0] for r in got] == [N.colon_count(v) for v in values]
