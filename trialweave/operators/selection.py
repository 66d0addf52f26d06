"""Exact order statistics of groups of any size, by counts: a range of values is narrowed until what is left of it fits in a task.

A pass takes a sketch of each group's values (its error is bounded), brackets the value of a wanted rank between two values of the sketch, counts what
lies below, at and between them, and goes on with the values between. Some hundredth of the values is left by each pass, whatever their distribution;
repeated values end at a bracket. No group is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize, sized

#: Values that one task sorts; steps of the sketch, and its accuracy, whose error is below half a step.
FIT, STEPS, ACCURACY = 100_000, 256, 2000


def _sorted_ranks(values: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rank, value) of groups that fit in a task."""
    own = values.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value")).cast("long"))
    return own.join(wanted, [*keys, "rank"]).select(*keys, "rank", "value")


def ranked_values(values: DataFrame, wanted: DataFrame, keys: Sequence[str], fit: int = FIT, steps: int = STEPS) -> DataFrame:
    """(keys, rank, value): the rank-th smallest value of each group, exactly, of (keys, value) and the wanted (keys, rank, n).

    `n` is a group's number of values, which aren't null, nor are the keys; ranks lie within 1..n. Groups of up to `fit` values are sorted in a task.
    """
    wanted = materialize(wanted.select(*keys, F.col("rank").cast("long"), F.col("n").cast("long")).distinct(), "wanted")
    found = [_sorted_ranks(values, wanted.where(F.col("n") <= fit).drop("n"), keys)]
    large = wanted.where(F.col("n") > fit)
    if large.isEmpty():
        return found[0]
    own = values.join(sized(large.select(*keys).distinct()), list(keys))
    grid = own.groupBy(*keys).agg(F.percentile_approx("value", [k / steps for k in range(steps + 1)], ACCURACY).alias("grid"))
    # a sketch's error is a two-thousandth of the values: one step more on either side is enough
    at = F.col("rank") * steps / F.col("n")
    low, high = F.greatest(F.lit(0), F.floor(at).cast("int") - 1), F.least(F.lit(steps), F.ceil(at).cast("int") + 1)
    bracket = sized(large.join(grid, list(keys)).select(*keys, "rank", F.when(low > 0, F.get("grid", low)).alias("lo"), F.when(high < steps, F.get("grid", high)).alias("hi")))
    placed = own.join(bracket, list(keys))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    within = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
    counts = placed.groupBy(*keys, "rank", "lo", "hi").agg(F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(v == hi).alias("at_hi"), F.count_if(within).alias("between"))
    counts = materialize(counts, "counts")
    left = F.col("rank") - F.col("below")
    state = F.when(left <= 0, F.raise_error(F.lit("a sketch missed a rank"))).when(left <= F.col("at_lo"), F.lit("lo")).when(left <= F.col("at_lo") + F.col("between"), F.lit("between"))
    state = state.when(left <= F.col("at_lo") + F.col("between") + F.col("at_hi"), F.lit("hi")).otherwise(F.raise_error(F.lit("a sketch missed a rank")))
    counts = counts.withColumn("state", state)
    found.append(counts.where("state <> 'between'").select(*keys, "rank", F.when(F.col("state") == "lo", lo).otherwise(hi).alias("value")))
    of = f"_of_{len(keys)}"  # a pass's ranks are keys of the next one
    open_ = counts.where("state = 'between'").select(*keys, F.col("rank").alias(of), (left - F.col("at_lo")).alias("rank"), F.col("between").alias("n"), "lo", "hi")
    if not open_.isEmpty():
        inside = own.join(sized(open_.select(*keys, of, "lo", "hi")), list(keys)).where(within).select(*keys, of, "value")
        deeper = ranked_values(materialize(inside, "between"), open_.select(*keys, of, "rank", "n"), [*keys, of], fit, steps)
        found.append(deeper.select(*keys, F.col(of).alias("rank"), "value"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _midpoint(n: Column, percent: float) -> Column:
    """The rank, a fraction, of a percentile by the midpoint rule."""
    return F.greatest(F.lit(1.0), F.least(n.cast("double"), n * (percent / 100) + 0.5))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: dict[str, float], fit: int = FIT) -> DataFrame:
    """One row a group: percentiles by the midpoint rule of groups of any size, as raster.percentiles(). Missing values are left out; groups aren't null."""
    values = materialize(df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("value")), "values")
    size = materialize(values.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), "sizes")
    low = {p: F.floor(_midpoint(F.col("n"), q)).cast("long") for p, q in percents.items()}
    ranks = F.array_distinct(F.array(*[x for at in low.values() for x in (at, F.least(at + 1, F.col("n")))]))
    found = ranked_values(values, size.select(*groups, "n", F.explode(ranks).alias("rank")), groups, fit)
    if not groups:
        found, size = found.withColumn("_one", F.lit(1)), size.withColumn("_one", F.lit(1))
    at = found.groupBy(*(groups or ["_one"])).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = size.join(at, list(groups or ["_one"]))
    for p, q in percents.items():
        first, second = F.try_element_at("at", low[p]), F.try_element_at("at", F.least(low[p] + 1, F.col("n")))
        out = out.withColumn(p, first + (_midpoint(F.col("n"), q) - low[p]) * (second - first))
    return out.select(*groups, *percents)


def deviations(df: DataFrame, groups: Sequence[str], value: str = "v", fit: int = FIT) -> DataFrame:
    """(groups, med, mad): median and median absolute deviation of groups of any size; the midpoint rule's median is the usual one."""
    med = materialize(percentiles(df, groups, value, {"med": 50}, fit), "medians")
    gaps = df.join(sized(med), list(groups)).select(*groups, F.abs(F.col(value) - F.col("med")).alias("gap"))
    return med.join(percentiles(gaps, groups, "gap", {"mad": 50}, fit), list(groups))
