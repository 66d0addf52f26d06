"""Operators on trials, conditions and stimulus sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize, sized


def holo_ids(points: DataFrame, order: list[str]) -> DataFrame:
    """(trial, position, holo): a sequence's distinct values in the order of their first sight, less the trial's least, plus 1.

    `points` has (trial, value) and the columns that order a trial's points.
    """
    first = points.withColumn("at", F.row_number().over(Window.partitionBy("trial").orderBy(*order))).groupBy("trial", "value").agg(F.min("at").alias("at"))
    w = Window.partitionBy("trial")
    return first.select("trial", F.row_number().over(w.orderBy("at")).cast("long").alias("position"), (F.col("value") - F.min("value").over(w) + 1).cast("long").alias("holo"))


def holo_ids_of_arrays(trials: DataFrame, fallback: str = "dummy") -> DataFrame:
    """As holo_ids(), of (trial, seq array, dummy array); an empty or missing sequence takes the dummy, else [0]."""
    seq = F.coalesce(F.when(F.size("seq") > 0, F.col("seq")), F.when(F.size(fallback) > 0, F.col(fallback)), F.array(F.lit(0.0)))
    got = trials.select("trial", F.array_distinct(seq).alias("seq"))
    return got.select("trial", F.posexplode("seq").alias("p", "x"), F.array_min("seq").alias("least")).select("trial", (F.col("p") + 1).cast("long").alias("position"), (F.col("x") - F.col("least") + 1).cast("long").alias("holo"))


def with_conditions(trials: DataFrame, conds: DataFrame, default: str) -> DataFrame:
    """Each trial with its condition's row; an empty onset vector is replaced by the default condition's, an unknown condition stays NULL.

    `conds` has (cond, n_holos, first_stim array): a dimension, of which the default is one row.
    """
    vector = F.when(F.size("first_stim") > 0, F.col("first_stim").cast("array<double>"))
    spare = conds.where(F.col("cond") == default).agg(F.first(vector, ignorenulls=True).alias("spare"))
    filled = conds.crossJoin(spare).select("cond", "n_holos", F.coalesce(vector, F.col("spare")).alias("first_stim"))
    return trials.join(filled, "cond", "left").withColumn("has_metadata", F.col("n_holos").isNotNull())


def session_fields(records: DataFrame) -> DataFrame:
    """Raw session records, one a row, with the fields that an analysis takes: numbers as such, lists as lists of their numbers.

    Adds n_trials and n_conds; times of the start in seconds; the first condition's number of holos is the largest one; pulse durations are the
    distinct ones that aren't 0, in order, of which numbers of pulses, their distance and the holos' delay take the first. Absent lists are empty.
    """
    numbers = lambda c: F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))
    lists = lambda c: F.coalesce(F.transform(c, lambda x: F.coalesce(x.cast("array<double>"), F.array().cast("array<double>"))), F.array().cast("array<array<double>>"))
    present = lambda c: F.array_sort(F.filter(F.array_distinct(numbers(c)), lambda x: x != 0))
    holos = numbers("n_holos").cast("array<long>")
    whole = F.when(F.size(holos) > 0, F.concat(F.array(F.array_max(holos)), F.slice(holos, 2, F.greatest(F.size(holos) - 1, F.lit(0))))).otherwise(holos)
    return records.select(
        "session", *[F.col(c).cast("double").alias(c) for c in ("imaging_freq", "fs", "trial_time", "start_time_ms")], (F.col("start_time_ms").cast("double") / 1000).alias("start_time"), "mouse_id",
        numbers("trial_cond").cast("array<long>").alias("trial_cond"), F.size(numbers("trial_cond")).cast("long").alias("n_trials"), F.size(lists("sequence")).cast("long").alias("n_conds"), numbers("powers").alias("powers"),
        *[lists(c).alias(c) for c in ("sequence", "sequence_this_trial", "first_stim_times")], whole.alias("n_holos"), present("pulse_dur").alias("pulse_durs"),
        *[F.get(present(c), F.lit(0)).alias(c) for c in ("n_pulses", "ipi", "next_holo_delay")])


def condition_counts(points: DataFrame, first: str) -> DataFrame:
    """(cond, n_holos) from (cond, pos): distinct non-zero positions; the first condition takes the largest count."""
    counts = points.where("pos <> 0").groupBy("cond").agg(F.count_distinct("pos").alias("n_holos"), F.array_sort(F.collect_set("pos")).alias("positions"))
    largest = counts.agg(F.max("n_holos").alias("largest"))
    return counts.crossJoin(largest).select("cond", F.when(F.col("cond") == first, F.col("largest")).otherwise(F.col("n_holos")).alias("n_holos"), "positions")


def eligible(trials: DataFrame, low: int, high: int, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Distinct trials of low..high that aren't excluded; with a share below 1, that part of them, rounded up, drawn by a hash of seed and trial."""
    got = trials.where(F.col("trial").between(low, high) & ~F.col("excluded")).select("trial").distinct()
    if share >= 1:
        return got
    drawn = _ranked(got.withColumn("_drawn", F.xxhash64(F.lit(seed), "trial")), ["_drawn", "trial"])
    return drawn.where(F.col("rank") <= F.ceil(F.col("total") * share)).select("trial")


def _ranked(trials: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank (from 1) and total. Ranks come from range-partitioned sorting and counts of the partitions, so no task sorts all trials."""
    # written with the number of each row's partition, which both its counts and its ranks refer to
    spread = materialize(trials.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("total"))
    own = spread.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*by)))
    return own.join(F.broadcast(before), "part").select(*trials.columns, (F.col("own") + F.col("before")).alias("rank"), "total")


def ranked_within(rows: DataFrame, groups: list[str], by: list[str], out: str) -> DataFrame:
    """Adds a row's number (from 1) within its group, in the order of `by`; of groups that aren't null. As _ranked(), no task sorts a group."""
    spread = materialize(rows.repartitionByRange(*groups, *by).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy(*groups, "_part").count()
    before = counts.select(*groups, "_part", (F.sum("count").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("count")).alias("_before"))
    own = spread.withColumn("_own", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*by)))
    return own.join(sized(before), [*groups, "_part"]).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("long").alias(out))


def evenly_spaced(trials: DataFrame, n: int) -> DataFrame:
    """At most n trials, evenly spaced by rank from the first to the last."""
    ranked = _ranked(trials.select("trial").distinct(), ["trial"])
    # rank 1 + floor(i * (total - 1) / (n - 1)) for an i
    step = F.greatest(F.col("total") - 1, F.lit(0))
    i = F.ceil((F.col("rank") - 1) * (n - 1) / F.greatest(step, F.lit(1)).cast("double")).cast("long")
    return ranked.where((F.expr("rank") == 1) | (F.col("rank") == 1 + F.floor(i * step / (n - 1)).cast("long"))).select("trial", F.col("rank").cast("long").alias("rank"))


def progress(trials: DataFrame) -> DataFrame:
    """Per condition: trials seen, excluded ones, the first and the last."""
    return trials.groupBy("cond").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("excluded").alias("n_excluded"), F.min("trial").alias("first_trial"), F.max("trial").alias("last_trial"))


def latest(records: DataFrame, groups: list[str], by: str) -> DataFrame:
    """Each group's row with the greatest `by`."""
    rest = [c for c in records.columns if c not in groups]
    return records.groupBy(*groups).agg(F.max_by(F.struct(*rest), by).alias("x")).select(*groups, "x.*")


def index_by_name(files: DataFrame, groups: list[str]) -> DataFrame:
    """Trial numbers by the alphabetical order of paths within a folder."""
    return ranked_within(files, groups, ["path"], "trial")


def electrodes(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """Both electrodes' rows, told apart by `electrode`; a missing second one adds nothing."""
    one = first.withColumn("electrode", F.lit(1).cast("long"))
    return one if second is None else one.unionByName(second.withColumn("electrode", F.lit(2).cast("long")))


def one_channel(pages: DataFrame, groups: list[str]) -> DataFrame:
    """The pages 0, 2, 4, ... renumbered 0, 1, 2, ..."""
    return pages.where("page % 2 = 0").withColumn("page", F.expr("page div 2"))


def preferred(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of the first source that has any for a key; a shuffle on the keys, no per-source joins."""
    ranked = None
    for k, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(k))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = F.min("_rank").over(Window.partitionBy(*keys))
    return ranked.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")
