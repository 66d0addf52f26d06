"""Streamed queries over the stored tables; their results are those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as T
from ..plans.trace_queries import HOLO_MEAN_CI_SQL, PRE_POINTS, SKIPPED, WINDOW, r6
from ..sources import bindings as B
from ..sources.scratch import materialize, scratch_dir
from . import keyed, live
from .versioned import VersionedTable


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = B.stored(spark, sf_dir, table).schema
    # a table is a file of the folder, or a folder of part files
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{table}.parquet*")


def live_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials streamed into a keyed state; means and intervals of what has come. It fails if a trial was set aside."""
    folder = scratch_dir(spark, "live")

    def process(rows: DataFrame) -> DataFrame:
        points = rows.select(F.col("trial"), "cond", F.posexplode("embedding").alias("p", "x")).where(F.col("p").between(16, 15 + WINDOW))
        points = points.select("trial", "cond", (F.col("p") - 15).cast("long").alias("k"), F.when(F.col("trial") % SKIPPED != 0, F.col("x").cast("double") + 1.0).alias("v"))
        return T.relative_change(points, ["trial"], PRE_POINTS)

    state = live.LiveState(folder, lambda: B.stored(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial")), process)
    arrivals = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), (F.col("label") + 1).cast("long").alias("cond"), "embedding")
    live.start(arrivals, state, f"{folder}/checkpoint", backlog_only=True).awaitTermination()
    aside = state.failed(spark)
    if aside is not None and (n := aside.count()):
        raise RuntimeError(f"{n} trials were set aside, among them {[tuple(r) for r in aside.select('trial', 'reason').limit(3).collect()]}")
    return T.mean_interval(state.results(spark), ["cond", "k"]).select("cond", "k", "n_cols", "n", *r6("mean", "sd", "lo", "hi", "ci_lo", "ci_hi"))


def live_keyed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As live_run, by keyed state: trials and metadata are two streams that meet in it. It fails if a trial was set aside."""
    folder = scratch_dir(spark, "keyed")
    arrivals = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.lit(0).alias("sent"), (F.col("label") + 1).cast("long").alias("cond"), F.slice("embedding", 17, WINDOW).alias("x"))
    met = keyed.meet(arrivals, _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial")))
    results, failed = VersionedTable(f"{folder}/results", ("trial",)), VersionedTable(f"{folder}/failed", ("trial",))

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "met")
        points = batch.where("reason is null").select("trial", "cond", F.posexplode("x").alias("p", "x"))
        points = points.select("trial", "cond", (F.col("p") + 1).cast("long").alias("k"), F.when(F.col("trial") % SKIPPED != 0, F.col("x").cast("double") + 1.0).alias("v"))
        results.merge(T.relative_change(points, ["trial"], PRE_POINTS), batch_id)
        failed.merge(batch.where("reason is not null").select("trial", "reason"), batch_id)

    # a run that ends with what is there needs no batches for timers, which would never end
    settings = {"spark.sql.streaming.stateStore.providerClass": keyed.ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if n := failed.read(spark).count():
        raise RuntimeError(f"{n} trials were set aside")
    return T.mean_interval(results.read(spark), ["cond", "k"]).select("cond", "k", "n_cols", "n", *r6("mean", "sd", "lo", "hi", "ci_lo", "ci_hi"))


def live_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running statistics of sweeps by trial and condition, as the stream has them at its end: a trigger writes the groups that it has changed."""
    folder = scratch_dir(spark, "groups")
    stats = _stream(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trial"), F.col("event_type").alias("cond")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    table = VersionedTable(f"{folder}/stats", ("trial", "cond"))
    query = stats.writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read(spark).select("trial", "cond", "n", *r6("mean"), F.round("sd", 4).alias("sd"))


GROUP_STATS_SQL = "SELECT user_id AS trial, event_type AS cond, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) END, 4) AS sd FROM events GROUP BY 1, 2"

QUERIES = {"live_run": live_run, "live_keyed_run": live_keyed_run, "live_group_stats": live_group_stats}
ORACLE_SQL = {"live_run": HOLO_MEAN_CI_SQL, "live_keyed_run": HOLO_MEAN_CI_SQL, "live_group_stats": GROUP_STATS_SQL}
