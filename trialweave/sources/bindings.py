"""The tables of the workload (trials, traces, images, events) over stored Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an image, as the vectors of a table are stacked.
IMAGE_ROWS = 64


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, cond, frame (from 1), v: a vector is a trial, its label the condition; the offset keeps baselines from zero."""
    return stored(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), (F.col("label") + 1).cast("long").alias("cond"), F.posexplode("embedding").alias("p", "x")).select(
        "trial", "cond", (F.col("p") + 1).cast("long").alias("frame"), (F.col("x").cast("double") + 1.0).alias("v"))


def trace_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, cond, samples: whole traces as arrays."""
    return stored(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), (F.col("label") + 1).cast("long").alias("cond"), F.transform("embedding", lambda x: x.cast("double") + 1.0).alias("samples"))


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, r, c (from 0), v: 64 vectors are the rows of an image."""
    return stored(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {IMAGE_ROWS}").alias("img"), (F.col("vec_id") % IMAGE_ROWS).alias("r"), F.posexplode("embedding").alias("p", "x")).select(
        "img", "r", F.col("p").cast("long").alias("c"), F.col("x").cast("double").alias("v"))


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, i (from 1, by time), cond, v, event_id: a user's events are a sweep."""
    e = stored(spark, sf_dir, "events")
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("trial"), i.cast("long").alias("i"), F.col("event_type").alias("cond"), F.col("value").alias("v"), "event_id")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, cond, excluded: orders with their priority; finished ones are excluded."""
    return stored(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("cond"), (F.col("o_orderstatus") == "F").alias("excluded"))


def trial_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, pos, v: an order's lines, those of one number added up."""
    return stored(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.sum("l_extendedprice").alias("v"))
