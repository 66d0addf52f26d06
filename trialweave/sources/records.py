"""Stored recordings and regions as tables: reading stacks, records and regions, writing stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import column_major, rescaled


def pixels_of_rows(image_rows: DataFrame) -> DataFrame:
    """(trial, frame, r, c, v) of compact rows (trial, frame, r, px array); c counts from 0."""
    return image_rows.select("trial", "frame", "r", F.posexplode("px").alias("c", "v")).withColumn("c", F.col("c").cast("long"))


def rows_of_pixels(pixels: DataFrame) -> DataFrame:
    """Compact rows of pixels, in the order of columns; an array never holds more than an image's row."""
    return pixels.groupBy("trial", "frame", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("px"))


def read_stack(spark: SparkSession, path: str, keep_even_pages: bool = False) -> DataFrame:
    """Frames of compact rows; with `keep_even_pages`, pages 0, 2, 4, ... of interleaved recordings, renumbered."""
    rows = spark.read.parquet(path)
    if keep_even_pages:
        rows = rows.where(F.col("frame") % 2 == 0).withColumn("frame", F.expr("frame div 2"))
    return pixels_of_rows(rows)


def write_stack(pixels: DataFrame, path: str, top: int = 65535) -> None:
    """Pixels scaled to 0..top by trial, in a folder a trial."""
    rescaled(pixels, ["trial"], top).drop("v").withColumnRenamed("u", "v").repartition("trial").write.partitionBy("trial").parquet(path)


def latest_path(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> str | None:
    """The last of a folder's matching names in alphabetical order; None if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max("path").alias("path")).first().path


def save_regions(regions: DataFrame, path: str, base: int = 0) -> None:
    """Regions (cell, r, c) that count pixels from `base`, stored counting from 0 in column order."""
    moved = regions.select("cell", (F.col("r") - base).alias("r"), (F.col("c") - base).alias("c")).distinct()
    column_major(moved, ["cell"]).write.mode("overwrite").parquet(path)


def load_regions(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """(cell, r, c, k), pixels counting from `base`."""
    return spark.read.parquet(path).select("cell", (F.col("r") + base).alias("r"), (F.col("c") + base).alias("c"), "k")


def zipped_regions(lists: DataFrame, base: int = 1) -> DataFrame:
    """(cell, r, c, k) of lists of rows and columns (cell, x array, y array) that count from `base`; pixels count from 0, k down the columns.

    Lists of a cell that differ in length stop the read; a cell without pixels has no row.
    """
    same = F.when(F.size("x") == F.size("y"), F.arrays_zip("x", "y")).otherwise(F.raise_error(F.concat(F.lit("rows and columns differ in number in cell "), F.col("cell").cast("string"))))
    pixels = lists.where("size(x) > 0 or size(y) > 0").select("cell", F.explode(same).alias("p"))
    return column_major(pixels.select("cell", (F.col("p.x") - base).cast("long").alias("r"), (F.col("p.y") - base).cast("long").alias("c")).distinct(), ["cell"])


def trace_points(nested: DataFrame, matrix: str) -> DataFrame:
    """(cell, trial, frame, v) of nested matrices (cell, matrix: an array of trials' arrays); empty and missing trials have one NULL row."""
    trials = nested.select("cell", F.posexplode_outer(matrix).alias("t", "samples"))
    return trials.select("cell", (F.col("t") + 1).cast("long").alias("trial"), F.posexplode_outer("samples").alias("f", "v")).select("cell", "trial", (F.col("f") + 1).cast("long").alias("frame"), "v")
