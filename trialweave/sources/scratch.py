"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a folder of this machine only where that is unset and all runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-trialweave-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows up to which a small table is broadcast; longer ones are joined by a shuffle.
SMALL_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` for a join: written, counted, and marked for broadcast only if it has at most `rows`."""
    df = materialize(df, "sized")
    return F.broadcast(df) if df.count() <= rows else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
