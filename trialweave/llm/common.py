"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, scratch_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch where the session has Spark's own defaults; texts can be long, and a batch is held whole.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    arrow = "spark.sql.execution.arrow"
    for key, default, own in ((f"{arrow}.maxRecordsPerBatch", "10000", BATCH_ROWS), (f"{arrow}.maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        if spark.conf.get(key, default) == default:  # that is also given where it is unset
            spark.conf.set(key, own)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """`make()` runs once a task and returns a function from one row's values to the values of `schema`.

    Only the columns of `df` travel to Python, in Arrow batches; rows stay in their partition.
    """
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            rows = list(map(one, *(c.to_pylist() for c in batch.columns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, target)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """As `map_rows`, but the function gets a whole Arrow batch and returns the columns of `schema`, as lists or arrays."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([v.cast(t.type) if isinstance(v, pa.Array) else pa.array(v, t.type) for v, t in zip(one(batch), arrow)], schema=arrow)

    return df.mapInArrow(run, target)


#: Ids (8 bytes each) up to which a list of them is broadcast; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized_ids(ids: DataFrame) -> DataFrame:
    """`ids` for a join: counted, and marked for broadcast only if there are at most BROADCAST_IDS."""
    ids = materialize(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id, parts: int, part: int):
    """True where crc32 of the id, as text, leaves `part` when divided by `parts`; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part
