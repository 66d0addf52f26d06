"""Live mode: trials arrive as files in any order; the results are those of a batch run over the trials seen so far."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.scratch import materialize
from .versioned import BUCKETS, Files, VersionedTable

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: Name of a trial's file; seconds that it must have been unchanged; times that a trial waits for its metadata.
TRIAL_FILE, QUIET_SECONDS, RETRIES = r"_(\d+)_mc\.tif$", 3, 30
#: Bad trials of a batch beyond which the fault is taken to be the processing's, and raised.
MOST_BAD = 100
#: SQL states of errors that a row's values cause: data exceptions, raised errors, errors in functions written in Python.
_DATA_ERROR = re.compile(r"SQLSTATE: (?:22|P0001|38|39)|PythonException")


def trial_number(path) -> F.Column:
    return F.regexp_extract(path, TRIAL_FILE, 1).try_cast("long")


def file_catalog(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modificationTime) of a folder's files that match, without hidden and empty ones; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("."))


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.tif", per_batch: int = 100) -> DataFrame:
    """A stream of (path, trial, length, modificationTime): first the files that are there, then new ones, each path once."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("path", trial_number(F.col("path")).alias("trial"), "length", "modificationTime").where("trial is not null")


def is_complete(now: float | None = None, quiet: float = QUIET_SECONDS) -> F.Column:
    """Whether a file has content and hasn't changed for `quiet` seconds."""
    at = F.timestamp_seconds(F.lit(time.time() if now is None else now))
    return (F.col("length") > 0) & (F.col("modificationTime") <= at - F.make_dt_interval(secs=F.lit(quiet)))


def in_order(files: DataFrame) -> DataFrame:
    """Files of one batch by trial number, then path; those without a number are left out."""
    return files.where("trial is not null").orderBy("trial", "path")


def complete_files(folder: str, pattern: str = "*.tif") -> Callable[[DataFrame], DataFrame]:
    """For LiveState.complete: of arrived rows (path, ...), those whose file is complete now, with its present length and time."""

    def complete(rows: DataFrame) -> DataFrame:
        now = file_catalog(rows.sparkSession, folder, pattern).where(is_complete()).select("path", "length", "modificationTime")
        return rows.drop("length", "modificationTime").join(now, "path").select(rows.columns)

    return complete


@dataclass
class LiveState:
    """Rows keyed by trial in `folder`, a table of versions: a batch replaces all rows of its trials, so a resent trial counts once.

    `metadata` gives the current table of trials (trial, ...), read again for each batch. Trials without a row there wait in
    `pending` and are tried with later batches, up to `retries` times; then they are listed in `failed`. There too go the trials
    that `process` gives an `error` (a text column, NULL for good rows), or for whose own rows it fails by their values; the batch's other new
    trials count, and those that had waited wait for the next batch, without a try. Any other failure is raised, so that the batch is run again from the checkpoint. `process` treats trials apart.
    Where rows are files, `complete` gives those that are complete; others wait in `pending` too, without a try.
    """

    folder: str
    metadata: Callable[[], DataFrame]
    process: Callable[[DataFrame], DataFrame]
    on_batch: Callable[[int, DataFrame], None] | None = None
    complete: Callable[[DataFrame], DataFrame] | None = None
    retries: int = RETRIES
    buckets: int = BUCKETS
    log: list[tuple[int, str]] = field(default_factory=list)
    #: Rows that the last batch has merged.
    fresh: DataFrame | None = None

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(f"{self.folder}/results", ("trial",), self.buckets)

    def _table(self, spark: SparkSession, name: str, schema: StructType | None = None) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def results(self, spark: SparkSession) -> DataFrame | None:
        return self.table.read(spark)

    def _processed(self, rows: DataFrame, bad: list[tuple], level: int = 0) -> list[DataFrame]:
        """Written results of the rows; trials that fail by their values go to `bad`, found by halving the trials."""
        try:
            return [materialize(self.process(rows), "processed")]
        except Exception as e:
            if not _DATA_ERROR.search(str(e)):
                raise
            trials = [r.trial for r in rows.select("trial").distinct().limit(2).collect()]
            if len(trials) < 2:
                bad += [(t, str(e)[:200]) for t in trials]
                if len(bad) > MOST_BAD or not trials:
                    raise
                return []
        side = F.pmod(F.shiftright(F.xxhash64("trial"), level), F.lit(2))
        return self._processed(rows.where(side == 0), bad, level + 1) + self._processed(rows.where(side == 1), bad, level + 1)

    def failed(self, spark: SparkSession) -> DataFrame | None:
        """(trial, reason, batch) of the trials that were set aside."""
        return self._table(spark, "failed")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch; a batch that is run again gives the same state."""
        spark = batch.sparkSession
        waiting = self._table(spark, f"pending/batch={batch_id - 1}")
        rows = batch.withColumn("tries", F.lit(0))
        if waiting is not None:
            rows = rows.unionByName(waiting.where(F.col("tries") < self.retries).withColumn("tries", F.col("tries") + 1))
        rows = materialize(rows, "arrived")
        growing = None
        if self.complete:
            done = materialize(self.complete(rows), "complete")
            growing = materialize(rows.join(done.select("path"), "path", "left_anti").select(rows.columns), "growing")
            rows = done
        known = materialize(self.metadata().select("trial").distinct(), "known")
        late = materialize(rows.join(known, "trial", "left_anti"), "late")
        bad: list[tuple] = []
        ready = materialize(rows.join(known, "trial", "left_semi"), "ready")
        parts = self._processed(ready.drop("tries"), bad)
        failed = late.where(F.col("tries") >= self.retries).select("trial", F.lit("no metadata").alias("reason")).distinct()
        failed = failed.unionByName(spark.createDataFrame(bad, failed.schema))
        self.log += [(batch_id, f"trial {t}: {reason}") for t, reason in bad]
        new = wrong = None
        for part in parts:
            new = part if new is None else new.unionByName(part)
        if new is not None and "error" in new.columns:
            wrong = materialize(new.where("error is not null").groupBy("trial").agg(F.min("error").alias("reason")), "wrong")
            self.log += [(batch_id, f"{n} trials with an error") for n in [wrong.count()] if n]
            failed, new = failed.unionByName(wrong), new.join(wrong, "trial", "left_anti").drop("error")
        failed.write.mode("overwrite").parquet(f"{self.folder}/failed/batch={batch_id}")
        waits = late.where(F.col("tries") < self.retries)
        if growing is not None:  # a row that has waited counts its next try, which this is taken off for
            waits = waits.unionByName(growing.withColumn("tries", F.col("tries") - 1).select(waits.columns))
        if bad or wrong is not None and wrong.count():
            again = ready.where("tries > 0").join(failed.select("trial"), "trial", "left_anti").join(ready.where("tries = 0").select("trial"), "trial", "left_anti")
            again = materialize(again, "again")
            waits = waits.unionByName(again.withColumn("tries", F.col("tries") - 1))
            new = new.join(again.select("trial"), "trial", "left_anti") if new is not None else None
        if new is not None:
            self.fresh = materialize(new, "good")
            self.table.merge(self.fresh, batch_id)
        waits.write.mode("overwrite").parquet(f"{self.folder}/pending/batch={batch_id}")
        if self.on_batch and new is not None:
            self.on_batch(batch_id, self.results(spark))


def start(stream: DataFrame, state: LiveState, checkpoint: str, backlog_only: bool = False) -> StreamingQuery:
    """Runs the state over a stream; with `backlog_only`, over what is there now."""
    writer = stream.writeStream.foreachBatch(state).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if backlog_only else writer).start()


def stop_when_idle(query: StreamingQuery, seconds: float, done: Callable[[], bool] = lambda: False, poll: float = 0.5) -> None:
    """Stops a query after `seconds` without input, or once `done()`."""
    last = time.time()
    while query.isActive:
        progress = query.lastProgress
        if progress and progress["numInputRows"]:
            last = time.time()
        if done() or time.time() - last > seconds:
            query.stop()
        time.sleep(poll)


def status(results: DataFrame, planned: int | None = None) -> DataFrame:
    """One row: trials seen and planned, rows, trials by condition and the time; a trial has one condition, 'none' if it is missing. The trials themselves are in seen()."""
    return _status(by_trial(results), planned)


def by_trial(results: DataFrame) -> DataFrame:
    """(trial, cond, rows), a row a trial."""
    cond = F.coalesce(F.max(F.col("cond").cast("string")), F.lit("none")) if "cond" in results.columns else F.lit("none")
    return results.groupBy("trial").agg(cond.alias("cond"), F.count(F.lit(1)).alias("rows"))


def _status(trials: DataFrame, planned: int | None) -> DataFrame:
    by_cond = trials.groupBy("cond").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    zero = F.lit(0).cast("long")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("cond", "n"))))
    row = by_cond.agg(F.coalesce(F.sum("n"), zero).alias("n_trials"), F.coalesce(F.sum("rows"), zero).alias("n_rows"), pairs.alias("trials_by_cond"))
    return row.select("n_trials", F.lit(planned).cast("long").alias("n_planned"), "n_rows", "trials_by_cond", F.current_timestamp().alias("written"))


def seen(results: DataFrame) -> DataFrame:
    """The trials that have come, each once, in order."""
    return results.select("trial").distinct().orderBy("trial")


def snapshot_writer(state: LiveState, planned: int | None = None) -> Callable[[int, DataFrame], None]:
    """For `state.on_batch`: after a batch, its trials in a table of trials, then a status that names the version of the results; readers take the newest status.

    What a batch writes goes with its own trials: the results are the state's, of which each version stays readable.
    """
    trials = VersionedTable(f"{state.folder}/trials", ("trial",), state.buckets)

    def write(batch_id: int, results: DataFrame) -> None:
        trials.merge(by_trial(state.fresh), batch_id)
        row = _status(trials.read(results.sparkSession), planned).withColumn("version", F.lit(batch_id).cast("long"))
        row.coalesce(1).write.mode("overwrite").json(f"{state.folder}/status/batch={batch_id:012d}")

    return write


def read_snapshot(spark: SparkSession, state: LiveState) -> tuple[DataFrame, DataFrame, dict] | None:
    """The results, the trials (trial, cond, rows) and the status of the newest complete snapshot, all of one version; None before the first."""
    files = Files(spark, f"{state.folder}/status")
    done = [n for n in files.names("") if "_SUCCESS" in files.names(n)]
    if not done:
        return None
    row = spark.read.json(f"{state.folder}/status/{done[-1]}").first().asDict(recursive=True)
    return state.table.read(spark, row["version"]), VersionedTable(f"{state.folder}/trials", ("trial",), state.buckets).read(spark, row["version"]), row


def complete_trials(results: DataFrame, planned: int) -> DataFrame:
    """Rows for every planned trial, with NULLs where none has come; trials beyond the plan are left out."""
    spine = results.sparkSession.range(1, planned + 1).select(F.col("id").alias("trial"))
    return spine.join(results, "trial", "left")
