"""Live results equal the batch's whatever the order of arrival."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from trialweave.streaming import keyed, live
from trialweave.streaming.folder import FolderReader, TrialFolder
from trialweave.streaming.versioned import VersionedTable


def test_trials_in_any_order(spark, tmp_path):
    folder, meta, arrive = tmp_path / "state", str(tmp_path / "meta"), tmp_path / "in"
    arrive.mkdir()
    spark.createDataFrame([(t,) for t in (1, 2, 3, 5)], "trial long").write.parquet(meta)
    seen = []
    state = live.LiveState(str(folder), lambda: spark.read.parquet(meta), lambda rows: rows.select("trial", (F.col("v") * 2).alias("x")), on_batch=lambda k, df: seen.append(df.count()), retries=2)
    stream = spark.readStream.schema("trial long, v double").option("maxFilesPerTrigger", 1).parquet(str(arrive))
    order = [(3, 1.0), (1, 1.0), (4, 4.0), (5, 1.0), (2, 2.0), (1, 9.0)]
    for k, row in enumerate(order):
        spark.createDataFrame([row], "trial long, v double").coalesce(1).write.mode("append").parquet(str(arrive))
        time.sleep(0.05)
        live.start(stream, state, str(tmp_path / "check"), backlog_only=True).awaitTermination()
    got = sorted(tuple(r) for r in state.results(spark).select("trial", "x").collect())
    assert got == [(1, 18.0), (2, 4.0), (3, 2.0), (5, 2.0)] and len(seen) == len(order)
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/failed").select("trial", "reason").collect()] == [(4, "no metadata")]
    planned = live.complete_trials(state.results(spark), 4).orderBy("trial").collect()
    assert [(r.trial, r.x) for r in planned] == [(1, 18.0), (2, 4.0), (3, 2.0), (4, None)]


def test_late_metadata_and_bad_batches(spark, tmp_path):
    meta = str(tmp_path / "meta")
    spark.createDataFrame([(1,)], "trial long").write.parquet(meta)

    def process(rows):
        return rows.select("trial", F.when(F.col("v") < 0, F.raise_error(F.lit("bad trial")).cast("double")).otherwise(F.col("v")).alias("x"))

    state = live.LiveState(str(tmp_path / "state"), lambda: spark.read.parquet(meta), process)
    batch = lambda *r: spark.createDataFrame(list(r), "trial long, v double")
    state(batch((1, 1.0), (2, 2.0)), 0)
    assert [r.trial for r in state.results(spark).collect()] == [1]
    spark.createDataFrame([(2,)], "trial long").write.mode("append").parquet(meta)
    state(batch((1, -1.0)), 1)
    assert state.log and sorted(r.trial for r in state.results(spark).collect()) == [1]
    state(batch((1, 3.0)), 2)
    assert sorted((r.trial, r.x) for r in state.results(spark).collect())[0] == (1, 3.0)


def test_only_bad_trials_are_set_aside(spark, tmp_path):
    meta = spark.range(1, 7).select(F.col("id").alias("trial"))
    fails = lambda rows: rows.select("trial", F.when(F.col("v") < 0, F.raise_error(F.lit("bad trial")).cast("double")).otherwise(F.col("v")).alias("x"))
    names = lambda rows: rows.select("trial", F.col("v").alias("x"), F.when(F.col("v") < 0, "negative").alias("error"))
    for name, process in (("fails", fails), ("names", names)):
        state = live.LiveState(str(tmp_path / name), lambda: meta, process)
        for _ in range(2):  # a batch that is run again gives the same state
            state(spark.createDataFrame([(t, -1.0 if t == 4 else 1.0) for t in range(1, 9)], "trial long, v double"), 0)
        assert sorted(r.trial for r in state.results(spark).collect()) == [1, 2, 3, 5, 6]
        assert [r.trial for r in state.failed(spark).collect()] == [4] and state.log
        assert sorted(r.trial for r in spark.read.parquet(f"{tmp_path}/{name}/pending/batch=0").collect()) == [7, 8]


def test_waiting_trials_outlast_a_bad_one(spark, tmp_path):
    meta = [1]
    process = lambda rows: rows.select("trial", F.col("v").alias("x"), F.when(F.col("v") < 0, "negative").alias("error"))
    state = live.LiveState(str(tmp_path), lambda: spark.createDataFrame([(t,) for t in meta], "trial long"), process, retries=1)
    batch = lambda *r: spark.createDataFrame(list(r), "trial long, v double")
    state(batch((2, 2.0)), 0)
    meta.append(2)
    state(batch((1, -1.0)), 1)
    state(batch((1, 3.0)), 2)
    assert sorted((r.trial, r.x) for r in state.results(spark).collect()) == [(1, 3.0), (2, 2.0)]
    assert [r.trial for r in state.failed(spark).collect()] == [1]


def test_failures_of_the_job_are_raised(spark, tmp_path):
    def process(rows):
        raise RuntimeError("executor lost")

    state = live.LiveState(str(tmp_path / "state"), lambda: spark.range(3).select(F.col("id").alias("trial")), process)
    with pytest.raises(RuntimeError):
        state(spark.createDataFrame([(1, 1.0)], "trial long, v double"), 0)
    assert state.failed(spark) is None


def test_files(spark, tmp_path):
    for name in ("s_12_mc.tif", "s_3_mc.tif", ".hidden_4_mc.tif", "notes.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    (tmp_path / "s_9_mc.tif").write_bytes(b"")
    files = live.file_catalog(spark, str(tmp_path), "*.tif").withColumn("trial", live.trial_number(F.col("path")))
    got = {r.name: r.trial for r in files.collect()}
    assert got == {"s_12_mc.tif": 12, "s_3_mc.tif": 3}  # Spark leaves empty files out
    ready = files.where(live.is_complete(time.time() + 60)).select("trial")
    assert sorted(r.trial for r in ready.collect()) == [3, 12]
    assert files.where(live.is_complete(time.time() - 60)).count() == 0
    out = []
    q = live.file_stream(spark, str(tmp_path)).writeStream.foreachBatch(lambda df, k: out.extend(r.trial for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out) == [3, 12]


def test_files_that_grow_wait(spark, tmp_path):
    files, folder = tmp_path / "files", tmp_path / "state"
    files.mkdir()
    for k in (1, 2):
        (files / f"s_{k}_mc.tif").write_bytes(b"x" * 10 * k)
        os.utime(files / f"s_{k}_mc.tif", (time.time() - 60, time.time() - 60))
    arrived = live.in_order(live.file_catalog(spark, str(files), "*.tif").withColumn("trial", live.trial_number(F.col("path"))).drop("name"))
    assert [r.trial for r in arrived.collect()] == [1, 2]
    rows = arrived.collect()
    os.utime(files / "s_2_mc.tif")  # it is being written
    state = live.LiveState(str(folder), lambda: spark.range(3).select(F.col("id").alias("trial")), lambda r: r.select("trial", "length"), complete=live.complete_files(str(files)), retries=0)
    state(spark.createDataFrame(rows, arrived.schema), 0)
    assert [(r.trial, r.length) for r in state.results(spark).collect()] == [(1, 10)]
    (files / "s_2_mc.tif").write_bytes(b"x" * 30)
    os.utime(files / "s_2_mc.tif", (time.time() - 60, time.time() - 60))
    for _ in range(2):
        state(spark.createDataFrame([], arrived.schema), 1)
        assert sorted((r.trial, r.length) for r in state.results(spark).collect()) == [(1, 10), (2, 30)]
    assert state.failed(spark).count() == 0


def test_snapshots(spark, tmp_path):
    state = live.LiveState(str(tmp_path), lambda: spark.range(100).select(F.col("id").alias("trial")), lambda rows: rows)
    state.on_batch = live.snapshot_writer(state, planned=9)
    assert live.read_snapshot(spark, state) is None
    batch = lambda *r: spark.createDataFrame(list(r), "trial long, cond long, x double")
    state(batch((1, 1, 2.0), (1, 1, 3.0)), 3)
    state(batch((5, 1, 0.0), (2, 1, 0.0), (2, 1, 1.0), (7, None, 0.0)), 4)
    results, trials, row = live.read_snapshot(spark, state)
    assert (row["n_trials"], row["n_planned"], row["n_rows"], row["trials_by_cond"], row["version"]) == (4, 9, 6, {"1": 3, "none": 1}, 4)
    assert results.count() == 6 and sorted(r.trial for r in trials.collect()) == [1, 2, 5, 7]
    state(batch((2, 1, 9.0)), 5)  # a trial sent again: its own bucket is written, the older version stays readable
    assert sorted(os.listdir(tmp_path / "results/data/5")) == sorted(["_SUCCESS", "._SUCCESS.crc", *[n for n in os.listdir(tmp_path / "results/data/5") if n.startswith("bucket=")]]) and len(os.listdir(tmp_path / "results/data/5")) == 3
    results, _, row = live.read_snapshot(spark, state)
    assert row["n_rows"] == results.count() == 5 and state.table.read(spark, 4).count() == 6


def test_versions_are_whole_and_replace_keys(spark, tmp_path):
    table = VersionedTable(str(tmp_path), ("k",), buckets=4, most_parts=3)
    assert table.read(spark) is None
    rng, want, seen = random.Random(1), {}, []
    for v in range(9):
        own = {k: [(k, v, j) for j in range(rng.randrange(1, 4))] for k in rng.sample(range(12), 3)}
        want = {**want, **own}
        rows = spark.createDataFrame([r for x in own.values() for r in x], "k long, v long, j long")
        table.merge(rows, v)
        table.merge(rows, v)  # a batch that is run again
        seen.append(sorted(r for x in want.values() for r in x))
        assert sorted(map(tuple, table.read(spark).collect())) == seen[-1]
    for v in range(9):
        assert sorted(map(tuple, table.read(spark, v).collect())) == seen[v]
    with pytest.raises(ValueError):
        table.merge(rows, 2.5)
    table.expire(spark, keep=2)
    assert table.versions(spark) == [7, 8] and sorted(map(tuple, table.read(spark, 7).collect())) == seen[7] and sorted(map(tuple, table.read(spark).collect())) == seen[8]
    # parts of a merge that has no manifest yet aren't seen
    rows.withColumn("_version", F.lit(9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/data/9")
    assert sorted(map(tuple, table.read(spark).collect())) == seen[8]
    table.merge(rows.limit(0), 9)
    assert sorted(map(tuple, table.read(spark).collect())) == seen[8]


def test_readers_see_whole_versions(spark, tmp_path):
    table, stop, bad = VersionedTable(str(tmp_path), ("k",), buckets=8, most_parts=2), [], []
    rows = lambda v: spark.range(40).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    table.merge(rows(0), 0)

    def look():
        while not stop:
            got = {(r.v, r.n) for r in table.read(spark).groupBy("v").agg(F.count("*").alias("n")).collect()}
            if len(got) != 1 or next(iter(got))[1] != 40:
                bad.append(got)

    reader = threading.Thread(target=look)
    reader.start()
    for v in range(1, 6):
        table.merge(rows(v), v)
    stop.append(1)
    reader.join()
    assert not bad


def test_a_trigger_writes_the_groups_that_it_changes(spark, tmp_path):
    arrive = str(tmp_path / "in")
    table = VersionedTable(str(tmp_path / "stats"), ("g",))
    for k, rows in enumerate([[(1, 1.0), (2, 2.0), (3, 3.0)], [(2, 4.0)], [(4, 1.0), (4, 3.0)]]):
        spark.createDataFrame(rows, "g long, v double").coalesce(1).write.mode("append").parquet(arrive)
        stats = spark.readStream.schema("g long, v double").parquet(arrive).groupBy("g").agg(F.avg("v").alias("mean"))
        stats.writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        newest = max(table.versions(spark))
        assert {r.g for r in spark.read.parquet(f"{tmp_path}/stats/data/{newest}").collect()} == {g for g, _ in rows}
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, 1.0), (2, 3.0), (3, 3.0), (4, 2.0)]


def test_folder_gives_files_that_stand_still(tmp_path):
    files, log = tmp_path / "files", tmp_path / "log"
    files.mkdir()
    for k in range(1, 11):
        (files / f"s_{k}_mc.tif").write_bytes(b"x" * k)
    (files / "notes.txt").write_bytes(b"x")
    (files / "s_11_mc.tif").write_bytes(b"")
    options = {"path": str(files), "log": str(log), "quiet": "3"}
    reader = FolderReader(options)
    assert reader.scan(100.0) == []
    (files / "s_3_mc.tif").write_bytes(b"x" * 30)  # it grows
    (files / "s_7_mc.tif").unlink()  # it vanishes
    assert reader.scan(101.0) == []
    ready = reader.scan(103.5)
    assert [t for _, t, _ in ready] == [1, 2, 4, 5, 6, 8, 9, 10]
    reader._note(ready)
    assert [(t, n) for _, t, n in reader.scan(104.5)] == [(3, 30)]  # not given yet, so a stream that starts again finds it
    again = FolderReader(options)
    assert [r[1] for p in again.partitions({"given": 2}, {"given": 8}) for r in again.read(p)] == [4, 5, 6, 8, 9, 10]
    assert again.scan(200.0) == [] and [t for _, t, _ in again.scan(204.0)] == [3] and again.scan(300.0) == []


def test_folder_as_a_stream(spark, tmp_path):
    files, got = tmp_path / "files", []
    files.mkdir()
    spark.dataSource.register(TrialFolder)
    for names in ([12, 3], [7], [7]):
        for k in names:
            (files / f"s_{k}_mc.tif").write_bytes(b"x" * 10)
        stream = spark.readStream.format("trial_folder").options(path=str(files), log=str(tmp_path / "log"), quiet="0.2", settle="5").load()
        query = stream.writeStream.foreachBatch(lambda df, k: got.append([r.trial for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [x for x in got if x] == [[3, 12], [7]]


def test_keyed_state_meets_in_any_order(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, keyed.ROCKS)
    for name in ("data", "meta"):
        (tmp_path / name).mkdir()
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    data, got = "trial long, sent long, x double", []
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("data", data), ("meta", "trial long"))]
    put("data", [(3, 1, 3.0), (1, 1, 1.0), (9, 1, 9.0)], data)
    query = keyed.meet(*streams, wait_ms=300, retries=3).writeStream.outputMode("update").foreachBatch(lambda df, k: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for rows in ([(1,), (2,)], [(3,)]):
            put("meta", rows, "trial long")
            time.sleep(0.5)
        put("data", [(2, 1, 2.0), (1, 2, 1.5), (1, 3, 1.6)], data)
        end = time.time() + 60
        while time.time() < end and query.isActive and not ({2, 3, 9} <= {t for t, *_ in got} and (1, 1.6, None) in got):
            time.sleep(0.2)
    finally:
        query.stop()
        spark.conf.set(store, before)
    assert query.exception() is None
    last = {t: (x, why) for t, x, why in got}
    assert last[1] == (1.6, None) and last[2] == (2.0, None) and last[9][1] == "no metadata"
    assert last[3] in ((3.0, None), (None, "no metadata"))  # its metadata may come after three short waits


def test_idle_streams_stop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1,)], "trial long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, got = spark.readStream.schema("trial long").parquet(str(tmp_path / "in")), []
    for name, done in (("idle", lambda: False), ("done", lambda: len(got) > 0)):
        query = stream.writeStream.foreachBatch(lambda df, k: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="100 milliseconds").start()
        began = time.time()
        live.stop_when_idle(query, 4.0 if name == "idle" else 60.0, done, poll=0.1)
        assert not query.isActive and got and time.time() - began < 40
