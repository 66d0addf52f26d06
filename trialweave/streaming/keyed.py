"""Live mode by keyed state: trials and their metadata arrive as streams in any order; each trial's state waits for what it lacks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors of this kind need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds between tries of a trial without metadata, and tries.
WAIT_MS, RETRIES = 2000, 30


#: Keys that trials are dealt to. A call to the state costs a round trip, so a key's trials are read and written together, as lists.
KEYS = 64


class Meeting(StatefulProcessor):
    """By a key of trials: a trial's data are given once its metadata are known, and again when they are sent again; without metadata they fail after `retries` waits."""

    def __init__(self, trial: str, payload: str, columns: list[str], wait_ms: int = WAIT_MS, retries: int = RETRIES):
        self.trial, self.payload, self.columns, self.wait_ms, self.retries = trial, payload, columns, wait_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", f"trial {self.trial}")
        self.waiting = handle.getListState("waiting", f"trial {self.trial}, {self.payload}, tries int, due long")

    def _held(self, state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def _keep(self, waiting: list[tuple]) -> None:
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(min(r[-1] for r in waiting))
        else:
            self.waiting.clear()

    def _given(self, rows: list[tuple], reason: str | None = None) -> pd.DataFrame:
        return pd.DataFrame([(*r, reason) for r in rows], columns=["trial", *self.columns, "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        known = {t for (t,) in self._held(self.known)}
        if fresh := sorted(set(pdf.loc[pdf["is_meta"], "trial"].tolist()) - known):
            self.known.appendList([(t,) for t in fresh])
            known |= set(fresh)
        own = pdf[~pdf["is_meta"]]
        own = own[own["sent"] == own.groupby("trial")["sent"].transform("max")]  # of two sendings in a batch the later one counts
        new = list(own[["trial", *self.columns]].itertuples(index=False, name=None))
        sent = {r[0] for r in new}
        before = self._held(self.waiting)
        held = [r for r in before if r[0] not in sent]
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        waiting = [r for r in held if r[0] not in known] + [(*r, 0, due) for r in new if r[0] not in known]
        if waiting or before:
            self._keep(waiting)
        ready = [r for r in new if r[0] in known] + [r[:-2] for r in held if r[0] in known]
        if ready:
            yield self._given(ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left, failed = timerValues.getCurrentProcessingTimeInMs(), [], []
        for *row, tries, due in self._held(self.waiting):
            if due > now:
                left.append((*row, tries, due))
            elif tries + 1 >= self.retries:
                failed.append(row[0])
            else:
                left.append((*row, tries + 1, now + self.wait_ms))
        self._keep(left)
        if failed:
            yield self._given([(t, *[None] * len(self.columns)) for t in sorted(set(failed))], "no metadata")

    def close(self) -> None:
        pass


def meet(arrivals: DataFrame, metadata: DataFrame, wait_ms: int = WAIT_MS, retries: int = RETRIES, keys: int = KEYS) -> DataFrame:
    """A stream of (trial, payload columns, reason): `arrivals` has (trial, sent, payload columns), where `sent` grows when a trial is sent again, and
    `metadata` has (trial). Rows of trials that have failed have a reason and no payload. The session's state store is RocksDB (ROCKS).

    A key's list of known trials and its waiting rows are read when one of its trials comes, so `keys` should grow with the trials of a session."""
    columns = [c for c in arrivals.columns if c not in ("trial", "sent")]
    kinds = {f.name: f.dataType.simpleString() for f in arrivals.schema.fields}
    payload = ", ".join(f"{c} {kinds[c]}" for c in columns)
    null = [F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    both = arrivals.select("trial", F.col("sent").cast("long"), *columns, F.lit(False).alias("is_meta")).unionByName(metadata.select("trial", F.lit(0).cast("long").alias("sent"), *null, F.lit(True).alias("is_meta")))
    dealt = both.withColumn("dealt", F.pmod(F.xxhash64("trial"), F.lit(keys)))
    return dealt.groupBy("dealt").transformWithStateInPandas(Meeting(kinds["trial"], payload, columns, wait_ms, retries), f"trial {kinds['trial']}, {payload}, reason string", "Update", "ProcessingTime")
