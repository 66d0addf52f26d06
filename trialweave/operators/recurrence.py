"""Recursive filters over traces of any length: a block scan of a linear recurrence.

A trace is cut into blocks. What a filter does to a block is linear: it turns the state at its start into `transfer @ state + gain`, where the
transfer depends on the block's length alone and the gain is the state that the block leaves when it starts from zero. So each block is first run from
zero, the states at the blocks' starts come from a scan over the blocks' gains (again by blocks, a level up, until one is left), and then each block
is run from its own state. No row holds more than a block, and no task more than its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recursive import steady_state
from ..sources.scratch import materialize, sized

#: Samples in a block, and blocks that a level of the scan folds into one.
BLOCK, FAN = 1024, 256


class Recurrence:
    """The filter of coefficients (b, a) as a linear system of its state."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        self.b, self.a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
        self.order = len(self.a) - 1
        self.step = np.zeros((self.order, self.order))
        self.step[:, 0] = -self.a[1:]
        self.step[:-1, 1:] += np.eye(self.order - 1)
        self._power: dict[int, np.ndarray] = {}

    def transfer(self, samples: int) -> np.ndarray:
        if samples not in self._power:
            self._power[samples] = np.linalg.matrix_power(self.step, samples)
        return self._power[samples]

    def run(self, x: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state of rows `x`, of which the first size[k] samples count, all rows at once."""
        y, z, last = np.empty_like(x), np.hstack([state, np.zeros((len(x), 1))]), state.copy()
        ends = {t: np.flatnonzero(size == t) for t in np.unique(size)}
        for t in range(x.shape[1]):
            y[:, t] = self.b[0] * x[:, t] + z[:, 0]
            z[:, :-1] = z[:, 1:] + x[:, t : t + 1] * self.b[1:] - y[:, t : t + 1] * self.a[1:]
            if t + 1 in ends:
                last[ends[t + 1]] = z[ends[t + 1], :-1]
        return y, last


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one width and their sizes; missing values are NaN."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _listed(values: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[np.arange(values.shape[1]) < size[:, None]], from_pandas=True))


def _flip(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each row's first size[k] values in reverse."""
    at = size[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=1), 0.0)


def _arrow_map(df: DataFrame, one: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type, from_pandas=True) for v, f in zip(one(batch), own)], schema=own)

    return df.mapInArrow(run, target)


def blocks(points: DataFrame, key: str, order: str, value: str, size: int = BLOCK) -> DataFrame:
    """(key, block, xs) of rows (key, order from 1 without gaps, value): a shuffle by (key, block)."""
    at = points.select(key, F.col(order).alias("_at"), F.col(value).cast("double").alias("_x")).withColumn("block", F.expr(f"(_at - 1) div {size}").cast("long"))
    return at.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("xs"))


def _folded(gains: list[list[float] | None], lengths: list[int], filt: Recurrence, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The state before each of a row of blocks, and after the last."""
    states, s = [], start
    for gain, length in zip(gains, lengths):
        states.append(s)
        s = filt.transfer(length) @ s + np.asarray([np.nan if g is None else g for g in gain])
    return states, s


def carried(gains: DataFrame, key: str, filt: Recurrence, fan: int = FAN) -> DataFrame:
    """(key, block, state before it) of (key, block, length, gain); the state before a key's first block is zero.

    `fan` blocks are folded at a time; what they leave together is scanned a level up.
    """
    kind = dict(gains.dtypes)[key]
    low, high = gains.agg(F.min("block"), F.max("block")).first()
    upper = gains.withColumn("up", F.expr(f"(block - {low or 0}) div {fan}")).groupBy(key, "up").agg(F.array_sort(F.collect_list(F.struct("block", "length", "gain"))).alias("own"))

    def fold(start: list | None, own: list) -> tuple[list[np.ndarray], np.ndarray]:
        first = np.zeros(filt.order) if start is None else np.array([np.nan if v is None else v for v in start])
        return _folded([x["gain"] for x in own], [x["length"] for x in own], filt, first)

    if (high or 0) - (low or 0) >= fan:
        upper = materialize(upper, "scan")

        def total(batch: pa.RecordBatch) -> list:
            rows = batch.column(2).to_pylist()
            return [batch.column(0), batch.column(1), [sum(x["length"] for x in own) for own in rows], [fold(None, own)[1].tolist() for own in rows]]

        above = _arrow_map(upper.select(key, "up", "own"), total, f"{key} {kind}, block long, length long, gain array<double>")
        start = carried(materialize(above, "scan-up"), key, filt, fan).withColumnRenamed("block", "up").withColumnRenamed("state", "start")
        upper = upper.join(start, [key, "up"])
    else:
        upper = upper.withColumn("start", F.lit(None).cast("array<double>"))

    def spread(batch: pa.RecordBatch) -> list:
        keys, names, states = [], [], []
        for k, start, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
            keys += [k] * len(own)
            names += [x["block"] for x in own]
            states += [s.tolist() for s in fold(start, own)[0]]
        return [keys, names, states]

    return _arrow_map(upper.select(key, "start", "own"), spread, f"{key} {kind}, block long, state array<double>")


def scan(parts: DataFrame, key: str, filt: Recurrence, start: Sequence[float] | None = None, backward: bool = False, fan: int = FAN) -> DataFrame:
    """(key, block, xs) filtered, written: `parts` has (key, block, xs), `start` is the state per unit of a key's first sample, zero if None.

    Backward, blocks and the samples in them are taken from the last to the first.
    """
    parts = parts.select(key, F.expr("-block" if backward else "block").alias("block"), "xs")
    kind = dict(parts.dtypes)[key]
    if start is None:
        parts = parts.withColumn("first", F.lit(False))
    else:
        first = sized(parts.groupBy(key).agg(F.min("block").alias("block")).withColumn("first", F.lit(True)))
        parts = parts.join(first, [key, "block"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    parts = materialize(parts.select(key, "block", "first", "xs"), "blocks")
    unit = np.zeros(filt.order) if start is None else np.asarray(start)

    def given(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size = _ragged(batch.column(3))
        x = _flip(x, size) if backward else x
        own = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        return x, size, np.where(own[:, None], x[:, :1] * unit, 0.0)

    def gain(batch: pa.RecordBatch) -> list:
        x, size, state = given(batch)
        return [batch.column(0), batch.column(1), size, _listed(filt.run(x, size, state)[1], np.full(len(x), filt.order))]

    gains = materialize(_arrow_map(parts, gain, f"{key} {kind}, block long, length long, gain array<double>"), "gains")
    states = carried(gains, key, filt, fan)

    def filtered(batch: pa.RecordBatch) -> list:
        x, size, state = given(batch)
        before, _ = _ragged(batch.column(4))
        y, _ = filt.run(x, size, state + before)
        y = _flip(y, size) if backward else y
        return [batch.column(0), batch.column(1), _listed(y, size)]

    done = _arrow_map(parts.join(states, [key, "block"]), filtered, f"{key} {kind}, block long, xs array<double>")
    return materialize(done.select(key, F.expr("-block" if backward else "block").alias("block"), "xs"), "filtered")


def _points(done: DataFrame, key: str, order: str, out: str, size: int) -> DataFrame:
    return done.select(key, "block", F.posexplode("xs").alias("_p", out)).select(key, (F.col("block") * size + F.col("_p") + 1).cast("long").alias(order), out)


def causal(points: DataFrame, b: Sequence[float], a: Sequence[float], key: str = "trial", order: str = "frame", value: str = "v", out: str = "y", size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(key, order, out): rows (key, order, value) filtered in the order of `order`, which counts from 1 without gaps. A missing value makes the rest of its trace missing."""
    return _points(scan(blocks(points, key, order, value, size), key, Recurrence(b, a), fan=fan), key, order, out, size)


def zero_phase(points: DataFrame, b: Sequence[float], a: Sequence[float], key: str = "trial", order: str = "frame", value: str = "v", out: str = "y", size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """As causal(), forward and backward, each trace being extended at both ends by 3 * order samples mirrored about its end values.

    Traces that are no longer than that extension have missing values only.
    """
    filt, pad = Recurrence(b, a), 3 * (len(a) - 1)
    if size <= pad:
        raise ValueError("a block is longer than the extension")
    parts = materialize(blocks(points, key, order, value, size), "trace-blocks")
    # the ends of each trace, from its first block and its last two
    tail = F.slice("xs", -F.least(F.lit(pad + 1), F.size("xs")), F.lit(pad + 1))
    ends = parts.groupBy(key).agg(F.max("block").alias("last"), F.max_by(tail, "block").alias("z"), F.min_by(F.slice("xs", 1, pad + 1), "block").alias("head"))
    before = parts.select(key, (F.col("block") + 1).alias("last"), tail.alias("y"))
    both = ends.join(before, [key, "last"], "left").withColumn("joined", F.concat(F.coalesce("y", F.array().cast("array<double>")), "z"))
    both = both.select(key, "last", "head", F.slice("joined", -F.least(F.lit(pad + 1), F.size("joined")), F.lit(pad + 1)).alias("tail"))
    both = materialize(both.where(F.size("tail") == pad + 1), "trace-ends")
    mirrored = lambda xs, end: F.transform(F.reverse(xs), lambda v: 2 * end - v)
    front = both.select(key, F.lit(-1).cast("long").alias("block"), mirrored(F.slice("head", 2, pad), F.get("head", F.lit(0))).alias("xs"))
    back = both.select(key, (F.col("last") + 1).alias("block"), mirrored(F.slice("tail", 1, pad), F.get("tail", F.lit(pad))).alias("xs"))
    known = sized(both.select(key))
    whole = parts.join(known, key, "left_semi").select(key, "block", "xs").unionByName(front).unionByName(back)
    unit = steady_state(list(b), list(a))
    done = scan(scan(whole, key, filt, unit, fan=fan), key, filt, unit, backward=True, fan=fan)
    # a trace's own blocks, without the extensions
    inner = done.join(sized(both.select(key, "last")), key).where("block between 0 and last").select(key, "block", "xs")
    short = parts.join(known, key, "left_anti").select(key, "block", F.transform("xs", lambda v: F.lit(None).cast("double")).alias("xs"))
    return _points(inner.unionByName(short), key, order, out, size)
