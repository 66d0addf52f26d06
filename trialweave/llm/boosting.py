"""Small gradient-boosted trees for two classes, fitted to all given rows and applied as Spark expressions.

Rows are distinct features with counts. A level of a tree takes sums of gradients by (node, feature, value), running sums of these in the order of values, and
the best cut of each node. If there are more than LOCAL_ROWS rows, each level is a Spark job and only the cuts reach the driver; fewer rows are gathered whole, and
the same sums are made in numpy. Gradients are added as whole multiples of 1 / SCALE, so that a fit doesn't depend on the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A leaf's value, or (feature, threshold, tree where the feature is at most the threshold, tree elsewhere).
Tree = float | tuple
#: A node's number, its sums of gradients and curvatures, the best cut's gain (-1 without any), feature and threshold, and the sums up to it.
Cut = tuple[int, float, float, float, int, float, float, float]

SCALE, RIDGE, LEAST_GAIN = 1 << 24, 1.0, 1e-6
#: Rows up to which they are gathered (some 200 bytes each); a choice of speed alone, as a level takes a Spark job a second or so.
LOCAL_ROWS = 50_000


def _column(tree: Tree, feature: Callable[[int], Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(feature(f) <= t, _column(low, feature)).otherwise(_column(high, feature))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))


def _feature(f: int) -> Column:
    return F.get("features", F.lit(f))


def _gain(g, h, gl, hl):
    part = lambda g, h: g * g / (h + RIDGE)
    return part(gl, hl) + part(g - gl, h - hl) - part(g, h)


def _spread_cuts(rows: DataFrame, model: dict) -> Callable[[Tree], Iterable[Cut]]:
    """A function from a tree whose leaves are numbers of nodes (0: closed) to the cuts of these nodes. Of equal gains the first feature's smallest value counts."""
    scaled = lambda x: F.round(x * SCALE).cast("long")
    p = rows.withColumn("p", 1 / (1 + F.exp(-margin_column(model, _feature))))
    sloped = p.select("features", scaled(F.col("positive") - F.col("n") * F.col("p")).alias("g"), scaled(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
    own = Window.partitionBy("node", "feature")
    up = own.orderBy("value")

    def cuts(tree: Tree) -> Iterable[Cut]:
        parts = sloped.withColumn("node", _column(tree, _feature)).where("node > 0").select("node", "g", "h", F.posexplode("features").alias("feature", "value"))
        sums = parts.groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        run = sums.select("node", "feature", "value", F.lead("value").over(up).alias("next"), *[(F.sum(c).over(w) / SCALE).alias(c + name) for c in "gh" for name, w in (("", own), ("l", up))])
        gain = F.when(F.col("next").isNotNull(), _gain(*map(F.col, ("g", "h", "gl", "hl")))).otherwise(-1.0)
        best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("value")).alias("value"), "next", "g", "h", "gl", "hl"))
        for r in run.groupBy("node").agg(best.alias("x")).select("node", "x.*").collect():
            yield r.node, r.g, r.h, r.gain, -r.feature, (-r.value + (r.next or 0.0)) / 2, r.gl, r.hl

    return cuts


def _local_cuts(x: np.ndarray, n: np.ndarray, positive: np.ndarray, model: dict) -> Callable[[Tree], Iterable[Cut]]:
    """As _spread_cuts, of arrays."""
    p = 1 / (1 + np.exp(-margin(model, x)))
    g, h = np.round((positive - n * p) * SCALE).astype(np.int64), np.round(n * p * (1 - p) * SCALE).astype(np.int64)

    def cuts(tree: Tree) -> Iterable[Cut]:
        nodes = _apply(tree, x)
        for node in set(nodes.tolist()) - {0}:
            at = nodes == node
            total = g[at].sum() / SCALE, h[at].sum() / SCALE
            best = (node, *total, -1.0, 0, 0.0, 0.0, 0.0)
            for f in range(x.shape[1]):
                order = np.argsort(x[at, f], kind="stable")
                v = x[at, f][order]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    gl, hl = np.cumsum(g[at][order])[cut] / SCALE, np.cumsum(h[at][order])[cut] / SCALE
                    gain = _gain(*total, gl, hl)
                    k = int(gain.argmax())
                    if gain[k] > best[3]:
                        best = (node, *total, gain[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2, gl[k], hl[k])
            yield best

    return cuts


def _grow(cuts: Callable[[Tree], Iterable[Cut]], depth: int) -> Tree:
    """Node 1 is the root; those below node i are 2i and 2i + 1."""
    split, value, last = {}, {}, {1}

    def tree(i: int, leaf: Callable) -> Tree:
        return (*split[i], tree(2 * i, leaf), tree(2 * i + 1, leaf)) if i in split else leaf(i)

    for _ in range(depth):
        found, last = cuts(tree(1, lambda i: i if i in last else 0)), set()
        for i, g, h, gain, f, t, gl, hl in list(found):
            value.setdefault(i, float(g / (h + RIDGE)))
            if gain > LEAST_GAIN:
                split[i] = (f, float(t))
                value[2 * i], value[2 * i + 1] = float(gl / (hl + RIDGE)), float((g - gl) / (h - hl + RIDGE))
                last |= {2 * i, 2 * i + 1}
        if not last:
            break
    return tree(1, value.__getitem__)


def fit(rows: DataFrame, trees: int = 20, depth: int = 3, rate: float = 0.4, local: int = LOCAL_ROWS) -> dict:
    """Logistic boosting on rows (features array<double>, n, positive): n rows have these features, `positive` of them are of the first class. `bias` is
    the log odds of the classes."""
    size, n, positive = rows.agg(F.count("*"), F.sum("n"), F.sum("positive")).first()
    model = {"bias": math.log((positive + 0.5) / (n - positive + 0.5)), "rate": rate, "trees": []}
    if size <= local:
        got = rows.select("features", "n", "positive").toArrow()
        arrays = np.array(got.column(0).to_pylist()), got.column(1).to_numpy(), got.column(2).to_numpy()
    for _ in range(trees):
        model["trees"].append(_grow(_local_cuts(*arrays, model) if size <= local else _spread_cuts(rows, model), depth))
    return model


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    return model["bias"] + model["rate"] * sum((_apply(t, x) for t in model["trees"]), np.zeros(len(x)))


def margin_column(model: dict, feature: Callable[[int], Column]) -> Column:
    """The margin as an expression of the features."""
    total = F.lit(0.0)
    for tree in model["trees"]:
        total = total + _column(tree, feature)
    return F.lit(model["bias"]) + F.lit(model["rate"]) * total


def _spread_sums(rows: DataFrame, a: float, b: float, high: float, low: float) -> tuple:
    """Sums over rows (z, n, positive) for a step of calibrate(); the last one is the loss."""
    z, n, positive = map(F.col, ("z", "n", "positive"))
    m = F.lit(a) * z + F.lit(b)
    p, target = 1 / (1 + F.exp(-m)), positive * high + (n - positive) * low
    w, d, loss = n * (p * (1 - p) + 1e-9), target - n * p, n * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))) - target * m
    return rows.select("z", w.alias("w"), d.alias("d"), loss.alias("loss")).selectExpr("sum(w * z * z)", "sum(w * z)", "sum(w)", "sum(d * z)", "sum(d)", "sum(loss)").first()


def _local_sums(z: np.ndarray, n: np.ndarray, positive: np.ndarray, a: float, b: float, high: float, low: float) -> tuple:
    m = a * z + b
    p, target = 1 / (1 + np.exp(-np.clip(m, -700, 700))), positive * high + (n - positive) * low
    w, d, loss = n * (p * (1 - p) + 1e-9), target - n * p, n * np.logaddexp(0, m) - target * m
    return (w * z * z).sum(), (w * z).sum(), w.sum(), (d * z).sum(), d.sum(), loss.sum()


def calibrate(rows: DataFrame, local: int = LOCAL_ROWS) -> tuple[float, float]:
    """Slope and offset of a sigmoid fitted to the held-out rows (z, n, positive): n rows have the margin z, `positive` of them are of the first class.

    By Newton's steps, each halved until the loss doesn't grow.
    """
    size, n, positive = rows.agg(F.count("*"), F.sum("n"), F.sum("positive")).first()
    high, low = (positive + 1) / (positive + 2), 1 / (n - positive + 2)
    if size <= local:
        got = rows.select("z", "n", "positive").toArrow()
        arrays = [c.to_numpy() for c in got.columns]

    def at(a: float, b: float) -> tuple:
        *sums, loss = _local_sums(*arrays, a, b, high, low) if size <= local else _spread_sums(rows, a, b, high, low)
        return a, b, *map(float, sums), float(loss) + 0.5e-3 * (a - 1) ** 2

    now = at(1.0, 0.0)
    for _ in range(50):
        a, b, zz, z1, one, dz, d1, loss = now
        zz, one, dz = zz + 1e-3, one + 1e-3, dz - 1e-3 * (a - 1)
        det = zz * one - z1 * z1
        step = (one * dz - z1 * d1) / det, (zz * d1 - z1 * dz) / det
        new = at(a + step[0], b + step[1])
        while new[-1] > loss and max(map(abs, step)) >= 1e-8:
            step = step[0] / 2, step[1] / 2
            new = at(a + step[0], b + step[1])
        if max(map(abs, step)) < 1e-8:
            break
        now = new
    return now[:2]
