"""Recursive (IIR) filters over arrays: causal, and forward-backward without phase."""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples up to which a trace is filtered as an array, whose fold copies its output at each step; longer ones are scanned by blocks (operators.recurrence).
LONG = 1000


def low_pass(order: int, cutoff: float, freq: float) -> tuple[list[float], list[float]]:
    """(b, a) of the maximally flat low-pass by the bilinear transform with pre-warping."""
    warped = 2 * freq * math.tan(math.pi * cutoff / freq)
    poles = [warped * cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    z = [(2 * freq + p) / (2 * freq - p) for p in poles]
    a, b = np.real(np.poly(z)), np.real(np.poly([-1.0] * order))
    return (b * (a.sum() / b.sum())).tolist(), a.tolist()


def steady_state(b: list[float], a: list[float]) -> list[float]:
    """The state that a constant input of 1 keeps."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -np.array(a[1:])
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, np.array(b[1:]) - np.array(a[1:]) * b[0]).tolist()


def causal(x: Column, b: list[float], a: list[float], start: list[Column] | None = None) -> Column:
    """The filtered array; `start` is the initial state, zero by default. A NULL sample makes the rest NULL."""
    n = len(a) - 1
    first = F.struct(*[(start[k] if start else F.lit(0.0)).cast("double").alias(f"z{k}") for k in range(n)], F.array().cast("array<double>").alias("y"))

    def step(s: Column, v: Column) -> Column:
        y = v * b[0] + s["z0"]
        nxt = [(s[f"z{k + 1}"] if k + 1 < n else F.lit(0.0)) + v * b[k + 1] - y * a[k + 1] for k in range(n)]
        return F.struct(*[z.alias(f"z{k}") for k, z in enumerate(nxt)], F.concat(s["y"], F.array(y)).alias("y"))

    return F.aggregate(x, first, step, lambda s: s["y"])


def zero_phase(x: Column, b: list[float], a: list[float]) -> Column:
    """Forward and backward pass over the array, extended at both ends by 3 * order samples mirrored about the end values."""
    pad = 3 * (len(a) - 1)
    n = F.size(x)
    head, tail = F.get(x, F.lit(0)), F.get(x, n - 1)
    front = F.transform(F.reverse(F.slice(x, 2, pad)), lambda v: 2 * head - v)
    back = F.transform(F.reverse(F.slice(x, F.greatest(n - pad, F.lit(1)), F.lit(pad))), lambda v: 2 * tail - v)
    z = steady_state(b, a)

    def one_way(values: Column) -> Column:
        # the wrapped array is bound once, as the first sample sets the state
        return F.get(F.transform(F.array(values), lambda w: F.reverse(causal(w, b, a, [F.get(w, F.lit(0)) * s for s in z]))), F.lit(0))

    return F.when(n > pad, F.slice(one_way(one_way(F.concat(front, x, back))), pad + 1, n))
