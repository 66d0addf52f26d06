"""The queries of fine regions and of a whole session against a run over whole images in numpy."""

import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from trialweave import catalog
from trialweave.functions import numeric as N
from trialweave.functions import recursive
from trialweave.operators.raster import disk
from trialweave.plans.batch_queries import ONSET, RUN

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def stack(data):
    """Images of 64 vectors each; rows that the last one lacks are NaN."""
    v = np.array(pq.read_table(f"{data}/embeddings.parquet", columns=["embedding"]).column(0).to_pylist(), float)
    out = np.full((-(-len(v) // 64) * 64, 64), np.nan)
    out[: len(v)] = v
    return out.reshape(-1, 64, 64)


def cells():
    return {k: (slice(4 + 20 * k, 20 + 20 * k), slice(6 + 18 * k, 22 + 18 * k)) for k in range(3)}


def along(a, weights, axis, mode):
    half = len(weights) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half, half)
    p = np.pad(a, pad, mode=mode)
    return sum(w * np.take(p, range(k, k + a.shape[axis]), axis=axis) for k, w in enumerate(weights))


def blur(a, sigma, radius):
    w = np.exp(-np.arange(-radius, radius + 1.0) ** 2 / (2 * sigma * sigma))
    return along(along(a, w / w.sum(), 1, "edge"), w / w.sum(), 0, "edge")


def percentile(x, p):
    x = np.sort(np.asarray(x, float).ravel())
    h = min(max(len(x) * p / 100 + 0.5, 1), len(x))
    low = int(math.floor(h))
    return x[low - 1] + (h - low) * (x[min(low, len(x) - 1)] - x[low - 1])


def normalised(a):
    filt = blur(a, 0.7, 2)
    if not (a > 0).any():
        return filt
    lo, hi = (percentile(filt[a > 0], p) for p in (10, 99))
    return np.clip((filt - lo) / max(hi - lo, N.EPS), 0, 1)


def ridges(a, sensitivity):
    best = np.zeros_like(a)
    for t in (4, 6, 8, 10, 12, 14):
        s = t / 6
        g = blur(a, s, math.ceil(3 * s))
        second, first = (0.25, 0, -0.5, 0, 0.25), (0.5, 0, -0.5)
        xx, yy, xy = (s * s * x for x in (along(g, second, 1, "symmetric"), along(g, second, 0, "symmetric"), along(along(g, first, 1, "symmetric"), first, 0, "symmetric")))
        root = np.sqrt((xx - yy) ** 2 + 4 * xy**2)
        m = np.stack([0.5 * (xx + yy + root), 0.5 * (xx + yy - root)])
        order = np.argsort(np.abs(m), axis=0, kind="stable")
        l1, l2 = np.take_along_axis(m, order, axis=0)
        v = np.exp(-(l1**2 / np.where(l2 == 0, N.EPS, l2**2)) / 0.5) * (1 - np.exp(-(l1**2 + l2**2) / (2 * sensitivity**2)))
        best = np.maximum(best, np.where(l2 >= 0, 0, v))
    return best


def dilated(mask, radius):
    out = np.zeros_like(mask)
    for dr, dc in disk(radius):
        r, c = np.nonzero(mask)
        r, c = r + dr, c + dc
        ok = (r >= 0) & (c >= 0) & (r < mask.shape[0]) & (c < mask.shape[1])
        out[r[ok], c[ok]] = True
    return out


def opened(mask, least):
    left, out = set(zip(*map(list, np.nonzero(mask)))), np.zeros_like(mask)
    while left:
        queue, part = [left.pop()], []
        while queue:
            r, c = queue.pop()
            part.append((r, c))
            for q in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    queue.append(q)
        if len(part) >= least:
            out[tuple(zip(*part))] = True
    return out


def ring(seed, image, without=None):
    raw = dilated(seed, 5) & ~dilated(seed, 2)
    raw = raw if without is None else raw & ~without
    raw &= ~np.isnan(image)
    clean = opened(raw & (image <= percentile(image[raw], 95)), 7) if raw.any() else raw
    return clean if clean.sum() >= 50 else raw


def global_regions(image, sensitivity):
    out = {}
    for k, box in cells().items():
        rough = np.zeros(image.shape, bool)
        rough[box] = True
        masked = np.where(rough, image, 0.0)
        found = ridges(normalised(masked), sensitivity)
        fine = found >= percentile(found[found > 0], 50) if (found > 0).any() else np.zeros_like(rough)
        fine &= found > 0
        out[k] = (fine if fine.any() else rough, ring(found != 0, masked))
    return out


def trial_regions(image, sensitivity):
    norm, fine = normalised(image), {}
    for k, (r, c) in cells().items():
        rough = np.zeros(image.shape, bool)
        rough[r, c] = True
        box = slice(max(r.start - 2, 0), r.stop + 2), slice(max(c.start - 2, 0), c.stop + 2)
        found = np.zeros_like(norm)
        found[box] = ridges(norm[box], sensitivity)
        found[~rough] = 0
        own = (found > 0) & (found >= percentile(found[found > 0], 60)) if (found > 0).any() else np.zeros_like(rough)
        fine[k] = own if own.any() else rough
    return fine


def pixels(mask):
    return set(zip(*map(lambda x: x.tolist(), np.nonzero(mask))))


def test_global_fine_regions(spark):
    want = global_regions(np.nanmean(stack(SMALL), axis=0) + 0.5, 0.1)
    got = catalog.QUERIES["fine_roi_global"](spark, SMALL).collect()
    for k, (fine, around) in want.items():
        for kind, mask in (("fine", fine), ("ring", around)):
            assert {(r.r, r.c) for r in got if r.cell == k and r.kind == kind} == pixels(mask), (k, kind)


def test_trial_fine_regions(spark):
    images = np.nanmean(stack(SMALL).reshape(-1, 4, 64, 64), axis=1) + 0.5
    got = catalog.QUERIES["fine_roi_trial"](spark, SMALL).collect()
    spare = {}
    for k, box in cells().items():
        rough = np.zeros((64, 64), bool)
        rough[box] = True
        spare[k] = dilated(rough, 5)
    for t, image in enumerate(images):
        fine = trial_regions(image, 0.1)
        taken = np.any(list(fine.values()), axis=0)
        for k in fine:
            around = ring(fine[k], image, taken)
            around = around if around.any() else spare[k] & ~taken
            for kind, mask in (("fine", fine[k]), ("ring", around)):
                assert {(r.r, r.c) for r in got if r.cell == k and r.kind == kind and r.trial == t} == pixels(mask), (t, k, kind)


def test_a_whole_session(spark):
    stacks = stack(LARGE)[: 4 * (len(stack(LARGE)) // 4)].reshape(-1, 4, 64, 64) + 1.0
    with np.errstate(all="ignore"):
        images = np.nanmean(stacks, axis=1)
        kept = [t for t in range(len(stacks)) if t % 5 != 3]
        around = {k: r for k, (_, r) in global_regions(np.nanmean(images[kept], axis=0), 2.0).items()}
    b, a = recursive.low_pass(4, RUN.cutoff, RUN.freq)
    start = (ONSET - RUN.pre / 1000) * RUN.freq
    first, last = math.floor(start), math.ceil(start) + N.window_frames(RUN.freq, RUN.ipi, RUN.n_pulses, RUN.pre, RUN.post)
    columns = {}
    for t, frames in enumerate(stacks):
        fine = trial_regions(images[t], 2.0)
        taken = np.any(list(fine.values()), axis=0)
        for k in fine:
            own = ring(fine[k], images[t], taken)
            own = own if own.any() else around[k] & ~taken
            inside = lambda mask: [f[np.ix_(*np.nonzero(mask))] for f in frames]
            mean = lambda mask: np.array([np.nan if np.isnan(x).all() else np.nanmean(x) for x in inside(mask)])
            signal = mean(fine[k])[first - 1 : last]
            cut = signal - RUN.alpha * mean(own)[first - 1 : last]
            base = cut[: N.pre_length(RUN.freq, RUN.pre)].mean()
            # a frame without a pixel of the region has no row
            dff = [(x - base) / base if not np.isnan(f) else None for x, f in zip(cut, signal)] if t in kept else [np.nan] * RUN.length
            columns.setdefault((k, t % 2 + 1), []).append(dff)
    want = {}
    for (k, cond), cols in columns.items():
        for at in range(RUN.length):
            x = [c[at] for c in cols if at < len(c) and c[at] is not None]
            seen = [v for v in x if not np.isnan(v)]
            if x:
                mean, sd = (np.mean(seen), np.std(seen, ddof=1) if len(seen) > 1 else 0.0) if seen else (None, None)
                half = None if mean is None else sd / math.sqrt(len(x)) * N.t_quantile(0.975, len(x) - 1)
                want[k, cond, at + 1] = (len(x), len(seen), mean, None if mean is None else -(mean - half), None if mean is None else -(mean + half))
    got = {(r.cell, r.cond, r.k): (r.n_cols, r.n, r["mean"], r.ci_lo, r.ci_hi) for r in catalog.QUERIES["batch_run"](spark, LARGE).collect()}
    assert got.keys() == want.keys() and len(a) == len(b)
    for key, row in want.items():
        assert got[key][:2] == row[:2] and (row[2] is None and got[key][2] is None or np.allclose(got[key][2:], row[2:], atol=2e-6)), key
