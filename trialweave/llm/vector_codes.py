"""Codes of vectors: each is cut into four parts, each part is named by its nearest entry of a codebook, in integers throughout.

Distances are compared after a Walsh-Hadamard transform of parts and entries, zero-padded to a power of two: with `p` values, the squared
differences of the transforms add up to `p` times the squared distance, whatever order they are added in. They are added in the order of
sequency, in which the first few hold most of the difference of smooth parts, and an entry is out as soon as its sum is beyond that of
an entry that is known in full.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

PARTS, SCALE, ENTRIES, ROUNDS = 4, 1024, 256, 4
#: Components are at most so large after scaling, so that a part's sum fits in 64 bits.
LARGEST = 1 << 60
#: Share of the transformed values that is added up for all entries before the first are out, and values in each step after it. Whole
#: rows of numpy are so much cheaper than single pairs that a smaller share costs more, even where it leaves one entry of six.
DENSE, STEP = 3 / 4, 4
#: Rows of which parts are compared with all entries at once, so that their sums stay in a core's cache.
BLOCK = 128
#: Share of all rows from which on a label counts as large; there are at most as many of these as shares in the whole.
LARGE_LABEL = 1 / 10_000


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and label of rows whose vector has neither null nor non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of the components as rows of `width`; shorter vectors end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))  # a power of two: the product is exact
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squared distances don't fit in a long")
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat.astype(np.int64)
    return out


@functools.lru_cache(8)
def _sequency(p: int) -> np.ndarray:
    """Where the functions of a fast transform of `p` values stand in the order of their sign changes."""
    rows = _butterfly(np.eye(p, dtype=np.int64))
    return np.argsort((np.diff(rows, axis=0) != 0).sum(axis=0), kind="stable")


def _butterfly(x: np.ndarray) -> np.ndarray:
    p, h = x.shape[1], 1
    while h < p:
        pairs = x.reshape(len(x), p // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), p)
        h *= 2
    return x


def transform(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transforms of the rows, zero-padded to a power of two, in the order of sequency. Python's integers where 64 bits may not do."""
    n, width = parts.shape
    p = 1 << max(0, width - 1).bit_length()
    wide = int(np.abs(parts).max(initial=0)) * p >= 1 << 63
    padded = np.zeros((n, p), object if wide else np.int64)
    padded[:, :width] = parts
    return _butterfly(padded)[:, _sequency(p)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of transforms the index of the nearest of the entries (the lowest of equally near ones) and the squared distance."""
    p = x.shape[1]
    most = p * (int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))) ** 2
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    x, entries = x.astype(kind), entries.astype(kind)
    code, least = np.zeros(len(x), np.int64), np.zeros(len(x), object if kind is object else np.int64)
    for at in range(0, len(x), BLOCK):
        code[at : at + BLOCK], least[at : at + BLOCK] = _nearest(x[at : at + BLOCK], entries)
    return code, least // p


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, dense = x.shape[1], math.ceil(DENSE * x.shape[1])
    total, gap = (np.zeros((len(x), len(entries)), x.dtype) for _ in range(2))
    for a, b in zip(x.T[:dense], np.ascontiguousarray(entries.T[:dense])):
        np.subtract(a[:, None], b, out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(total, gap, out=total)
    guess = entries[total.argmin(axis=1)]  # known in full, it bounds the rest
    bound = ((x - guess) ** 2).sum(axis=1, dtype=x.dtype)
    row, entry = np.nonzero(total <= bound[:, None])
    left = total[row, entry]
    for s in range(dense, p, STEP):
        left = left + ((x[row, s : s + STEP] - entries[entry, s : s + STEP]) ** 2).sum(axis=1, dtype=x.dtype)
        still = left <= bound[row]
        row, entry, left = row[still], entry[still], left[still]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(left, first)
    ties = np.flatnonzero(left == least[row])
    return entry[ties[np.r_[True, row[ties][1:] != row[ties][:-1]]]], least


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, PARTS, axis=1)


def _sums(column: pa.Array, books: list[np.ndarray], spectra: list[np.ndarray]) -> list[tuple]:
    """(part, code, number of rows, componentwise sums) of one batch."""
    out = []
    for k, part in enumerate(_parts(integers(column, books[0].shape[1] * PARTS))):
        if not len(part):
            continue
        code, _ = nearest(transform(part), spectra[k])
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        total = np.add.reduceat(part[order], first, axis=0) if int(np.abs(part).max(initial=0)) * len(part) < 1 << 63 else np.add.reduceat(part[order].astype(object), first, axis=0)
        out += zip([k] * len(first), code[order][first].tolist(), np.diff(np.r_[first, len(order)]).tolist(), total)
    return out


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: codebooks whose entries are the means, rounded down, of the parts nearest to them; unused entries stay.

    Each task adds up its rows by (part, entry), then these sums are added up by Spark: the driver gets one row an entry at most.
    """
    width = books[0].shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((books, [transform(b) for b in books]))  # as large as the codebooks
    schema = pa.schema([("part", pa.int32()), ("code", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        own, spectra = sent.value
        count = [[0] * len(own[0]) for _ in own]
        total = [[None] * len(own[0]) for _ in own]
        for batch in batches:
            for part, code, n, sums in _sums(batch.column(0), own, spectra):
                had = total[part][code]
                if had is not None and (had.dtype == object or sums.dtype == object or max(np.abs(had).max(initial=0), np.abs(sums).max(initial=0)) >= 1 << 62):
                    had = had.astype(object)
                count[part][code] += n
                total[part][code] = sums if had is None else had + sums
        found = [(k, e, count[k][e], [Decimal(int(v)) for v in total[k][e]]) for k in range(len(own)) for e in range(len(own[0])) if count[k][e]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), schema)], schema=schema)

    partial = rows.select("embedding").mapInArrow(run, "part int, code int, n long, sums array<decimal(38,0)>")
    added = partial.groupBy("part", "code").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).cast("array<decimal(38,0)>").alias("sums"))
    books = [b.copy() for b in books]
    for r in added.collect():
        books[r.part][r.code] = [int(v) // r.n for v in r.sums]
    return books


def first_books(rows: DataFrame) -> list[np.ndarray]:
    """The parts of the ENTRIES rows with the smallest vec_id (null ids last, equal ids by their vectors); fewer, if there are fewer rows."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES).toArrow().column(0).combine_chunks()
    return _parts(integers(start, width))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of `kept` rows, one a part."""
    books = first_books(rows)
    for _ in range(rounds if len(books[0]) else 0):
        books = _moved(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances to the entries) of `kept` rows."""
    sent = rows.sparkSession.sparkContext.broadcast([transform(b) for b in books])
    width = books[0].shape[1] * PARTS

    def make():
        spectra = sent.value

        def one(batch: pa.RecordBatch) -> list:
            found = [nearest(transform(part), spectra[k]) for k, part in enumerate(_parts(integers(batch.column(1), width)))]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = [sum(e) for e in zip(*(d.tolist() for _, d in found))]
            return [batch.column(0), batch.column(2), [c.tobytes().hex() for c in codes], error]

        return one

    types = dict(rows.dtypes)
    return map_batches(rows, make, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors added up over equal labels, nulls together) and codebooks_sha256 of rows (vec_id, embedding, label).

    Rows whose vector is null or has a null or non-finite component are dropped. Vectors that are shorter than the longest, or whose length isn't
    a multiple of four, count as ended by zeros; empty ones are all zeros. Repeated rows each have their code; a table without rows gives none.
    Components beyond 2**50 are an error, as is a squared distance beyond a long. Other columns are ignored.
    Each round reads the vectors once; only sums by part and entry are shuffled.
    """
    rows = kept(vectors)
    books = fit(rows, rounds)
    coded = materialize(encode(rows, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")).withColumnRenamed("label", "of_label")
    by_label = materialize(by_label, "label-errors")
    # large labels are few, so that they are broadcast; each of the others fits in a task
    bound = max(1, int(coded.count() * LARGE_LABEL))
    large, small = by_label.where(F.col("rows") >= bound), by_label.where(F.col("rows") < bound)
    same = lambda sums: F.col("label").eqNullSafe(sums["of_label"])
    in_large = coded.join(F.broadcast(large), same(large))
    in_small = coded.join(F.broadcast(large.select("of_label")), same(large), "left_anti").join(small, same(small))
    return in_large.unionByName(in_small).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
