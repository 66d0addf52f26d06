"""Exact deduplication by a minimal perfect hash over the distinct digests of a history.

The history's digests are dealt to buckets of bounded mean size. Each bucket gets a minimal perfect hash: the keys
of a sub-bucket are displaced together until all keys fill the bucket's slots with no gap. A slot holds
the full digest and the locator (doc_id) of the row that stays. A lookup computes one slot and compares the full
digest, so a digest outside the history is never taken for a member; such nonmembers are grouped by themselves.

Building the index groups by bucket (uniform, as digests are) after one row a digest has been aggregated; a
group of copies, however large, reaches a bucket as one row, and the number of tasks goes by the number of digests. The lookup joins
on the bucket, an ordinary sort-merge join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Keys a bucket holds on average, and keys of a sub-bucket that share a displacement.
BUCKET_KEYS, SHARED_KEYS = 128, 4
#: Digests that a task which builds buckets has on average.
TASK_KEYS = 1 << 15


def normalized(text):
    """White space runs ([\\x20\\x09-\\x0D]+) become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 (32 bytes) of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalized(F.col("text")).cast("binary"), 256)).alias("digest"))


def _hash(salt: int):
    return F.shiftrightunsigned(F.xxhash64("digest", F.lit(salt)), 2)


def _place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """h: three hashes a key. The shift of each sub-bucket and the slot of each key (n keys fill slots 0..n-1)."""
    n = h.shape[1]
    groups = max(1, -(-n // SHARED_KEYS))
    sub, a, b = h[0] % groups, h[1] % n, h[2] % n
    shifts, slots, taken, moves = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    members = [np.flatnonzero(sub == g) for g in range(groups)]
    for g in sorted(range(groups), key=lambda g: -len(members[g])):
        own = members[g]
        for turn in range(n):  # a shift is a turn, which multiplies the third hash, and a move; all moves of a turn are tried at once
            start = (a[own] + turn * b[own]) % n
            if len(set(start.tolist())) < len(own):
                continue
            free = ~taken[(start[:, None] + moves) % n].any(0)
            move = int(free.argmax())
            if free[move]:
                break
        else:
            return None
        shifts[g], slots[own] = turn * n + move, (start + move) % n
        taken[slots[own]] = True
    return shifts, slots


def _index_schema(doc_id: str) -> str:
    return f"bucket long, dropped_bits int, shifts array<long>, slot_digest array<binary>, slot_winner array<{doc_id}>, slot_rows array<long>"


def _build(keys: pa.Table) -> pa.Table:
    """The index row of one bucket. Where the hashes don't separate its keys, their upper bits are tried. Ids stay Arrow values, nulls too."""
    h = np.stack([keys.column(c).to_numpy() for c in ("h1", "h2", "h3")])
    drop, found = next((d, f) for d in range(45) if (f := _place(h >> d)))
    by_slot = keys.select(["digest", "winner", "rows"]).take(pa.array(np.argsort(found[1]))).combine_chunks()
    whole = lambda c: pa.ListArray.from_arrays([0, keys.num_rows], by_slot.column(c).combine_chunks())
    return pa.table({
        "bucket": pc.cast(keys.column("bucket").slice(0, 1), pa.int64()), "dropped_bits": pa.array([drop], pa.int32()), "shifts": pa.array([found[0].tolist()], pa.list_(pa.int64())),
        "slot_digest": whole("digest"), "slot_winner": whole("winner"), "slot_rows": whole("rows")})


def build_index(digests: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """The index of a history (doc_id, digest) and its number of buckets.

    A group's winner is its smallest doc_id, of any type that can be ordered; null ids never win against others. Repeated rows count.
    """
    groups = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("rows")), "digest-groups")
    n = groups.count()
    buckets = buckets or max(1, n // BUCKET_KEYS)
    keyed = groups.select("digest", "winner", "rows", (_hash(0) % buckets).alias("bucket"), *[_hash(k).alias(f"h{k}") for k in (1, 2, 3)])
    # a number of its own, as rows are small and adaptive execution would gather too many buckets in a task
    dealt = keyed.repartition(-(-n // TASK_KEYS) or 1, "bucket")
    return materialize(dealt.groupBy("bucket").applyInArrow(_build, _index_schema(dict(digests.dtypes)["doc_id"])), "digest-index"), buckets


def lookup(digests: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Adds hist_member, hist_winner and hist_rows to (doc_id, digest); the slot's digest is compared in full."""
    keyed = digests.withColumn("bucket", _hash(0) % buckets)
    n, bits = F.size("slot_digest"), F.col("dropped_bits")
    h = [F.expr(f"shiftrightunsigned(shiftrightunsigned(xxhash64(digest, {k}), 2), dropped_bits)") for k in (1, 2, 3)]
    joined = keyed.join(index, "bucket", "left").withColumn("shift", F.get("shifts", (h[0] % F.size("shifts")).cast("int")))
    slot = ((h[1] % n + F.expr("shift div size(slot_digest)") * (h[2] % n) + F.col("shift") % n) % n).cast("int")
    found = joined.withColumn("slot", slot).withColumn("hist_member", F.coalesce(F.get("slot_digest", F.col("slot")) == F.col("digest"), F.lit(False)))
    return found.select("doc_id", "digest", "hist_member", *[F.when(F.col("hist_member"), F.get(c, F.col("slot"))).alias(a) for c, a in (("slot_winner", "hist_winner"), ("slot_rows", "hist_rows"))])


def deduplicate(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `docs` and `history` have doc_id (of one type) and text; other columns are ignored. Without a history, `docs` is its own, as where one
    table is to be freed of its repetitions: the digests of all its rows are indexed, every row is looked up, none is a nonmember, and the
    row with the smallest doc_id of equal texts stays. With one, every text that the history has is
    dropped in favour of the history's winner (group_size counts the history's rows), and the rest is grouped
    separately. Null text counts as empty; rows that repeat both text and the winning doc_id get equal flags; a null doc_id stays only
    where no row of its group has an id. An empty table gives an empty result.
    """
    own = materialize(digests(docs), "digests")
    index, buckets = build_index(own if history is None else digests(history))
    found = lookup(own, index, buckets)
    if history is None:
        sure = F.when(F.col("hist_member"), F.col("hist_rows")).otherwise(F.raise_error(F.lit("a digest of the history has no slot")).cast("long"))
        out = found.select("doc_id", F.col("hist_winner").alias("keep_id"), sure.alias("group_size"), F.col("doc_id").eqNullSafe(F.col("hist_winner")).alias("kept"), "digest")
    else:
        found = materialize(found, "digest-lookup")
        new = found.where(~F.col("hist_member")).select("doc_id", "digest")
        groups = new.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = found.where("hist_member").select("doc_id", F.col("hist_winner").alias("keep_id"), F.col("hist_rows").alias("group_size"), F.lit(False).alias("kept"), "digest").unionByName(
            new.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
