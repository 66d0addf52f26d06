"""Language-model scoring by cross-entropy difference.

Two byte n-gram models of one order, one smoothing and one vocabulary: the target's counts are of the documents chosen as good,
the background's of all documents. P(c | h) = (count(hc) + alpha) / (count(h) + 256 alpha), where h are the ORDER - 1 bytes before c
(zero bytes stand before a text). A document is scored by counts without its own, in the background and, if it is good, in the target, so that
good documents have no advantage by having been counted. A token's loss is -ln P; a document's score is its mean loss under the background
less that under the target, so a higher score is nearer to the target.

Counts cover all bytes of all documents. Documents are dealt to chunks of bounded bytes. Tasks count the n-grams of each chunk, Spark adds them up
by n-gram and by context, and the sums of a chunk's n-grams come back to its documents by a join on the chunk. So neither the driver
nor a task ever holds more than a chunk and its own n-grams, at every size of the corpus, and an n-gram's sums move once a chunk rather than once a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_ids, small_batches

ORDER, ALPHA = 5, 0.1
#: Bytes of text from which on a chunk ends; n-grams that a task gathers before it adds them up.
CHUNK_BYTES, GATHERED = 8 << 20, 1 << 21


def grams(text: str | None, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number."""
    b = np.frombuffer(bytes(order - 1) + (text or "").encode(), np.uint8).astype(np.int64)
    out = b[order - 1 :].copy()
    for k in range(1, order):
        out |= b[order - 1 - k : len(b) - k] << 8 * k
    return out


def chunked(docs: DataFrame, target: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text, is_target and chunk: consecutive rows of a task share a chunk until it has `chunk_bytes`."""
    good = sized_ids(target.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("is_target", F.lit(True)))
    known = docs.select("doc_id", "text").join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))

    def run(batches):
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            own = []
            for size in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
                own.append(chunk)
                held += size
                if held >= chunk_bytes:
                    chunk, held = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["doc_id", "text", "is_target", "chunk"])

    small_batches(docs.sparkSession)
    return materialize(known.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, is_target boolean, chunk long"), "chunks")


def count_grams(chunks: DataFrame, order: int = ORDER) -> DataFrame:
    """(chunk, gram, target, background): counts over the rows of each chunk; those of one n-gram may come in several rows."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        of, waiting = None, 0

        def added():
            keys, at = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([p[c] for p in parts]), len(keys)).astype(np.int64) for c in (1, 2)]
            return [(keys, *sums)] if len(keys) else []

        def emit():
            for keys, good, every in added() if parts else ():
                for i in range(0, len(keys), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[cut]), of)), pa.array(keys[cut]), pa.array(good[cut]), pa.array(every[cut])], names=["chunk", "gram", "target", "background"])

        for batch in batches:
            for chunk, text, good in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != of:
                    yield from emit()
                    parts, of, waiting = [], chunk, 0
                g = grams(text, order)
                one = np.ones(len(g))
                parts.append((g, one * good, one))
                waiting += len(g)
                if waiting >= GATHERED:
                    parts = added()
                    waiting = len(parts[0][0])
                    if waiting > GATHERED // 2:
                        yield from emit()
                        parts, waiting = [], 0
        yield from emit()

    return chunks.select("chunk", "text", "is_target").mapInArrow(run, "chunk long, gram long, target long, background long")


def model_counts(counts: DataFrame) -> DataFrame:
    """(gram, target, background, target_all, background_all): sums of each n-gram and of its context, over all chunks."""
    sums = counts.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).withColumn("context", F.shiftright("gram", 8))
    totals = sums.groupBy("context").agg(F.sum("target").alias("target_all"), F.sum("background").alias("background_all"))
    return sums.join(totals, "context").drop("context")


def score(docs: DataFrame, target: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, background_loss, target_loss, score (mean losses a byte, in nats).

    `target` has the doc_ids of the good documents (its nulls and repetitions don't matter). Null and empty texts have no bytes and null losses.
    Repeated rows count as often as they stand, and each is scored without itself only. Other columns are ignored. Without a target document
    (or another one, for a single one), the target model is uniform. An empty table gives no rows.
    """
    chunks = chunked(docs, target, chunk_bytes)
    counts = materialize(count_grams(chunks, order), "chunk-grams")
    sums = counts.select("chunk", "gram").join(materialize(model_counts(counts), "gram-counts"), "gram")
    kind = dict(docs.dtypes)["doc_id"]

    def losses(rows: pa.Table, sums: pa.Table) -> pa.Table:
        keys, at = np.unique(sums.column("gram").to_numpy(), return_index=True)
        of = {c: sums.column(c).to_numpy()[at] for c in ("target", "background", "target_all", "background_all")}
        n_bytes, out = [], {"background": [], "target": []}
        for text, good in zip(rows.column("text").to_pylist(), rows.column("is_target").to_pylist()):
            g, n = np.unique(grams(text, order), return_counts=True)
            n_bytes.append(int(n.sum()))
            if not len(g):
                out["background"].append(None), out["target"].append(None)
                continue
            k = np.searchsorted(keys, g)
            new = np.append(True, g[1:] >> 8 != g[:-1] >> 8)
            own = np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]  # of the context, in this text
            for model, less in (("background", 1), ("target", int(good))):
                p = (of[model][k] - less * n + alpha) / (of[f"{model}_all"][k] - less * own + 256 * alpha)
                out[model].append(float(-np.log(p) @ n) / n_bytes[-1])
        b, t = (pa.array(out[m], pa.float64()) for m in ("background", "target"))
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "background_loss": b, "target_loss": t, "score": pc.subtract(b, t)})

    return chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(losses, f"doc_id {kind}, n_bytes long, background_loss double, target_loss double, score double")
