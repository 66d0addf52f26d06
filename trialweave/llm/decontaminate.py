"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Texts are lower-cased (A-Z) and cut into words of digits, letters and every non-ASCII character. A window is `size`
consecutive words of an item; a shorter item is one window. The automaton holds each distinct window once, with a space at
both ends; it scans a document's normalised words once, and hits are mapped back to offsets in the original text.

Windows are gathered on the driver in blocks of bounded bytes (BLOCK_BYTES), each block one automaton that tasks build once
and use for all their documents. A byte of windows is a state at most, and a state takes some 50 bytes, so a block bounds a task's memory too. A usual test set is one block. Larger ones take one scan a block; the blocks' hits
are then joined by row.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, small_batches

#: Words in a window; the most bytes of windows in an automaton, as the size of what is sent to each task.
WINDOW, BLOCK_BYTES = 10, 4 << 20
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: UTF-8 bytes: A-Z to a-z, all other ASCII but digits and a-z to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = "row long, n_words long, items array<string>, hit_from array<long>, hit_to array<long>, spans array<struct<begin:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window and the sorted distinct item_ids (as strings) that have it."""

    def make():
        def one(item, text):
            w = words(text)
            return item, sorted({b" ".join(w[i : i + size]).decode() for i in range(max(1, len(w) - size + 1))} if w else ())

        return one

    listed = map_rows(benchmark.select(F.col("item_id").cast("string"), "text"), make, "item string, windows array<string>")
    return listed.select(F.coalesce("item", F.lit("")).alias("item"), F.explode("windows").alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(windows: DataFrame, block_bytes: int):
    """The windows as lists of at most about `block_bytes`, one at a time."""
    windows = materialize(windows, "windows")
    total = windows.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield [(r.window, r.items) for r in windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).toLocalIterator()]


def _scanner(sent, size):
    def make():
        automaton = ahocorasick.Automaton()
        automaton.add_word("\0", None)  # in no normalised text; an automaton without words can't search
        for window, items in sent.value:
            # bytes as latin-1 characters, so that offsets count bytes
            text = f" {window} ".encode().decode("latin-1")
            automaton.add_word(text, (len(text), items))
        automaton.make_automaton()
        space = np.frombuffer(b" ", np.uint8)[0]

        def one(row, text):
            w = words(text)
            if not w:
                return row, 0, [], [], [], []
            line = b" " + b" ".join(w) + b" "
            found = list(automaton.iter(line.decode("latin-1")))
            if not found:
                return row, len(w), [], [], [], []
            ends = np.array([e for e, _ in found])
            starts = ends - np.array([n for _, (n, _) in found]) + 1
            at = np.cumsum(np.frombuffer(line, np.uint8) == space)  # spaces so far
            lo, hi = at[starts] - 1, at[ends] - 1  # words lo..hi-1
            steps = np.zeros(len(w) + 1, np.int64)
            np.add.at(steps, lo, 1)
            np.add.at(steps, hi, -1)
            edge = np.diff(np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]]))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            place = [m.span() for m in WORDS.finditer(text.translate(_UPPER))]
            items = sorted({x for _, (_, items) in found for x in items})
            return row, len(w), items, lo.tolist(), hi.tolist(), [{"begin": place[a][0], "end": place[b - 1][1]} for a, b in zip(lo, hi)]

        return one

    return make


_UPPER = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_hit, n_items, items, spans.

    A word is hit inside any occurrence of a window; spans are the runs of hit words as code-point offsets of the original
    text (end exclusive), items the sorted ids found. Null or wordless texts have no words; items without words are never found;
    a null item_id counts as ''. Repeated doc_ids are scanned each by itself. Only doc_id and text of `docs` and item_id and
    text of `benchmark` are read. Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    blocks = _blocks(item_windows(benchmark, size), block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = map_rows(docs.select("doc_id", "text"), _scanner(spark.sparkContext.broadcast(first), size), SPANS.replace("row long", f"doc_id {dict(docs.dtypes)['doc_id']}"))
        return _summed(out)
    numbered = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    # one block after the other: what it finds is written, and then neither the driver nor a task holds it any more
    hits = None
    for block in chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(block)
        part = materialize(map_rows(numbered.select("row", "text"), _scanner(sent, size), SPANS), "hits")
        sent.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to", "spans")))).alias("runs"))
    # overlapping runs of different blocks become one
    joined = F.aggregate("runs", F.expr("cast(array() as array<struct<hit_from:bigint,hit_to:bigint,spans:struct<begin:bigint,end:bigint>>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["hit_to"] >= x["hit_from"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["hit_from"].alias("hit_from"), F.greatest(F.element_at(acc, -1)["hit_to"], x["hit_to"]).alias("hit_to"),
            F.struct(F.element_at(acc, -1)["spans"]["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["spans"]["end"], x["spans"]["end"]).alias("end")).alias("spans"))))).otherwise(F.concat(acc, F.array(x))))
    merged = merged.withColumn("runs", F.when(F.size("runs") > 0, joined).otherwise(F.col("runs")))
    merged = merged.select("row", "n_words", "items", F.col("runs.hit_from").alias("hit_from"), F.col("runs.hit_to").alias("hit_to"), F.col("runs.spans").alias("spans"))
    return _summed(numbered.select("row", "doc_id").join(merged, "row"))


def _summed(df: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows that have a hit; all its columns stay.

    One scan a block filters in place, so neither a join nor an id is needed. With more than one block the rows that are left are written
    between scans, so that a task has one worker and one automaton at a time.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(item_windows(benchmark, size), block_bytes)
    block = next(blocks, None)
    while block is not None:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            automaton.add_word("\0", True)
            for window, _ in sent.value:
                automaton.add_word(f" {window} ".encode().decode("latin-1"), True)
            automaton.make_automaton()
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text")).to_pylist()
                lines = ((b" " + b" ".join(words(t)) + b" ").decode("latin-1") for t in text)
                yield batch.filter(pa.array([next(automaton.iter(x), None) is None for x in lines], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        block = next(blocks, None)
        if block is not None:
            docs = materialize(docs, "scanned")
            sent.unpersist()
    return docs
