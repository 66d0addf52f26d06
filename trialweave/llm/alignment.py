"""Alignment of two tokenizers: byte offsets where tokens of both end cut a text's tokens into groups.

Both token sequences cover the same bytes. Every token points to the farthest-right token, of either kind, that overlaps it; of two that end
together the second tokenizer's is the farther. Doubling the pointers, all at once, leads every token to the last of its group, which names it.
Texts of a batch are laid one after the other: at the end of a text tokens of both kinds end, so groups never cross it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: White space from which on a text goes to the slower of two equal encoders, as the faster one's pattern runs out of stack.
LONG_SPACE = 4096
#: Characters of texts that are aligned at once; their tokens take some hundred bytes a character.
CHUNK_CHARS = 1 << 19
#: The pre-tokenizing pattern of byte-level BPE, a fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.lru_cache(4)
def byte_level(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level BPE file, by id. Its special tokens have none, as they are never made."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    special = {t["id"] for t in own["added_tokens"]}
    vocab, letters = {**own["model"]["vocab"], **{t["content"]: t["id"] for t in own["added_tokens"]}}, byte_letters()
    entries = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if i not in special:
            entries[i] = bytes(map(letters.__getitem__, token))
    merges = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in own["model"]["merges"]]
    if merges != sorted(merges) or own["pre_tokenizer"]["type"] != "ByteLevel" or own["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} isn't a byte-level model whose ids are in the order of merges")
    return entries


def byte_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the file's model, strings of special tokens being plain text."""
    import tiktoken

    entries = byte_level(path)
    fast = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(entries) if b}, special_tokens={})
    spaces = re.compile(rf"\s{{{LONG_SPACE}}}").search

    def encode(text: str) -> list[int]:
        return _slow(path)(text) if spaces(text) else fast.encode_ordinary(text)

    return encode


@functools.lru_cache(1)
def _slow(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@functools.lru_cache(4)
def pieces_of(path: str):
    """The model of a piece file and the bytes of each piece, by id."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    return own, [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(raw)]


def pointers(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of tokens of A and of B in the order of their ends (A's before B's of the same end), and where each place's token points to.

    Both sequences of ends rise and end with the same value.
    """
    at_a = np.arange(len(ends_a)) + np.searchsorted(ends_b, ends_a, "left")
    at_b = np.arange(len(ends_b)) + np.searchsorted(ends_a, ends_b, "right")
    starts_a, starts_b = (np.r_[0, e[:-1]] for e in (ends_a, ends_b))
    to = np.empty(len(at_a) + len(at_b), np.int64)
    to[at_a] = np.maximum(at_a, at_b[np.searchsorted(starts_b, ends_a, "left") - 1])
    to[at_b] = np.maximum(at_b, at_a[np.searchsorted(starts_a, ends_b, "left") - 1])
    return at_a, at_b, to


def groups(to: np.ndarray) -> np.ndarray:
    """Where each place ends when pointers are followed to the last: the step is doubled until nothing moves."""
    while True:
        on = to[to]
        if np.array_equal(on, to):
            return to
        to = on


class Aligner:
    """Aligns the texts of a batch."""

    def __init__(self, path_a: str, path_b: str):
        self.encode = byte_encoder(path_a)
        self.bytes_a = byte_level(path_a)
        self.model_b, self.bytes_b = pieces_of(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # ids with what follows them in a listing: A's at 0 and 1, B's at 2 to 4 times the larger vocabulary
        self.stride = max(len(self.bytes_a), len(self.bytes_b))
        self.listed = [b"%d%s" % (i, mark) for mark in (b",", b"|", b",", b";", b"") for i in range(self.stride)]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both models; none for null and empty texts and those whose tokens don't join to a space and the text."""
        a = [self.encode(" " + t) if t else [] for t in texts]
        b = self.model_b.encode([t or "" for t in texts], num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for k, t in enumerate(texts):
            if t and b"".join(map(get_a, a[k])) == b"".join(map(get_b, b[k])) == b" " + t.encode():
                continue
            a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str | None]) -> list[dict]:
        """Of each text n_a, n_b, n_groups, links (the pairs of ids that end together, as A's id times 2**32 and B's), and the groups as text."""
        rows_a, rows_b = self.tokens(texts)
        n_a, n_b = (np.array(list(map(len, r)), np.int64) for r in (rows_a, rows_b))
        a, b = (np.array([i for r in rows for i in r], np.int64) for rows in (rows_a, rows_b))
        if not len(a):
            return [{"n_a": 0, "n_b": 0, "n_groups": 0, "links": np.zeros(0, np.int64), "listing": b""} for _ in texts]
        at_a, at_b, to = pointers(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        last = groups(to)
        end_b = np.flatnonzero(last[at_b] == at_b)  # each group's last token of B, and the token of A that ends with it
        end_a = np.searchsorted(at_a, at_b[end_b] - 1)
        links = (a[end_a] << 32) | b[end_b]
        # the listing's order: by group, A's tokens before B's
        group_a, group_b = last[at_a], last[at_b]
        code = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.full(len(b), 2)
        mark_a[end_a], mark_b[end_b] = 1, 3
        mark_b[np.cumsum(n_b)[n_b > 0] - 1] = 4
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + mark_a * self.stride
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + mark_b * self.stride
        tokens_to = np.cumsum(n_a + n_b)
        groups_to = np.searchsorted(end_b, np.cumsum(n_b))  # a text's groups are those whose last token of B is before its end
        out, token, group, listed = [], 0, 0, self.listed.__getitem__
        for k, (t, g) in enumerate(zip(tokens_to.tolist(), groups_to.tolist())):
            out.append({"n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": g - group, "links": links[group:g], "listing": b"".join(map(listed, code[token:t].tolist()))})
            token, group = t, g
        return out


_aligners: dict[tuple, Aligner] = {}


def _shared(path_a: str, path_b: str) -> Aligner:
    """One a worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def most_pairs(path_a: str, path_b: str) -> int:
    """A bound of the number of linked pairs of any corpus: of two tokens that end together, the bytes of one end with those of the other."""
    from collections import Counter

    a, b = Counter(filter(None, byte_level(path_a))), Counter(filter(None, pieces_of(path_b)[1]))
    ends = lambda own, other, least: sum(n * other[x[k:]] for x, n in own.items() for k in range(least, len(x)))
    return ends(a, b, 0) + ends(b, a, 1)


def _chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """The texts in turn, in lists of up to `most` characters or of one text."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of each row of (doc_id, text)."""

    def make():
        own = _shared(path_a, path_b)

        def one(batch: pa.RecordBatch) -> list:
            found = [f for texts in _chunks(batch.column(1).to_pylist()) for f in own.align(texts)]
            column = lambda name: [f[name] for f in found]
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in column("listing")]
            offsets = np.cumsum([0, *map(len, column("links"))]).astype(np.int32)
            pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(column("links"))))
            return [batch.column(0), column("n_a"), column("n_b"), column("n_groups"), list(map(len, column("links"))), digests, pairs]

        return one

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of (doc_id, text), whole texts.

    `path_a` is a byte-level BPE file, `path_b` a piece model; executors read them too. Null and empty texts, and those that a model changes, have no
    tokens: zeros and an empty digest. Repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.

    Texts are encoded once: their links are written, counted by pair, and read again with the counts. The table of pairs is bounded by the
    vocabularies (`most_pairs`), not by the texts, so it is sent to all tasks.
    """
    found = materialize(links(docs, path_a, path_b), "links")
    counted = materialize(found.select(F.explode("links").alias("pair")).groupBy("pair").count(), "pairs")
    pairs = counted.limit(most_pairs(path_a, path_b)).toArrow()  # the limit is that of the proof; it cuts nothing
    key, count = pairs.column("pair").to_numpy(), pairs.column("count").to_numpy()
    order = np.argsort(key)
    key, count = key[order], count[order]
    _, entry = np.unique(key & 0xFFFFFFFF, return_inverse=True)
    highest = np.zeros(len(key), np.int64)
    np.maximum.at(highest, entry, count)
    sent = docs.sparkSession.sparkContext.broadcast((key, count, count == highest[entry]))

    def make():
        keys, counts, best = sent.value

        def one(batch: pa.RecordBatch) -> list:
            lists = batch.column(6)
            at = np.searchsorted(keys, lists.flatten().to_numpy())
            sums = [np.r_[0, np.cumsum(v)] for v in (best[at], counts[at])]
            ends = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            return [*batch.columns[:5], *(s[ends[1:]] - s[ends[:-1]] for s in sums), batch.column(5)]

        return one

    kept = "n_a long, n_b long, n_groups long, n_links long"
    return map_batches(found, make, f"doc_id {dict(docs.dtypes)['doc_id']}, {kept}, n_best long, count_sum long, groups_sha256 string")
