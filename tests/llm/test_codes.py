"""Cross-tokenizer alignment, quality and vector codes, against brute force and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialweave.llm import alignment, quality, queries, vector_codes
from trialweave.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.01"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def plain_groups(aligner, text):
    """Ids of both, groups as (A ids, B ids) by a walk over common ends."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    a = own.encode(" " + text, add_special_tokens=False).ids if text else []
    b = aligner.model_b.encode(text) if text else []
    if b"".join(aligner.bytes_a[i] for i in a) != (" " + text).encode() or b"".join(aligner.bytes_b[i] for i in b) != (" " + text).encode():
        return []
    ends = []
    for ids, size in ((a, aligner.size_a), (b, aligner.size_b)):
        at = 0
        ends.append([at := at + int(size[i]) for i in ids])
    out, low = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, own_ends) if low < e <= cut] for ids, own_ends in zip((a, b), ends)))
        low = cut
    return out


def listing(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


ODD = ["", " ", "a", "a▁b", "héllo 你好 🎉🎉", "<|endoftext|> <s> <0x41>", " \n\n  x", "\x00a", "é ﬁ", " " * 9000 + "x", "\n" * 9000, "a" * 3000, "it's we'LL"]


def test_groups_equal_a_walk(aligner):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("ab é你🎉 \n'12.▁", k=rng.randrange(60))) for _ in range(300)]
    for t, f in zip(texts, aligner.align(texts)):
        want = plain_groups(aligner, t)
        assert f["listing"].decode() == listing(want), t
        assert (f["n_a"], f["n_b"], f["n_groups"]) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
        assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in f["links"]] == [(a[-1], b[-1]) for a, b in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30))
def test_doubling_equals_union_of_overlaps(a, b):
    ends = [np.cumsum(a), np.cumsum(b)]
    end = max(e[-1] for e in ends)
    ends = [e if e[-1] == end else np.r_[e, end] for e in ends]
    at_a, at_b, to = alignment.pointers(*ends)
    label = alignment.groups(to)
    starts = [np.r_[0, e[:-1]] for e in ends]
    parent = list(range(len(to)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ends[0])):
        for j in range(len(ends[1])):
            if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]:
                parent[find(at_a[i])] = find(at_b[j])
    assert len({(find(k), int(label[k])) for k in range(len(to))}) == len({find(k) for k in range(len(to))}) == len(set(label.tolist()))


def test_alignment_counts(spark, aligner):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (3, ""), (4, "x▁y"), (5, "The dog, the cats' thé " * 150), (None, "the the")]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, n_a int, links string")
    got = alignment.align(docs, A, B).collect()
    groups = [plain_groups(aligner, t or "") for _, t in rows]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    assert len(count) <= alignment.most_pairs(A, B)
    want = []
    for (doc_id, _), g in zip(rows, groups):
        pairs = [(a[-1], b[-1]) for a, b in g]
        digest = hashlib.sha256(listing(g).encode()).hexdigest() if g else ""
        want.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op11_alignment(spark, DATA)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == docs.count()
    assert got.where("n_best > n_links or n_groups > least(n_a, n_b) or count_sum < n_links or n_links <> n_groups").count() == 0


def test_quality_on_held_out_documents(spark):
    got = queries.op12_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (r in held) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    odd = spark.createDataFrame([(1, None, 1.0), (1, None, 2.0), (2, "", 0.0), (3, " \n", 0.0), (None, "Plain words here. " * 50000, 0.0)], "doc_id long, text string, score double")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(docs, quality.training_labels(labels))
    rows = quality.score(odd, forest).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score(odd.limit(0), forest).collect() == []


def test_quality_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for labels, low, high in (([], 0.4, 0.6), ([(1, 1), (None, 0), (2, None)], 0.5, 1), ([(2, 0)], 0, 0.3)):
        rows = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
        assert len(rows) == 2 and all(low < r.score < high for r in rows)


def test_copies_weigh_once_in_quality(spark):
    rng = random.Random(2)
    good, bad = (" ".join(rng.choices(words, k=20)) for words in (["one", "two", "three", "four"], ["!!", "##", "$x$"]))
    rows = [(k, " ".join(rng.choices(["one", "two", "three", "four"], k=20)), 1) for k in range(40)] + [(100 + k, " ".join(rng.choices(["!!", "##", "$x$"], k=20)), 0) for k in range(40)]
    rows += [(1000 + k, bad, 0) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string"), quality.fit(df, df, sample=41)).collect()
    assert {r.doc_id: r.predicted for r in got} == {1: 1, 2: 0}


def test_forest_walk_equals_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(1)
    y = (x[:, 0] * x[:, 1] > 0.2).astype(float)
    forest = quality.fit_forest(x, y, np.ones(400))

    def walk(t, row):
        node = 0
        for _ in range(quality.DEPTH):
            node = 2 * node + (2 if row[forest["feature"][t, node]] > forest["threshold"][t, node] else 1)
        return forest["value"][t, node - forest["threshold"].shape[1]]

    want = [1 / (1 + math.exp(-forest["bias"] - sum(walk(t, row) for t in range(quality.TREES)))) for row in x]
    assert np.allclose(quality.probability(forest, x), want) and ((np.array(want) > 0.5) == y).mean() > 0.95


def brute_codes(rows, rounds=4):
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 4)
    rows = sorted(((i, v + [0] * (4 * width - len(v)), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = lambda v, k: v[k * width : (k + 1) * width]
    books = [[part(v, k) for _, v, _ in rows[:256]] for k in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            mine = [near(part(v, k), book)[1] for _, v, _ in rows]
            for e in set(mine):
                own = [part(v, k) for (_, v, _), m in zip(rows, mine) if m == e]
                book[e] = [sum(c) // len(own) for c in zip(*own)] if width else []
    found = [[near(part(v, k), books[k]) for k in range(4)] for _, v, _ in rows]
    error = [sum(d for d, _ in f) for f in found]
    label_error = Counter()
    for (_, _, label), e in zip(rows, error):
        label_error[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{k:02x}" for _, k in f), e, label_error[label], digest)) for (i, _, label), f, e in zip(rows, found, error))


@pytest.mark.parametrize("width", [8, 20, 7, 1, 0])
def test_vector_codes_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(k if k % 50 else None, [rng.choice([-0.5, 0.0, 0.001, 0.3, 2.0]) + rng.random() * 0.01 for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for k in range(320)]
    rows += [(400 + k, rows[5][1], 1) for k in range(20)] + [(5, rows[5][1], 1), (5, [0.25] * width, 2)]
    if width:
        rows += [(3, None, 1), (2, [None] + [0.0] * (width - 1), 1), (1, [float("nan")] * width, 2), (0, [float("-inf")] * width, 3), (900, [1.0], 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_codes(rows)


def test_vector_codes_of_few_and_large_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    rows = [(k, [float((k * j * 7919) % 1000003) for j in range(12)], k % 2) for k in range(300)]  # beyond 32-bit sums
    got = vector_codes.compress(spark.createDataFrame(rows, schema)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_codes(rows)
    with pytest.raises(Exception, match="don't fit in a long"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], schema)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 3, 5, 8, 13, 16]), st.sampled_from([3, 1000, 10**6, 2**31, 2**45]))
def test_nearest_is_exact(seed, width, most):
    rng = np.random.default_rng(seed)
    parts, entries = (rng.integers(-most, most + 1, (n, width)) for n in (140, 40))
    code, least = vector_codes.nearest(vector_codes.transform(parts), vector_codes.transform(entries))
    full = ((parts.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(axis=2)
    assert (least == full.min(axis=1)).all() and (code == [row.tolist().index(row.min()) for row in full]).all()


def test_vector_codes_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.op13_vector_codes(spark, DATA)
    want = c.execute(queries.OP13_SQL)
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
