"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, exact_dedup, lm_score, near_dedup, shingles

SCHEMA = "doc_id long, text string"


def docs(spark, texts, first=1):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "x", 0, b"d", 7, ["y"]) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA + ", digest string, bucket int, payload binary, n_hit int, items array<string>")


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contamination(texts, items, size):
    windows = defaultdict(set)
    for item, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(item))
    for t in texts:
        w, hit, found = words_of(t), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination(spark, block):
    rng = random.Random(1)
    vocabulary = ["a", "b", "Cé", "d1", "日本"]
    texts = [None, "", "!!", "A b-C. a"] + [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a " * 20000]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7)))) for i in range(30)] + [(7, None), (None, "a b"), (40, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = 4
    got = {r.doc_id: r for r in decontaminate.scan(docs(spark, texts), bench, size, block).collect()}
    want = list(contamination(texts, [("" if i is None else i, t) for i, t in items], size))
    for k, (n, hit, found) in enumerate(want, 1):
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k]["items"]) == (n, hit, len(found), found)
        for s in got[k].spans:
            inside = words_of(texts[k - 1][s.begin : s.end])
            assert inside and texts[k - 1][s.begin : s.end].strip(" ,!.") == texts[k - 1][s.begin : s.end]
        assert sum(len(words_of(texts[k - 1][s.begin : s.end])) for s in got[k].spans) == hit
    kept = decontaminate.decontaminate(docs(spark, texts), bench, size, block)
    workers = kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert workers <= 1  # whatever the number of blocks
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [k for k, w in enumerate(want, 1) if not w[1]]
    none = decontaminate.scan(docs(spark, texts), bench.limit(0), size)
    assert none.agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.scan(docs(spark, []), bench, size).count() == 0


TEXTS = [None, "", " ", "a b", "a\t\n b", "a  b", "A b", "a b ", " ", "é" * 50_000, "é" * 50_000] + ["hot copy"] * 40


def expected_groups(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts, 1):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


def test_exact_dedup(spark):
    texts = TEXTS + [f"text {k % 700}" for k in range(1500)]
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.deduplicate(docs(spark, texts)).collect()}
    assert got == expected_groups(texts)
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (3, "x"), (None, "y"), (5, "z"), (5, "z")], SCHEMA)
    rows = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.deduplicate(nulls).collect())
    assert rows == [(0, 0, 1, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True), (5, 5, 2, True), (5, 5, 2, True)]


@pytest.mark.parametrize("kind", ["long", "string", "decimal(30,0)"])
def test_exact_dedup_keeps_ids_as_they_are(spark, kind):
    ids, big = [9007199254740993, 9007199254740995, None, 9007199254740997], 2**53
    df = spark.createDataFrame(list(zip(ids, ["a", "a", "b", "c"])), SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((r.text_sha256, str(r.doc_id), str(r.keep_id), r.kept) for r in exact_dedup.deduplicate(df).collect())
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "abc"}
    want = [(sha["a"], str(big + 1), str(big + 1), True), (sha["a"], str(big + 3), str(big + 1), False), (sha["b"], "None", "None", True), (sha["c"], str(big + 5), str(big + 5), True)]
    assert got == sorted(want)


def test_exact_dedup_against_a_history(spark):
    history, new = docs(spark, ["a", "b", "b"], 1), docs(spark, ["b", "c", "c", "a ", None, "d"], 10)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(new, history).collect()}
    assert got == {10: (2, 2, False), 11: (11, 2, True), 12: (11, 2, False), 13: (13, 1, True), 14: (14, 1, True), 15: (15, 1, True)}
    got = {r.doc_id: r.kept for r in exact_dedup.deduplicate(new, docs(spark, [])).collect()}
    assert got == {10: True, 11: True, 12: False, 13: True, 14: True, 15: True}


def test_the_hash_is_minimal_and_perfect(spark):
    own = exact_dedup.digests(spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    index, buckets = exact_dedup.build_index(own)
    assert index.agg(F.sum(F.size("slot_digest"))).first()[0] == 3000 and index.count() <= buckets
    found = exact_dedup.lookup(own, index, buckets)
    assert found.where("hist_member and hist_winner = doc_id").count() == 3000
    others = exact_dedup.digests(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id")).alias("text")))
    assert exact_dedup.lookup(others, index, buckets).where("hist_member").count() == 0


def components(texts, size, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts, 1):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def edited(rng, words, share):
    return " ".join(rng.choice("pqrstuv") + w if rng.random() < share else w for w in words)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, size):
    rng = random.Random(size)
    make = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    texts = [None, "", " \t", "One", "one", "one two", "a b c d", "A b c d", "a b c d e"]
    for n in (6, 9, 40, 200, 480, 520, 700):  # on both sides of the sketch's change of kind
        for base in (make(n), make(n)):
            texts += [edited(rng, base, s) for s in (0, 0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.1)]
    base = make(120)
    texts += [edited(rng, base, 0.04) for _ in range(120)] + [" ".join(base)] * 60  # a family whose pairs lie about the threshold
    texts += [" ".join(make(30)) for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.classes(docs(spark, texts), size).collect()}
    assert got == components(texts, size)


@pytest.mark.parametrize("own", [4, 8, 12, 20])
def test_near_dedup_of_a_template(spark, own):
    """Pages of shared and own words, some in pairs or groups of near copies, about the similarity of a link; all buckets are crowded."""
    rng = random.Random(own)
    shared = [f"s{k}" for k in range(80 - own)]
    texts = []
    for k in range(240):
        page = shared[: 40 - own // 2] + [f"w{rng.randint(0, 4000)}" for _ in range(own)] + shared[40 - own // 2 :]
        texts += [" ".join(page)] + [edited(rng, page, s) for s in (0.01, 0.03, 0.05)[: rng.choice([0, 0, 1, 3])]]
    texts += [" ".join(shared)]
    want = components(texts, 2)
    for crowd in (4, 10_000):
        assert {r.doc_id: tuple(r)[1:] for r in near_dedup.classes(docs(spark, texts), 2, crowd=crowd).collect()} == want


def test_pages_below_a_link_are_not_paired(spark):
    """Pages of 74 shared and 10 own words, at a similarity of 0.77: levels of rare shingles keep them from meeting, though the template itself is among them."""
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(74)]
    texts = [" ".join([*shared, *(f"w{rng.randrange(10**9)}" for _ in range(10))]) for _ in range(400)] + [" ".join(shared)] * 2
    texts += [texts[7] + " more", texts[9].replace("s40", "other")]
    assert {r.doc_id: tuple(r)[1:] for r in near_dedup.classes(docs(spark, texts), 2).collect()} == components(texts, 2)


def test_rare_shingles_lose_no_link(spark):
    rng = random.Random(9)
    base = [rng.sample(range(300), 40) for _ in range(6)]
    sets = {k: sorted({x if rng.random() < 0.93 else rng.randint(0, 2000) for x in rng.choice(base)}) for k in range(150)}
    df = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    nodes = df.select("node", F.col("node").alias("comp"), F.size("shingles").alias("n"))
    rare = near_dedup.rare_shingles(df, nodes).cache()
    own = rare.groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    found = {(r.a, r.b) for r in near_dedup.sharing_rare(rare, own, 80).collect()}
    r = {**dict.fromkeys(sets, 0), **{x.node: x.r for x in own.collect()}}
    links = {(a, b) for a in sets for b in sets if a > b and 100 * len(i := {*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert len(links) > 20
    for a, b in links - found:
        rest = min(len(sets[a]) - r[a], len(sets[b]) - r[b])
        assert max(r[x] / len(sets[x]) for x in (a, b)) <= 0.2 and 100 * rest >= 80 * (rest + r[a] + r[b])


def test_near_dedup_of_long_texts_and_other_ids(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 100_000)}" for _ in range(60_000)]
    texts = [" ".join(base), edited(rng, base, 0.03), "short one", " ".join(base[:50_000]), "short one"]
    df = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.classes(df, 2).collect()}
    assert got == {f"d{i}": (f"d{c}", k) for i, (_, c, k) in components(texts, 2).items()}


def test_near_dedup_edges(spark):
    assert near_dedup.classes(docs(spark, [])).count() == 0
    assert near_dedup.classes(docs(spark, [None, ""])).where("kept").count() == 2
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (None, "z"), (4, "q"), (4, "r"), (9, "r")], SCHEMA)
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in near_dedup.classes(df, 2).collect())
    assert got == [(0, 0, True), (0, 2, False), (2, 2, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    with pytest.raises(ValueError):
        near_dedup.classes(df, percent=70)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)] + [(1, 1)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in df.collect()} == {x: p for x, p in parent.items() if p != x}


def test_registers_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    df = spark.createDataFrame([(shingles.permuted_bands(a), shingles.permuted_bands(b))], "a array<long>, b array<long>")
    assert abs(df.select(near_dedup.estimated(F.col("a"), F.col("b"), F.lit(400), F.lit(400)).alias("j")).first().j - 0.6) < 0.15
    assert shingles.bucketed_bands(a) is None and shingles.permuted_bands(np.arange(600, dtype=np.uint64)) is None


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 7])
def test_lm_scores(spark, chunk_bytes):
    texts = [None, "", "a", "abcabc", "good text é", "good texts", "bad bad bad"] * 2 + ["long text " * 20_000]
    good = spark.createDataFrame([(4,), (5,), (5,), (None,)], "doc_id long")
    df = docs(spark, texts).withColumn("gram", F.lit("clash")).withColumn("chunk", F.lit("clash")).withColumn("is_target", F.lit("clash"))
    got = {r.doc_id: r for r in lm_score.score(df, good, chunk_bytes=chunk_bytes).collect()}
    counts = {i: Counter((bytes(4) + (t or "").encode())[k : k + 5] for k in range(len((t or "").encode()))) for i, t in enumerate(texts, 1)}

    def loss(i, ids):
        n, h = Counter(), Counter()
        for j in ids:
            if j != i:
                n += counts[j]
        for g, k in n.items():
            h[g[:4]] += k
        return sum(k * -np.log((n[g] + 0.1) / (h[g[:4]] + 25.6)) for g, k in counts[i].items()) / sum(counts[i].values())

    assert len(got) == len(texts)
    for i in counts:
        assert got[i].n_bytes == sum(counts[i].values())
        if counts[i]:
            t, b = loss(i, (4, 5)), loss(i, counts)
            assert (got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((t, b, b - t), abs=1e-9)
        else:
            assert got[i].score is None
    assert lm_score.score(docs(spark, []), good).count() == 0
    assert lm_score.score(docs(spark, ["a"]), good.limit(0)).count() == 1
