"""Near-duplicates by HyperMinHash: banded compressed registers propose, corrected estimates prune, full sets confirm.

Equal shingle sets become one node. Nodes that share a band's registers share a bucket. First each node is checked against one
node only, the smallest of the buckets it shares most; the confirmed links are a forest, which pointer jumping turns into classes. Only
buckets that still hold several classes are looked at again: each member outside the bucket's main class is
compared with the members of other classes, pruned inside the join by size, by the first common band (so a pair comes up once), by the
similarity that the registers estimate, less six standard deviations, and by the overlap of half hashes; the join gives only pairs that are
all but certain, which full sets then confirm. Pairs of one class are never made, so a group of copies or near copies makes rows in
proportion to its size.

Pages of one template share bands, though most of them aren't alike. Buckets with more than CROWD members are therefore thinned first by rare shingles,
those of at most RARE of the nodes in such buckets: two nodes that share one are proposed for that, and counting what they share prunes them; of two
that share none, both have all their rare shingles to themselves, so a node whose rare shingles are more than a fifth of its set can't be linked with
any of them and leaves the bucket. Others are compared only if the rest would suffice: rare shingles add up to no more than a quarter of what the two may
share, so members are dealt to levels by their share of rare shingles, and only levels that together stay within that bound meet. No step loses a link.

A pair at a similarity of 0.8 shares none of the 32 bands with a probability of 5e-8.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import map_rows, materialize, sized_ids

#: Levels of the share of rare shingles.
LEVELS = 32
#: Members from which on a bucket is thinned by rare shingles, and in how many nodes of such buckets these are at most.
CROWD, RARE = 64, 8
SKETCH = "n_shingles long, set_key binary, permuted array<long>, bucketed array<long>"


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """Per row of (doc_id, text): the size of its shingle set, a 128-bit digest of the set, its band keys. No shingles: nulls."""

    def make():
        shingler = S.Shingler(size)

        def one(doc_id, text):
            s = shingler.set_of(text)
            return (doc_id, len(s), S.set_key(s), S.permuted_bands(s), S.bucketed_bands(s)) if len(s) else (doc_id, 0, None, None, None)

        return one

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, {SKETCH}")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    def make():
        shingler = S.Shingler(size)
        return lambda doc_id, text: (doc_id, shingler.set_of(text).view("int64").tolist())

    return map_rows(docs.select("doc_id", "text"), make, f"node {dict(docs.dtypes)['doc_id']}, shingles array<long>")


def estimated(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity by equal registers, less those that unlike values make equal by chance."""
    lane = lambda x, k: (F.shiftrightunsigned(F.shiftleft(x, 48 - 16 * k), 48) == 0).cast("int")
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + lane(x, 0) + lane(x, 1) + lane(x, 2) + lane(x, 3))
    # the chance that least values of disjoint sets agree in leading zeros and mantissa: 0.1699 / 2^bits for equal sizes
    chance = F.lit(0.169919487 / (1 << S.MANTISSA)) * 4 * na * nb / ((na + nb) * (na + nb))
    return (equal / F.lit(float(S.REGISTERS)) - chance) / (1 - chance)


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, label) of a forest (node, label) whose labels are smaller nodes: every node's root. Roots have no row."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = materialize(parents.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "jump")
        parents = after.select("node", "label")
        if after.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of (a, b) but the smallest of each component, which is its label.

    Each round hooks every node to its smallest neighbour, jumps to the roots and contracts the edges.
    """
    edges, labels = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _jumped(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).where("label < node"))
        if labels is None:
            labels = roots
        else:
            moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left").select("node", F.coalesce("above", "label").alias("label"))
            labels = materialize(moved.unionByName(roots), "labels")
        to = lambda c: roots.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root"))
        left = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def rare_shingles(sets: DataFrame, nodes: DataFrame, rare: int = RARE) -> DataFrame:
    """(shingle, node, comp, n, df): the shingles of sets (node, shingles) of the nodes (node, comp, n) that at most `rare` of these have, with how many do."""
    sets = sets.join(nodes, "node")
    each = sets.select("node", "comp", "n", F.explode("shingles").alias("shingle"))
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= rare)
    return each.join(counts, "shingle")


def sharing_rare(rare: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of nodes of different classes that share a rare shingle and may be alike by their counts.

    `own` has (node, r): how many rare shingles a node has. All other shingles of the smaller set might be shared too, and no more.
    """
    some = rare.where("df > 1").select("shingle", "node", "comp", "n")
    x, y = some.alias("x"), some.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")))
    pairs = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    pairs = pairs.join(own.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a").join(own.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
    most = F.col("c") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    return pairs.where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select("a", "b")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, crowd: int = CROWD) -> DataFrame:
    """One row for each row of `docs` (doc_id of a type that can be ordered, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest
    doc_id that links reach. Null texts and those without words have no shingles and link with nothing. Rows that repeat a doc_id are one vertex,
    whatever their texts. A row without an id joins the component of an equal set that has one, and else has component null and
    is kept. Other columns are ignored; an empty table gives no rows. percent must be at least 80, for which the bands are laid out.
    """
    if percent < 80:
        raise ValueError("bands are laid out for similarities of at least 0.8")
    sketched = materialize(sketch(docs, size), "sketch")
    nodes = materialize(
        sketched.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "permuted", "bucketed")]), "nodes")
    none = F.array().cast("array<struct<slot:int,key:bigint>>")
    slots = F.concat(
        F.coalesce(F.transform("permuted", lambda k, i: F.struct(i.alias("slot"), k.alias("key"))), none),
        F.coalesce(F.transform("bucketed", lambda k, i: F.struct((i + S.BANDS).alias("slot"), k.alias("key"))), none))
    keys = nodes.select("node", F.explode(slots).alias("x")).select("node", "x.slot", "x.key")
    shared = keys.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).where("n > 1").select("slot", "key", "center")
    members = materialize(keys.join(shared, ["slot", "key"]), "members")

    own = sized_ids(members.select(F.col("node").alias("doc_id")).distinct())
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(own, "doc_id", "left_semi"), size).distinct(), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")

    stars = members.where("node <> center").groupBy("node", "center").count()
    best = materialize(stars.groupBy("node").agg(F.min_by("center", F.struct(-F.col("count"), F.col("center"))).alias("center")).select(F.col("node").alias("a"), F.col("center").alias("b")), "best")
    forest = _jumped(linked(best).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))

    placed = materialize(members.drop("center").join(forest, "node", "left").select("slot", "key", "node", F.coalesce("label", "node").alias("comp")), "placed")
    counts = placed.groupBy("slot", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("slot", "key").agg(F.min_by("comp", F.struct(-F.col("n"), F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("members")).where("comps > 1")
    open_ = materialize(placed.join(main.select("slot", "key", "main", (F.col("members") > crowd).alias("crowded")), ["slot", "key"]).join(nodes.select("node", F.col("n_shingles").alias("n")), "node"), "open")
    crowded = materialize(open_.where("crowded").select("node", "comp", "n").distinct(), "crowded")
    if crowded.isEmpty():
        open_, proposed = open_.withColumn("r", F.lit(0)), None
    else:
        rare = materialize(rare_shingles(sets, crowded), "rare")
        own = materialize(rare.groupBy("node").agg(F.count(F.lit(1)).alias("r")), "own")
        proposed = sharing_rare(rare, own, percent)
        open_ = open_.join(own, "node", "left").withColumn("r", F.when(F.col("crowded"), F.coalesce("r", F.lit(0))).otherwise(0)).where(100 * F.col("r") <= (100 - percent) * F.col("n"))
        still = open_.groupBy("slot", "key").agg(F.count_distinct("comp").alias("comps")).where("comps > 1").select("slot", "key")
        open_ = materialize(open_.join(still, ["slot", "key"]), "thinned")
    if percent < 100:
        level = F.floor(F.col("r") * (LEVELS * percent) / (F.greatest(F.col("n") - F.col("r"), F.lit(1)) * (100 - percent))).cast("int")
    else:
        level = F.when(F.col("r") > 0, LEVELS + 1).otherwise(0)
    open_ = open_.withColumn("level", F.when(F.col("crowded"), level).otherwise(-1))
    present = open_.groupBy("slot", "key").agg(F.collect_set("level").alias("present"))  # at most LEVELS + 2 numbers
    open_ = open_.join(nodes.select("node", "permuted", "bucketed"), "node").withColumn("bands", F.when(F.col("slot") < S.BANDS, F.col("permuted")).otherwise(F.col("bucketed"))).drop("permuted", "bucketed", "crowded")
    # halves of a set may be equal; what is lost of the shared ones by that is no more than what each of the two sets loses
    halves = sets.select("node", F.transform("shingles", lambda h: F.shiftright(h, 32).cast("int")).alias("half")).withColumn("lost", F.size("half") - F.size(F.array_distinct("half")))
    meets = F.filter("present", lambda other: (other < 0) | (other + F.col("level") <= LEVELS))
    x = open_.where("comp <> main").join(present, ["slot", "key"]).withColumn("met", F.explode(meets)).drop("present").join(halves, "node").alias("x")
    y = open_.join(halves, "node").alias("y")
    c = lambda name: F.col(name)
    first = F.array_position(F.zip_with(c("x.bands"), c("y.bands"), lambda a, b: a == b), F.lit(True)) == F.pmod(c("x.slot"), F.lit(S.BANDS)) + 1
    least = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / S.REGISTERS)
    other = (c("x.comp") != c("y.comp")) & ((c("y.comp") == c("y.main")) | (c("x.node") < c("y.node")))
    sized = 100 * F.least(c("x.n"), c("y.n")) >= percent * F.greatest(c("x.n"), c("y.n"))
    rest = F.least(c("x.n") - c("x.r"), c("y.n") - c("y.r"))
    rest_suffices = 100 * rest >= percent * (rest + c("x.r") + c("y.r"))
    common = F.size(F.array_intersect(c("x.half"), c("y.half"))) + F.least(c("x.lost"), c("y.lost"))
    alike = 100 * common >= percent * (c("x.n") + c("y.n") - common)
    near = F.when(other & sized & rest_suffices, F.when(first, F.when(estimated(c("x.bands"), c("y.bands"), c("x.n"), c("y.n")) >= least, alike))).otherwise(False)
    pairs = x.join(y, (c("x.slot") == c("y.slot")) & (c("x.key") == c("y.key")) & (c("x.met") == c("y.level")) & near)
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    pairs = (pairs if proposed is None else pairs.unionByName(proposed)).distinct().join(best, ["a", "b"], "left_anti")

    # links between the forest's classes
    to = lambda k: forest.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    across = linked(pairs).join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    merged = components(across).select(F.col("node").alias("label"), F.col("label").alias("least"))
    # a class's label may have moved; a node outside the forest may have become another's
    reached = nodes.select("set_key", "node").join(forest, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"))
    reached = reached.join(merged, "label", "left").select("set_key", F.coalesce("least", "label").alias("reached"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(reached, "set_key", "left")
    component = F.coalesce("reached", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
