"""Graphs too large for a task: components, and greedy choices among conflicts. Each round is a few joins on written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Edges up to which a graph is finished in one task: a fixed bound, so that long chains don't take a round a link.
SMALL_EDGES = 200_000


def _in_one_task(edges: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if frames:
            yield solve(pd.concat(frames, ignore_index=True))

    return edges.coalesce(1).mapInPandas(run, schema)


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): a component is named by its least node; any type that has an order will do.

    Stars alternate: every node's larger neighbours are tied to its least one, then its smaller neighbours are. Edges become fewer or point lower
    in each round, until all point to the least node of their component. What is left of up to `small` edges is finished in one task.
    """
    kind = dict(edges.dtypes)["a"]
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        if edges.count() <= small:
            return materialize(_in_one_task(edges, _union_find, f"node {kind}, component {kind}"), "components")
        # large stars: both ends see each other
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small stars: edges point from the greater to the smaller end
        large = materialize(large, "large-stars")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        tied = materialize(tied, "small-stars")
        if tied.count() == edges.count() and tied.exceptAll(edges).isEmpty():
            names = tied.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return names.unionByName(tied.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = tied


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})


def beaten(conflicts: DataFrame, keys: Sequence[str], small: int = SMALL_EDGES) -> DataFrame:
    """(keys, node): the nodes that go when, from the best down, a node stays unless one that stays conflicts with it.

    `conflicts` has (keys, better, worse), an acyclic order. In each round the nodes that no undecided better one conflicts with stay, and those that
    conflict with one of them go. What is left of up to `small` conflicts is decided in one task.
    """
    left = materialize(conflicts.select(*keys, "better", "worse").distinct(), "conflicts")
    kinds = dict(left.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", node {kinds['worse']}"
    gone: list[DataFrame] = []
    same = lambda name: [*keys, name]
    while left.count() > small:
        free = left.select(*keys, "better").distinct().join(left.select(*keys, F.col("worse").alias("better")).distinct(), same("better"), "left_anti")
        lost = materialize(left.join(free, same("better"), "left_semi").select(*keys, F.col("worse").alias("node")).distinct(), "beaten")
        gone.append(lost)
        rest = left.join(lost.withColumnRenamed("node", "worse"), same("worse"), "left_anti").join(lost.withColumnRenamed("node", "better"), same("better"), "left_anti")
        left = materialize(rest, "conflicts")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        ties: dict[tuple, list] = {}
        waits: dict[tuple, int] = {}
        for *k, better, worse in pdf[[*keys, "better", "worse"]].itertuples(index=False, name=None):
            ties.setdefault((*k, better), []).append((*k, worse))
            waits[(*k, worse)] = waits.get((*k, worse), 0) + 1
        ready, out = [x for x in ties if x not in waits], set()
        while ready:
            x = ready.pop()
            for y in ties.get(x, []):
                if x not in out:
                    out.add(y)
                waits[y] -= 1
                if not waits[y]:
                    ready.append(y)
        return pd.DataFrame(sorted(out), columns=[*keys, "node"])

    done = materialize(_in_one_task(left, decide, schema), "beaten")
    for lost in gone:
        done = done.unionByName(lost)
    return done
