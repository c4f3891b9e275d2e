"""Connected components of a table of edges, without bringing more than a bounded number of edges together anywhere.

Each partition first replaces its edges by a spanning forest of stars. If no more than FEW edges are left then, or after any later round, one task ends
the work: rounds of shuffles cost far more than such a table. Otherwise large-star and small-star steps alternate (every
node hangs its larger neighbours, then its smaller ones, on the smallest node it knows) until nothing changes, which takes
a number of rounds that grows with the logarithm of the nodes. Minima are aggregated before they are shuffled, and nodes with very many edges, which are few,
are joined by a broadcast, so they are no hot spots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Edges that a task holds while it looks for its forest.
HELD = 1 << 21
#: Edges (16 bytes each) that one task takes through to the end.
FEW = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each is connected with, by these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hang the larger root on the smaller one, then shorten all paths
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def out() -> pd.DataFrame:
        rows = pd.concat(held)
        nodes, roots = forest(rows["a"].to_numpy(), rows["b"].to_numpy())
        other = nodes != roots
        return pd.DataFrame({"a": nodes[other], "b": roots[other]})

    for f in frames:
        held.append(f)
        if sum(map(len, held)) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if held := [f for f in frames if len(f)]:
        rows = pd.concat(held)
        nodes, roots = forest(rows["a"].to_numpy(), rows["b"].to_numpy())
        yield pd.DataFrame({"node": nodes, "root": roots})


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root from edges (a long, b long): root is the smallest node of the component. Nodes without edges to others aren't in it."""
    edges = common.cut(edges.select("a", "b").where("a <> b").mapInPandas(_forests, "a long, b long"))
    while (total := edges.count()) > FEW:
        # a > b from here on. Large star: neighbours above u go to the smallest of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("size"))
        large = common.join_by_size(both, least, "u", "size", 2 * total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: neighbours at or below u, and u, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        small = common.join_by_size(large, least, "a", "size", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = common.cut(small.where("a <> b").distinct())
        common.forget(edges)
        # Done when no node has two smaller neighbours and no root has a smaller neighbour itself.
        tall = small.select(F.col("b").alias("a")).join(small.select("a"), "a", "left_semi")
        if tall.isEmpty() and small.groupBy("a").count().where("count > 1").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = small
    return edges.coalesce(1).mapInPandas(_finish, "node long, root long")
