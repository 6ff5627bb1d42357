"""Connected components by contraction, over tables only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.plans.workspace import Workspace


def components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges`` (a, b) to (node, root): the least node that links reach, for every node with an edge to another.

    Each round lets every node follow its least neighbour, twice, and replaces
    the ends of the edges by what they followed, so every node that still has
    an edge is merged with another and the edges shrink geometrically. A round
    moves edges and nodes by their keys and combines minima before the shuffle;
    a hub's edges are split by adaptive joins.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    live = work.save(f"{name}-edges0", both)
    roots = work.save(f"{name}-roots0", live.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    at = 0
    while not live.isEmpty():
        least = live.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        least = work.save(f"{name}-least{at}", least)
        up = least.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = work.save(f"{name}-jump{at}", least.join(up, "p").select("a", F.least("p", "pp").alias("to")))
        to_a, to_b = jump, jump.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = live.join(to_a, "a").join(to_b, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct()
        to_root = jump.select(F.col("a").alias("root"), "to")
        roots = work.save(f"{name}-roots{at + 1}", roots.join(to_root, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        live = work.save(f"{name}-edges{at + 1}", moved)
        work.drop(f"{name}-edges{at}", f"{name}-roots{at}", f"{name}-least{at}", f"{name}-jump{at}")
        at += 1
    return roots


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``n`` points under the links ``i``-``j``."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return root
