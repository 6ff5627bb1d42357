"""Distributed weighted selection: where does the running weight of a sorted key cross a target?

The key range is cut into bins, a grouped aggregation sums the weight of each
bin, and the bin that holds the crossing becomes the next range. Each round
shuffles one partial sum per bin and task; the driver sees at most
``bins * nodes`` sums. No row is ever sorted or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Crossing:
    """The key at which the running weight reaches the target, and the weight strictly below it and on it."""

    key: int
    below: int
    at: int


def of_node(values: dict[int, int], node: Column) -> Column:
    """A literal lookup by node number."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, int(v))]), node).cast("long")


def crossings(rows: DataFrame, node: Column, key: Column, weight: Column, targets: dict[int, int], ends: dict[int, tuple[int, int]] | None = None, bins: int = 512) -> dict[int, Crossing]:
    """For each node of ``targets`` the first key, in ascending order, whose running weight reaches the target.

    ``key`` is a long. Nodes without rows are left out. Targets beyond a node's
    total weight select its last key. ``ends``: a range per node that holds all
    its keys, if the caller knows one.
    """
    rows = rows.select(node.cast("int").alias("_n"), key.cast("long").alias("_k"), weight.cast("long").alias("_w"))
    rows = rows.where(F.col("_n").isin([int(n) for n in targets]))
    ends = ends or {r["_n"]: (r["lo"], r["hi"]) for r in rows.groupBy("_n").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).collect()}
    below = dict.fromkeys(ends, 0)
    found: dict[int, Crossing] = {}
    while ends:
        width = {n: (hi - lo) // bins + 1 for n, (lo, hi) in ends.items()}
        low, high = ({n: e[i] for n, e in ends.items()} for i in (0, 1))
        n, k = F.col("_n"), F.col("_k")
        open_rows = rows.where(n.isin(list(ends)) & (k >= of_node(low, n)) & (k <= of_node(high, n)))
        binned = open_rows.withColumns({"_o": k - of_node(low, n), "_d": of_node(width, n)}).withColumn("_b", F.expr("_o div _d"))
        sums: dict[int, list] = {}
        for r in binned.groupBy("_n", "_b").agg(F.sum("_w").alias("w"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).collect():
            sums.setdefault(r["_n"], []).append((r["_b"], r["w"], r["lo"], r["hi"]))
        again = {}
        for at, parts in sums.items():
            for i, (_, w, lo, hi) in enumerate(sorted(parts)):
                if below[at] + w >= targets[at] or i == len(parts) - 1:
                    if lo == hi:
                        found[at] = Crossing(lo, below[at], w)
                    else:
                        again[at] = (lo, hi)
                    break
                below[at] += w
        ends = again
    return found
