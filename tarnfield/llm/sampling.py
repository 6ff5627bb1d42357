"""Bounded samples of labelled rows by a hash threshold.

Asking each task for its first ``n`` rows would bring ``n`` rows of every task
to the driver. Here the rows of each kind are counted first, and a threshold on
a hash of the row, the same for all tasks, leaves about ``n`` of a kind. Rows
that repeat each other count as one, so a row that much of the table repeats
neither fills the sample nor the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_by_hash(rows: DataFrame, kind: Column, key: Column, n: int) -> DataFrame:
    """``rows`` plus ``_kind`` and ``_hash``: all of a kind if its distinct keys are at most ``n``, else of ``n`` of them and four deviations more."""
    marked = rows.select("*", kind.alias("_kind"), F.shiftrightunsigned(key, 1).alias("_hash")).where(F.col("_kind").isNotNull())
    counts = marked.select("_kind", "_hash").distinct().groupBy("_kind").agg(F.count("*").alias("n")).collect()
    tight = {r["_kind"]: int(min(1.0, (n + 4 * n**0.5 + 16) / r["n"]) * (2**63 - 1)) for r in counts if r["n"] > n}
    if not tight:
        return marked
    limits = F.create_map(*[F.lit(x) for k, v in tight.items() for x in (k, v)])
    return marked.where(F.col("_hash") <= F.coalesce(F.try_element_at(limits, F.col("_kind")), F.lit(2**63 - 1)))


def bounded_sample(rows: DataFrame, kind: Column, key: Column, n: int) -> list:
    """At most ``n`` distinct rows of each kind as ``(kind, row)``, in the order of ``key``'s hash; reruns agree."""
    fields = rows.columns
    # Rows are few here: what the threshold leaves.
    once = kept_by_hash(rows, kind, key, n).groupBy("_kind", "_hash").agg(F.min(F.struct(*fields)).alias("row"))
    out, seen = [], {}
    for r in sorted(once.collect(), key=lambda r: (r["_hash"], str(r["_kind"]))):
        seen[r["_kind"]] = seen.get(r["_kind"], 0) + 1
        if seen[r["_kind"]] <= n:
            out.append((r["_kind"], r["row"]))
    return out
