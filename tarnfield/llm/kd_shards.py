"""Sharding by a k-d tree over metadata, in DataFrame operations only.

The whole table is the root. A node that stands for ``n`` shards is cut along
the metadata dimension that is widest in it, at the weighted quantile that
leaves ``n // 2`` of ``n`` shards' bytes on the left, until every leaf is one
shard of about ``total / shards`` bytes. All nodes of a level are measured and
cut together, each by grouped sums (see ``selection``): no sort, and nothing
that grows with the rows reaches the driver. A level's cuts are literals, at
most ``shards - 1`` in all, so routing needs no join; each row's node is
written before the next level, which keeps the generated code small.

Rows of one group (here: equal texts) share their position in every dimension
and so go to the same shard, unless the group alone weighs more than
``whole_groups`` of a shard; such a hot group is cut by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnfield.llm.selection import crossings, of_node
from tarnfield.plans.workspace import Workspace

STEPS = 2**30 - 1  # positions along a dimension; the low half of a key is the group's hash


def _key(position: Column, group: Column) -> Column:
    return F.shiftleft(position.cast("long"), 32).bitwiseOR(group.bitwiseAND(0xFFFFFFFF))


def kd_shards(docs: DataFrame, dims: dict[str, Column], weight: Column, group: Column, row: Column, shards: int, whole_groups: float = 0.05, buckets: int = 1024) -> DataFrame:
    """``docs`` with ``weight`` long, ``shard`` int (0 to ``shards - 1``) and ``slot`` long (gapless from 0 in a shard).

    ``dims`` are numeric columns (null counts as the least value), ``weight`` a
    positive long, ``group`` and ``row`` long hashes of what must stay together
    and of the row. An empty table gives an empty result, repeated rows get a
    slot each, columns of ``docs`` named like results are replaced.
    """
    work = Workspace(docs.sparkSession, "kd")
    names = [f"_d{i}" for i in range(len(dims))]
    keep = [c for c in docs.columns if c not in ("weight", "shard", "slot")]
    raw = docs.select(*keep, weight.cast("long").alias("weight"), group.alias("_group"), row.bitwiseAND(2**62 - 1).alias("_tie"), *[d.cast("double").alias(n) for n, d in zip(names, dims.values(), strict=True)])
    ends = raw.agg(F.sum("weight").alias("total"), *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]).first()
    scaled = {}
    for n in names:
        lo, hi = ends[f"min{n}"], ends[f"max{n}"]
        flat = lo is None or hi <= lo
        scaled[n] = F.lit(0) if flat else F.coalesce(F.round((F.col(n) - lo) / (hi - lo) * STEPS), F.lit(0)).cast("int")
    placed = _grow(work, raw.withColumns(scaled | {"_node": F.lit(0)}), names, shards, whole_groups * (ends["total"] or 0) / shards)
    placed = placed.withColumn("_bucket", F.pmod("_tie", F.lit(buckets)).cast("int"))
    # A slot is the rows of earlier buckets of the shard, at most shards * buckets sums, plus the place in its own bucket.
    starts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(F.col("shard"), F.col("_bucket"), (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_start"))
    own = Window.partitionBy("shard", "_bucket").orderBy("_tie", "_group")
    numbered = placed.select(*keep, "weight", "shard", "_bucket", F.row_number().over(own).alias("_at"))
    return numbered.join(F.broadcast(starts), ["shard", "_bucket"]).select(*keep, "weight", "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"))


def _grow(work: Workspace, rows: DataFrame, dims: list[str], shards: int, heavy: float) -> DataFrame:
    """``rows`` with their ``shard``. A node is a (first shard, number of shards); its number is its first shard."""
    nodes, level = {0: shards}, 0
    rows = work.save("level0", rows)
    while wide := {at: n for at, n in nodes.items() if n > 1}:
        node = F.col("_node")
        seen = rows.groupBy("_node").agg(F.sum("weight").alias("total"), *[f(d).alias(f"{f.__name__}{d}") for d in dims for f in (F.min, F.max)]).collect()
        seen = {r["_node"]: r for r in seen if r["_node"] in wide}
        if not seen:
            break
        cut_at = {at: max(range(len(dims)), key=lambda i, r=r: r[f"max{dims[i]}"] - r[f"min{dims[i]}"]) for at, r in seen.items()}
        ends = {at: (r[f"min{dims[cut_at[at]]}"] << 32, (r[f"max{dims[cut_at[at]]}"] << 32) + 0xFFFFFFFF) for at, r in seen.items()}
        targets = {at: round(r["total"] * (wide[at] // 2) / wide[at]) for at, r in seen.items()}
        key = _key(F.element_at(F.array(*dims), of_node({at: i + 1 for at, i in cut_at.items()}, node).cast("int")), F.col("_group"))
        found = crossings(rows, node, key, F.col("weight"), targets, ends)
        ties = {}
        if hot := {at: c for at, c in found.items() if c.at > heavy}:
            inside = node.isin(list(hot)) & (key == of_node({at: c.key for at, c in hot.items()}, node))
            ties = crossings(rows.where(inside), node, F.col("_tie"), F.col("weight"), {at: targets[at] - c.below for at, c in hot.items()})
        keys, rests = {}, {}
        for at, c in found.items():
            short = targets[at] - c.below
            if at in ties:  # a group too heavy to go whole: its rows are cut by their hash
                keys[at], rests[at] = c.key, ties[at].key + (short - ties[at].below > ties[at].at / 2)
            else:  # the cut goes before or after the group, whichever is nearer
                keys[at], rests[at] = c.key + (short > c.at / 2), 0
        cut = of_node(keys, node)
        right = (key > cut) | ((key == cut) & (F.col("_tie") >= of_node(rests, node)))
        nodes = {x: n for at, m in nodes.items() for x, n in ([(at, m // 2), (at + m // 2, m - m // 2)] if at in found else [(at, m if at not in wide else 1)])}
        step = of_node({at: wide[at] // 2 for at in found}, node).cast("int")
        rows, level = work.save(f"level{level + 1}", rows.withColumn("_node", F.when(node.isin(list(found)) & right, node + step).otherwise(node))), level + 1
        work.drop(f"level{level - 1}")
    return rows.withColumnRenamed("_node", "shard")


def text_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents in shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty. The dimensions are metadata of the text: its
    bytes and lines (logarithms), its share of multi-byte characters and its
    first character, so equal texts share a leaf.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text.alias("_text"))
    text_of = F.col("_text")
    dims = {
        "bytes": F.log2(F.octet_length(text_of) + 8),
        "lines": F.log2(F.lit(1) + F.length(text_of) - F.length(F.replace(text_of, F.lit("\n"), F.lit("")))),
        "wide": (F.octet_length(text_of) - F.length(text_of)) / (F.octet_length(text_of) + 8),
        "first": F.ascii(F.substring(text_of, 1, 1)),
    }
    hashed = base.select("doc_id", "text_crc32", (F.octet_length(text_of).cast("long") + 8).alias("size"), F.xxhash64(text_of).alias("_g"), F.xxhash64("doc_id", text_of).alias("_r"), *[d.alias(n) for n, d in dims.items()])
    placed = kd_shards(hashed, {n: F.col(n) for n in dims}, F.col("size"), F.col("_g"), F.col("_r"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
