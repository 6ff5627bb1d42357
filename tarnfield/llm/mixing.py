"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a hash-shuffled order, has a virtual finish
time: the source's words up to and with it, divided by the source's weight. A
repeat of the source goes on counting where the pass before ended, and after
``repeats`` passes the source is exhausted. The mix is the global order by
virtual finish time, cut where the running words reach the budget. Sources that
run dry leave their share to the others in proportion to weight, so the cut
itself water-fills the targets.

Texts are read once for narrow rows (size, order, bucket); equal rows are
counted as one, so a row that a third of the table repeats is no hot key, and
are told apart again after the running sums. These use two levels: a source's
shuffled order is split by hash into ``buckets``, a bucket's start is a running
sum over bucket sums, and only the rows of one bucket meet in a task. The queue
is then sorted by ranges of the finish time; sums per range tell in which range
the budget ends, and only that one is summed up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.plans.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 10_000  # equal rows that one array tells apart
TICKS = 2**52  # virtual time is compared as a long: ticks of the latest finish time


def word_count(text: Column) -> Column:
    """Number of ``WORD`` in the text, null as none; one pass, whatever stands between words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A fixed pseudo-random order that reruns repeat: equal only for equal rows."""
    return F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Per source (``source``, ``source_size``): its ``weight`` and its water-filled ``target``.

    One row per source: the windows without partition run over the sources only.
    Sources go by code point with null last and take the weights in turn. The
    level ``x`` solves sum(min(repeats * size, x * weight)) = sum(size).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_ratio", F.col("source_size") * repeats / F.col("weight"))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    filled = ranked.withColumns({
        "_before": F.coalesce(F.sum(F.col("source_size") * repeats).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(everything),
        "_k": F.row_number().over(fill),
    }).withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_left"))
    # The first source, by how soon it runs dry, that the level leaves under its limit decides the level.
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_k", "_level"))).over(everything)
    level = F.coalesce(first["_level"], F.lit(0.0))
    return filled.withColumn("target", F.least(F.col("source_size").cast("double") * repeats, level * F.col("weight"))).select("source", "source_size", "weight", "target")


def _row_keys(rows: DataFrame) -> list[Column]:
    told = [F.col(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(i), *told) for i in (1, 2)]


def _queue_end(work: Workspace, passes: DataFrame, budget: int) -> int:
    """Where the queue, sorted by ``tick``, is cut: the last tick that stays. The tick that crosses the budget does if that ends nearer to it."""
    parts = int(passes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = passes.repartitionByRange(parts, "tick").sortWithinPartitions("tick").withColumn("_range", F.spark_partition_id())
    in_order = work.save("ranges", in_order)
    below = 0
    for r in sorted(in_order.groupBy("_range").agg(F.sum("size").alias("n"), F.max("tick").alias("last")).collect()):
        if below + r["n"] < budget:
            below += r["n"]
            continue
        ticks = in_order.where(F.col("_range") == r["_range"]).groupBy("_range", "tick").agg(F.sum("size").alias("n"))
        run = ticks.select("tick", "n", F.sum("n").over(Window.partitionBy("_range").orderBy("tick")).alias("run"))
        cut = run.where(F.col("run") >= budget - below).agg(F.min(F.struct("run", "tick", "n")).alias("cut")).first()["cut"]
        over, short = below + cut["run"] - budget, budget - (below + cut["run"] - cut["n"])
        return cut["tick"] if over <= short else cut["tick"] - 1
    return -1


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, buckets: int = 1024, with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` (source, text and doc_id are read; text is kept only ``with_text``) plus size, source_size, target and taken.

    ``taken`` is the document's size times the passes of it that the mix holds.
    A null source is a source of its own, null and empty texts have size 0 and
    take nothing, repeated rows are separate documents, an empty table gives an
    empty result; columns named like results are replaced. The word is whatever
    ``WORD`` matches, so U+0085 or U+2028 are words or parts of them.
    """
    made = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in made]
    work = Workspace(docs.sparkSession, "mix")
    own_name = {c: f"c{i}" for i, c in enumerate(keep)}  # so that no name of the table meets one of ours
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own_name.items()])
    text, held = F.col(own_name["text"]), [n for c, n in own_name.items() if c != "text"]
    k1, k2 = _row_keys(rows)
    sized = rows.select(*held, k1.alias("_k1"), k2.alias("_k2"), word_count(text).alias("size"), shuffle_key(F.col(own_name["doc_id"]), text).alias("_order"), F.col(own_name["source"]).alias("source"))
    sized = sized.withColumn("_bucket", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    sized = sized.groupBy("source", "_bucket", "_order", "_k1", "_k2", "size").agg(F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in held])
    sized = work.save("sized", sized)
    parts = work.save("parts", sized.groupBy("source", "_bucket").agg(F.sum(F.col("size") * F.col("_copies")).alias("_sum")))
    sources = work.save("sources", source_targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, repeats))
    starts = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).select(
        parts["source"].alias("_source"), parts["_bucket"].alias("_b"), "source_size", "weight", "target",
        (F.sum("_sum").over(Window.partitionBy(parts["source"]).orderBy("_bucket")) - F.col("_sum")).alias("_start"),
    )
    placed = sized.join(starts, sized["source"].eqNullSafe(F.col("_source")) & (sized["_bucket"] == F.col("_b")))
    own = Window.partitionBy("_source", "_b").orderBy("_order", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_before", F.col("_start") + F.sum(F.col("size") * F.col("_copies")).over(own) - F.col("size") * F.col("_copies"))
    queue = work.save("queue", _told_apart(placed).select(*held, "_k1", "_k2", "size", "source_size", "target", "weight", (F.col("_before") + F.col("size") * (F.col("_copy") + 1)).alias("_end")))
    work.drop("sized")
    total = queue.agg(F.sum("size").alias("budget"), F.max((F.col("_end") + F.col("source_size") * (repeats - 1)) / F.col("weight")).alias("latest")).first()
    latest = total["latest"] or 1.0

    def tick(a_pass: Column) -> Column:
        return F.floor((F.col("_end") + F.col("source_size") * a_pass) / F.col("weight") / latest * TICKS).cast("long")

    passes = queue.where("size > 0").select("size", "_end", "source_size", "weight", F.explode(F.array(*[F.lit(p) for p in range(repeats)])).alias("_pass"))
    last = _queue_end(work, passes.select("size", tick(F.col("_pass")).alias("tick")), total["budget"] or 0)
    times = sum((tick(F.lit(p)) <= last).cast("long") for p in range(repeats))
    mixed = queue.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).cast("long"))
    work.drop("ranges")
    named = [F.col(n).alias(c) for c, n in own_name.items() if with_text or c != "text"]
    if not with_text:
        return mixed.select(*named, *made)
    # Equal rows are one row with its text here, and as many as before again after the join.
    found = work.save("found", mixed.groupBy("_k1", "_k2", *made).agg(F.count("*").alias("_copies")))
    work.release()
    once = rows.select(*own_name.values(), k1.alias("_a"), k2.alias("_b")).groupBy("_a", "_b").agg(*[F.first(n).alias(n) for n in own_name.values()])
    joined = once.join(found, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")))
    return _told_apart(joined).select(*named, *made)


def _told_apart(rows: DataFrame) -> DataFrame:
    """Each row ``_copies`` times, numbered from 0 by ``_copy``."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long"))))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + COPIES, F.col("_copies")) - 1)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return fair_mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, source_size * 3 / weight AS ratio FROM r),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, encode(source) NULLS LAST) AS k, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (SELECT source, source_size, weight, least(CAST(source_size AS DOUBLE) * 3, coalesce((SELECT level FROM l AS m WHERE level <= ratio ORDER BY k LIMIT 1), 0) * weight) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, d.o,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o ROWS UNBOUNDED PRECEDING) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, p, (fin + source_size * p) / weight AS v FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE size > 0),
g AS (SELECT v, sum(size) AS w FROM (SELECT size, floor(v / (SELECT max(v) FROM e) * 4503599627370496) AS v FROM e) GROUP BY v),
c AS (SELECT v, w, sum(w) OVER (ORDER BY v) AS run, (SELECT sum(size) FROM d) AS budget FROM g),
cut AS (SELECT max(v) AS v FROM c WHERE run - w < budget AND (run <= budget OR 2 * (budget - (run - w)) >= w))
SELECT q.doc_id, q.size, q.source_size, q.target,
       CAST(q.size * (SELECT count(*) FROM unnest([0, 1, 2]) AS x(p) WHERE q.size > 0 AND floor((q.fin + q.source_size * p) / q.weight / (SELECT max(v) FROM e) * 4503599627370496) <= (SELECT v FROM cut)) AS BIGINT) AS taken
FROM q
"""
