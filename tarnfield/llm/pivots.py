"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest of a set of reference points,
nearest first: the head of its permutation of the points. The points are fitted
on a bounded sample and kept apart from each other, so no dense region owns
more than a few. Every vector enters inverted lists; vectors that meet in a list
become candidates if they share at least ``SHARED`` points there and the shared
points stand far enough in front of both permutations (``ORDER``); candidates
are verified by their cosine in double precision. Points are ranked by how many
vectors name them, rare ones first: two vectors that share ``SHARED`` points
have their first two shared ones among the first ``NEAREST - SHARED + 2`` of
either, so a list stands for two such points, and the list of the first two that
a pair shares is the one that counts it. A list returns counts and a spanning
forest of its links, never the pairs; long lists are dealt out in blocks.

Equal vectors are one vector with a multiplicity, by which its links count.
Dense balls. Vectors within ``BALL`` degrees of one leader are pairwise linked
(twice the ball's radius is below the linking angle), so their counts follow
from the ball's size and they enter no list. Only vectors in the ball's halo
may link into it too; they are compared with the ball's members block by block,
and again only counts leave. So a group that holds a large part of all vectors
costs one comparison each and those with its halo. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.graph import components, forest
from tarnfield.llm.sampling import bounded_sample
from tarnfield.plans.workspace import Workspace

SAMPLE = 8192  # vectors that points and leaders are fitted on
POINTS = (64, 4096)  # least and most reference points: the root of twice the rows, so lists stay about as long, between these
NEAREST, SHARED = 6, 3  # points that describe a vector, of which linked ones share so many
ORDER = 40  # least sum over shared points of the product of their places, counted from the back (of equal permutations: 91)
APART = 0.5  # cosine that two reference points stay below, where the sample allows
LINK = 0.95
BALL = float(np.degrees(np.arccos(LINK))) / 2 - 0.01
LEADERS = 256  # most balls
BUCKET_ROWS = 4000  # vectors that a bucket of lists stands for, at most about
BLOCK = 2048  # rows of one block of products, and of one block of a list


def unit(batch_column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in double precision and of length 1, whether usable); null, zero and non-finite vectors and those not of ``width`` are not."""
    values = batch_column.to_pylist()
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        if v and len(v) == width and None not in v:
            out[i] = v
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    size = np.sqrt((out * out).sum(1))
    fine = finite & (size > 0) & np.isfinite(size)
    out[fine] /= size[fine, None]
    return out, fine


def fit(sample: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(reference points, leaders of dense balls) from a sample of unit vectors."""
    want = min(max(POINTS[0], int((2 * rows) ** 0.5)), POINTS[1], len(sample))
    points: list[int] = []
    nearest = np.full(len(sample), -2.0)  # cosine of the nearest point so far
    for apart in (APART, 0.9, 0.99, 2.0):
        for i in range(len(sample)):
            if len(points) < want and nearest[i] < apart:
                points.append(i)
                nearest = np.maximum(nearest, sample @ sample[i])
                nearest[i] = 3.0
    near = [np.flatnonzero(sample @ x >= np.cos(np.radians(BALL / 2))) for x in sample]
    leaders: list[int] = []
    free, count = np.ones(len(sample), bool), np.array([len(n) for n in near], np.int64)
    while free.any() and len(leaders) < LEADERS:
        at = int(np.where(free, count, 0).argmax())
        if count[at] < 5:
            break
        leaders.append(at)
        gone = np.flatnonzero(free & (sample @ sample[at] >= np.cos(np.radians(3 * BALL))))
        free[gone] = False
        for i in gone.tolist():
            count[near[i]] -= 1
    return sample[points], sample[leaders]


def _described(rows: DataFrame, points: np.ndarray, leaders: np.ndarray) -> DataFrame:
    """id, m, ball (leader or -1), halos (other leaders near enough for links into their balls), nearest (points, nearest first), vector (bytes of doubles)."""
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast((points, leaders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, leaders = given.value
        k = min(NEAREST, len(points))
        for batch in batches:
            x, fine = unit(batch.column("_v"), points.shape[1])
            ids, m = (batch.column(c).filter(pa.array(fine)) for c in ("id", "m"))
            x = x[fine]
            if not len(x):
                continue
            like = np.round(x @ points.T, 12)
            near = np.argpartition(-like, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(like, near, 1)), axis=1), 1)
            ball = np.full(len(x), -1)
            halos = [[] for _ in range(len(x))]
            if len(leaders):
                angle = np.degrees(np.arccos(np.clip(x @ leaders.T, -1, 1)))
                best = angle.argmin(1)
                inside = angle[np.arange(len(x)), best] <= BALL
                ball[inside] = best[inside]
                for i, j in zip(*np.nonzero(angle <= 3 * BALL + 0.05), strict=True):
                    if ball[i] < 0 or ball[i] > j:  # of two balls the later one's vectors are compared with the earlier one's
                        halos[i].append(int(j))
            yield pa.RecordBatch.from_arrays(
                [ids, m, pa.array(ball, pa.int32()), pa.array(halos, pa.list_(pa.int32())), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["id", "m", "ball", "halos", "nearest", "vector"],
            )

    return rows.mapInArrow(run, "id long, m long, ball int, halos array<int>, nearest array<int>, vector binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


_LINKS = "id long, n long, root long"


def _as_links(found: list[tuple]) -> pa.Table:
    """id, n (links decided here), root (least id of its tree here)."""
    columns = [np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("id", "n", "root"), columns, strict=True)))


def _groups(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, end) of each run of equal keys."""
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _bucket_links(table: pa.Table) -> pa.Table:
    """What the inverted lists of one bucket add."""
    table = table.sort_by([(c, "ascending") for c in ("p", "q", "i", "j", "id")])
    p, q, i, j, own, ids, m = (table.column(c).to_numpy() for c in ("p", "q", "i", "j", "own", "id", "m"))
    near, ranks = (np.array(table.column(c).to_pylist(), np.int64).reshape(len(ids), -1) for c in ("nearest", "ranked"))
    x = _matrix(table.column("vector"))
    found = [_list_links((p[a], q[a]), ids[a:b], m[a:b], own[a:b] if i[a] != j[a] else None, x[a:b], near[a:b], ranks[a:b]) for a, b in _groups(p, q, i, j) if b - a > 1]
    return _as_links(found)


def _list_links(name: tuple[int, int], ids: np.ndarray, m: np.ndarray, own: np.ndarray | None, x: np.ndarray, near: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, roots) of the members of one list that have links; ``ids`` ascend. ``own``: the block of each, if only pairs across blocks count."""
    n, k = near.shape
    points, at = np.unique(near, return_inverse=True)
    places = np.zeros((n, len(points)), np.float32)  # a point's place in the permutation, counted from the back; 0 where it isn't named
    places[np.arange(n)[:, None], at.reshape(n, k)] = NEAREST - np.arange(k)
    named = (places > 0).astype(np.float32)
    counts = np.zeros(n, np.int64)
    found_i, found_j = [np.zeros(0, int)], [np.zeros(0, int)]
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            may = (named[a : a + BLOCK] @ named[b : b + BLOCK].T >= min(SHARED, k)) & (places[a : a + BLOCK] @ places[b : b + BLOCK].T >= ORDER)
            i, j = np.nonzero(may)
            i, j = i + a, j + b
            ahead = i < j if own is None else (i < j) & (own[i] != own[j])
            i, j = i[ahead], j[ahead]
            for s in range(0, len(i), 20_000):
                u, v = i[s : s + 20_000], j[s : s + 20_000]
                ok = np.einsum("ij,ij->i", x[u], x[v]) >= LINK
                u, v = u[ok], v[ok]
                shared = (ranked[u][:, :, None] == ranked[v][:, None, :]).any(2)  # ranks ascend: the first two shared points name the list
                first = shared.argmax(1)
                rest = shared.copy()
                rest[np.arange(len(u)), first] = False
                mine = (ranked[u, first] == name[0]) & (ranked[u, rest.argmax(1)] == name[1])
                u, v = u[mine], v[mine]
                counts += (np.bincount(u, m[v], n) + np.bincount(v, m[u], n)).astype(np.int64)
                found_i.append(u)
                found_j.append(v)
    root = forest(n, np.concatenate(found_i), np.concatenate(found_j))
    linked = counts > 0
    return ids[linked], counts[linked], ids[root[linked]]


def _halo_links(table: pa.Table) -> pa.Table:
    """Links between members of balls and vectors in their halos, for the blocks of one bucket; all are in the ball's tree."""
    table = table.sort_by([(c, "ascending") for c in ("ball", "i", "j", "halo", "id")])
    ball, i, j, halo, ids, root, m = (table.column(c).to_numpy() for c in ("ball", "i", "j", "halo", "id", "root", "m"))
    found = []
    for a, b in _groups(ball, i, j):
        cut = a + int(np.searchsorted(halo[a:b], 1))
        if a < cut < b:
            inner, outer = _matrix(table.column("vector").slice(a, cut - a)), _matrix(table.column("vector").slice(cut, b - cut))
            near = inner @ outer.T >= LINK
            n = np.concatenate([near @ m[cut:b], m[a:cut] @ near])
            found.append((ids[a:b][n > 0], n[n > 0], root[a:b][n > 0]))
    return _as_links(found)


def _in_balls(work: Workspace, described: DataFrame, parts: int) -> DataFrame:
    """Links of the members of balls, with each other and with their halos; the sizes of at most ``LEADERS`` balls are broadcast."""
    inside = described.where("ball >= 0")
    balls = work.save("balls", inside.groupBy("ball").agg(F.sum("m").alias("all"), F.count("*").alias("size"), F.min("id").alias("root")))
    alone = inside.join(F.broadcast(balls), "ball").select("id", (F.col("all") - F.col("m")).alias("n"), "root")
    touching = described.select("id", "m", "vector", F.explode("halos").alias("ball"))
    halos = work.save("halos", touching.groupBy("ball").agg(F.count("*").alias("halo")))
    both = F.broadcast(work.save("sides", balls.join(halos, "ball").select("ball", "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("_i"), F.ceil(F.col("halo") / BLOCK).cast("int").alias("_j"))))

    def dealt(rows: DataFrame, own: str, other: str, mine: str, halo: bool) -> DataFrame:
        blocks = rows.join(both, "ball").withColumn(mine[1], F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        return blocks.withColumn(other[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("ball", "i", "j", F.lit(int(halo)).alias("halo"), "id", "m", "root", "vector")

    members, around = dealt(inside.select("ball", "id", "m", "vector"), "_i", "_j", "_i", False), dealt(touching, "_j", "_i", "_j", True)
    pairs = members.unionByName(around).withColumn("bucket", F.pmod(F.xxhash64("ball", "i", "j"), F.lit(4 * parts)))
    return alone.unionByName(pairs.groupBy("bucket").applyInArrow(_halo_links, _LINKS))


def _in_lists(work: Workspace, described: DataFrame, buckets: int) -> DataFrame:
    """Links of the vectors that are in no ball."""
    free = described.where("ball < 0").select("id", "m", "vector", "nearest")
    # One row a point: which is named how often, so that lists of rare points come first.
    named = free.select(F.explode("nearest").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    rank = {r["p"]: i for i, r in enumerate(sorted(named, key=lambda r: (r["n"], r["p"])))}
    ranks = F.array(*[F.lit(rank.get(p, -1)) for p in range(max(rank, default=0) + 1)])
    ranked = work.save("ranked", free.withColumn("_ranks", ranks).select("id", "m", "vector", "nearest", F.array_sort(F.transform("nearest", lambda p: F.get("_ranks", p))).alias("ranked")))
    front = range(NEAREST - SHARED + 2)
    pairs = [F.struct(F.get("ranked", F.lit(i)).alias("p"), F.get("ranked", F.lit(j)).alias("q")) for i in front for j in front if i < j]
    lists = ranked.select("*", F.explode(F.filter(F.array(*pairs), lambda s: s["q"].isNotNull())).alias("_l")).select("id", "m", "vector", "nearest", "ranked", "_l.p", "_l.q")
    long = work.save("long", lists.groupBy("p", "q").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("_blocks")).where("_blocks > 1"))
    blocked = lists.join(long, ["p", "q"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    blocked = blocked.select("id", "m", "vector", "nearest", "ranked", "p", "q", "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))
    return blocked.withColumn("bucket", F.pmod(F.xxhash64("p", "q", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket_links, _LINKS)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rows`` plus n_links, component_id and kept.

    Unusable vectors (null, empty, zero, with null or non-finite components, or
    not of the most frequent length, the greater one at a tie) link with
    nothing. Rows without id link with nothing, name no component and are kept.
    Rows that repeat an id are vectors of their own, which that id names too. An
    empty table gives an empty result; columns named like results are replaced.
    """
    made = ("n_links", "component_id", "kept")
    keep = [c for c in rows.columns if c not in made]
    spark = rows.sparkSession
    work = Workspace(spark, "pivots")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = rows.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("_v"))
    widths = given.groupBy(F.size("_v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 1
    once = given.where(F.size("_v") == width).groupBy("_v").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    once = work.save("once", once.withColumn("id", F.monotonically_increasing_id()))
    total = once.count()
    sample = [r["_v"] for _, r in bounded_sample(once.select("_v"), F.lit(0), F.xxhash64("_v"), SAMPLE)]
    x, fine = unit(pa.array(sample, pa.list_(pa.float64())), width)
    points, leaders = fit(x[fine], total)
    if not len(points):
        return rows.select(*keep, F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"), F.lit(True).alias("kept"))
    described = work.save("described", _described(once, points, leaders))
    buckets = max(4 * parts, total // BUCKET_ROWS + 1)
    links = work.save("links", _in_lists(work, described, buckets).unionByName(_in_balls(work, described, parts)).where("n > 0"))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(work, links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    usable = described.select("id", "m").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    key1, key2 = (F.xxhash64(F.lit(i), F.col("_v")) for i in (1, 2))
    keyed = usable.join(once.select("id", "least", key1.alias("_k1"), key2.alias("_k2")), "id").withColumn("root", F.coalesce("root", "id"))
    named = keyed.groupBy("root").agg(F.min("least").alias("_component"))
    found = work.save("found", keyed.join(named, "root").select("_k1", "_k2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), "_component"))
    work.drop("once", "described", "ranked", "balls", "halos", "sides", "long")
    work.release()
    told = F.col(vec_id).isNotNull() & (F.size(vector) == width)
    a, b = (F.when(told, F.xxhash64(F.lit(i), F.col(vector))) for i in (1, 2))
    own = F.coalesce(F.col("_component"), F.col(vec_id))
    return rows.select(*keep, a.alias("_a"), b.alias("_b")).join(found, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left").select(
        *keep, F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col(vec_id), F.lit(True)).alias("kept")
    )


def near_embeddings(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_vectors(rows.select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
