"""Jaccard self-join of word shingles by prefixes of token combinations.

A document's tokens are its distinct shingles, in a global order: rare ones
first, then the frequent ones by ascending count. Tokens have classes: rare ones
class size 1, frequent ones 2, and one more for each ``STEP`` times as many
documents, so that lists stay about as long however large the corpus; these are
divided into bins by hash. A document with ``n`` tokens may miss at most ``d = n - ceil(t n)``
of them in a linked document. Its prefix is the shortest that holds, over all
classes of size ``k``, ``sum(max(0, tokens of the class - (k - 1))) >= d + 1``:
however ``d`` tokens go missing, some class keeps ``k`` of them, and the
document whose prefix ends first shares these with the other's prefix. So the
index holds every single rare token and every ``k``-combination within a class,
and no link is lost; which tokens count as frequent decides only how long the
lists get. The number of bins grows with the document (by bands of size, a
document near the edge of a band enters both), which keeps combinations in
proportion to the prefix.

Lists are not expanded into pairs. Every member is first verified against its
list's pivot, the member with most frequent tokens (in a group of near copies,
the text they derive from). Only members of one list that are in different
components after that are compared with each other, in blocks, behind an upper
bound on their overlap from counts of tokens in 128 cells. Near copies share
many lists, so a pair is made in the list of its least shared signature only: a
list leaves out pairs whose least ``LOW`` signatures already hold a lower one in
common, which is where that pair is met. Verification reads whole texts.
Components, which is what is asked for, come out whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.graph import components
from tarnfield.llm.superkmers import _binary, _Hashes, _is_in, _parts, _u, rolled, spread
from tarnfield.plans.workspace import Workspace, tidy

FREQUENT, STEP = 20, 100  # documents of a token, of those that tasks counted, to be in class 2; in class k with STEP**(k - 2) times as many
TABLE = 1 << 20  # frequent tokens that are told to all tasks, 24 bytes each; where more qualify, FREQUENT rises until they fit
SMALL = 32  # sets below this size use single tokens only
CELLS = 128
BLOCK = 2000  # members of a list compared at once
SIDE = 500  # of these, in one array operation
LOW = 32  # least signatures of a member by which a list knows pairs of lower lists; moves no result, only how often a pair is made
CHUNK = 256  # members that are verified against one copy of their pivot's text
_C = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LOWER = bytes(range(256)).lower()


class Shingles:
    """Distinct shingle hashes of texts, ascending; one shingle of all words if there are fewer than ``words``."""

    def __init__(self, words: int):
        self.words, self.seen = words, _Hashes()

    def of(self, text: bytes) -> np.ndarray:
        w = text.translate(LOWER).split()
        h = np.fromiter(map(self.seen.__getitem__, w), np.uint64, len(w))
        if 0 < len(h) < self.words:
            return rolled(h, len(h)) ^ _u(len(h))
        return np.unique(rolled(h, self.words))


def least_overlap(n: np.ndarray | int, percent: int):
    """Fewest tokens that a set of ``n`` shares with a linked one."""
    return (percent * n + 99) // 100


def cells(tokens: np.ndarray) -> bytes:
    return np.minimum(np.bincount((tokens >> _u(57)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap could reach the threshold, by counts in cells (full cells say nothing)."""
    least = np.minimum(a, b)
    bound = least.sum(-1, dtype=np.int64)
    bound = np.where((least == 255).any(-1), np.minimum(na, nb), bound)
    return (100 + percent) * bound >= percent * (na + nb)


def frequent_tokens(work: Workspace, texts: DataFrame, words: int, least: int = FREQUENT, table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, their counts): all tokens of ``least`` texts or more or, if more than ``table`` qualify, of so many more that at most ``table`` do.

    A task leaves out what it meets once in a batch, so counts are lower bounds.
    The bound is found from a histogram, so the driver never gets more than ``table`` rows.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for batch in batches:
            counted = [np.unique(np.concatenate([make.of(t) for t in _binary(part, "text")]), return_counts=True) for part in _parts(batch, "text")]
            tokens, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in counted]]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([np.zeros(0), *[c for _, c in counted]]), len(tokens)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    counted = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = work.save("tokens", counted)
    level = F.floor(F.log2("n") * 16).cast("int")
    left = table
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            counted = counted.where(level > r["level"])
            break
    found = counted.toArrow()
    tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    work.drop("tokens")
    return tokens[order], n[order]


@lru_cache(maxsize=256)
def _choices(n: int, k: int) -> np.ndarray:
    """All ways to choose ``k`` of ``n`` places, a row for each of the ``k``."""
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k).T


def _bands(n: int, percent: int) -> list[int]:
    """Bands of size in which a set of ``n`` is indexed: its own, and the one below if a partner may be there."""
    band = 0 if n < SMALL else n.bit_length() - 1
    low = 0 if band == 0 else max(SMALL, 1 << band)
    return [band, 0 if band == SMALL.bit_length() - 1 else band - 1] if band and least_overlap(n, percent) < low else [band]


def signatures(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, rank: np.ndarray, percent: int, least: int = FREQUENT, step: int = STEP) -> tuple[np.ndarray, int]:
    """(signature hashes, number of frequent tokens) of one set; ``rank`` orders the frequent tokens by count."""
    n = len(tokens)
    spare = n - least_overlap(n, percent)
    often = _is_in(tokens, frequent)
    n_often = int(often.sum())
    rare = tokens[~often]
    out = [spread(rare[: spare + 1])]  # the same in every band
    missing = spare + 1 - len(rare)
    if missing > 0:
        common = tokens[often]
        at = np.searchsorted(frequent, common)
        order = np.argsort(rank[at])
        common, level = common[order], counts[at][order]
        size = 2 + np.floor(np.log(np.maximum(level, least) / least) / np.log(step) + 1e-9).astype(np.int64)
        for band in _bands(n, percent):
            mixed = spread(common ^ spread(np.array([_C[2] * (band + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
            out += [mixed[:missing]] if band == 0 else _combined(mixed, common, size, missing, max(1, ((1 << band) - least_overlap(1 << band, percent)) // 3))
    return np.unique(np.concatenate(out)), n_often


def _combined(mixed: np.ndarray, common: np.ndarray, size: np.ndarray, missing: int, bins: int) -> list[np.ndarray]:
    """Hashes of the combinations within each class (``size``, bin) of the prefix that makes up for ``missing`` tokens."""
    held: dict[tuple[int, int], list[int]] = {}
    for i, (g, k) in enumerate(zip((spread(common) % _u(bins)).tolist(), size.tolist(), strict=True)):
        own = held.setdefault((k, g), [])
        own.append(i)
        if len(own) >= k:
            missing -= 1
            if missing == 0:
                break
    out = []
    for (k, _), own in held.items():
        if len(own) >= k:
            chosen = mixed[np.array(own)][_choices(len(own), k)]
            h = chosen[0]
            for x in chosen[1:]:
                h = spread(h * _u(_C[0]) + x)
            out.append(h)
    return out


def _indexed(texts: DataFrame, given, words: int, percent: int, least: int, step: int) -> DataFrame:
    """tid, n, often, cells, sigs of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        frequent, counts, rank = given.value
        for batch in (part for whole in batches for part in _parts(whole, "text")):
            n, often, boxes, flat, ends = [], [], [], [], [0]
            for t in _binary(batch, "text"):
                tokens = make.of(t)
                sigs, many = signatures(tokens, frequent, counts, rank, percent, least, step) if len(tokens) else (np.zeros(0, np.uint64), 0)
                n.append(len(tokens))
                often.append(many)
                boxes.append(cells(tokens))
                flat.append(sigs)
                ends.append(ends[-1] + len(sigs))
            sigs = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), pa.array(n, pa.int64()), pa.array(often, pa.int64()), pa.array(boxes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sigs))],
                names=["tid", "n", "often", "cells", "sigs"],
            )

    return texts.select("tid", "text").mapInArrow(run, "tid long, n long, often long, cells binary, sigs array<long>")


def _verified(work: Workspace, texts: DataFrame, pairs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, from the whole texts.

    Pairs of one ``a`` are cut into chunks by a hash of ``b``. A chunk gets one
    copy of a's text, sorted before the texts of its members, so that a task
    streams them and holds one set at a time.
    """
    pairs = work.save(f"{name}-pairs", pairs)
    needed = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    few = work.save(f"{name}-texts", texts.select("tid", "text").join(needed, "tid", "left_semi"))
    work.release()
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    chunked = work.save(f"{name}-chunks", pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_chunks").alias("chunk")))
    members = chunked.join(few, chunked["b"] == few["tid"]).select("a", "chunk", "b", "text")
    heads = chunked.select("a", "chunk").distinct().join(few, F.col("a") == F.col("tid")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(heads).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, x = Shingles(words), None
        for batch in batches:
            found = []
            for part in _parts(batch, "text"):
                for a, b, t in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), _binary(part, "text"), strict=True):
                    y = make.of(t)
                    if b is None:
                        x = y
                        continue
                    few, all_ = (x, y) if len(x) <= len(y) else (y, x)
                    if len(few) and (100 + percent) * int(_is_in(few, all_).sum()) >= percent * (len(x) + len(y)):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = work.save(f"{name}-links", dealt.mapInArrow(run, "a long, b long"))
    work.drop(f"{name}-pairs", f"{name}-texts", f"{name}-chunks")
    work.release()
    return links


def _close(na, nb, percent: int):
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _pass(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with na, nb, ca, cb that the cells don't rule out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("ca", "cb")]
            ok = _may_link(*boxes, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a long, b long")


def _lowest(lists: DataFrame) -> DataFrame:
    """tid, low: the ``LOW`` least signatures of each member, ascending."""
    return lists.groupBy("tid").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LOW).alias("low"))


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of at most ``LOW`` numbers, filled up with the greatest one."""
    rows = column.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    out = np.full((len(size), LOW), np.iinfo(np.int64).max)
    out[np.arange(LOW) < size[:, None]] = rows.flatten().to_numpy()
    return out


def _met_before(a: np.ndarray, b: np.ndarray, sig: int) -> np.ndarray:
    """Whether the rows of ``a`` and ``b`` share a number below ``sig``."""
    met = np.zeros(len(a), bool)
    for k in range(LOW):
        x = b[:, k : k + 1]
        if not (x < sig).any():
            break
        met |= ((a == x) & (x < sig)).any(1)
    return met


def _across(lists: DataFrame, parts: int, percent: int) -> DataFrame:
    """Pairs of members (sig, tid, n, cells, low, root, pivot, members) of one list in different components, block by block; hardly any twice."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("tid"), blocks).cast("int")
    spread_out = lists.select("*", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    spread_out = spread_out.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")})
    keyed = spread_out.select("sig", "i", "j", F.col("_own").alias("own"), "tid", "n", "cells", "low", "root", "pivot", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(parts)).alias("bucket"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sig", "ascending"), ("i", "ascending"), ("j", "ascending"), ("n", "ascending"), ("tid", "ascending")])
        sig, i, j, own, tid, n, root, pivot = (table.column(c).to_numpy() for c in ("sig", "i", "j", "own", "tid", "n", "root", "pivot"))
        boxes = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        low = _padded(table.column("low"))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.append(np.flatnonzero(new), len(sig))
        found = [np.zeros((0, 2), np.int64)]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for x in range(s, e, SIDE):  # ascending by size: a member's partners follow it, up to the size that still may link
                top = min(x + SIDE, e)
                last = int(np.searchsorted(n[s:e] * percent, n[top - 1] * 100, side="right")) + s
                for y in range(x, last, SIDE):
                    u, v = np.arange(x, top)[:, None], np.arange(y, min(y + SIDE, last))[None, :]
                    ok = (u < v) & (root[u] != root[v]) & (n[u] * 100 >= n[v] * percent) & (tid[u] != pivot[s]) & (tid[v] != pivot[s])
                    if i[s] != j[s]:
                        ok &= own[u] != own[v]
                    p, q = np.nonzero(ok)
                    p, q = p + x, q + y
                    for k in range(0, len(p), 20_000):
                        a, b = p[k : k + 20_000], q[k : k + 20_000]
                        may = _may_link(boxes[a], boxes[b], n[a], n[b], percent)
                        a, b = a[may], b[may]
                        new_here = ~_met_before(low[a], low[b], sig[s])
                        found.append(np.sort(np.stack([tid[a[new_here]], tid[b[new_here]]], 1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.groupBy("bucket").applyInArrow(run, "a long, b long")


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _text_keys(text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), _body(text)), F.xxhash64(F.lit(2), _body(text))


def _once(docs: DataFrame, text: str, first: Column) -> DataFrame:
    """t1, t2, text, first: a row for each distinct text."""
    t1, t2 = _text_keys(text)
    rows = docs.select(t1.alias("t1"), t2.alias("t2"), _body(text).alias("text"), first.alias("first"))
    return rows.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.min("first").alias("first"))


def _text_groups(work: Workspace, docs: DataFrame, text: str, first: Column, words: int, percent: int, least: int, step: int) -> DataFrame:
    """Distinct texts and their groups: t1, t2, tid, first, n, root.

    ``first`` is the least value of that column among the rows of a text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = work.save("texts", _once(docs, text, first).withColumn("tid", F.monotonically_increasing_id()))
    work.release()
    frequent, counts = frequent_tokens(work, texts, words, least)
    rank = np.empty(len(frequent), np.int64)
    rank[np.lexsort((frequent, counts))] = np.arange(len(frequent))
    given = spark.sparkContext.broadcast((frequent, counts, rank))
    index = work.save("index", _indexed(texts, given, words, percent, least, step))
    work.release()
    # Nine signatures of ten stand alone: they are counted bare, and only the others carry anything on.
    entries = index.select(F.explode("sigs").alias("sig"), "tid", "n", "often")
    again = work.save("again", entries.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1"))
    work.release()
    entries = work.save("entries", entries.join(again, "sig"))
    index = work.save("sizes", index.select("tid", "n", "cells"))
    work.drop("again", "index")
    work.release()
    heads = entries.groupBy("sig").agg(F.max(F.struct("often", "n", "tid")).alias("head")).select("sig", F.col("head.tid").alias("pivot"), F.col("head.n").alias("pn"))
    lists = work.save("lists", entries.drop("often").join(heads, "sig"))
    work.drop("entries")
    work.release()
    boxes = index.select("tid", "cells")
    stars = lists.where((F.col("tid") != F.col("pivot")) & _close(F.col("n"), F.col("pn"), percent)).select(F.col("pivot").alias("a"), F.col("tid").alias("b"), F.col("pn").alias("na"), F.col("n").alias("nb")).distinct()
    stars = stars.join(boxes.toDF("a", "ca"), "a").join(boxes.toDF("b", "cb"), "b")
    near = _verified(work, texts, _pass(stars, percent), words, percent, "near")
    roots = components(work, near, "first")
    placed = lists.where("members > 2").join(roots.toDF("tid", "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("sig")
    placed = work.save("mixed", placed.join(mixed, "sig", "left_semi"))
    work.release()
    rest = _across(placed.join(boxes.join(_lowest(placed), "tid"), "tid"), 4 * parts, percent).distinct()
    far = _verified(work, texts, rest, words, percent, "far")
    roots = components(work, near.unionByName(far), "all")
    found = texts.select("t1", "t2", "tid", "first").join(index.select("tid", "n"), "tid").join(roots.toDF("tid", "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    found = work.save("found", found)
    work.drop("texts", "lists", "mixed", "sizes", "near-links", "far-links")
    work.release()
    return found


def text_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, percent: int = 90, least: int = FREQUENT, step: int = STEP) -> DataFrame:
    """``docs`` plus n_shingles and component_id; ``percent`` is 50 to 100.

    Null texts and texts without words have no shingles and link with nothing,
    so each is its own component. Equal texts link with each other, and are
    compared with others once. Rows without id take part, but name no component.
    An empty table gives an empty result; columns named like results are replaced.
    ``least`` and ``step`` bound the classes of frequent tokens, which move no result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    made = ("n_shingles", "component_id")
    keep = [c for c in docs.columns if c not in made]
    work = Workspace(docs.sparkSession, "shingles")
    found = _text_groups(work, docs, text, F.col(doc_id).cast("long"), words, percent, least, step)
    ids = found.groupBy("root").agg(F.min("first").alias("component"))
    named = found.join(ids, "root").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("n").alias("n_shingles"), "component")
    t1, t2 = _text_keys(text)
    rows = docs.select(*keep, t1.alias("_a"), t2.alias("_b")).join(named, (F.col("_a") == F.col("_t1")) & (F.col("_b") == F.col("_t2")))
    own = F.when(F.col("n_shingles") == 0, F.col(doc_id)).otherwise(F.col("component"))
    return rows.select(*keep, "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80, least: int = FREQUENT, step: int = STEP) -> DataFrame:
    """One row of each component of ``docs``: of the row with the least id (null last), then the least other values.

    A text without words links with nothing, so its rows all stay. Rows of
    different components stay whatever ids they repeat. Other columns must be
    of types that can be ordered. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in (text, doc_id)]
    work = Workspace(docs.sparkSession, "one")
    bare = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    first = F.struct(F.col(doc_id).isNull().alias("_lacks"), F.col(doc_id).alias("_id"), *[F.col(c) for c in others])
    found = _text_groups(work, docs.where(~bare), text, first, words, percent, least, step)
    # Texts that the component's best one stands for; few against all. Texts are read once more: nothing large is left behind.
    best = found.groupBy("root").agg(F.min(F.struct("first", "t1", "t2", "tid")).alias("best")).select(F.col("best.tid").alias("tid"))
    gone = work.save("gone", found.select("t1", "t2", "tid").join(best, "tid", "left_anti").select("t1", "t2"))
    work.drop("found")
    kept = _once(docs.where(~bare), text, first).join(gone, ["t1", "t2"], "left_anti")
    fields = {doc_id: F.col("first._id"), text: F.col("text"), **{c: F.col(f"first.`{c}`") for c in others}}
    return kept.select(*[fields[c].alias(c) for c in docs.columns]).unionByName(docs.where(bare))


def document_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, at a similarity of 0.9 of 3-word shingles."""
    return text_components(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
