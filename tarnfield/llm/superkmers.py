"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least of its runs
of ``minimiser`` words in a fixed order, so equal windows have equal minimisers.
Consecutive windows that share a minimiser overlap, and travel as one packed
string (a super-k-mer) to the bucket of the minimiser, where sorting brings
equal windows together; equal hashes are compared word by word, so the counts
are exact.

Hot passages. The order of word runs puts those that are frequent in the corpus
last, so a window takes a frequent minimiser only if all its runs are frequent,
which is so only inside text that itself repeats. Such windows are equal across
documents and collapse before the shuffle: a string that a task holds twice is
known to repeat, is resolved there, and goes to its bucket once, without
references; what is resolved needs no bucket and is dealt out evenly. So a
bucket gets at most one such string from each task and flush. The table of
frequent runs has a fixed size, whatever the corpus.

Exact text equality is decided on words; rows are told apart by a 128-bit hash
of the whole row, so null or repeated ids do no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.plans.workspace import Workspace, tidy

WINDOW, MINIMISER = 35, 3
LONGEST_RUN = 256  # windows in one packed string
FLUSH_BYTES = 32 << 20  # packed strings a task holds before it sends them
PART_BYTES = 3 << 20  # text that is held as words at once
BUCKET_BYTES = 2_400_000  # text a bucket stands for, at most about
FREQUENT_RUNS = 1 << 20  # word runs that are told to all tasks, 8 bytes each; where more are frequent, these are the most frequent
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)  # odd 64-bit multipliers
_VOCABULARY = 300_000


class _Hashes(dict):
    """64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> _u(30))) * _u(_MIX[2])
    x = (x ^ (x >> _u(27))) * _u(_MIX[1])
    return x ^ (x >> _u(31))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` values, by doubling; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    whole, size, power = None, 0, _u(_MIX[0])
    part, width = h.astype(np.uint64), 1
    while True:
        if n & width:
            if whole is None:
                whole, size = part, width
            else:  # the wider part stands in front
                m = len(h) - size - width + 1
                whole = part[:m] * _power(_u(_MIX[0]), size) + whole[width : width + m]
                size += width
        if width * 2 > n:
            return spread(whole[: len(h) - n + 1])
        part = part[: len(part) - width] * power + part[width:]
        power, width = _power(power, 2), width * 2


def _power(x: np.uint64, n: int) -> np.uint64:
    return _u(pow(int(x), n, 1 << 64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in turn, by doubling."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _hashed(texts: list[bytes], seen: _Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts in turn, their hashes, and where each text's words end."""
    words, ends = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        ends[i] = len(words)
    return words, np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)), ends


def _window_starts(ends: np.ndarray, window: int) -> np.ndarray:
    """Positions at which a whole window of one text starts, and no other."""
    n = int(ends[-1]) if len(ends) else 0
    ok = np.ones(n, bool)
    for k in range(1, window):
        at = ends - k
        ok[at[at >= 0]] = False
    return np.flatnonzero(ok)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _parts(batch: pa.RecordBatch, name: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (else ``PART_BYTES``), or one row."""
    most = most or PART_BYTES
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def frequent_runs(work: Workspace, rows: DataFrame, buckets: int, total: int, minimiser: int = MINIMISER, most: int = FREQUENT_RUNS, part_bytes: int = PART_BYTES) -> np.ndarray:
    """Hashes of word runs in a tenth of a bucket's share of ``total`` places or more, sorted; if over ``most`` are, of those in so many more that at most ``most`` are left."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for batch in batches:
            counted = [np.unique(rolled(_hashed(_binary(part, "_text"), seen)[1], minimiser), return_counts=True) for part in _parts(batch, "_text", part_bytes)]
            runs, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *[r for r, _ in counted]]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([np.zeros(0), *[c for _, c in counted]]), len(runs)).astype(np.int64)
            often = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(runs[often].view(np.int64)), pa.array(n[often])], names=["run", "n"])

    counted = rows.select("_text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    counted = work.save("runs", counted.where(F.col("n") >= max(50, total // (10 * buckets))))
    level = F.floor(F.log2("n") * 16).cast("int")
    left = most
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            counted = counted.where(level > r["level"])
            break
    found = np.sort(counted.select("run").toArrow().column("run").to_numpy().view(np.uint64))
    work.drop("runs")
    return found


def _is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


class _Sender:
    """Packed strings of one task, by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.strings: dict[bytes, list] = {}
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, string: bytes, ref: tuple) -> None:
        """``ref``: bucket, k1, k2, start, windows."""
        got = self.strings.get(string)
        if got is None:
            self.strings[string] = [ref]
            self.size += len(string) + 400
        else:
            got.append(ref)

    def flush(self) -> Iterator[tuple]:
        """Rows (bucket, k1, k2, start, end, blob): strings for a bucket, or what is known to repeat."""
        by: dict[int, list] = {}
        for string, refs in self.strings.items():
            by.setdefault(refs[0][0], []).append((string, refs))
        for bucket, held in by.items():
            for _, refs in held:
                if len(refs) > 1:
                    # These need no bucket: any spreads them.
                    yield from (((k1 ^ start) % self.buckets, k1, k2, start, start + n + WINDOW - 1, None) for _, k1, k2, start, n in refs)
            meta = np.array([(r[0][1], r[0][2], r[0][3], r[0][4], len(r) > 1) for _, r in held], np.int64)
            body = meta.tobytes() + b"\n".join(s for s, _ in held)
            yield bucket, None, None, None, None, struct.pack("<I", len(held)) + self.zip.compress(body)
        self.strings, self.size = {}, 0


_SENT = pa.schema([("bucket", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("blob", pa.binary())])
_RANGES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(rows: DataFrame, frequent, buckets: int, flush_bytes: int, part_bytes: int) -> DataFrame:
    """Super-k-mers of all rows, as blobs for buckets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sender, often = _Hashes(), _Sender(buckets), frequent.value
        top = _u(1 << 63)
        for batch in (part for whole in batches for part in _parts(whole, "_text", part_bytes)):
            words, h, ends = _hashed(_binary(batch, "_text"), seen)
            starts = _window_starts(ends, WINDOW)
            if len(starts):
                runs = rolled(h, MINIMISER)
                runs = (runs >> _u(1)) | (_is_in(runs, often).astype(np.uint64) * top)  # frequent ones come last
                least = sliding_min(runs, WINDOW - MINIMISER + 1)[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(starts)))
                if size.max() > LONGEST_RUN:
                    first, size = _halved(first, size)
                doc = np.searchsorted(ends, starts[first], side="right")
                begin = np.where(doc > 0, ends[doc - 1], 0)
                to = (spread(least[first]) % _u(buckets)).astype(np.int64).tolist()
                k1, k2 = batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist()
                for s, n, d, b, bucket in zip(starts[first].tolist(), size.tolist(), doc.tolist(), begin.tolist(), to, strict=True):
                    sender.add(b" ".join(words[s : s + n + WINDOW - 1]), (bucket, k1[d], k2[d], s - b, n))
            if sender.size >= flush_bytes:
                yield from _in_parts(sender.flush())
        yield from _in_parts(sender.flush())

    return rows.mapInArrow(run, "bucket int, k1 long, k2 long, start long, end long, blob binary")


def _halved(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at most LONGEST_RUN windows."""
    out = [(f + at, min(LONGEST_RUN, n - at)) for f, n in zip(first.tolist(), size.tolist(), strict=True) for at in range(0, n, LONGEST_RUN)]
    return tuple(np.array(out, np.int64).T)


def _in_parts(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    size = 0
    for r in rows:
        part.append(r)
        size += 48 + len(r[-1] or b"")
        if size > 8 << 20:
            yield _rows(part, _SENT)
            part, size = [], 0
    if part:
        yield _rows(part, _SENT)


def _counted(table: pa.Table) -> pa.Table:
    """The repeated ranges of one bucket."""
    blobs = [b for b in table.column("blob").to_pylist() if b is not None]
    known = table.filter(pc.is_null(table.column("blob"))).select(_RANGES.names).cast(_RANGES)
    if not blobs:
        return known
    metas, bodies = [], []
    unzip = zstandard.ZstdDecompressor()
    for b in blobs:
        (n,) = struct.unpack("<I", b[:4])
        raw = unzip.decompress(b[4:])
        metas.append(np.frombuffer(raw[: n * 40], np.int64).reshape(n, 5))
        bodies.append(raw[n * 40 :])
    meta = np.concatenate(metas)
    words = b"\n".join(bodies).split()
    del bodies
    ends = np.cumsum(meta[:, 3] + WINDOW - 1)
    starts = _window_starts(ends, WINDOW)
    owner = np.repeat(np.arange(len(meta)), meta[:, 3])
    h = rolled(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), WINDOW)[starts]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~same)])
    lead = order[np.concatenate([[0], np.flatnonzero(~same) + 1])][group]  # the group's first window
    tied = np.flatnonzero(order != lead)
    wrong = [i for i, a, b in zip(tied.tolist(), starts[order[tied]].tolist(), starts[lead[tied]].tolist(), strict=True) if words[a : a + WINDOW] != words[b : b + WINDOW]]
    weight = np.bincount(group, 1 + meta[owner[order], 4])
    again = np.zeros(len(starts), bool)
    again[order] = weight[group] > 1
    for g in np.unique(group[wrong]):  # different windows of one hash: compare all of that hash
        inside = order[group == g]
        by: dict[tuple, list[int]] = {}
        for w in inside.tolist():
            by.setdefault(tuple(words[starts[w] : starts[w] + WINDOW]), []).append(w)
        for at in by.values():
            again[at] = sum(1 + meta[owner[w], 4] for w in at) > 1
    again &= meta[owner, 4] == 0  # the others are known already
    hit = np.flatnonzero(again)
    if not len(hit):
        return known
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(hit)) - 1
    own = owner[hit[a]]
    base = meta[own, 2] - (np.cumsum(meta[:, 3]) - meta[:, 3])[own]
    found = pa.table([meta[own, 0], meta[own, 1], base + hit[a], base + hit[b] + WINDOW], schema=_RANGES)
    return pa.concat_tables([known, found])


def repeated_ranges(work: Workspace, rows: DataFrame, flush_bytes: int = FLUSH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """k1, k2, start, end: words of rows (``_k1``, ``_k2``, ``_text``) inside windows that start anywhere else too; ranges may overlap."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(4 * parts, size // BUCKET_BYTES + 1)
    frequent = spark.sparkContext.broadcast(frequent_runs(work, rows, buckets, size // 6, part_bytes=part_bytes))
    sent = _cut(rows, frequent, buckets, flush_bytes, part_bytes)
    return sent.groupBy("bucket").applyInArrow(_counted, "k1 long, k2 long, start long, end long")


def drop_repeats(docs: DataFrame, text: str = "text", flush_bytes: int = FLUSH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` plus n_words, n_removed and kept (the words left, joined by one space).

    A null text has no words; a text of fewer than ``WINDOW`` words keeps all.
    Repeated rows repeat each other, so they lose every word that a window
    covers. An empty table gives an empty result; columns named like results
    are replaced. ``flush_bytes`` and ``part_bytes`` bound what a task holds and move no result.
    """
    made = ("n_words", "n_removed", "kept")
    keep = [c for c in docs.columns if c not in made]
    work = Workspace(docs.sparkSession, "repeats")
    every = [F.col(c) for c in keep if not docs.schema[c].dataType.simpleString().startswith("map")]
    keyed = docs.select(*keep, F.xxhash64(F.lit(1), *every).alias("_k1"), F.xxhash64(F.lit(2), *every).alias("_k2"))
    found = repeated_ranges(work, keyed.select("_k1", "_k2", F.coalesce(F.col(text), F.lit("")).alias("_text")), flush_bytes, part_bytes)
    ranges = work.save("ranges", found)
    work.release()
    per_row = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    joined = keyed.join(per_row, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").drop("k1", "k2", "_k1", "_k2")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["n_words long", "n_removed long", "kept string"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, rs in zip(_binary(batch, text), batch.column("_ranges").to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if rs:
                    at, out = 0, []
                    for a, b in sorted((r["start"], r["end"]) for r in rs):
                        if a > at:
                            out += words[at:a]
                        at = max(at, b)
                    words = out + words[at:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*keep, *made])

    return joined.mapInArrow(run, schema)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    out = drop_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
