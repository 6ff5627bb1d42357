"""Media columns: content-addressed payloads in tar shards, metadata by range reads.

Writing: every task packs its rows' payloads as 8-bit grey PNG files into a tar
shard of its own in the shared folder and returns one index row per input row
(digest, shard, offset, length). A payload is stored once per shard under its
digest, however many rows of the task carry it, and no payload is shuffled. A
shard belongs to one attempt of one task; an attempt that dies leaves a file
that no index row names.

Reading: ``read_headers`` fetches the first 33 bytes at a row's offset, which
hold the image size, and nothing else; ``read_payloads`` fetches the stored
bytes, verifies their digest, unpacks the samples and computes features.
Shards are opened through ``pyarrow.fs``, so the folder may be any store that
it knows by URI.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.plans.workspace import Workspace, tidy

SIDE = 576  # samples in a row of the image; payloads are padded to whole rows
FILLER = b"\xff"
SHARD_BYTES = 256 << 20  # a task starts another shard beyond this
HEADER_BYTES = 33  # PNG signature and IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format
INDEX = "n_bytes long, media_sha256 string, media_bytes long, shard string, offset long"
_KNOWN_ROWS = 65536  # results remembered per task for rows that share a payload


def padded(data: bytes) -> bytes:
    """``data`` filled with bytes 255 up to a positive multiple of ``SIDE``."""
    rows = max(1, -(-len(data) // SIDE))
    return data + FILLER * (rows * SIDE - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """An 8-bit grey image of ``SIDE`` samples a row; unfiltered rows, so samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    lines = np.zeros((len(rows), SIDE + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first bytes of an image."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(media)
    at, packed = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def sample_features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and shares of 8 equal ranges of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    at = np.arange(256)
    mean = float((p * at).sum())
    dev = float(np.sqrt((p * (at - mean) ** 2).sum()))
    used = p[p > 0]
    bands = "-".join(str(int(round(1000 * x))) for x in p.reshape(8, 32).sum(1))
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(used * np.log2(used)).sum()):.4f};bands={bands}"


class _Shards:
    """The tar files of one task."""

    def __init__(self, root: str, limit: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.limit, self.out, self.at, self.known, self.name = limit, None, 0, {}, ""

    def add(self, digest: str, media: bytes) -> tuple[str, int]:
        if digest in self.known:
            return self.known[digest]
        if self.out is None or self.at + len(media) + 2048 > self.limit and self.at:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.dir}/{self.name}")
        entry = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        entry.size = len(media)
        head = entry.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + bytes(-len(media) % 512))
        where = self.name, self.at + len(head)
        self.at += len(head) + len(media) + -len(media) % 512
        self.known[digest] = where
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
        self.out, self.known = None, {}


def pack_media(rows: DataFrame, payload: str, root: str, form: Callable[[bytes], bytes] = lambda data: to_png(padded(data)), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Index of ``rows``: their columns but ``payload`` (binary, null as empty), then those of ``INDEX``.

    Lazy: write the result once (see ``Workspace``) before using it, as each run
    of the plan writes new shards under ``root``. Clashing columns are replaced.
    """
    made = [f.split()[0] for f in INDEX.split(", ")]
    keep = [c for c in rows.columns if c not in (*made, payload)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [INDEX])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(root, shard_bytes)
        by_text: dict[bytes, tuple] = {}
        for batch in batches:
            found = []
            for data in batch.column(payload).to_pylist():
                data = data or b""
                key = hashlib.blake2b(data, digest_size=20).digest()
                if key not in by_text:
                    media = form(data)
                    digest = hashlib.sha256(media).hexdigest()
                    if len(by_text) >= _KNOWN_ROWS:
                        by_text.clear()
                    by_text[key] = (len(data), digest, len(media), *shards.add(digest, media))
                found.append(by_text[key])
            n, digest, size, shard, at = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(shard, pa.string()), pa.array(at, pa.int64())],
                names=[*keep, *made],
            )
        shards.close()

    return rows.mapInArrow(run, schema)


def _reading(index: DataFrame, root: str, made: str, read: Callable) -> DataFrame:
    """``index`` plus columns ``made`` that ``read(file, offset, length, digest)`` returns, once for rows of one payload in turn."""
    names = [f.split()[0] for f in made.split(", ")]
    keep = [c for c in index.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in index.select(*keep).schema] + [made])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        name, file, known = None, None, {}
        for batch in batches:
            found = []
            for shard, at, size, digest in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes", "media_sha256")], strict=True):
                if digest not in known:
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, store.open_input_file(f"{folder}/{shard}")
                    if len(known) >= _KNOWN_ROWS:
                        known.clear()
                    known[digest] = read(file, at, size, digest)
                found.append(known[digest])
            columns = zip(*found, strict=True) if found else ((),) * len(names)
            types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in made.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*keep, *names])
        if file is not None:
            file.close()

    return index.mapInArrow(run, schema)


def read_headers(index: DataFrame, root: str) -> DataFrame:
    """``index`` plus width, height and bits, from ``HEADER_BYTES`` bytes a payload."""
    return _reading(index, root, "width int, height int, bits int", lambda file, at, size, digest: png_header(file.read_at(HEADER_BYTES, at)))


def read_payloads(index: DataFrame, root: str) -> DataFrame:
    """``index`` plus payload_bytes, payload_sha256, tail_crc32 and feature of the samples read back."""

    def read(file, at, size, digest):
        media = file.read_at(size, at)
        if hashlib.sha256(media).hexdigest() != digest:
            raise OSError(f"{digest} reads back damaged")
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sample_features(payload)

    return _reading(index, root, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", read)


def one_place(work: Workspace, index: DataFrame) -> DataFrame:
    """``index`` with one shard and offset for each digest, whichever tasks stored it; other copies stay unnamed.

    Places are chosen on (digest, shard, offset) alone, combined before the
    shuffle, so a payload that many rows carry is no hot key and none is moved.
    """
    places = work.save("places", index.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset")).alias("_at"), F.min("shard").alias("_lo"), F.max("shard").alias("_hi")).where("_lo <> _hi").select(F.col("media_sha256").alias("_digest"), "_at"))
    moved = index.join(places, index["media_sha256"] == places["_digest"], "left")
    keep = [c for c in index.columns if c not in ("shard", "offset")]
    named = moved.select(*keep, F.coalesce("_at.shard", "shard").alias("shard"), F.coalesce("_at.offset", "offset").alias("offset"))
    # Ranges of places, so that a task reads a shard from front to back; a payload of many rows is spread by their hash.
    return named.repartitionByRange("shard", "offset", F.xxhash64(*keep)).sortWithinPartitions("shard", "offset")


def text_media(docs: DataFrame) -> DataFrame:
    """Every document's text stored as an image and read back, one row per row of ``docs``.

    ``shard`` and ``offset`` are where the stored form lies in the work folder.
    Null texts are stored as empty ones (one row of filler), repeated rows and
    equal texts get equal values, an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "media")
    root = work.path("shards")
    index = work.save("index", pack_media(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")), "payload", root))
    placed = work.save("placed", one_place(work, index))
    read = read_payloads(read_headers(placed, root), root)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset")
