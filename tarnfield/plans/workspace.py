"""Scratch tables in the folder that the driver and all executors share.

An operator that needs a result more than once writes it here as Parquet and
reads it back: that cuts the lineage, so losing an executor never recomputes
more than one stage, and each stage starts from a plain columnar scan.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="tarnfield-code-")) / "tarnfield_code.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(package.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tarnfield-")
    return _own[app]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives its memory back when its task ends: workers live on, for other steps too."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return tidied


class Workspace:
    """One operator's scratch folder; ``drop`` what later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_dir(spark)}/tarnfield-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` now and return a scan of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of finished steps now rather than at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
