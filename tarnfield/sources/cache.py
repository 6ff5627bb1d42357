"""Pages and images from a file cache and an injectable fetcher; tables of a built index."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlparse
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.plans.workspace import ship
from tarnfield.functions.text import image_path, quoted_path
from tarnfield.schemas import DOCS, FETCH

Fetch = Callable[[str], tuple[int, bytes]]
TRIES = 3


def http_fetch(base_url: str, timeout: float = 30.0, agent: str = "tarnfield") -> Fetch:
    """A fetcher of paths below ``base_url`` (or whole addresses) by HTTP; an error status is returned, other failures raise."""

    def fetch(path: str) -> tuple[int, bytes]:
        url = path if "://" in path else f"{base_url.rstrip('/')}/{path.lstrip('/')}"
        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return answer.status, answer.read()
        except HTTPError as e:
            return e.code, b""

    return fetch


def cached(spark: SparkSession, folder: str, glob: str = "*.*html") -> DataFrame:
    """path (below ``folder``) and html of every non-empty cached file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).where("length > 0")
    root = folder.split("://")[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), F.decode("content", "UTF-8").alias("html"))


def to_fetch(paths: DataFrame, have: DataFrame, force: bool = False) -> DataFrame:
    """Paths that aren't cached."""
    return paths.select("path").distinct() if force else paths.select("path").distinct().join(have.select("path"), "path", "left_anti")


def fetched(paths: DataFrame, fetch: Fetch, tasks: int = 8, pause: float = 0.5) -> DataFrame:
    """``FETCH`` columns plus content, by ``tasks`` tasks; missing pages fail at once, other failures are tried again."""
    ship(paths.sparkSession)

    def one(path: str) -> tuple:
        status, error = None, None
        for n in range(TRIES):
            try:
                status, body = fetch(path)
                if status == 200:
                    return path, True, False, 200, None, body
                error = f"HTTP {status}"
                if status == 404:
                    break
            except Exception as e:  # a plug-in's failures become the row's error
                error = f"{type(e).__name__}: {e}"
            if n + 1 < TRIES:
                time.sleep(2**n * pause + random.uniform(0, 0.3) * (pause > 0))
        return path, False, False, status, error, None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(p) for p in part["path"]], columns=["path", "ok", "from_cache", "status", "error", "content"])

    return paths.select("path").repartition(tasks).mapInPandas(run, FETCH + ", content binary")


def read_through(paths: DataFrame, have: DataFrame, fetch: Fetch, force: bool = False) -> DataFrame:
    """path, html of what is cached, or fetched where it isn't."""
    new = fetched(to_fetch(paths, have, force), fetch).where("ok").select("path", F.decode("content", "UTF-8").alias("_new"))
    return paths.select("path").distinct().join(have, "path", "left").join(new, "path", "left").select("path", F.coalesce("_new", "html").alias("html")).where("html is not null")


def is_below(url: str, base: str) -> bool:
    """Whether a live address is on the base's host and under its path, segment by segment."""
    u, b = urlparse(url), urlparse(base)
    own, root = u.path.split("/"), b.path.rstrip("/").split("/")
    return u.scheme in ("http", "https") and u.netloc == b.netloc and own[: len(root)] == root and ".." not in own


def images(figures: DataFrame, have: DataFrame, fetch: Fetch, force: bool = False, tasks: int = 8, pause: float = 0.4) -> DataFrame:
    """Fetch log of the distinct sources of ``figures`` (src) that aren't among the names in ``have`` (path), plus ``name``, the file in the flat image folder."""
    wanted = figures.where("src <> ''").groupBy(image_path("src").alias("name")).agg(F.min(quoted_path("src")).alias("url"))
    missing = wanted if force else wanted.join(have.select(image_path("path").alias("name")).distinct(), "name", "left_anti")
    log = fetched(missing.select(F.col("url").alias("path")), fetch, tasks, pause)
    return log.join(missing, log["path"] == missing["url"]).drop("url")


def write_corpus(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines corpus; a malformed line fails."""
    return spark.read.schema(DOCS).json(path, mode="FAILFAST")


def write_tables(folder: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_knowledge(folder: str, pages: DataFrame, **others: DataFrame) -> None:
    """The page index as one sorted JSON-lines file, contents and names beside it as they are."""
    pages.coalesce(1).sortWithinPartitions("order", "path").write.mode("overwrite").json(f"{folder}/pages")
    for name, table in others.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")


def exists(spark: SparkSession, folder: str, *names: str) -> bool:
    """Whether all the tables have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS") for n in names]
    return all(p.getFileSystem(conf).exists(p) for p in at)


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the index; empty if it wasn't written."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if exists(spark, folder, name) else spark.createDataFrame([], schema)
