"""Lexical index as tables: postings, term statistics, chunk lengths; and its manifest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.text import col, token_list
from tarnfield.plans.workspace import Workspace, ship
from tarnfield.settings import Settings
from tarnfield.sources.cache import exists

LEXICAL, STORE = ("postings", "terms", "lengths", "sizes"), ("chunks", "vectors", "manifest")


class IndexNotBuilt(Exception):
    """Tables of the index are missing from its folder."""


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # id, term, tf, dl (tokens of the row)
    terms: DataFrame  # term, df, idf
    lengths: DataFrame  # id, dl
    n: int
    mean_length: float


def term_counts(rows: DataFrame, key: str, text: Column | str) -> DataFrame:
    """id, term, tf, dl; ``key`` is unique, so that a row's terms are counted where the row is, without a shuffle."""
    ship(rows.sparkSession)
    given = rows.select(F.col(key).alias("id"), col(text).alias("text"))
    kind = dict(given.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, terms, tf, dl = [], [], [], []
            for i, t in enumerate(batch.column("text")):
                found = token_list(t.as_py())
                counted = Counter(found)
                owner += [i] * len(counted)
                terms += counted.keys()
                tf += counted.values()
                dl += [len(found)] * len(counted)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], names=["id", "term", "tf", "dl"])

    return given.mapInArrow(run, f"id {kind}, term string, tf long, dl long")


def term_stats(postings: DataFrame, n: int, epsilon: float = 0.25) -> DataFrame:
    """term, df and idf ``ln(n - df + .5) - ln(df + .5)``; a negative one is ``epsilon`` times the mean over all terms."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


def build_index(rows: DataFrame, key: str, text: Column | str, settings: Settings = Settings(), folder: str | None = None) -> LexicalIndex:
    """Tokenises once and keeps the tables in ``folder``, or else the shared scratch folder; ``key`` must be unique and not null."""
    spark, work = rows.sparkSession, Workspace(rows.sparkSession, "index")
    if folder:
        work.root = folder.rstrip("/")
    postings = work.save("postings", term_counts(rows, key, text))
    known = postings.groupBy("id").agg(F.first("dl").alias("dl"))
    lengths = work.save("lengths", rows.select(F.col(key).alias("id")).join(known, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl")))
    size = work.save("sizes", lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))).first()
    work.save("terms", term_stats(postings, size["n"], settings.epsilon))
    return open_lexical(spark, work.root)


def open_lexical(spark: SparkSession, folder: str) -> LexicalIndex:
    """The lexical index that ``build_index`` left in a folder."""
    if not exists(spark, folder, *LEXICAL):
        raise IndexNotBuilt(folder)
    postings, terms, lengths, sizes = (spark.read.parquet(f"{folder}/{n}") for n in LEXICAL)
    size = sizes.first()
    return LexicalIndex(postings, terms, lengths, size["n"], size["mean"] or 1.0)


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``built`` true, or one row with ``built`` false."""
    if not exists(spark, folder, *LEXICAL, *STORE):
        return spark.createDataFrame([(False, "index not built")], "built boolean, message string")
    return spark.read.parquet(f"{folder}/manifest").select(F.lit(True).alias("built"), "*")


def manifest(chunks: DataFrame, **facts) -> DataFrame:
    """Counts of a chunk table (path, book, figures), with facts of the build as constant columns."""
    figures = chunks.select(F.explode("figures").alias("f")).agg(F.countDistinct("f.src").alias("n_figures"))
    counts = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_pages"), F.countDistinct(F.when(F.col("book") != "", F.col("book"))).alias("n_books"))
    return counts.crossJoin(figures).select("*", *[F.lit(v).alias(k) for k, v in facts.items()])
