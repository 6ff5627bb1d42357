"""A corpus pipeline of five stages; each takes all that the one before kept and returns rows of ``documents``.

The last stage returns piece ids instead, and what they decode to as a digest. ``run`` writes every stage as Parquet
in the folder that the cluster shares and reads it back as the next one's input.
Every stage takes an empty table to an empty one and leaves out columns that
documents don't have, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.language import UNDETERMINED, document_languages
from tarnfield.llm.mixing import fair_mix
from tarnfield.llm.shingle_join import one_of_each
from tarnfield.llm.superkmers import drop_repeats
from tarnfield.llm.wfst import MODEL, encode_texts, read_model
from tarnfield.plans.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_PERCENT = 5, 80  # near duplicates: shingles of five words, similarity 0.8 or more


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence determines, with that language; the others go.

    A null, empty or letterless text goes, whatever else is null; repeated rows
    are judged alike and all stay; a tie goes to the first language by name.
    """
    found = document_languages(docs.select(*COLUMNS)).where(F.col("lang_id") != UNDETERMINED)
    return found.select("doc_id", "text", F.col("lang_id").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null last, then the least other values.

    Unlike documents stay even if they repeat an id; repeated rows are near copies of each other, also without ids.
    """
    return one_of_each(docs.select(*COLUMNS), words=NEAR_WORDS, percent=NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover; documents with nothing left go, untouched ones keep their exact text.

    Texts of under 35 words, empty and null ones included, stay as they are;
    rows that repeat each other cover each other whole, and go.
    """
    cut = drop_repeats(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    touched = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(touched, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(touched, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all.

    A null source is a source of its own; documents without words are never
    taken; repeated rows are documents of their own.
    """
    mixed = fair_mix(docs.select(*COLUMNS), with_text=True).where(F.col("taken") > 0)
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.withColumn("_time", F.explode(times)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number, decoded_sha256 and round_trip: whether the ids give the text again (U+2581 reads back as a space).

    Null and empty texts have no ids and decode to an empty one; every row stays.
    """
    pieces = encode_texts(docs.select("doc_id", "lang", "source", "text"), read_model(MODEL), decoded=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return pieces.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Trigram models, piece machines and graph components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.save(name, stage(spark, docs, sf_dir))
        if before:
            work.drop(before)
        work.release()
        before = name
    return docs
