"""Queries of the operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfield.llm.kd_shards import text_shards
from tarnfield.llm.language import page_languages
from tarnfield.llm.licences import LICENSE_SQL, document_licenses
from tarnfield.llm.media import text_media
from tarnfield.llm.mixing import MIX_SQL, mixed_documents
from tarnfield.llm.pivots import near_embeddings
from tarnfield.llm.shingle_join import document_components
from tarnfield.llm.superkmers import deduplicated_documents
from tarnfield.llm.toxicity import document_toxicity
from tarnfield.llm.wfst import document_pieces
from tarnfield.plans.workspace import tables


def _over(table: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": _over("documents", text_media),
        "op2_kd_shards": _over("documents", text_shards),
        "op3_gru_toxicity": lambda spark, sf_dir: document_toxicity(*tables(spark, sf_dir, "documents", "labels")),
        "op4_language_fusion": lambda spark, sf_dir: page_languages(*tables(spark, sf_dir, "pages", "documents")),
        "op5_shingle_join": _over("documents", document_components),
        "op6_pivot_neighbours": _over("embeddings", near_embeddings),
        "op7_superkmer_dedup": _over("documents", deduplicated_documents),
        "op8_wfst_pieces": _over("documents", document_pieces),
        "op9_license_scan": _over("documents", document_licenses),
        "op10_fair_mix": _over("documents", mixed_documents),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": LICENSE_SQL, "op10_fair_mix": MIX_SQL}
