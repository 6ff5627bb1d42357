"""Tables of contents and help maps to one row per page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.html import toc_entries, ui_entries
from tarnfield.functions.rules import page_type
from tarnfield.functions.text import fold, strip
from tarnfield.plans.workspace import ship
from tarnfield.schemas import TOC

LAST = 10**9


def toc_table(raw: DataFrame, book_root: str) -> DataFrame:
    """Lines of the contents pages in ``raw`` (html)."""
    ship(raw.sparkSession)

    @F.pandas_udf(f"array<struct<{TOC.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>")
    def entries(html: pd.Series) -> pd.Series:
        return html.map(lambda x: toc_entries(x, book_root))

    return raw.select(F.explode(entries("html")).alias("e")).select("e.*")


def ui_map_table(raw: DataFrame, book_root: str) -> DataFrame:
    """pos, names, key, path, anchor of the help map in ``raw`` (html)."""
    ship(raw.sparkSession)

    @F.pandas_udf("array<struct<pos: int, names: string, key: string, path: string, anchor: string>>")
    def entries(html: pd.Series) -> pd.Series:
        return html.map(lambda x: ui_entries(x, book_root))

    return raw.select(F.explode(entries("html")).alias("e")).select("e.*")


def ui_names(raw: DataFrame) -> DataFrame:
    """``raw`` (pos, names, key, path, anchor) to one row per distinct (folded name, path), the first one: names split at commas."""
    parts = raw.select("pos", "key", "path", "anchor", F.posexplode(F.split("names", ",")).alias("part", "ui_name")).withColumn("ui_name", strip("ui_name")).where("ui_name <> ''")
    first = Window.partitionBy(fold("ui_name"), "path").orderBy("pos", "part")
    return parts.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("ui_name", "key", "path", "anchor", "pos", "part")


def page_index(toc: DataFrame, ui: DataFrame) -> DataFrame:
    """One row per page: the shallowest, earliest line names it; pages known by on-screen names only come last."""
    lines = toc.groupBy("path").agg(
        F.min_by("title", F.struct("depth", "order")).alias("title"),
        F.min(F.struct("depth", "order")).alias("at"),
        F.bool_or("is_folder").alias("is_folder"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("order", "title"))), lambda x: x["title"])).alias("toc_titles"),
    )
    names = ui.groupBy("path").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "ui_name"))), lambda x: x["ui_name"])).alias("ui_names"))
    both = lines.join(names, "path", "full")
    none = F.array().cast("array<string>")
    found = F.col("at").isNotNull()
    first = F.get(F.col("ui_names"), F.lit(0))
    return both.select(
        "path",
        F.coalesce("title", first).alias("title"),
        F.when(found, page_type("title")).otherwise("concept").alias("page_type"),
        F.coalesce("at.depth", F.lit(99)).alias("depth"),
        F.coalesce("at.order", F.lit(LAST)).alias("order"),
        F.coalesce("is_folder", F.lit(False)).alias("is_folder"),
        F.coalesce("toc_titles", none).alias("toc_titles"),
        F.coalesce("ui_names", none).alias("ui_names"),
    )


def master_toc(raw: DataFrame, book_root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, on-screen names, lines) of the contents page in ``raw`` (html)."""
    lines, names = toc_table(raw, book_root), ui_names(ui_map_table(raw, book_root))
    return page_index(lines, names), names, lines
