"""Raw pages to documents and menus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.extract import menu_paths, sample_files
from tarnfield.functions.html import menu_items, page_record
from tarnfield.functions.rules import page_type
from tarnfield.functions.text import page_url, plain_view
from tarnfield.plans.workspace import ship
from tarnfield.schemas import FIGURE
from tarnfield.settings import Settings

RECORD = f"struct<title: string, breadcrumb: array<string>, published: string, prev: string, next: string, markdown: string, n_chars: int, figures: array<{FIGURE}>>"


def documents(raw: DataFrame, pages: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``raw`` (path, html) parsed to documents; ``pages`` adds types, names and titles where a page has none of its own."""
    ship(raw.sparkSession)
    root, fence = settings.book_root, settings.fence

    @F.pandas_udf(RECORD)
    def record(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_record(x, root, fence) for x in html], columns=["title", "breadcrumb", "published", "prev", "next", "markdown", "n_chars", "figures"])

    parsed = raw.select("path", record(F.coalesce("html", F.lit(""))).alias("r")).select("path", "r.*")
    if pages is None:
        known = parsed.withColumns({"_title": F.lit(""), "_type": F.lit(None).cast("string"), "ui_names": F.array().cast("array<string>")})
    else:
        known = parsed.join(pages.select("path", F.col("title").alias("_title"), F.col("page_type").alias("_type"), "ui_names"), "path", "left")
    title = F.when(F.col("title") == "", F.coalesce("_title", F.lit(""))).otherwise(F.col("title"))
    plain = plain_view("markdown")
    return known.select(
        "path", page_url(settings.base_url, "path").alias("url"), title.alias("title"), F.coalesce(F.get("breadcrumb", F.lit(0)), F.lit("")).alias("book"), "breadcrumb",
        F.coalesce("_type", page_type(title)).alias("page_type"), "published", "markdown", "n_chars", "figures", menu_paths(plain).alias("menu_paths"),
        sample_files(plain, settings.sample_extension).alias("sample_data"), F.coalesce("ui_names", F.array().cast("array<string>")).alias("ui_names"), "prev", "next",
    )


def menus(raw: DataFrame) -> DataFrame:
    """``raw`` (html, platform) to one row per menu item."""
    ship(raw.sparkSession)

    @F.pandas_udf("array<struct<menu: string, item: string, menu_path: string, description: string>>")
    def items(html: pd.Series) -> pd.Series:
        return html.map(menu_items)

    return raw.select("platform", F.explode(items("html")).alias("m")).select("m.*", "platform")


def menu_index(raw: DataFrame, needed: str = "windows") -> DataFrame:
    """Menus of all platforms in ``raw`` (html, platform); a page of the needed one must be there, others may lack (null html)."""
    if raw.where((F.col("platform") == needed) & F.col("html").isNotNull()).isEmpty():
        raise ValueError(f"no menu page of {needed}")
    return menus(raw.where("html is not null"))
