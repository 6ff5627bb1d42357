"""Documents to chunks: sections by headings, packing with overlap, and what each chunk inherits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.text import fold
from tarnfield.functions.vocabulary import Alias, terms_of
from tarnfield.plans.workspace import ship
from tarnfield.settings import Settings

HEADING = re.compile(r"(#{1,6})\s+(.*)$")


def sections(markdown: str) -> list[tuple[str, str]]:
    """(heading trail, body) per heading with a body; the whole text without a trail if there is none."""
    found, trail, body = [], [], []
    for line in [*markdown.splitlines(), None]:
        head = HEADING.match(line) if line is not None else None
        if line is not None and not head:
            body.append(line)
            continue
        text = "\n".join(body).strip()
        if text:
            found.append((" > ".join(t for _, t in trail), text))
        body = []
        if head:
            trail = [x for x in trail if x[0] < len(head[1])] + [(len(head[1]), head[2].strip())]
    return found or ([("", markdown.strip())] if markdown.strip() else [])


def paragraphs(text: str) -> Iterator[str]:
    """Fenced blocks whole, other text at blank lines."""
    for i, part in enumerate(re.split(r"(```.*?```)", text, flags=re.S)):
        if i % 2:
            yield part
        else:
            yield from (p for p in re.split(r"\n\s*\n", part) if p.strip())


def packed(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed to about ``size``; a chunk repeats the last whole paragraphs of the one before, up to ``overlap``."""
    if len(text) <= size:
        return [text]
    done, held, cost = [], [], 0
    for p in paragraphs(text):
        if held and cost + len(p) + 2 > size:
            done.append("\n\n".join(held))
            keep = cost = 0
            while keep < len(held) and cost + len(held[-1 - keep]) <= overlap:
                keep += 1
                cost += len(held[-keep])
            held = held[len(held) - keep :]
        if not held and len(p) + 2 > size:
            done.append(p)
        else:
            held.append(p)
            cost += len(p) + 2
    if held:
        done.append("\n\n".join(held))
    return [c for c in (d.strip() for d in done) if c]


def pieces(markdown: str, settings: Settings) -> list[tuple[str, str]]:
    """(section, text) of each chunk of one document."""
    if len(markdown) <= settings.min_page_chars:
        return [("", markdown)] if markdown.strip() else []
    return [(s, p) for s, body in sections(markdown) for p in packed(body, settings.chunk_size, settings.chunk_overlap)]


def split(docs: DataFrame, markdown: str = "markdown", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without ``markdown`` but with ord, section and text: a row per chunk."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<section: string, text: string>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"section": s, "text": t} for s, t in pieces(x or "", settings)])

    keep = [c for c in docs.columns if c not in (markdown, "ord", "section", "text")]
    return docs.select(*keep, F.posexplode(cut(markdown)).alias("ord", "_p")).select(*keep, "ord", "_p.section", "_p.text")


def chunk_figures(figures, text):
    """Figures that a chunk's markers name: by whole label, by its head before `` - ``, or by containment, first one wins."""
    marks = F.regexp_extract_all(text, F.lit(r"\[FIGURE:\s*(.+?)\]"), F.lit(1))
    name = lambda f: fold(F.when(f["figure_id"] != "", f["figure_id"]).when(f["caption"] != "", f["caption"]).otherwise(f["src"]))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))

    def found(mark):
        label = fold(F.trim(mark))
        head = F.get(F.split(label, " - "), F.lit(0))
        near = F.filter(figures, lambda f: (name(f) != "") & (F.contains(label, name(f)) | F.contains(name(f), label)))
        return F.coalesce(last(F.filter(figures, lambda f: name(f) == label)), last(F.filter(figures, lambda f: name(f) == head)), F.get(near, F.lit(0)))

    return F.array_distinct(F.filter(F.transform(marks, found), lambda f: f.isNotNull()))


def chunks(docs: DataFrame, aliases: list[Alias], settings: Settings = Settings()) -> DataFrame:
    """All documents as chunks with inherited figures, menu paths, samples and the bridge's user terms."""
    rows = split(docs.withColumn("_md", F.col("markdown")).drop("n_chars"), "_md", settings)
    here = F.filter("menu_paths", lambda m: F.contains(F.col("text"), F.element_at(F.split(m, " > "), -1)))
    paths = F.when(F.size(here) > 0, here).when(F.col("ord") == 0, F.col("menu_paths")).otherwise(F.array().cast("array<string>"))
    out = rows.select(
        F.concat("path", F.lit("#"), F.col("ord").cast("string")).alias("chunk_id"), "path", "url", "title", "book", "breadcrumb", "section", "page_type", "text", F.length("text").alias("n_chars"),
        chunk_figures(F.col("figures"), F.col("text")).alias("figures"), paths.alias("menu_paths"), F.filter("sample_data", lambda s: F.contains(F.col("text"), s)).alias("sample_data"), "ui_names", "ord",
    )
    return out.withColumn("alias_terms", terms_of(F.concat("title", F.lit("\n"), "text"), aliases, "vendor", 24))  # in the row: a join would parse every page again
