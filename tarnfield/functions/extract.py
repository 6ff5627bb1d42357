"""Menu paths and sample-file names in plain text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield.functions.text import fold, norm_ws, strip

# Roots of menu paths, and words that run into a file name.
MENUS = ("File", "Edit", "Tables", "Rows", "Cols", "DOE", "Analyze", "Graph", "Tools", "Project", "View", "Window", "Help", "Format")
NOT_A_NAME = (
    "the", "a", "an", "this", "that", "these", "those", "open", "opens", "select", "use", "uses", "using", "see", "in", "from", "and", "or", "figure", "table", "example", "shows", "show",
    "data", "folder", "sample", "named", "called", "file",
)


def menu_segment(segment: Column) -> Column:
    """The menu item that a segment starts with: words up to punctuation, the first lower-case one only if the next is capitalised."""
    head = F.get(F.split(strip(segment), r"[.;:,)\]]\s|[.;:]\s*$|\s+\d+\.\s"), F.lit(0))
    words = F.regexp_extract_all(head, F.lit(r"([A-Za-z0-9][A-Za-z0-9()'/&_-]*)"), F.lit(1))
    big = lambda w: w.rlike(r"^[A-Z0-9]")
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), (big(w) | ((i > 0) & F.coalesce(big(F.get(words, i + 1)), F.lit(False)))).alias("ok")))
    stop = F.coalesce(F.array_min(F.transform(F.filter(numbered, lambda x: ~x["ok"]), lambda x: x["i"])), F.size(words))
    return F.array_join(F.slice(words, 1, F.greatest(stop, F.lit(0))), " ")


def menu_paths(text: Column, menus: tuple[str, ...] = MENUS) -> Column:
    """Distinct ``Root > Item > ...`` paths in order of appearance."""
    pattern = rf"\b((?:{'|'.join(menus)})\s*>\s*[^\n]{{1,160}})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def path(x: Column) -> Column:
        parts = F.split(x, ">")
        items = F.transform(F.slice(parts, 2, 1000), menu_segment)
        empty = F.array_position(items, "").cast("int")
        kept = F.when(empty > 0, F.slice(items, 1, empty - 1)).otherwise(items)
        return F.when(F.size(kept) > 0, F.array_join(F.concat(F.array(strip(F.get(parts, F.lit(0)))), kept), " > "))

    return F.array_distinct(F.filter(F.transform(found, path), lambda p: p.isNotNull()))


def sample_name(raw: Column, extension: str) -> Column:
    """The file name at the end of a run of words: capitalised words or such with an underscore, without leading prose."""
    stem = F.substring(raw, F.lit(1), F.length(raw) - len(extension))
    words = F.filter(F.split(stem, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    named = lambda w: w.rlike(r"(?U)^\p{Lu}") | F.contains(w, F.lit("_"))
    breaks = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), named(w).alias("ok"))), lambda x: ~x["ok"]), lambda x: x["i"])
    tail = F.slice(words, F.coalesce(F.array_max(breaks), F.lit(-1)) + 2, F.greatest(n, F.lit(1)))
    real = F.filter(F.transform(tail, lambda w, i: F.struct(i.alias("i"), fold(w).isin(*NOT_A_NAME).alias("stop"))), lambda x: ~x["stop"])
    first = F.array_min(F.transform(real, lambda x: x["i"]))
    return F.when(first.isNull(), "").otherwise(F.concat(F.array_join(F.slice(tail, first + 1, F.greatest(n, F.lit(1))), " "), F.lit(extension)))


def sample_files(text: Column, extension: str) -> Column:
    """Distinct names of sample files with ``extension`` (with its dot) in order of appearance."""
    dot = extension.replace(".", r"\.")
    found = F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9 _&'.-]{{1,60}}?{dot})\b"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: sample_name(norm_ws(x), extension)), lambda x: x != ""))
