"""Text views and folding as Column expressions, defined once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folds of letters that lower-casing leaves alone.
FOLDS = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("ſ", "s"), ("ς", "σ"))
TOKEN = "[a-z0-9_]+"
# Characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_TOKENS = re.compile(TOKEN).findall


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Case folding: equal for texts that differ in case only."""
    out = F.lower(col(x))
    for given, folded in FOLDS:
        out = F.replace(out, F.lit(given), F.lit(folded))
    return out


def tokens(x: Column | str) -> Column:
    """Lexical tokens in order: folded runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(fold(F.coalesce(col(x), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def token_list(text: str | None) -> list[str]:
    """``tokens`` of one text, for functions that see whole rows."""
    out = (text or "").lower()
    for given, folded in FOLDS:
        out = out.replace(given, folded)
    return _TOKENS(out)


def strip(x: Column | str) -> Column:
    """Without white space at either end, in the Unicode sense; one pass, however much of it stands inside."""
    return F.btrim(col(x), F.lit(SPACES))


def norm_ws(x: Column | str) -> Column:
    """Runs of space, tab and no-break space to one space; line breaks inside stay."""
    return strip(F.regexp_replace(col(x), "[ \\t\u00a0]+", " "))


def plain_view(markdown: Column | str) -> Column:
    """Markdown without emphasis, code and heading marks; ``>`` stays, as menu paths need it."""
    out = F.regexp_replace(col(markdown), "[`*]", "")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s*", "")
    return F.regexp_replace(out, r"(?m)^>\s*\*{0,2}Note:\*{0,2}\s*", "Note: ")


def page_url(base: Column | str, path: Column | str) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(col(path), "^/+", ""))


def context_line(breadcrumb: Column, book: Column, section: Column) -> Column:
    """Breadcrumb (or book), and the section where the trail doesn't hold it already."""
    trail = F.when(F.size(breadcrumb) > 0, F.array_join(breadcrumb, " > ")).otherwise(book)
    extended = F.when(trail == "", section).otherwise(F.concat(trail, F.lit(" > "), section))
    return F.when((section != "") & ~F.contains(trail, section), extended).otherwise(trail)


def embed_text(context: Column, title: Column, text: Column) -> Column:
    return F.concat(context, F.lit("\n"), title, F.lit("\n\n"), text)


def bm25_text(title: Column, context: Column, text: Column, *names: Column) -> Column:
    """Title, context, text and lists of other names, each on lines of its own; empty parts are left out."""
    parts = [title, context, text, *[F.array_join(n, " ") for n in names]]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def ordered_distinct(x: Column) -> Column:
    """First appearances in order."""
    return F.array_distinct(x)


def image_path(src: Column | str) -> Column:
    """File name of an image source in the flat image folder."""
    return F.element_at(F.split(col(src), "/"), -1)


def image_src(src: Column | str) -> Column:
    """Image source without leading ``../``, with forward slashes, percent-decoded; a plus sign stays one."""
    out = F.regexp_replace(strip(src), r"\\", "/")
    out = F.regexp_replace(F.regexp_replace(out, r"^(\.\./)+", ""), "^/+", "")
    return F.coalesce(F.try_url_decode(F.replace(out, F.lit("+"), F.lit("%2B"))), out)


def quoted_path(src: Column | str) -> Column:
    """Percent-encoded path segments; spaces as %20."""
    return F.array_join(F.transform(F.split(col(src), "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
