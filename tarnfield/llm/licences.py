"""Licence scan by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, spellings, copyright lines and
punctuation levelled), hashed, and the digest of the entire form is joined to
the digests of known licences. The known side has one row per licence form, so
it is broadcast; documents are never shuffled. Every line of a document is an
entire text of its own for a second lookup, which finds one-line notices: of
its levelled lines those are hashed that are as long as some known form, as
only these can equal one. Long licences are known by their digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("non-commercial", "noncommercial"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("authorisation", "authorization"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("https://", "http://"), ("wilful", "willful"), ("fulfil ", "fulfill "),
)

_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_KEEP_ISC = ", provided that the above copyright notice and this permission notice appear in all copies."
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
    'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
# Texts of public licences, and the one-line notices that point to one.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("ISC", _GRANT_ISC + _KEEP_ISC + "\n\n" + _AS_IS_ISC), ("ISC", "ISC License\n\n" + _GRANT_ISC + _KEEP_ISC + "\n\n" + _AS_IS_ISC),
    ("0BSD", _GRANT_ISC + ".\n\n" + _AS_IS_ISC), ("BSD-2-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_AS_IS), ("BSD-3-Clause", _BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_AS_IS),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", _UNLICENSE), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)
# SHA-256 of the canonical forms of longer public licences as published, whole and, where that is usual, without what follows their terms.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("GPL-3.0", "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
COPYRIGHT_LINE = r"(^|\n)[\x20\t]*(copyright|\(c\)|©)[^\n]*(\d{4}|\(c\)|©|all rights reserved)[^\n]*"


def levelled(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, and letters and digits with single spaces between; line ends stay."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for given, common in EQUIVALENT:
        out = F.replace(out, F.lit(given), F.lit(common))
    return F.regexp_replace(out, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F‘’“”–—]+", " ")


def joined_lines(flat: Column) -> Column:
    return F.trim(F.regexp_replace(flat, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """``levelled`` with line ends as spaces: words of letters and digits joined by one space."""
    return joined_lines(levelled(text))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """license_id, digest, line_length: a row for each known form; of two licences of one form the first by name. ``line_length`` is null but for forms of one line."""
    form = canonical(F.col("text"))
    size = F.when(~F.contains("text", F.lit("\n")), F.length(form))
    forms = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", F.sha2(form, 256).alias("digest"), size.alias("line_length"))
    forms = forms.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"), allowMissingColumns=True)
    return forms.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("line_length").alias("line_length"))


def license_scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, text: str = "text", digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """``docs`` plus canonical_sha256, license_id (of the entire text, else null) and notice_ids.

    ``notice_ids`` are the sorted distinct licences that single lines of the text
    name. Null and empty texts have the digest of the empty form and no licence;
    repeated rows are looked up each, columns named like results are replaced.
    """
    made = ("canonical_sha256", "license_id", "notice_ids")
    keep = [c for c in docs.columns if c not in made]
    found = known_digests(docs.sparkSession, known, digests)
    # Bounded by the table of known forms, which the caller passes as literals.
    lines = {r["digest"]: r for r in found.where("line_length > 0").collect()}
    sizes = sorted({r["line_length"] for r in lines.values()})
    flat = docs.select(*[F.col(f"`{c}`") for c in keep], levelled(F.coalesce(F.col(text), F.lit(""))).alias("canonical_sha256"))
    of_lines = F.transform(F.split("canonical_sha256", "\n"), lambda x: F.trim(x))
    per_line = F.transform(F.filter(of_lines, lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    names = F.create_map(*[F.lit(v) for d, r in lines.items() for v in (d, r["license_id"])]) if lines else F.lit(None).cast("map<string,string>")
    hits = F.array_sort(F.array_distinct(F.filter(F.transform(per_line, lambda d: F.try_element_at(names, d)), lambda i: i.isNotNull())))
    hashed = flat.select(*[F.col(f"`{c}`") for c in keep], F.sha2(joined_lines(F.col("canonical_sha256")), 256).alias("canonical_sha256"), hits.alias("notice_ids"))
    whole = found.select(F.col("digest").alias("_digest"), "license_id")
    return hashed.join(F.broadcast(whole), F.col("canonical_sha256") == F.col("_digest"), "left").select(*keep, "canonical_sha256", "license_id", "notice_ids")


def document_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license_id and notice_ids (joined by commas) of every document."""
    return license_scan(docs.select("doc_id", "text")).select("doc_id", "canonical_sha256", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_line(x: str) -> str:
    """Canonical form of one line, from the words found in it; empty for a copyright line."""
    out = f"lower({x})"
    for given, common in EQUIVALENT:
        out = f"replace({out}, '{given}', '{common}')"
    words = rf"array_to_string(regexp_extract_all({out}, '[0-9a-z\x{{80}}-\x{{2012}}\x{{2015}}-\x{{2017}}\x{{201A}}\x{{201B}}\x{{201E}}-\x{{10FFFF}}]+'), ' ')"
    head = rf"ltrim(lower({x}), ' ' || chr(9))"
    rest = rf"substr({head}, CASE WHEN starts_with({head}, 'copyright') THEN 10 WHEN starts_with({head}, '(c)') THEN 4 ELSE 2 END)"
    dated = f"(contains({rest}, '(c)') OR contains({rest}, '©') OR contains({rest}, 'all rights reserved') OR regexp_matches({rest}, '[0-9]{{4}}'))"
    return rf"CASE WHEN (starts_with({head}, 'copyright') OR starts_with({head}, '(c)') OR starts_with({head}, '©')) AND {dated} THEN '' ELSE {words} END"


# Lines are levelled one by one and put together again, with nothing in front that says which may matter.
LICENSE_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS n, license_id, t FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)}) AS v(license_id, t)),
t AS (SELECT 0 AS side, n AS rn, t AS text FROM k UNION ALL SELECT 1, row_number() OVER (), coalesce(text, '') FROM documents),
l AS (SELECT side, rn, pos, {_sql_line("line")} AS form FROM (SELECT side, rn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t)),
w AS (SELECT side, rn, count(*) AS n_lines, sha256(coalesce(string_agg(form, ' ' ORDER BY pos) FILTER (WHERE form <> ''), '')) AS digest FROM l GROUP BY side, rn),
kd AS (SELECT digest, min(license_id) AS license_id, bool_or(n_lines = 1) AS one_line FROM (SELECT w.digest, k.license_id, w.n_lines FROM w JOIN k ON k.n = w.rn WHERE w.side = 0
       UNION ALL SELECT digest, license_id, 9 FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(d)})" for i, d in DIGESTS)}) AS v(license_id, digest)) GROUP BY digest),
n AS (SELECT rn, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM l JOIN kd ON kd.one_line AND kd.digest = sha256(l.form) WHERE side = 1 GROUP BY rn),
d AS (SELECT row_number() OVER () AS rn, doc_id FROM documents)
SELECT d.doc_id, w.digest AS canonical_sha256, kd.license_id, coalesce(n.notice_ids, '') AS notice_ids
FROM d JOIN w ON w.side = 1 AND w.rn = d.rn LEFT JOIN n ON n.rn = d.rn LEFT JOIN kd ON kd.digest = w.digest
"""
