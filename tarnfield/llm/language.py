"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are joined in the log domain for every page:

* the text, by byte-trigram likelihoods, tempered so that beyond
  ``TEXT_WEIGHT`` trigrams a longer text doesn't count as more evidence;
* the language that its markup declares, by how often pages that read like
  language ``l`` declare ``d``;
* the suffix of its address, in the same way;
* a prior of its host, smoothed towards its registered domain, and that towards
  all pages.

The tables behind the last three are grouped sums of text-only posteriors over
all rows (whole millionths, so reruns agree), one row per host, domain, suffix
or declared code. A page's own share is taken out of the sums that it is judged
by. Hosts are joined by key; a host with a large part of all pages is combined
before the shuffle on one side and split by adaptive joins on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.sampling import kept_by_hash
from tarnfield.plans.workspace import Workspace, ship, tidy

SAMPLE = 1500  # labelled texts per language that the trigram model is fitted on, at most
SAMPLE_BYTES = 20_000  # longest of these; of a language that has only longer ones, their beginnings
BUCKETS = 1 << 16
TEXT_WEIGHT = 30.0
SMOOTH = {"domain": 20.0, "host": 10.0, "suffix": 200.0, "declared": 5.0}
SAME_CODE = 0.8  # prior probability that a page declares the language it is in
SURE = 0.4  # posterior below which a language stays undetermined
UNLIKE = -10.5  # mean log likelihood of a trigram under the best language, below which a text is in none of them (by chance: -11.09)
UNDETERMINED = "und"
_SCALE = 1_000_000
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text's letters, words set apart by single spaces."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    h = (data[:-2] << np.uint32(16)) ^ (data[1:-1] << np.uint32(8)) ^ data[2:]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def fit_text(texts: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages log probabilities)."""
    return _model({name: sum(np.bincount(trigrams(t), minlength=BUCKETS) for t, lang in zip(texts, langs, strict=True) if lang == name) for name in set(langs)})


def _model(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(counts)
    table = np.empty((BUCKETS, len(names)), np.float32)
    for i, name in enumerate(names):
        smooth = counts[name] + 0.05
        table[:, i] = np.log(smooth / smooth.sum())
    return names, table


# What is left open runs to the end, and no pattern reads beyond the next tag, so that each takes time in proportion to the page.
_SKIP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^<>]*>")
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_META = re.compile(r"<meta\b[^<>]*?content-language[^<>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def page_parts(html: str) -> tuple[str, str]:
    """(visible text, declared language or "") of a page."""
    code = _DECLARED.search(html) or _META.search(html)
    return unescape(_TAG.sub(" ", _SKIP.sub(" ", html))), code[1].lower() if code else ""


def host_parts(url: Column) -> dict[str, Column]:
    """host, domain and suffix of an address; empty where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1)}


def _evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], body: str, parts: Callable[[str], tuple[str, str]]) -> DataFrame:
    """``rows`` without ``body`` but with declared (where ``parts`` finds it), n_trigrams and the mean log likelihood of a trigram in each language."""
    names, table = model
    given = rows.sparkSession.sparkContext.broadcast(table)
    keep = [c for c in rows.columns if c not in (body, "_declared")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + ["_declared string, _n long, _t array<double>"])

    told = "_declared" in rows.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value
        for batch in batches:
            declared, n, means = [], [], np.zeros((batch.num_rows, len(names)))
            own = batch.column("_declared").to_pylist() if told else [None] * batch.num_rows
            for i, (text, code) in enumerate(zip(batch.column(body).to_pylist(), own, strict=True)):
                text, found = parts(text or "")
                grams = trigrams(text.encode("utf-8", "replace"))
                declared.append(code or found)
                n.append(len(grams) if len(grams) > 1 else 0)
                if n[-1]:
                    means[i] = np.bincount(grams, minlength=BUCKETS) @ table / len(grams) if len(grams) > 20_000 else table[grams].mean(0, dtype=np.float64)
            arrays = [batch.column(c) for c in keep] + [pa.array(declared, pa.string()), pa.array(n, pa.int64()), pa.array(list(np.round(means, 9)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "_declared", "_n", "_t"])

    return rows.mapInArrow(run, schema)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _shares(logs: Column) -> Column:
    """Softmax of an array."""
    return F.transform(logs, lambda x: 1 / F.aggregate(logs, F.lit(0.0), lambda s, y: s + F.exp(y - x)))


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def fused(rows: DataFrame, model: tuple[list[str], np.ndarray], body: str, parts: Callable[[str], tuple[str, str]], sure: float = SURE) -> DataFrame:
    """``rows`` (with ``host``, ``domain``, ``suffix`` and perhaps ``_declared``) without ``body`` but with lang_id and confidence."""
    names, _ = model
    k = len(names)
    work = Workspace(rows.sparkSession, "language")
    keep = [c for c in rows.columns if c not in (body, "_declared", "host", "domain", "suffix")]
    weight = F.least(F.col("_n").cast("double"), F.lit(TEXT_WEIGHT))

    def told(given: DataFrame) -> DataFrame:
        seen = _evidence(given, model, body, parts).withColumn("_like", (F.col("_n") > 0) & (F.array_max("_t") >= UNLIKE)).withColumn("_t", F.transform("_t", lambda x: x * weight))
        alone = F.transform(_shares(F.col("_t")), lambda p: F.when(F.col("_like"), F.round(p * _SCALE)).otherwise(0).cast("long"))
        return seen.withColumn("_r", alone)

    # What is summed is written without the rows' other columns, and texts are read once more for their own verdict: nothing large is left behind.
    key = ("host", "domain", "suffix")
    seen = work.save("evidence", told(rows.select(body, *key, *(["_declared"] if "_declared" in rows.columns else []))).select(*key, "_declared", "_r"))
    sums = [F.coalesce(F.sum(F.get("_r", F.lit(i))), F.lit(0)) for i in range(k)]
    total = seen.agg(F.array(*sums).alias("s")).first()["s"]
    every = [x / _SCALE for x in total]
    base = _literal([(x + 1) / (sum(every) + k) for x in every])

    joined = told(rows)
    for kind in ("domain", "host", "suffix", "_declared"):
        groups = seen.where(F.col(kind) != "").groupBy(F.col(kind).alias("_key")).agg(F.array(*sums).alias("_sums"))
        joined = joined.join(work.save(f"by{kind}", groups), F.col(kind) == F.col("_key"), "left").drop("_key")
        # The page's own share is no evidence about itself.
        others = F.transform(F.arrays_zip("_sums", "_r"), lambda x: F.greatest((x["_sums"] - x["_r"]) / _SCALE, F.lit(0.0)))
        joined = joined.withColumn(f"_of_{kind.strip('_')}", F.coalesce(others, _literal([0] * k))).drop("_sums")

    def prior(kind: str, above: Column) -> Column:
        own, n = F.col(f"_of_{kind}"), SMOOTH[kind]
        return F.when(F.col(kind) == "", above).otherwise(F.zip_with(own, above, lambda c, b: (c + n * b) / (_total(own) + n)))

    def likelihood(kind: str, column: str, aim: Column) -> Column:
        """Of the code given each language: its part of the language's sum, smoothed to ``aim``."""
        n = SMOOTH[kind]
        smooth = F.zip_with(F.col(f"_of_{kind}"), aim, lambda c, b: c + n * b + 1e-6)
        return F.when(F.col(column) == "", _literal([1] * k)).otherwise(F.zip_with(smooth, _literal(every), lambda x, e: x / (e + n)))

    share = _total(F.col("_of_suffix")) / max(sum(every), 1.0)
    same = F.transform(F.array(*[F.lit(x) for x in names]), lambda x: F.when(x == F.col("_declared"), F.lit(SAME_CODE)).otherwise(F.lit((1 - SAME_CODE) / k)))
    joined = joined.withColumn("_domain", prior("domain", base)).withColumn("_host", prior("host", F.col("_domain")))
    joined = joined.withColumn("_suffix", likelihood("suffix", "suffix", F.array_repeat(share, k))).withColumn("_code", likelihood("declared", "_declared", same))
    logs = F.transform(F.arrays_zip("_t", "_host", "_suffix", "_code"), lambda x: x["_t"] + F.log(x["_host"]) + F.log(x["_suffix"]) + F.log(x["_code"]))
    joined = joined.withColumn("_logs", logs).withColumn("_q", F.transform(_shares(F.col("_logs")), lambda q: F.round(q, 6)))
    joined = joined.withColumn("_best", F.array_max("_q"))
    lang = F.when(F.col("_like") & (F.col("_best") >= sure), F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("_q", F.col("_best")).cast("int"))).otherwise(UNDETERMINED)
    return joined.select(*keep, lang.alias("lang_id"), F.when(F.col("_n") > 0, F.col("_best")).otherwise(0.0).alias("confidence"), F.col("_declared").alias("declared"), "suffix", "host")


def text_model(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The trigram model of every labelled language; without labels, one that no text is like.

    It is fitted on all labelled texts of a language or, of those with more, on
    about ``sample`` chosen by hash; repeated rows count once. Trigrams are
    counted in the tasks: the driver gets at most ``BUCKETS`` sums a language.
    """
    fits = F.octet_length("text") <= SAMPLE_BYTES
    labelled = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(F.col("lang"), F.substring("text", 1, SAMPLE_BYTES).alias("text"), F.xxhash64("doc_id", "text").alias("key"), fits.alias("fits"))
    have = labelled.groupBy("lang").agg(F.count(F.when(F.col("fits"), 1)).alias("short")).collect()
    long = [r["lang"] for r in have if not r["short"]]
    usable = labelled.where(F.col("fits") | F.col("lang").isin(long)) if long else labelled.where("fits")
    chosen = kept_by_hash(usable.select("lang", "text", "key"), F.col("lang"), F.col("key"), sample).groupBy("_kind", "_hash").agg(F.min("text").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("_kind").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(text.encode("utf-8", "replace")), minlength=BUCKETS)
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    ship(docs.sparkSession)
    sums = chosen.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {r["lang"]: np.zeros(BUCKETS) for r in have}
    lang, bucket, n = (sums.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    for name in counts:
        own = lang == name
        counts[name][bucket[own]] = n[own]
    return _model(counts) if counts else (["en"], np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang_id, confidence, declared, suffix and host of every page.

    A page without letters is undetermined with confidence 0, and one that is like
    no modelled language is undetermined too; null or malformed
    addresses and markup without a language are no evidence; repeated rows are
    judged alike, an empty table gives an empty result.
    """
    rows = pages.select("page_id", F.col("html").alias("_body"), *[c.alias(n) for n, c in host_parts(F.col("url")).items()])
    return fused(rows, text_model(docs), "_body", page_parts)


def document_languages(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``docs`` plus lang_id and confidence: the text, the declared ``lang``, and ``source`` as host."""
    keep = [c for c in docs.columns if c not in ("lang_id", "confidence")]
    model = model or text_model(docs)
    source = F.coalesce(F.col("source"), F.lit(""))
    rows = docs.select(*keep, F.col("text").alias("_body"), F.coalesce(F.lower("lang"), F.lit("")).alias("_declared"), source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))
    return fused(rows, model, "_body", _plain).select(*keep, "lang_id", "confidence")


def _plain(text: str) -> tuple[str, str]:
    return text, ""
