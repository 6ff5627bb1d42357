"""Every query by name over the driver's tables, and the SQL that says the same.

Bindings: documents are chunks (source as book, the label of the vector of the
same id as page type), benchmark items are questions, embeddings are vectors of
chunks and questions, parts are menus and on-screen names, the geography is a
table of contents, events are a fetch log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions import rules, text
from tarnfield.functions.extract import menu_paths, sample_files
from tarnfield.functions.vocabulary import Alias, matched_aliases, user_terms, vendor_terms
from tarnfield.operators import chat, chunks, evaluate, index, lookup, pages, retrieve, toc, tools
from tarnfield.plans.workspace import Workspace
from tarnfield.plugins import OverlapReranker
from tarnfield.settings import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TYPES = ("launch", "howto", "example", "concept", "overview", "report", "statistical_details", "options", "reference")
# A small bridge over the vocabulary of the part table: makers' words and shoppers' words.
ALIASES = [
    Alias("colour", ("green", "lime green"), ("leafy", "verdant")),
    Alias("colour", ("red", "blue"), ("warm tone", "cool tone")),
    Alias("metal", ("steel", "brass"), ("iron alloy", "yellow metal", "verdant")),
    Alias("shape", ("ring", "bolt", "nut"), ("fastener", "round part")),
]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def type_of(label: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in TYPES]), F.pmod(label, F.lit(len(TYPES))).cast("int")), F.lit("concept"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _lexical(spark: SparkSession, d: str) -> index.LexicalIndex:
    return index.build_index(table(spark, d, "documents"), "doc_id", "text")


def _queries(spark: SparkSession, d: str, subs: int = 1) -> DataFrame:
    """The question, and for two also its first three words; both with the vector of the item's number."""
    short = F.array_join(F.slice(F.split("question", r"\s+"), 1, 3), " ")
    q = retrieve.sub_queries(_questions(spark, d), F.col("question"), *[short] * (subs - 1))
    return q.join(_vectors(spark, d).select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid", "left")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, d, "documents").join(label, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), "lang", type_of(F.col("label")).alias("page_type"), F.col("text").alias("passage"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- shared SQL ---

FOLD = "replace(lower({0}), 'ß', 'ss')"
TOKENS = "regexp_extract_all(" + FOLD + ", '[a-z0-9_]+')"
CTE_TF = f"""tok AS (SELECT doc_id AS id, unnest({TOKENS.format("text")}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
dl AS (SELECT d.doc_id AS id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf ON tf.id = d.doc_id GROUP BY d.doc_id),
tot AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _cte_search(subs: int) -> str:
    extra = "UNION ALL SELECT item_id, 1, array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') FROM benchmark" if subs == 2 else ""
    return f"""{CTE_TF},
sub AS (SELECT item_id AS qid, 0 AS sub, text AS q FROM benchmark {extra}),
qt AS (SELECT qid, sub, term, count(*) AS qtf FROM (SELECT qid, sub, unnest({TOKENS.format("q")}) AS term FROM sub) GROUP BY ALL),
lex AS (SELECT qid, sub, tf.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS score
        FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id, tot GROUP BY qid, sub, tf.id),
lexk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sub ORDER BY round(score, 9) DESC, id) AS rn FROM lex) WHERE rn <= 20 AND score > 0),
den AS (SELECT s.qid, s.sub, v.vec_id AS id, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) AS score
        FROM sub s JOIN embeddings w ON w.vec_id = s.qid, embeddings v),
denk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sub ORDER BY round(score, 9) DESC, id) AS rn FROM den) WHERE rn <= 20),
lvl AS (SELECT qid, id, 'd' AS side, score, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
        FROM denk WINDOW w AS (PARTITION BY qid, sub)
        UNION ALL
        SELECT qid, id, 'l', score, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END
        FROM lexk WINDOW w AS (PARTITION BY qid, sub)),
pool AS (SELECT qid, id, coalesce(max(CASE WHEN side = 'd' THEN norm END), 0) AS dense_score, coalesce(max(CASE WHEN side = 'l' THEN norm END), 0) AS bm25_score,
         greatest(coalesce(max(CASE WHEN side = 'd' THEN score END), 0), 0) AS dense_cosine FROM lvl GROUP BY qid, id),
fus AS (SELECT *, 0.6 * dense_score + 0.4 * bm25_score AS fused FROM pool)"""


TYPE_SQL = "coalesce([" + ", ".join(f"'{t}'" for t in TYPES) + f"][CAST(label % {len(TYPES)} AS INT) + 1], 'concept')"


def _rules_sql(column: str, given: tuple[tuple[str, str], ...], default: str) -> str:
    whens = " ".join("WHEN regexp_matches(trim(%s, ' ' || chr(9) || chr(10) || chr(13)), '(?i)%s') THEN '%s'" % (column, p.replace("'", "''"), n) for n, p in given)
    return f"CASE {whens} ELSE '{default}' END"


def _weights_sql(i: str, t: str) -> str:
    whens = " ".join(f"WHEN {i} = '{a}' AND {t} = '{b}' THEN {w}" for a, ws in rules.WEIGHTS.items() for b, w in ws.items())
    return f"CASE {whens} ELSE 0.0 END"


# --- lexical index ---


@query(f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT t) AS n_terms FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY doc_id")
def tokenize_counts(spark, d):
    found = text.tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_terms")).where("n_tokens > 0")


@query(f"WITH {CTE_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, d):
    return _rounded(_lexical(spark, d).terms, "idf")


@query(f"WITH {_cte_search(1)} SELECT qid, rn, id, round(score, 6) AS score FROM lexk")
def bm25_topk(spark, d):
    return _rounded(retrieve.bm25_topk(_queries(spark, d), _lexical(spark, d), 20).select("qid", F.col("rn").cast("long").alias("rn"), "id", "score"), "score")


@query("SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(DISTINCT doc_id) FROM documents) AS n_pages, (SELECT count(DISTINCT source) FROM documents WHERE source <> '') AS n_books, (SELECT count(DISTINCT lang || '.png') FROM documents) AS n_figures, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT max(len(embedding)) FROM embeddings) AS embed_dim")
def manifest_stats(spark, d):
    vectors = table(spark, d, "embeddings").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("long").alias("embed_dim"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("book"), F.array(F.struct(F.concat("lang", F.lit(".png")).alias("src"))).alias("figures"))
    return index.manifest(docs).crossJoin(vectors)


# --- retrieval ---


@query(f"WITH {_cte_search(1)} SELECT qid, rn, id, round(score, 6) AS score FROM denk")
def dense_topk(spark, d):
    return _rounded(retrieve.dense_topk(_queries(spark, d).where("qv is not null"), _vectors(spark, d), 20).select("qid", F.col("rn").cast("long").alias("rn"), "id", "score"), "score")


@query(f"WITH {_cte_search(1)} SELECT qid, id, side, round(norm, 6) AS norm FROM lvl")
def minmax_per_query(spark, d):
    q = _queries(spark, d)
    sides = {"d": retrieve.dense_topk(q.where("qv is not null"), _vectors(spark, d), 20), "l": retrieve.bm25_topk(q, _lexical(spark, d), 20)}
    both = [retrieve.level(s, ["qid", "sub"]).select("qid", "id", F.lit(n).alias("side"), F.round("norm", 6).alias("norm")) for n, s in sides.items()]
    return both[0].unionByName(both[1])


def _pool(spark, d, subs: int) -> DataFrame:
    q = _queries(spark, d, subs)
    return retrieve.fused(retrieve.pooled(retrieve.dense_topk(q.where("qv is not null"), _vectors(spark, d), 20), retrieve.bm25_topk(q, _lexical(spark, d), 20)))


@query(f"WITH {_cte_search(1)} SELECT qid, rn, id, round(fused, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rn FROM fus) WHERE rn <= 6")
def hybrid_fused_topk(spark, d):
    return retrieve.top(_pool(spark, d, 1), ["qid"], "fused", 6).select("qid", F.col("rn").cast("long").alias("rn"), "id", F.round("fused", 6).alias("score"))


@query(f"WITH {_cte_search(2)} SELECT qid, id, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, round(dense_cosine, 6) AS dense_cosine FROM pool")
def hybrid_multiquery_pool(spark, d):
    return _rounded(_pool(spark, d, 2).select("qid", "id", "dense_score", "bm25_score", "dense_cosine"), "dense_score", "bm25_score", "dense_cosine")


@query(f"WITH {_cte_search(1)} SELECT qid, rn, id, round(fused, 6) AS score FROM (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rn FROM fus f JOIN documents d ON d.doc_id = f.id WHERE d.lang = 'en') WHERE rn <= 6")
def hybrid_lang_filter(spark, d):
    english = _chunks(spark, d).where("lang = 'en'").select("id")
    return retrieve.top(_pool(spark, d, 1).join(english, "id", "left_semi"), ["qid"], "fused", 6).select("qid", F.col("rn").cast("long").alias("rn"), "id", F.round("fused", 6).alias("score"))


@query(f"WITH {_cte_search(1)} SELECT qid, rn, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rn FROM fus) WHERE rn <= 24")
def candidate_cap(spark, d):
    return retrieve.top(_pool(spark, d, 1), ["qid"], "fused", 24).select("qid", F.col("rn").cast("long").alias("rn"), "id")


def _boost_sql(pool: str = "true", intent: str | None = None, k: int = 6, rerank: bool = False) -> str:
    """Search as CTEs: filters on the pool, the cap, perhaps the reranker, the boost and the first ``k``."""
    asked = f"'{intent}'" if intent else _rules_sql("b.text", rules.intent_rules(), rules.DEFAULT_INTENT)
    words = "list_distinct(list_filter(string_split_regex(" + FOLD + ", '[\\s]+'), lambda w: w <> ''))"
    base, extra = "fused", ""
    if rerank:
        asked_words, held = words.format("b.text"), words.format("substr(d.text, 1, 800)")
        extra = f"""rr AS (SELECT c.*, CAST(len(list_intersect({asked_words}, {held})) AS DOUBLE) / greatest(1, len({asked_words})) AS rerank_score FROM cap c JOIN documents d ON d.doc_id = c.id JOIN benchmark b ON b.item_id = c.qid),
lev AS (SELECT *, CASE WHEN max(rerank_score) OVER w - min(rerank_score) OVER w < 1e-12 THEN 1.0 ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS base FROM rr WINDOW w AS (PARTITION BY qid)),"""
        base = "base"
    return f"""{_cte_search(2)},
typed AS (SELECT f.*, {TYPE_SQL} AS page_type, {asked} AS intent, d.source, d.lang, d.text AS passage
          FROM fus f JOIN documents d ON d.doc_id = f.id LEFT JOIN embeddings e ON e.vec_id = f.id JOIN benchmark b ON b.item_id = f.qid),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS c FROM typed WHERE {pool}) WHERE c <= 24),
{extra}
boost AS (SELECT *, 0.15 * {_weights_sql("intent", "page_type")} AS boost FROM {"lev" if rerank else "cap"}),
hits AS (SELECT *, {base} + boost AS score FROM boost),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rn FROM hits) WHERE rn <= {k})"""


_BOOST = _boost_sql()


def _search(spark, d, **how) -> DataFrame:
    asked = _questions(spark, d).withColumn("intent", rules.intent("question"))
    return retrieve.search(asked, _queries(spark, d, 2), _lexical(spark, d), _vectors(spark, d), _chunks(spark, d), **how)


@query(f"WITH {_BOOST} SELECT qid, rn, id, round(score, 6) AS score, round(boost, 6) AS boost, round(dense_cosine, 6) AS dense_cosine FROM fin")
def hybrid_search(spark, d):
    return _rounded(_search(spark, d).select("qid", F.col("rn").cast("long").alias("rn"), "id", "score", "boost", "dense_cosine"), "score", "boost", "dense_cosine")


@query(f"WITH {_BOOST} SELECT b.item_id AS qid, round(dense_cosine, 6) AS top_relevance, coalesce(dense_cosine, -1e9) < 0.45 AS weak FROM benchmark b JOIN fin ON fin.qid = b.item_id AND rn = 1")
def top_relevance_gate(spark, d):
    return _rounded(retrieve.top_relevance(_questions(spark, d), _search(spark, d)), "top_relevance")


@query(f"WITH {_boost_sql(rerank=True)} SELECT qid, rn, id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM fin")
def hybrid_search_reranked(spark, d):
    return _rounded(_search(spark, d, reranker=OverlapReranker()).select("qid", F.col("rn").cast("long").alias("rn"), "id", "score", "rerank_score"), "score", "rerank_score")


@query(f"WITH {_BOOST} SELECT qid, id, intent, page_type, round(boost, 6) AS boost, round(score, 6) AS score FROM hits")
def hybrid_type_boost(spark, d):
    pool = retrieve.top(_pool(spark, d, 2).join(_chunks(spark, d), "id"), ["qid"], "fused", 24, "c")
    asked = _questions(spark, d).select("qid", rules.intent("question").alias("intent"))
    return _rounded(retrieve.boosted(pool.join(asked, "qid"), "fused").select("qid", "id", "intent", "page_type", "boost", "score"), "boost", "score")


def _as_chunks(spark, d) -> DataFrame:
    """Documents as chunks of a page for each source: language as sample and figure."""
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rows = table(spark, d, "documents").join(label, "doc_id", "left")
    figure = F.struct(F.lit("").alias("figure_id"), F.concat(F.lit("In "), "lang").alias("caption"), F.concat(F.lit("img/"), "lang", F.lit(".png")).alias("src"), F.lit("").alias("alt"))
    source = F.coalesce("source", F.lit(""))
    return rows.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), source.alias("path"), F.concat(F.lit("https://example.com/help/"), source).alias("url"), F.concat(F.lit("Page of "), source).alias("title"), source.alias("book"),
        F.array(F.lit("Guide"), source).alias("breadcrumb"), F.col("lang").alias("section"), type_of(F.col("label")).alias("page_type"), "text", F.array(figure).alias("figures"),
        F.array(F.concat(F.lit("File > "), "lang")).alias("menu_paths"), F.array(F.concat("lang", F.lit(".csv"))).alias("sample_data"),
    )


@query(f"WITH {_boost_sql('source = ' + chr(39) + 'src1' + chr(39), k=20)} SELECT qid, rn, 'Page of src1' AS title, 'src1' AS book, 'Guide > src1' AS breadcrumb, lang AS section, page_type, 'https://example.com/help/src1' AS url, md5(passage) AS text_md5, lang || '.csv' AS samples, round(score, 4) AS score FROM fin")
def search_payload(spark, d):
    """The search tool over one book; 40 excerpts are asked for, 20 are the most."""
    hits = _search(spark, d, k=tools.bounded(40, 20), books=["src1"])
    shown = tools.payload(hits, _as_chunks(spark, d))
    return shown.select("qid", F.col("rn").cast("long").alias("rn"), "title", "book", "breadcrumb", "section", "page_type", "url", F.md5("text").alias("text_md5"), F.array_join("sample_data", ",").alias("samples"), "score")


@query(f"""WITH {_boost_sql("page_type = 'example'", "example", 15)}, e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS n FROM fin WHERE contains(lang || '.csv', 'e'))
SELECT qid, n AS "at", rn, md5(passage) AS text_md5, round(score, 4) AS score FROM e WHERE n <= 5""")
def find_example(spark, d):
    asked = _questions(spark, d).withColumn("intent", F.lit("example"))
    hits = retrieve.search(asked, _queries(spark, d, 2), _lexical(spark, d), _vectors(spark, d), _chunks(spark, d), 15, page_types=["example"])
    found = tools.example_hits(hits, _as_chunks(spark, d), "E", 5)
    return found.select("qid", F.col("at").cast("long").alias("at"), F.col("rn").cast("long").alias("rn"), F.md5("text").alias("text_md5"), "score")


@query(f"WITH {_boost_sql(k=24)}, f AS (SELECT qid, lang, min(rn) AS rn FROM fin GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS n FROM f) SELECT g.qid, n AS at, 'In ' || g.lang AS caption, g.lang || '.png' AS local_name, 'https://example.com/help/img/' || g.lang || '.png' AS source_url, 'Page of ' || fin.source AS page_title FROM g JOIN fin ON fin.qid = g.qid AND fin.rn = g.rn WHERE n <= 6")
def find_figures(spark, d):
    found = tools.figure_hits(_search(spark, d, k=24), _as_chunks(spark, d), 6)
    return found.select("qid", F.col("at").cast("long").alias("at"), "caption", "local_name", "source_url", "page_title")


@query(f"WITH {_BOOST}, w AS (SELECT qid FROM fin WHERE rn = 1 AND dense_cosine < 0.45), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rn FROM hits)) SELECT qid, rn, id, round(score, 6) AS score FROM r WHERE rn <= 6 OR (rn <= 9 AND qid IN (SELECT qid FROM w))")
def retry_weak(spark, d):
    wide = _search(spark, d, k=9)
    first = wide.where("rn <= 6")
    weak = retrieve.top_relevance(_questions(spark, d), first)
    return _rounded(retrieve.with_retry(first, wide, weak).select("qid", F.col("rn").cast("long").alias("rn"), "id", "score"), "score")


# --- views, rules, bridge ---


@query("SELECT doc_id, md5(CASE WHEN contains(source, lang) THEN source ELSE source || ' > ' || lang END || chr(10) || 'Page ' || doc_id || chr(10) || chr(10) || text) AS view_md5 FROM documents")
def embed_text_view(spark, d):
    context = text.context_line(F.array().cast("array<string>"), F.col("source"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.embed_text(context, F.concat(F.lit("Page "), F.col("doc_id").cast("string")), F.col("text"))).alias("view_md5"))


@query("SELECT doc_id, md5('Page ' || doc_id || chr(10) || source || chr(10) || text || chr(10) || lang || ' ' || source) AS view_md5 FROM documents WHERE text <> ''")
def bm25_text_view(spark, d):
    none = F.array().cast("array<string>")
    view = text.bm25_text(F.concat(F.lit("Page "), F.col("doc_id").cast("string")), F.col("source"), F.col("text"), F.array("lang", "source"), none)
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(view).alias("view_md5"))


@query(f"SELECT p_partkey, {_rules_sql('title', rules.PAGE_TYPES, rules.DEFAULT_TYPE)} AS page_type FROM (SELECT p_partkey, ['Example of ', 'Launch the ', 'Overview of ', 'Create a ', 'Functions for ', '', 'Options for '][p_partkey % 7 + 1] || p_name AS title FROM part)")
def classify_page_type(spark, d):
    heads = F.array(*[F.lit(x) for x in ("Example of ", "Launch the ", "Overview of ", "Create a ", "Functions for ", "", "Options for ")])
    title = F.concat(F.get(heads, (F.col("p_partkey") % 7).cast("int")), "p_name")
    return table(spark, d, "part").select("p_partkey", rules.page_type(title).alias("page_type"))


_ASKED = "['how do I make ', 'where is ', 'what is ', 'why is it wrong: ', 'show me how ', 'interpret ', 'automate ', 'what does the x option '][turn % 8 + 1] || text"


@query(f"SELECT conv_id, turn, {_rules_sql('q', rules.intent_rules(), rules.DEFAULT_INTENT)} AS intent FROM (SELECT conv_id, turn, {_ASKED} AS q FROM conversations WHERE role = 'user')")
def classify_intent(spark, d):
    return _asked(spark, d).select("conv_id", "turn", rules.intent("q").alias("intent"))


def _asked(spark, d) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("how do I make ", "where is ", "what is ", "why is it wrong: ", "show me how ", "interpret ", "automate ", "what does the x option ")])
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.get(heads, (F.col("turn") % 8).cast("int")), "text").alias("q"))


@query(f"SELECT intent, page_type, {_weights_sql('intent', 'page_type')} AS weight, n FROM (SELECT intent, page_type, count(*) AS n FROM (SELECT {_rules_sql('q', rules.intent_rules(), rules.DEFAULT_INTENT)} AS intent, ['" + "', '".join(TYPES) + f"'][turn % 9 + 1] AS page_type FROM (SELECT turn, {_ASKED} AS q FROM conversations WHERE role = 'user')) GROUP BY ALL)")
def intent_type_weights(spark, d):
    rows = _asked(spark, d).select(rules.intent("q").alias("intent"), type_of(F.col("turn")).alias("page_type"))
    return rows.groupBy("intent", "page_type").agg(F.count("*").alias("n")).withColumn("weight", rules.page_type_weight("intent", "page_type"))


def _bridge_sql(given: str, limit: int, text_sql: str, key: str, source: str) -> str:
    """Over texts of lower-case words and single spaces: phrases in order of length, matched at word boundaries."""
    rows = [(p, i, j, t) for i, a in enumerate(ALIASES) for p in (a.vendor if given == "vendor" else a.user) for j, t in enumerate(a.user if given == "vendor" else a.vendor)]
    values = ", ".join(f"('{p}', {i}, {j}, '{t}')" for p, i, j, t in rows)
    alternatives = "|".join(sorted({r[0] for r in rows}, key=lambda p: (-len(p), p)))
    return f"""WITH m AS (SELECT {key} AS key, regexp_extract_all(replace(' ' || lower({text_sql}) || ' ', ' ', '  '), ' ((?:{alternatives.replace(" ", "  ")})) ', 1) AS found FROM {source}),
x AS (SELECT key, replace(unnest(found), '  ', ' ') AS phrase, generate_subscripts(found, 1) AS pos FROM m),
t AS (SELECT x.key, pos, i, j, term FROM x JOIN (VALUES {values}) AS v(phrase, i, j, term) USING (phrase)),
f AS (SELECT key, lower(term) AS folded, min((pos, i, j, term)) AS pl FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pl) AS rn FROM f)
SELECT m.key AS {key}, coalesce((SELECT string_agg(pl[4], ',' ORDER BY rn) FROM r WHERE r.key = m.key AND rn <= {limit}), '') AS terms FROM m"""


@query(_bridge_sql("vendor", 3, "p_name || ' steel ring'", "p_partkey", "part"))
def bridge_user_terms(spark, d):
    name = F.concat("p_name", F.lit(" steel ring"))
    return user_terms(table(spark, d, "part"), "p_partkey", name, ALIASES, 3).select("p_partkey", F.array_join("user_terms", ",").alias("terms"))


@query(_bridge_sql("user", 8, "'verdant fastener ' || p_name", "p_partkey", "part"))
def bridge_vendor_terms(spark, d):
    name = F.concat(F.lit("verdant fastener "), "p_name")
    return vendor_terms(table(spark, d, "part"), "p_partkey", name, ALIASES).select("p_partkey", F.array_join("vendor_terms", ",").alias("terms"))


@query("SELECT p_partkey, i AS alias_idx, c AS category FROM part, (VALUES (0, 'colour'), (2, 'metal'), (3, 'shape')) AS v(i, c)")
def bridge_matched_aliases(spark, d):
    return matched_aliases(table(spark, d, "part"), "p_partkey", F.concat(F.lit("verdant fastener "), "p_name"), ALIASES)


# --- pages and chunks ---


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH RECURSIVE b AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS md FROM documents),
s AS (SELECT doc_id, md, trim(md, {_WS}) AS body, list_filter(string_split_regex(trim(md, {_WS}), '\\n\\s*\\n'), lambda p: trim(p, {_WS}) <> '') AS ps FROM b),
r AS (SELECT doc_id, ps, 1 AS i, CAST([] AS VARCHAR[]) AS held, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS done FROM s WHERE length(md) > 200 AND length(body) > 1200
UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN len(kept) = 0 AND length(p) + 2 > 1200 THEN kept ELSE list_append(kept, p) END, CASE WHEN len(kept) = 0 AND length(p) + 2 > 1200 THEN left_cost ELSE left_cost + length(p) + 2 END,
  CASE WHEN len(kept) = 0 AND length(p) + 2 > 1200 THEN list_append(sent, p) ELSE sent END
 FROM (SELECT *, CASE WHEN full_ THEN coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) ELSE cost END AS left_cost, CASE WHEN full_ THEN list_append(done, array_to_string(held, chr(10) || chr(10))) ELSE done END AS sent
  FROM (SELECT *, ps[i] AS p, len(held) > 0 AND cost + length(ps[i]) + 2 > 1200 AS full_, CASE WHEN len(held) > 0 AND cost + length(ps[i]) + 2 > 1200 THEN list_filter(held, lambda x, j: list_sum(list_transform(held[j:], lambda y: length(y))) <= 200) ELSE held END AS kept
   FROM r WHERE i <= len(ps)))),
e AS (SELECT doc_id, CASE WHEN len(held) > 0 THEN list_append(done, array_to_string(held, chr(10) || chr(10))) ELSE done END AS parts FROM r WHERE i = len(ps) + 1
UNION ALL SELECT doc_id, CASE WHEN body = '' THEN [] WHEN length(md) <= 200 THEN [md] ELSE [body] END FROM s WHERE length(md) <= 200 OR length(body) <= 1200),
x AS (SELECT doc_id, unnest(list_filter(parts, lambda q: trim(q, {_WS}) <> '')) AS text, generate_subscripts(list_filter(parts, lambda q: trim(q, {_WS}) <> ''), 1) - 1 AS ord FROM e)
SELECT x.doc_id, ord, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT x.doc_id, ord, CASE WHEN length(md) <= 200 THEN text ELSE trim(text, {_WS}) END AS t FROM x JOIN s ON s.doc_id = x.doc_id) x""")
def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("markdown"))
    return chunks.split(docs).select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# Help pages written from the part table in every kind of markup that the parser knows, and what must come out of them.
_PAGE_HTML = (
    '<html><head><link rel="Prev" href="p', "K", '.shtml#x"></head><body><div class="ww_skin_breadcrumbs"><a>Atlas</a> &gt; <a>', "T", '</a></div><div class="ww_creation_date">Publication date: 2020-', "K",
    '</div><div id="page_content"><div class="miniTOC_x">skip</div><h1>Overview of <b>', "N", "</b></h1><p>A  ", "N", " of type <i>", "T", '</i><br>.</p><p class="Figure_Title"><span class="zmpFigTab">Figure ', "K", "</span> Map of ", "N",
    '</p><p><img src="../img/', "K", '%20map.png" alt="alt ', "K", '"></p><p class="code">x = ', "K", ';</p><p class="codeOutput">y = ', "N", ';</p><p class="N2bullet">deep ', "K", '</p><p class="bullet">flat ', "T",
    '</p><p class="Note">Note: careful with ', "N", '</p><p class="defTerm">', "T", '</p><table><caption>Facts</caption><tr><th>name</th><th>key|no</th></tr><tr><td><span class="code">', "N", "</span></td><td>", "K",
    "</td></tr><tr><td>only</td></tr></table><ol><li>one<li>two ", "K", "</ol><pre>raw ", "K", "\n  kept</pre><h3>Use</h3><div><p>Select Analyze &gt; Part ", "K", " &gt; Fit. Then open the Part", "K", ".csv table.</p></div><footer>gone</footer></div></body></html>",
)
_PAGE_MARKDOWN = (
    "# Overview of **", "N", "**\n\nA ", "N", " of type *", "T", "*.\n\n[FIGURE: Figure ", "K", " - Map of ", "N", "]\n\n```code\nx = ", "K", ";\ny = ", "N", ";\n```\n\n  - deep ", "K", "\n- flat ", "T", "\n\n> **Note:** careful with ", "N",
    "\n\n**", "T", "**\n\n**Facts**\n\n| name | key\\|no |\n|---|---|\n| `", "N", "` | ", "K", " |\n| only |  |\n\n1. one\n2. two ", "K", "\n\n```code\nraw ", "K", "\n  kept\n```\n\n### Use\n\nSelect Analyze > Part ", "K", " > Fit. Then open the Part", "K", ".csv table.",
)
_PART_SQL = {"K": "CAST(p_partkey AS VARCHAR)", "N": "p_name", "T": "p_type"}


def _sql_text(parts: tuple[str, ...]) -> str:
    return " || ".join(_PART_SQL.get(x) or "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in parts)


def _help_pages(spark, d) -> DataFrame:
    given = {"K": F.col("p_partkey").cast("string"), "N": F.col("p_name"), "T": F.col("p_type")}
    # A row of a few bytes becomes a page that takes milliseconds: dealt over all cores while it is small, however few files there are.
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select(F.concat(F.lit("help/p"), given["K"], F.lit(".shtml")).alias("path"), F.concat(*[given.get(x, F.lit(x)) for x in _PAGE_HTML]).alias("html"))


@query(f"""WITH m AS (SELECT 'help/p' || p_partkey || '.shtml' AS path, p_partkey AS k, p_name AS n, p_type AS t, {_sql_text(_PAGE_MARKDOWN)} AS md FROM part)
SELECT path, 'https://example.com/help/' || path AS url, 'Overview of **' || n || '**' AS title, 'Atlas' AS book, 'Atlas > ' || t AS breadcrumb, 'overview' AS page_type, '2020-' || k AS published, 'help/p' || k || '.shtml' AS prev, '' AS "next",
md5(md) AS markdown_md5, length(md) AS n_chars, 'Figure ' || k AS figure_id, 'Map of ' || n AS caption, 'img/' || k || ' map.png' AS src, 'alt ' || k AS alt, 'Analyze > Part ' || k || ' > Fit' AS menus, 'Part' || k || '.csv' AS samples FROM m""")
def help_pages_parse(spark, d):
    found = pages.documents(_help_pages(spark, d))
    figure = F.get("figures", F.lit(0))
    return found.select(
        "path", "url", "title", "book", F.array_join("breadcrumb", " > ").alias("breadcrumb"), "page_type", "published", "prev", "next", F.md5("markdown").alias("markdown_md5"), F.col("n_chars").cast("long").alias("n_chars"),
        figure["figure_id"].alias("figure_id"), figure["caption"].alias("caption"), figure["src"].alias("src"), figure["alt"].alias("alt"), F.array_join("menu_paths", ";").alias("menus"), F.array_join("sample_data", ";").alias("samples"),
    )


@query(f"""WITH m AS (SELECT p_partkey AS k, p_name AS n, {_sql_text(_PAGE_MARKDOWN)} AS md FROM part),
c AS (SELECT k, n, 0 AS ord, 'Overview of **' || n || '**' AS section, substr(md, strpos(md, chr(10)) + 2, strpos(md, chr(10) || '### Use') - strpos(md, chr(10)) - 3) AS text FROM m
UNION ALL SELECT k, n, 1, 'Overview of **' || n || '** > Use', substr(md, strpos(md, '### Use') + 9) FROM m)
SELECT 'help/p' || k || '.shtml#' || ord AS chunk_id, section, 'overview' AS page_type, md5(text) AS text_md5, CASE ord WHEN 0 THEN 'img/' || k || ' map.png' ELSE '' END AS figures, 'Analyze > Part ' || k || ' > Fit' AS menus,
CASE ord WHEN 1 THEN 'Part' || k || '.csv' ELSE '' END AS samples FROM c""")
def help_pages_chunks(spark, d):
    found = chunks.chunks(pages.documents(_help_pages(spark, d)), [])
    return found.select("chunk_id", "section", "page_type", F.md5("text").alias("text_md5"), F.array_join(F.col("figures.src"), ",").alias("figures"), F.array_join("menu_paths", ";").alias("menus"), F.array_join("sample_data", ";").alias("samples"))


@query("SELECT p_brand AS menu, p_name AS item, p_brand || ' > ' || p_name AS menu_path, p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN 'macos' ELSE 'windows' END AS platform FROM part")
def menu_pages(spark, d):
    """Menu pages of two platforms, a table for each brand, read back into one list."""
    platform = F.when(F.col("p_partkey") % 3 == 0, "macos").otherwise("windows")
    row = F.concat(F.lit("<tr><td>"), F.col("p_name"), F.lit("</td><td> "), F.replace(F.col("p_type"), F.lit(" "), F.lit("\n ")), F.lit("</td></tr>"))
    tables = table(spark, d, "part").groupBy(platform.alias("platform"), "p_brand").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    html = F.concat(F.lit('<div id="page_content"><table><caption>'), "p_brand", F.lit(" Menu</caption><tr><th>Item</th><th>Description</th></tr>"), "rows", F.lit("</table></div>"))
    return pages.menus(tables.select("platform", html.alias("html")))


@query("""SELECT 'help/r' || r_regionkey || '.shtml' AS path, '' AS anchor, r_name AS title, 1 AS depth, true AS is_folder FROM region UNION ALL
SELECT 'help/n' || n_nationkey || '.shtml', 'a' || n_nationkey, n_name, 2, false FROM nation""")
def toc_pages(spark, d):
    """Contents pages, one for each region with its nations below, read back into lines."""
    link = lambda path, anchor, name: F.concat(F.lit('<a class="WebWorks_TOC_Link" href="help/'), path, F.lit(".shtml"), anchor, F.lit('">'), name, F.lit("</a>"))
    nation = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<li>"), link(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("#a"), F.col("n_nationkey").cast("string")), F.col("n_name")), F.lit("</li>"))), "").alias("below"))
    region = table(spark, d, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey"))
    html = F.concat(F.lit('<div id="toc:1"><ul><li>'), link(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit(""), F.col("r_name")), F.lit("<ul>"), "below", F.lit("</ul></li></ul></div>"))
    return toc.toc_table(region.select(html.alias("html")), "help").select("path", "anchor", "title", "depth", "is_folder")


@query("""SELECT p_name AS ui_name, 'k' || p_partkey AS key, 'help/u' || p_partkey || '.shtml' AS path, 'x' AS anchor FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_type || ' x', 'k' || p_partkey, 'help/u' || p_partkey || '.shtml', 'x' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'the key ' || p_partkey, 'the_key_' || p_partkey, 'help/u' || p_partkey || '.shtml', 'x' FROM part WHERE p_partkey % 2 = 1""")
def ui_map_pages(spark, d):
    """Help maps with several names to a link, or none but the key, read back into one row a name."""
    k = F.col("p_partkey").cast("string")
    named = F.col("p_partkey") % 2 == 0
    key = F.when(named, F.concat(F.lit("k"), k)).otherwise(F.concat(F.lit("the_key_"), k))
    link = F.concat(F.lit('<p><a id="topic:1:'), key, F.lit('" href="help/u'), k, F.lit('.shtml#x">'), F.when(named, F.concat("p_name", F.lit(", "), "p_type", F.lit(" x"))).otherwise(""), F.lit('</a><a id="topic:1:z" href="other/u.shtml">no</a></p>'))
    return toc.ui_names(toc.ui_map_table(table(spark, d, "part").select(link.alias("html")), "help")).select("ui_name", "key", "path", "anchor")


_ALIAS_TEXT = ("a verdant thing ", "warm tone, Round Part ", "unleafy leafy-ish ", "")


@query(f"""WITH t AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _ALIAS_TEXT)}][p_partkey % 4 + 1] || p_name AS text FROM part),
a AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x.category}', '{p}')" for i, x in enumerate(ALIASES) for p in x.user)}) AS v(i, category, phrase))
SELECT DISTINCT p_partkey, i AS alias_idx, category FROM t JOIN a ON regexp_matches(text, '(?i)(^|[^a-z0-9_])' || phrase || '([^a-z0-9_]|$)')""")
def bridge_matched_aliases_varied(spark, d):
    heads = F.array(*[F.lit(x) for x in _ALIAS_TEXT])
    return matched_aliases(table(spark, d, "part"), "p_partkey", F.concat(F.get(heads, (F.col("p_partkey") % 4).cast("int")), "p_name"), ALIASES)


@query("SELECT n_nationkey, 0 AS ord, r_name || ' > ' || n_name AS section, repeat(n_name || ' is a nation of ' || r_name || '. ', 9) || 'End.' AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def section_trail(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.repeat(F.concat("n_name", F.lit(" is a nation of "), "r_name", F.lit(". ")), F.lit(9)), F.lit("End."))
    md = F.concat(F.lit("# "), "r_name", F.lit("\n\n## "), "n_name", F.lit("\n\n"), body)
    return chunks.split(both.select("n_nationkey", md.alias("markdown"))).select("n_nationkey", "ord", "section", "text")


@query()
def html_parse(spark, d):
    found = pages.documents(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), "html"))
    return found.select("path", "title", "page_type", "n_chars", F.md5("markdown").alias("markdown_md5"), F.size("figures").alias("n_figures"))


@query(r"SELECT page_id, replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def page_title(spark, d):
    raw = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    for given, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(given), F.lit(char))
    return table(spark, d, "pages").select("page_id", raw.alias("title"))


@query("SELECT n_nationkey, 'Analyze > ' || strip || ' > Fit' AS paths, strip || '.csv' AS samples FROM (SELECT n_nationkey, 'Nation' || n_nationkey AS strip FROM nation)")
def extract_paths(spark, d):
    name = F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string"))
    prose = F.concat(F.lit("Select Analyze > "), name, F.lit(" > Fit. Then open the sample data "), name, F.lit(".csv and run."))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(menu_paths(prose), ";").alias("paths"), F.array_join(sample_files(prose, ".csv"), ";").alias("samples"))


@query("SELECT p_partkey, 'img/' || p_name || '+' || p_partkey || '%.png' AS src, p_name || '+' || p_partkey || '%.png' AS name, 'img/' || replace(p_name, ' ', '%20') || '%2B' || p_partkey || '%25.png' AS quoted, 'https://example.com/help/a/p' || p_partkey AS url FROM part")
def image_sources(spark, d):
    """Sources as pages write them: decoded, as a file name, quoted again; and a page's address."""
    raw = F.concat(F.lit("..\\\\../img/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), F.col("p_partkey").cast("string"), F.lit("%25.png "))
    src = text.image_src(F.replace(raw, F.lit("\\\\"), F.lit("\\")))
    return table(spark, d, "part").select("p_partkey", src.alias("src"), text.image_path(src).alias("name"), text.quoted_path(src).alias("quoted"), text.page_url(F.lit("https://example.com/help//"), F.concat(F.lit("/a/p"), F.col("p_partkey").cast("string"))).alias("url"))


@query("SELECT p_partkey, p_name || chr(10) || 'Note: ' || p_type || ' is here' || chr(10) || 'Analyze > Fit ' || p_brand AS plain, 'a b ' || p_name || chr(10) || 'c' AS spaced FROM part")
def plain_views(spark, d):
    md = F.concat(F.lit("### **"), "p_name", F.lit("**\n> **Note:** `"), "p_type", F.lit("` is *here*\nAnalyze > Fit "), "p_brand")
    wide = F.concat(F.lit("\u2003 a \t\u00a0 b "), "p_name", F.lit("\nc\u00a0\t\n"))
    return table(spark, d, "part").select("p_partkey", text.plain_view(md).alias("plain"), text.norm_ws(wide).alias("spaced"))


@query("SELECT i.intent, 'Script Book' AS book, p.page_type, CASE WHEN i.intent = 'scripting' THEN 0.15 ELSE 0.15 * w END AS boost FROM (SELECT unnest(['scripting', 'what_is']) AS intent) i, (SELECT unnest(['reference', 'concept', 'report']) AS page_type) p JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', {rules.WEIGHTS[i].get(t, 0)})" for i in ("scripting", "what_is") for t in ("reference", "concept", "report")) + ") AS v(i, t, w)) v ON v.t = p.page_type AND v.i = intent")
def scripting_boost(spark, d):
    """A scripting question prefers the books of the language, whatever the page type."""
    pairs = spark.createDataFrame([(i, t) for i in ("scripting", "what_is") for t in ("reference", "concept", "report")], "intent string, page_type string")
    settings = Settings(script_books=("Script Book",))
    return retrieve.boosted(pairs.select("*", F.lit("Script Book").alias("book"), F.lit(0.0).alias("base")), "base", settings).select("intent", "book", "page_type", F.round("boost", 6).alias("boost"))


def _toc(spark, d) -> DataFrame:
    region, nation, customer = (table(spark, d, n) for n in ("region", "nation", "customer"))
    a = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("title"), F.lit(1).alias("depth"), F.col("r_regionkey").cast("long").alias("order"), F.lit(True).alias("is_folder"))
    b = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("title"), F.lit(2).alias("depth"), (F.col("n_nationkey") + 100).cast("long").alias("order"), F.lit(False).alias("is_folder"))
    c = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("title"), F.lit(3).alias("depth"), (F.col("c_custkey") + 1000).alias("order"), F.lit(False).alias("is_folder"))
    return a.unionByName(b).unionByName(c)


_TOC_SQL = """t AS (SELECT 'r' || r_regionkey AS path, r_name AS title, 1 AS depth, CAST(r_regionkey AS BIGINT) AS ord, true AS f FROM region
UNION ALL SELECT 'r' || n_regionkey, n_name, 2, n_nationkey + 100, false FROM nation
UNION ALL SELECT 'n' || c_nationkey, c_mktsegment, 3, c_custkey + 1000, false FROM customer)"""


@query(f"""WITH {_TOC_SQL}, l AS (SELECT path, arg_min(title, (depth, ord)) AS title, min((depth, ord)) AS pl, bool_or(f) AS is_folder FROM t GROUP BY path),
dt AS (SELECT path, title, min(ord) AS o FROM t GROUP BY path, title), lt AS (SELECT path, string_agg(title, '|' ORDER BY o) AS toc_titles FROM dt GROUP BY path),
u AS (SELECT 'n' || (p_partkey % 40) AS path, p_partkey AS pos, p_name AS ui FROM part), du AS (SELECT path, ui, min(pos) AS o FROM (SELECT path, pos, arg_min(ui, pos) OVER (PARTITION BY path, lower(ui)) AS ui FROM u) GROUP BY path, ui),
lu AS (SELECT path, string_agg(ui, '|' ORDER BY o) AS ui_names, arg_min(ui, o) AS first FROM du GROUP BY path)
SELECT coalesce(l.path, lu.path) AS path, coalesce(l.title, first) AS title, CASE WHEN l.path IS NULL THEN 'concept' ELSE {_rules_sql("l.title", rules.PAGE_TYPES, "concept")} END AS page_type, coalesce(pl[1], 99) AS depth, coalesce(pl[2], 1000000000) AS "order",
coalesce(is_folder, false) AS is_folder, coalesce(toc_titles, '') AS toc_titles, coalesce(ui_names, '') AS ui_names FROM l LEFT JOIN lt USING (path) FULL JOIN lu ON lu.path = l.path""")
def toc_page_index(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("names"), F.lit("k").alias("key"), F.concat(F.lit("n"), (F.col("p_partkey") % 40).cast("string")).alias("path"), F.lit("").alias("anchor"))
    found = toc.page_index(_toc(spark, d), toc.ui_names(raw))
    return found.withColumns({"toc_titles": F.array_join("toc_titles", "|"), "ui_names": F.array_join("ui_names", "|")})


@query("""WITH p AS (SELECT p_partkey AS pos, p_brand AS path, unnest(string_split(p_name || ', ' || p_type, ',')) AS raw, generate_subscripts(string_split(p_name || ', ' || p_type, ','), 1) AS part FROM part),
r AS (SELECT pos, path, trim(raw) AS ui_name, row_number() OVER (PARTITION BY lower(trim(raw)), path ORDER BY pos, part) AS rn FROM p WHERE trim(raw) <> '') SELECT ui_name, path, pos FROM r WHERE rn = 1""")
def ui_map_explode_dedupe(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(", "), "p_type").alias("names"), F.lit("").alias("key"), F.col("p_brand").alias("path"), F.lit("").alias("anchor"))
    return toc.ui_names(raw).select("ui_name", "path", "pos")


# --- lookups ---

_NEEDLES = "(SELECT n_nationkey AS nid, CASE n_nationkey % 3 WHEN 0 THEN (SELECT min(p_name) FROM part) WHEN 1 THEN (SELECT split_part(max(p_name), ' ', 1) FROM part) ELSE n_name END AS needle FROM nation)"


@query(f"""SELECT nid, rn, pos, match_kind FROM (SELECT nid, p_partkey AS pos, CASE WHEN lower(p_name) = lower(needle) THEN 'exact' ELSE 'partial' END AS match_kind,
row_number() OVER (PARTITION BY nid ORDER BY CASE WHEN lower(p_name) = lower(needle) THEN 0 ELSE 1 END, p_partkey) AS rn FROM part, {_NEEDLES} WHERE contains(lower(p_name), lower(needle)) OR contains(lower(needle), lower(p_name))) WHERE rn <= 3""")
def whats_this(spark, d):
    part = table(spark, d, "part")
    ends = part.agg(F.min("p_name").alias("a"), F.split_part(F.max("p_name"), F.lit(" "), F.lit(1)).alias("b"))
    needle = F.when(F.col("n_nationkey") % 3 == 0, F.col("a")).when(F.col("n_nationkey") % 3 == 1, F.col("b")).otherwise(F.col("n_name"))
    asked = table(spark, d, "nation").crossJoin(ends).select(F.col("n_nationkey").alias("nid"), needle.alias("needle"))
    ui = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("ui_name"), F.col("p_partkey").cast("string").alias("path"), F.lit("").alias("anchor"))
    return lookup.whats_this(asked, ui).select("nid", F.col("rn").cast("long").alias("rn"), F.col("path").cast("long").alias("pos"), "match_kind")


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(f"""WITH q AS (SELECT nid, CASE nid % 4 WHEN 0 THEN 'src' || nid WHEN 1 THEN 'PAGE of SRC' || nid WHEN 2 THEN 'of src' || (nid % 20) ELSE 'nowhere' || nid END AS page FROM (SELECT n_nationkey AS nid FROM nation)),
p AS (SELECT source AS path, 'page of ' || source AS title, min(doc_id) AS ord, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, string_agg(DISTINCT 'File > ' || lang, ',' ORDER BY 'File > ' || lang) AS menus,
      string_agg(DISTINCT lang || '.csv', ',' ORDER BY lang || '.csv') AS samples, count(DISTINCT lang) AS n_figures, {TYPE_SQL.replace("label", "first(label ORDER BY doc_id)")} AS page_type FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT nid, path, row_number() OVER (PARTITION BY nid ORDER BY CASE WHEN path = page THEN 0 WHEN title = lower(page) THEN 1 ELSE 2 END, ord) AS rn FROM q JOIN p ON path = page OR contains(title, lower(page)))
SELECT q.nid, q.page, p.path, 'Page of ' || p.path AS title, 'Guide > ' || p.path AS breadcrumb, p.page_type, p.text_md5, p.menus, p.samples, p.n_figures, CASE WHEN p.path IS NULL THEN 'no page matching ' || q.page END AS error
FROM q LEFT JOIN m ON m.nid = q.nid AND m.rn = 1 LEFT JOIN p ON p.path = m.path""")
def page_tool(spark, d):
    nid = F.col("n_nationkey")
    as_text = nid.cast("string")
    page = F.when(nid % 4 == 0, F.concat(F.lit("src"), as_text)).when(nid % 4 == 1, F.concat(F.lit("PAGE of SRC"), as_text)).when(nid % 4 == 2, F.concat(F.lit("of src"), (nid % 20).cast("string"))).otherwise(F.concat(F.lit("nowhere"), as_text))
    found = tools.page_tool(_as_chunks(spark, d).where("path <> ''"), table(spark, d, "nation").select(nid.alias("nid"), page.alias("page")))
    size = F.when(F.col("path").isNotNull(), F.size("figures").cast("long"))
    return found.select("nid", "page", "path", "title", "breadcrumb", "page_type", F.md5("text").alias("text_md5"), F.array_join("menu_paths", ",").alias("menus"), F.array_join("sample_data", ",").alias("samples"), size.alias("n_figures"), "error")


@query("SELECT source AS book, count(*) AS n_chunks FROM documents WHERE source <> '' GROUP BY source")
def books_by_chunks(spark, d):
    return lookup.books_by_chunks(_as_chunks(spark, d))


@query("WITH f AS (SELECT lang, min(doc_id) AS first FROM documents WHERE source = 'src1' GROUP BY lang) SELECT '# src1' || chr(10) || chr(10) || string_agg('- In ' || lang || '  (page)', chr(10) ORDER BY first) AS markdown FROM f")
def book_resource(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("path"), F.concat(F.lit("In "), "lang").alias("title"), F.lit("page").alias("page_type"), F.col("source").alias("book"))
    return tools.book_resource(rows, "src1")


@query(f"""WITH t AS (SELECT item_id AS tid, 'find the ' || text || ' fastener' AS task FROM benchmark),
w AS (SELECT tid, task, list_filter({_WORDS.format(FOLD.format("task"))}, lambda x: len(x) > 2 AND x NOT IN ({", ".join(f"'{s}'" for s in lookup.TASK_STOP_WORDS)})) AS asked FROM t),
i AS (SELECT p_partkey AS ord, p_type || ' > ' || p_name AS menu_path, lower(p_name) AS item, lower(p_brand || ' ' || p_type) AS descr FROM part),
iw AS (SELECT *, {_WORDS.format("item")} AS iw, {_WORDS.format("descr")} AS dw FROM i),
s AS (SELECT tid, ord, menu_path, 6.0 * len(list_filter(asked, lambda a: len(list_filter(iw, lambda h: starts_with(h, a) AND len(h) - len(a) <= 2)) > 0)) / len(asked)
 + 3.0 * len(list_filter(asked, lambda a: len(list_filter(dw, lambda h: starts_with(h, a) AND len(h) - len(a) <= 2)) > 0)) / len(asked)
 + list_sum(list_transform(['ring', 'bolt', 'nut'], lambda n: CASE WHEN n = item THEN 8 WHEN contains(item, n) THEN 4 WHEN contains(descr, n) THEN 2 ELSE 0 END)) + CASE WHEN lower(task) = item THEN 10 ELSE 0 END AS score FROM w, iw)
SELECT tid, rn, ord, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(score, 9) DESC, ord) AS rn FROM s WHERE score > 0) WHERE rn <= 5""")
def menu_lookup(spark, d):
    return _found_menus(table(spark, d, "part"), _questions(spark, d).select(F.col("qid").alias("tid"), F.concat(F.lit("find the "), "question", F.lit(" fastener")).alias("task")))


def _found_menus(part: DataFrame, tasks: DataFrame) -> DataFrame:
    tasks = tasks.join(vendor_terms(tasks, "tid", F.col("task"), ALIASES), "tid").withColumnRenamed("vendor_terms", "terms")
    menus = part.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("menu"), F.col("p_name").alias("item"), F.concat("p_type", F.lit(" > "), "p_name").alias("menu_path"), F.concat("p_brand", F.lit(" "), "p_type").alias("description"), F.lit("windows").alias("platform"))
    return _rounded(lookup.find_menu(tasks, menus).select("tid", F.col("rn").cast("long").alias("rn"), "ord", "score"), "score")


@query("SELECT source AS book, count(DISTINCT doc_id) AS n_pages FROM documents WHERE source <> '' GROUP BY source")
def list_books(spark, d):
    return lookup.list_books(table(spark, d, "documents"), "doc_id", "source")


@query("SELECT lang AS path, min(doc_id) AS ord FROM documents WHERE source = 'src1' GROUP BY lang ORDER BY ord LIMIT 60")
def browse_book(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("lang").alias("path"), F.col("lang").alias("title"), F.col("doc_id").alias("ord"))
    return lookup.browse(rows, "src1").select("path", "ord")


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def get_page_concat(spark, d):
    return lookup.whole_page(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", F.md5("text").alias("text_md5"), "n_parts")


@query("""WITH q AS (SELECT nid, CASE nid % 3 WHEN 0 THEN CAST(nid AS VARCHAR) WHEN 1 THEN upper((SELECT min(p_name) FROM part)) ELSE substr((SELECT max(p_name) FROM part), 2) END AS page FROM (SELECT n_nationkey AS nid FROM nation)),
f AS (SELECT nid, CAST(p_partkey AS VARCHAR) AS path, p_partkey AS ord, CASE WHEN CAST(p_partkey AS VARCHAR) = page THEN 0 WHEN lower(p_name) = lower(page) THEN 1 ELSE 2 END AS kind FROM part, q WHERE CAST(p_partkey AS VARCHAR) = page OR contains(lower(p_name), lower(page)))
SELECT nid, path, kind FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY kind, ord) AS rn FROM f) WHERE rn = 1""")
def resolve_page(spark, d):
    part = table(spark, d, "part")
    ends = part.agg(F.upper(F.min("p_name")).alias("a"), F.expr("substr(max(p_name), 2)").alias("b"))
    nid = F.col("n_nationkey")
    asked = table(spark, d, "nation").crossJoin(ends).select(nid.alias("nid"), F.when(nid % 3 == 0, nid.cast("string")).when(nid % 3 == 1, F.col("a")).otherwise(F.col("b")).alias("page"))
    return lookup.resolve_page(asked, part.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord")))


def _first_occurrences(spark, d, words: Column) -> DataFrame:
    figures = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(F.lower(F.substring(w, 1, 2)).alias("src")))
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rn"), figures.alias("figures"))
    return retrieve.first_figures(hits, 6).select("qid", F.col("at").cast("long").alias("at"), "figure.src")


@query("""WITH x AS (SELECT conv_id AS qid, turn AS rn, lower(substr(unnest(string_split(text, ' ')), 1, 2)) AS src, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations),
f AS (SELECT qid, src, min((rn, pos)) AS pl FROM x WHERE src <> '' GROUP BY ALL), n AS (SELECT qid, src, row_number() OVER (PARTITION BY qid ORDER BY pl) AS k FROM f) SELECT qid, k AS at, src FROM n WHERE k <= 6""")
def first_occurrence_distinct(spark, d):
    return _first_occurrences(spark, d, F.split("text", " "))


# --- conversations ---


@query(f"""WITH u AS (SELECT conv_id, turn, text, row_number() OVER w AS n, lag(text) OVER w AS prev FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, (n > 1 AND regexp_matches(text, '(?i){rules.FOLLOW_UP}')) OR len(string_split_regex(trim(text), '\\s+')) <= 3 AS need FROM u)
SELECT conv_id, turn, CASE WHEN need AND prev IS NOT NULL AND prev || ' ' || text <> text THEN 2 ELSE 1 END AS n_queries, md5(CASE WHEN need AND prev IS NOT NULL THEN prev || ' ' || text ELSE text END) AS last_md5 FROM e""")
def conversation_expand(spark, d):
    found = chat.expanded(chat.user_turns(table(spark, d, "conversations")))
    return found.select("conv_id", "turn", F.size("queries").alias("n_queries"), F.md5(F.element_at("queries", -1)).alias("last_md5"))


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(text, 1, 400), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id""")
def history_window(spark, d):
    return chat.history(table(spark, d, "conversations"))


@query("""WITH b AS (SELECT conv_id AS key, turn AS rn, '[' || turn || '] ' || role || ' - c' || conv_id || chr(10) || text AS block FROM conversations),
u AS (SELECT *, coalesce(sum(len(block)) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT key, md5(string_agg(substr(block, 1, CAST(900 - used AS INT)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn)) AS context_md5, count(*) AS n_blocks FROM u WHERE used < 900 GROUP BY key""")
def context_budget(spark, d):
    block = chat.context_block(F.col("turn"), F.col("role"), F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("text"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("rn"), block.alias("block"))
    return chat.context(rows, 900).select("key", F.md5("context").alias("context_md5"), "n_blocks")


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i){rules.CHITCHAT}') THEN 'chitchat' ELSE 'docs' END AS route FROM (SELECT conv_id, turn, ['hello!', text, 'Thank you'][turn % 3 + 1] AS q FROM conversations)")
def route_chitchat(spark, d):
    q = F.get(F.array(F.lit("hello!"), F.col("text"), F.lit("Thank you")), (F.col("turn") % 3).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.route(q).alias("route"))


@query("""WITH w AS (SELECT conv_id AS qid, turn AS rn, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations),
f AS (SELECT qid, v, min((rn, p)) AS pl FROM w GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pl) AS k FROM f) SELECT qid, string_agg(v, '|' ORDER BY k) AS shown FROM n WHERE k <= 5 GROUP BY qid""")
def answer_collect(spark, d):
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rn"), F.split("text", " ").alias("shown"))
    return chat.collected(hits, "shown").select("qid", F.array_join("shown", "|").alias("shown"))


@query("SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def transcript(spark, d):
    return chat.transcript(table(spark, d, "conversations")).select("conv_id", F.md5("transcript").alias("transcript_md5"))


_LINE = "[text, substr(text, 1, 60), 'looking at ' || substr(text, 1, 20), substr(text, 1, 30) || '.', 'ab', substr(text, 1, 30) || ' !  '][turn % 6 + 1]"


@query(f"""WITH l AS (SELECT conv_id, turn, trim({_LINE}, {_WS}) AS line FROM conversations)
SELECT conv_id, turn, length(line) > 3 AND length(line) <= 90 AND NOT regexp_matches(line, '(?i){rules.PROSE.replace("'", "''")}') AND len(string_split_regex(line, '\\s+')) <= 14 AND NOT (ends_with(line, '.') OR ends_with(line, '!') OR ends_with(line, '?:')) AS ok FROM l""")
def query_lines(spark, d):
    """Which lines of a rewriter are queries and not prose."""
    text_, short = F.col("text"), lambda n: F.substring("text", 1, n)
    line = F.get(F.array(text_, short(60), F.concat(F.lit("looking at "), short(20)), F.concat(short(30), F.lit(".")), F.lit("ab"), F.concat(short(30), F.lit(" !  "))), (F.col("turn") % 6).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.looks_like_query(line).alias("ok"))


@query("""SELECT doc_id, doc_id % 9 + 1 AS rn, '[' || (doc_id % 9 + 1) || '] Page ' || doc_id AS line, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN 'Guide > ' || lang ELSE '' END, ''), nullif(source, ''), 'Page ' || doc_id) AS citation,
md5(replace(substr(text, 1, 420) || CASE WHEN length(text) > 420 THEN '...' ELSE '' END, chr(10), ' ')) AS snippet_md5 FROM documents""")
def source_lines(spark, d):
    """Citations as they stand below an answer."""
    docs = table(spark, d, "documents")
    title = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    trail = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Guide"), "lang")).otherwise(F.array().cast("array<string>"))
    hits = docs.select(F.col("doc_id").alias("qid"), (F.col("doc_id") % 9 + 1).alias("rn"), title.alias("title"), F.lit("concept").alias("page_type"), retrieve.citation(trail, F.col("source"), title).alias("citation"), "text")
    return chat.sources(hits).select(F.col("qid").alias("doc_id"), "rn", "line", "citation", F.md5("snippet").alias("snippet_md5"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN '**Menu:** `File > ' || p_name || '` · `Edit`' END, CASE WHEN p_partkey % 3 = 0 THEN '**Sample data:** `' || p_type || '.csv`' END,
CASE WHEN p_partkey % 5 = 0 THEN '**Also called:** `a` · `b` · `c`' END], lambda x: x IS NOT NULL), '  ' || chr(10)) AS chips FROM part""")
def answer_chips(spark, d):
    """What is shown beside an answer: three menu paths, samples and terms at most."""
    none, k = F.array().cast("array<string>"), F.col("p_partkey")
    menus = F.when(k % 2 == 0, F.array(F.concat(F.lit("File > "), "p_name"), F.lit("Edit"))).otherwise(none)
    samples = F.when(k % 3 == 0, F.array(F.concat("p_type", F.lit(".csv")))).otherwise(none)
    terms = F.when(k % 5 == 0, F.array(*[F.lit(x) for x in "abcd"])).otherwise(none)
    return table(spark, d, "part").select("p_partkey", chat.chips(menus, samples, terms).alias("chips"))


_PROMPT_SQL = "CASE i " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chat.PROMPTS.items()) + f" ELSE '{chat.PROMPTS['how_to']}' END"


@query(f"""WITH q AS (SELECT conv_id, turn, {_rules_sql('q', rules.intent_rules(), rules.DEFAULT_INTENT)} AS known, q FROM (SELECT conv_id, turn, {_ASKED} AS q FROM conversations WHERE role = 'user')),
k AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'unheard' ELSE known END AS i FROM q)
SELECT conv_id, turn, md5({_PROMPT_SQL} || chr(10) || chr(10) || 'Context of ' || conv_id || chr(10) || chr(10) || 'Question: ' || q) AS answer_md5 FROM k""")
def answers_generated(spark, d):
    """Prompts by intent, the first one for an unknown intent, through a stand-in that thinks aloud and repeats them."""
    rows = _asked(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, "unheard").otherwise(rules.intent("q")).alias("intent"), F.col("q").alias("question"), F.concat(F.lit("Context of "), F.col("conv_id").cast("string")).alias("context"))
    told = chat.answers(rows, lambda prompt: f"<think>let me see\n{len(prompt)}</think>\n {prompt}\n")
    return told.select("conv_id", "turn", F.md5("answer").alias("answer_md5"))


# --- quality ---


def _recall_mrr(spark, d, hits: DataFrame) -> DataFrame:
    """A hit is relevant if its label is the question's and it is not the first."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("other"))
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("category"))
    hits = hits.join(labels, "id").join(own, "qid")
    ranks = evaluate.first_hit(hits, (F.col("other") == F.col("category")) & (F.col("rn") > 1)).join(own, "qid")
    return _rounded(evaluate.recall_mrr(ranks, "category"), "recall", "mrr")


@query("""WITH s AS (SELECT a.vec_id AS qid, a.label AS category, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rn
FROM embeddings a, embeddings b), r AS (SELECT qid, category, min(CASE WHEN other = category AND rn > 1 THEN rn END) AS rank FROM s WHERE rn <= 6 GROUP BY ALL)
SELECT category, count(*) AS n, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, round(coalesce(sum(1.0 / rank), 0) / count(*), 6) AS mrr FROM r GROUP BY ROLLUP (category)""")
def eval_recall_mrr(spark, d):
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.lit(0).alias("sub"), F.col("embedding").alias("qv"))
    return _recall_mrr(spark, d, retrieve.dense_topk_blocks(asked, _vectors(spark, d), 6))


@query(f"""WITH {_cte_search(1)}, v AS (SELECT 'dense' AS variant, qid, id, dense_score AS s FROM fus UNION ALL SELECT 'lexical', qid, id, bm25_score FROM fus UNION ALL SELECT 'fused', qid, id, fused FROM fus),
k AS (SELECT v.*, row_number() OVER (PARTITION BY variant, qid ORDER BY round(s, 9) DESC, id) AS rn FROM v),
r AS (SELECT variant, qid, min(CASE WHEN d.label = w.label THEN rn END) AS rank FROM k LEFT JOIN embeddings d ON d.vec_id = k.id LEFT JOIN embeddings w ON w.vec_id = k.qid WHERE rn <= 6 GROUP BY ALL)
SELECT variant, count(*) AS n, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, round(coalesce(sum(1.0 / rank), 0) / count(*), 6) AS mrr FROM r GROUP BY variant""")
def eval_ablations(spark, d):
    """Either retriever alone and both; a hit is relevant if it has the question's label."""
    work = Workspace(spark, "ablations")
    pool = work.save("pool", _pool(spark, d, 1))
    label = table(spark, d, "embeddings").select("vec_id", "label")
    pool = pool.join(label.toDF("id", "held"), "id", "left").join(label.toDF("qid", "asked"), "qid", "left")
    runs = {name: retrieve.top(pool, ["qid"], column, 6) for name, column in (("dense", "dense_score"), ("lexical", "bm25_score"), ("fused", "fused"))}
    return _rounded(evaluate.ablations(runs, F.col("held") == F.col("asked")), "recall", "mrr")


@query("SELECT source AS book, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END), 6) AS with_terms, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS with_figures FROM documents GROUP BY ROLLUP (source)")
def chunk_stats(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "documents").select(F.col("source").alias("book"), "n_chars", F.when(F.col("lang") == "en", F.array("lang")).otherwise(none).alias("alias_terms"), F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(none).alias("figures"))
    return _rounded(evaluate.chunk_stats(rows), "mean_chars", "with_terms", "with_figures")


@query("""SELECT coalesce(l.path, b.path) AS path, l.live, b.built FROM (SELECT doc_id AS path, lang AS live FROM documents WHERE doc_id % 7 <> 0) l
FULL JOIN (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS built FROM documents WHERE doc_id % 11 <> 0) b ON b.path = l.path WHERE l.live IS DISTINCT FROM b.built""")
def stale_pages(spark, d):
    docs = table(spark, d, "documents")
    live = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.col("lang").alias("published"))
    built = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("published"))
    return evaluate.stale(live, built)


@query(f"WITH a AS (SELECT {_rules_sql('q', rules.intent_rules(), rules.DEFAULT_INTENT)} AS found, CASE WHEN turn % 8 = 2 THEN 'what_is' WHEN turn % 8 = 1 THEN 'where_is_it' END AS expected FROM (SELECT turn, {_ASKED} AS q FROM conversations WHERE role = 'user')) SELECT count(*) AS n, round(avg(CASE WHEN found = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a WHERE expected IS NOT NULL")
def intent_accuracy(spark, d):
    expected = F.when(F.col("turn") % 8 == 2, "what_is").when(F.col("turn") % 8 == 1, "where_is_it")
    return _rounded(evaluate.intent_accuracy(_asked(spark, d), rules.intent("q"), expected), "accuracy")


@query("SELECT source AS book, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS sum_chars, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars FROM documents GROUP BY ROLLUP (source)")
def corpus_summary(spark, d):
    return _rounded(evaluate.summary(table(spark, d, "documents").withColumnRenamed("source", "book"), "book", "n_chars"), "mean_chars")


@query("""SELECT name, n, tolerance, n <= tolerance AS ok FROM (SELECT 'empty' AS name, count(*) FILTER (WHERE coalesce(text, '') = '') AS n, 25 AS tolerance FROM documents
UNION ALL SELECT 'no_source', count(*) FILTER (WHERE coalesce(source, '') = ''), 0 FROM documents UNION ALL SELECT 'short', count(*) FILTER (WHERE n_chars < 200), 40 FROM documents)""")
def health_checks(spark, d):
    checks = {"empty": (F.coalesce("text", F.lit("")) == "", 25), "no_source": (F.coalesce("source", F.lit("")) == "", 0), "short": (F.col("n_chars") < 200, 40)}
    return evaluate.health(table(spark, d, "documents"), checks)


@query("SELECT count(*) AS n, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS n_ok, sum(CASE WHEN event_type <> 'error' AND user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_cached, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_failed, sum(CASE WHEN event_type <> 'error' THEN event_id % 1000 END)::BIGINT AS sum_bytes FROM events")
def crawl_outcomes(spark, d):
    log = table(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 2 == 0).alias("from_cache"), (F.col("event_id") % 1000).alias("n_bytes"))
    return evaluate.outcomes(log)


@query("SELECT DISTINCT user_id AS path FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def fetch_worklist(spark, d):
    from tarnfield.sources.cache import to_fetch

    events = table(spark, d, "events")
    return to_fetch(events.select(F.col("user_id").alias("path")), events.where("event_id % 50 = 0").select(F.col("user_id").alias("path")))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    from tarnfield.streaming.incremental import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
