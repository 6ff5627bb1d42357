"""Batched hybrid retrieval: a table of questions in, a table of hits out.

Rankings are windows per question with an explicit tie-break (score rounded to
9 places, then id). Scores of a sub-query and retriever are levelled to 0..1
over its own top ``k``, so ``k`` is part of the meaning; filters come after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.rules import page_type_weight
from tarnfield.functions.text import tokens
from tarnfield.operators.index import LexicalIndex
from tarnfield.plans.workspace import ship
from tarnfield.plugins import Reranker, reranked
from tarnfield.settings import Settings

MOST_BROADCAST = 20_000  # questions of at most so many rows are broadcast against the vectors
BLOCK = 4096  # questions, and vectors, that are multiplied with each other at once, about


def top(rows: DataFrame, by: list[str], score: str, k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` of each group of ``by``, ranked from 1."""
    order = Window.partitionBy(*by).orderBy(F.round(F.col(score), 9).desc(), F.col("id").asc())
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def sub_queries(questions: DataFrame, *texts: Column) -> DataFrame:
    """qid, sub, q: the distinct non-blank texts of a question in order."""
    kept = F.array_distinct(F.filter(F.array(*texts), lambda t: t.isNotNull() & (F.trim(t) != "")))
    return questions.select("qid", F.posexplode(kept).alias("sub", "q"))


def bm25_scores(queries: DataFrame, index: LexicalIndex, settings: Settings = Settings()) -> DataFrame:
    """qid, sub, id, score over all matches. Query terms are counted before they meet the postings."""
    wanted = queries.select("qid", "sub", F.explode(tokens("q")).alias("term")).groupBy("qid", "sub", "term").agg(F.count("*").alias("qtf"))
    hits = index.postings.join(wanted.join(index.terms.select("term", "idf"), "term"), "term")
    norm = F.lit(settings.k1) * (F.lit(1 - settings.b) + F.lit(settings.b) * F.col("dl") / F.lit(index.mean_length))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(settings.k1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("qid", "sub", "id").agg(F.sum(part).alias("score"))


def bm25_topk(queries: DataFrame, index: LexicalIndex, k: int, settings: Settings = Settings()) -> DataFrame:
    return top(bm25_scores(queries, index, settings), ["qid", "sub"], "score", k).where("score > 0")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of each row, the first columns at a tie."""
    least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
    above, ties = score > least, score == least
    return np.nonzero(above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True))))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, sub, id, score, rn: every question (qid, sub, qv) against every vector (id, v), exhaustively; null vectors match nothing.

    Up to ``MOST_BROADCAST`` questions go to all tasks as one matrix; each
    multiplies it with its vectors and gives the best ``k`` of its batches, so no
    vector is moved. More questions meet the vectors block by block.
    """
    asked = queries.where("qv is not null").select("qid", "sub", "qv")
    told = asked.limit(MOST_BROADCAST + 1).toArrow()
    if told.num_rows > MOST_BROADCAST:
        return dense_topk_blocks(asked, vectors.where("v is not null"), k)
    kinds = dict(asked.dtypes) | dict(vectors.dtypes)
    schema = f"qid {kinds['qid']}, sub {kinds['sub']}, id {kinds['id']}, score double"
    if not told.num_rows:
        return queries.sparkSession.createDataFrame([], schema + ", rn int")
    ship(queries.sparkSession)
    matrix = np.array(told.column("qv").to_pylist(), np.float64)
    given = queries.sparkSession.sparkContext.broadcast((told.select(["qid", "sub"]).combine_chunks(), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = given.value
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("id")
            v = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(v):
                continue
            exact = q @ v.T
            row, col = _best(np.round(exact, 9), k)
            told = names.take(pa.array(row))
            columns = [told.column("qid").combine_chunks(), told.column("sub").combine_chunks(), batch.column("id").take(pa.array(col)).combine_chunks(), pa.array(exact[row, col])]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "sub", "id", "score"])

    found = vectors.where("v is not null").select("id", "v").mapInArrow(run, schema)
    return top(found, ["qid", "sub"], "score", k)


def dense_topk_blocks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """As ``dense_topk``, for about as many questions as vectors: every block of questions meets every block of vectors as matrices, and gives the best ``k`` of the block for each question."""
    ship(queries.sparkSession)
    many = [-(-max(1, side.count()) // BLOCK) for side in (queries, vectors)]
    deal = [F.pmod(F.xxhash64("qid", "sub"), F.lit(many[0])), F.pmod(F.xxhash64("id"), F.lit(many[1]))]
    numbers = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in many]
    asked = queries.select("qid", "sub", "qv", deal[0].alias("_q"), numbers[1].alias("_v"))
    given = vectors.select("id", "v", deal[1].alias("_v"), numbers[0].alias("_q"))
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    schema = f"qid {kinds['qid']}, sub {kinds['sub']}, id {kinds['id']}, score double"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a hash may leave a block empty
            return pa.table({"qid": left.column("qid")[:0], "sub": left.column("sub")[:0], "id": right.column("id")[:0], "score": np.zeros(0)})
        right = right.sort_by("id")
        q, v = (np.array(t.column(c).to_pylist(), np.float64).reshape(t.num_rows, -1) for t, c in ((left, "qv"), (right, "v")))
        rows, cols, scores = [], [], []
        for a in range(0, len(q), 256):
            exact = q[a : a + 256] @ v.T
            row, col = _best(np.round(exact, 9), k)
            rows, cols, scores = [*rows, row + a], [*cols, col], [*scores, exact[row, col]]
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table({"qid": left.column("qid").take(row), "sub": left.column("sub").take(row), "id": right.column("id").take(col), "score": np.concatenate(scores)})

    found = asked.groupBy("_q", "_v").cogroup(given.groupBy("_q", "_v")).applyInArrow(best, schema)
    return top(found, ["qid", "sub"], "score", k)


def level(rows: DataFrame, by: list[str], score: str = "score", to: str = "norm") -> DataFrame:
    """Min-max of the score within each group; all 1 where it hardly varies."""
    group = Window.partitionBy(*by)
    lo, hi = F.min(score).over(group), F.max(score).over(group)
    return rows.withColumn(to, F.when(hi - lo < 1e-12, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def pooled(dense: DataFrame, bm25: DataFrame) -> DataFrame:
    """qid, id with the best levelled score of each retriever over the sub-queries and the best raw cosine, 0 where missing; one shuffle for both sides."""
    sides = level(dense, ["qid", "sub"]).select("qid", "id", F.col("norm").alias("d"), F.lit(None).cast("double").alias("l"), F.col("score").alias("c"))
    sides = sides.unionByName(level(bm25, ["qid", "sub"]).select("qid", "id", F.lit(None).cast("double").alias("d"), F.col("norm").alias("l"), F.lit(None).cast("double").alias("c")))
    return sides.groupBy("qid", "id").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("dense_score"), F.coalesce(F.max("l"), F.lit(0.0)).alias("bm25_score"), F.greatest(F.coalesce(F.max("c"), F.lit(0.0)), F.lit(0.0)).alias("dense_cosine"))


def fused(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return scores.withColumn("fused", F.lit(settings.weight_dense) * F.col("dense_score") + F.lit(settings.weight_bm25) * F.col("bm25_score"))


def boosted(rows: DataFrame, base: str, settings: Settings = Settings()) -> DataFrame:
    """``boost`` and ``score`` from ``intent``, ``page_type`` and ``book``."""
    weight = page_type_weight("intent", "page_type")
    if settings.script_books:
        weight = F.when((F.col("intent") == "scripting") & F.col("book").isin(*settings.script_books), F.greatest(weight, F.lit(1.0))).otherwise(weight)
    return rows.withColumn("boost", F.lit(settings.page_type_boost) * weight).withColumn("score", F.col(base) + F.col("boost"))


def search(
    questions: DataFrame,
    queries: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    chunks: DataFrame,
    k: int | None = None,
    books: list[str] | None = None,
    page_types: list[str] | None = None,
    reranker: Reranker | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Hits of each question: qid, rn, id and all component scores.

    ``questions``: qid, question, intent. ``queries``: qid, sub, q, qv (a null
    vector has no dense side). ``chunks``: id, book, page_type and, for a
    reranker, passage. Filters apply to the pool, after the top ``k_per_query``,
    and the pool is cut to ``rerank_candidates`` with or without reranking.
    """
    dense = dense_topk(queries.where("qv is not null"), vectors, settings.k_per_query)
    lexical = bm25_topk(queries, index, settings.k_per_query, settings)
    pool = fused(pooled(dense, lexical), settings).join(chunks, "id")
    if books:
        pool = pool.where(F.col("book").isin(books))
    if page_types:
        pool = pool.where(F.col("page_type").isin(page_types))
    pool = top(pool, ["qid"], "fused", settings.rerank_candidates, "candidate").join(questions, "qid")
    base = "fused"
    if reranker is not None:
        pool = pool.withColumn("rerank_score", reranked(F.col("question"), F.substring("passage", 1, settings.rerank_max_chars), reranker))
        pool, base = level(pool, ["qid"], "rerank_score", "base"), "base"
    else:
        pool = pool.withColumn("rerank_score", F.lit(0.0))
    final = top(boosted(pool, base, settings), ["qid"], "score", k or settings.k_final)
    return final.select("qid", "rn", "id", "score", "dense_score", "bm25_score", "dense_cosine", "rerank_score", "boost")


def top_relevance(questions: DataFrame, hits: DataFrame, by_rerank: bool = False, settings: Settings = Settings()) -> DataFrame:
    """qid, top_relevance (of the first hit; minus infinity without hits) and weak."""
    floor = settings.rerank_floor if by_rerank else settings.cosine_floor
    best = hits.where("rn = 1").select("qid", F.col("rerank_score" if by_rerank else "dense_cosine").alias("_top"))
    out = questions.select("qid").join(best, "qid", "left").select("qid", F.coalesce("_top", F.lit(float("-inf"))).alias("top_relevance"))
    return out.withColumn("weak", F.col("top_relevance") < floor)


def with_retry(first: DataFrame, wider: DataFrame, weak: DataFrame) -> DataFrame:
    """Hits of the first pass, or of the wider one for questions that ``weak`` marks."""
    marked = weak.where("weak").select("qid")
    return first.join(marked, "qid", "left_anti").unionByName(wider.join(marked, "qid", "left_semi"))


def first_figures(hits: DataFrame, k: int | None = None) -> DataFrame:
    """qid, at, figure: distinct figures by source in rank order (hits: qid, rn, figures)."""
    each = hits.select("qid", "rn", F.posexplode("figures").alias("pos", "figure"))
    first = Window.partitionBy("qid", "figure.src").orderBy("rn", "pos")
    kept = each.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    out = kept.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("rn", "pos")))
    return (out.where(F.col("at") <= k) if k else out).select("qid", "at", "figure")


def citation(breadcrumb: Column, book: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(breadcrumb, " > "), F.lit("")), F.nullif(book, F.lit("")), title)
