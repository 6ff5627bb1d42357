"""The pipeline's stages, each against plain rules on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """name to (input, output), written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "  ", "en", "src1", 2), (90003, "%% 12 $$", "en", "src1", 8)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{folder}/{name}")
        found = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, found)
        docs = found
    return out


def test_all_but_the_last_return_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tuple(stages[name][1].columns) == corpus_pipeline.COLUMNS


def test_language_keeps_clean_documents(stages):
    given, kept = stages["language_id"]
    gone = {r["doc_id"] for r in given.join(kept, "doc_id", "left_anti").collect()}
    assert {90001, 90002, 90003} <= gone and len(gone) <= 5


def test_one_document_of_each_near_group_stays(stages):
    given, kept = stages["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    from test_operators import brute_components

    want = {c for _, n, c in brute_components(rows, 5, 80)}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)


def test_repeats_go(stages):
    from test_operators import brute_dedup

    given, kept = stages["repeated_passages"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    cut = {i: n - gone for i, n, gone, _ in brute_dedup(rows) if gone}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    original = dict(rows)
    for i, left in cut.items():
        assert (len(texts[i].split()) == left) if left else i not in texts
    assert all(texts[i] == t for i, t in original.items() if i not in cut)


def test_mix_repeats_within_bounds(stages):
    given, mixed = stages["mix_sources"]
    times = mixed.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 3
    assert mixed.join(given, "doc_id", "left_anti").count() == 0


def test_pieces_are_of_the_mixed_texts(stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    mixed, pieces = stages["encode_pieces"]
    peer = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = pieces.collect()
    assert len(rows) == mixed.count() and all(list(r["ids"]) == peer.encode(texts[r["doc_id"]]) for r in rows[:80])


def test_unlike_documents_of_one_id_both_stay(spark, small):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a + " more", "en", "s", 1), (2, a, "en", "s", 1), (1, b, "en", "s", 1), (3, b, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect())
    assert kept == [(1, "a"), (1, "b")]


def odd_rows(spark, small):
    """Documents with nulls in every column, empty, letterless and long texts, repeated rows and ids, and columns named like ours."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    sample = [r["text"] for r in docs.where("lang = 'en' and n_chars > 300").orderBy("doc_id").limit(2).collect()]
    fresh = " ".join(f"the and of ing{i} tion{i}" for i in range(12))
    rows = [(9001, fresh, "en", None, None), (9001, fresh, "en", None, None), (None, "other the and of with " * 3 + sample[0][:100], None, "s", 3), (9002, None, None, None, None), (9003, "", "en", "s", 0), (9004, "%% 12", "en", "s", 5), (9005, (sample[1] + " ") * 40, "en", "s", 9)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("size", "taken", "first", "tid", "kept", "n_words", "_k1", "_copies", "lang_id", "ids", "root", "_text"):
        odd = odd.withColumn(name, F.lit("clash"))
    return odd


def test_stages_take_odd_rows_and_empty_tables(spark, small):
    odd = odd_rows(spark, small)
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0
        out = stage(spark, odd, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        count[name] = {}
        for r in out.collect():
            count[name][r["doc_id"]] = count[name].get(r["doc_id"], 0) + 1
    kept = {name: [c.get(i, 0) for i in (9001, None, 9002, 9003, 9004, 9005)] for name, c in count.items()}
    assert kept["language_id"] == [2, 1, 0, 0, 0, 1]
    assert kept["near_duplicates"] == [1, 1, 1, 1, 1, 0]  # 9005 repeats one of the documents over and over, which adds no shingle
    assert kept["repeated_passages"] == [0, 1, 1, 1, 1, 0]
    assert kept["mix_sources"][2:4] == [0, 0] and all(n <= 6 for n in kept["mix_sources"])
    assert kept["encode_pieces"] == [2, 1, 1, 1, 1, 1]


def test_pieces_are_decoded(spark, small):
    import hashlib

    texts = ["One  two, drei \u00fc.\n", "lost \u2581 mark", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["round_trip"], r["decoded_sha256"]) for r in corpus_pipeline.encode_pieces(spark, docs, small).collect()}
    assert got == {i: (i != 1, hashlib.sha256((t or "").replace("\u2581", " ").encode()).hexdigest()) for i, t in enumerate(texts)}
