"""Every query of the library against its SQL in another engine; those without SQL give rows of a stable schema."""

import pytest
from conftest import rows_of

from tarnfield import catalog
from tarnfield.operators import lookup


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, small, duck):
    got = rows_of(catalog.QUERIES[name](spark, small).toPandas())
    want = rows_of(duck.execute(catalog.SQL[name]).fetchdf())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(name, spark, small):
    found = catalog.QUERIES[name](spark, small)
    assert found.count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_asks_every_vector(spark, small):
    rows = catalog.eval_recall_mrr(spark, small).collect()
    labels = [r["label"] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("label").collect()]
    assert {r["category"]: r["n"] for r in rows} == {None: len(labels)} | {x: labels.count(x) for x in labels}


def test_blocks_find_what_the_join_finds(spark, monkeypatch):
    from tarnfield.operators import retrieve

    monkeypatch.setattr(retrieve, "BLOCK", 2)  # leaves some blocks empty
    given = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    vectors, asked = spark.createDataFrame(given, "id long, v array<float>"), spark.createDataFrame([(i, 0, v) for i, v in given], "qid long, sub int, qv array<float>")
    got, want = (sorted(map(tuple, f(asked, vectors, 6).select("qid", "sub", "id", "score", "rn").collect())) for f in (retrieve.dense_topk_blocks, retrieve.dense_topk))
    assert got == want and len(got) == 360


def test_values_first_seen_late_in_a_turn_are_listed(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "a a a a Bcd"), (1, 1, "user", "e")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["src"] for r in catalog.first_occurrence_distinct(spark, str(tmp_path)).orderBy("at").collect()] == ["a", "bc", "e"]
    assert catalog.answer_collect(spark, str(tmp_path)).first()["shown"] == "a|Bcd|e"


def test_menus_are_looked_up_for_every_question(spark, small):
    asked = {r["item_id"] for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id").collect()}
    assert {r["tid"] for r in catalog.menu_lookup(spark, small).select("tid").collect()} == asked


def under_broadcasts(frame):
    """Lines of the plan below each broadcast."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                yield below


def test_no_menus_are_broadcast_and_alike_ones_are_ranked(spark, small):
    assert not [x for x in under_broadcasts(catalog.menu_lookup(spark, small)) if "_item#" in x or "_desc#" in x]
    menus = spark.createDataFrame([(i, "m", "Big Bolt" if i % 2 else "big bolt", f"m > {i}", "iron", "windows") for i in range(40)] + [(50, "m", "bolt cutter", "m > 50", "", "windows"), (60, "m", "big bolt", "no", "iron", "macos")], "ord long, menu string, item string, menu_path string, description string, platform string")
    tasks = spark.createDataFrame([(1, "big bolt", []), (2, "cutter", ["Bolt"]), (3, "", ["bolt"])], "tid long, task string, terms array<string>")
    found = lookup.find_menu(tasks, menus, 3)
    got = {t: [(r["ord"], r["menu_path"], r["score"]) for r in found.where(f"tid = {t}").orderBy("rn").collect()] for t in (1, 2, 3)}
    assert got[1] == [(i, f"m > {i}", 16.0) for i in range(3)]
    assert got[2] == [(50, "m > 50", 10.0), (0, "m > 0", 4.0), (1, "m > 1", 4.0)]
    assert got[3] == [(i, f"m > {i}", 4.0) for i in range(3)]


def test_help_pages_are_parsed_once_over_all_cores(spark, small):
    plan = catalog.help_pages_chunks(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [record(") == 1
    assert catalog._help_pages(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
