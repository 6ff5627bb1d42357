"""Conversations: routing, follow-ups, history, context within a budget, and what an answer shows.

A conversation is a table (conv_id, turn, role, text); each step is a window
over a conversation's own turns, so all conversations go in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.rules import intent, needs_expansion, route
from tarnfield.settings import Settings

HISTORY, CLIP, SHOWN = 6, 400, 5

# Prompts by intent; an unknown intent uses how_to.
PROMPTS = {
    "how_to": "Give numbered steps with the menu path first. Use only the excerpts and cite them as [n].",
    "what_is": "Define the feature in two or three sentences, then say when to use it. Use only the excerpts and cite them as [n].",
    "interpret": "Explain what each part of the output means and how to read it. Use only the excerpts and cite them as [n].",
    "option_lookup": "List the option, where it is and what it changes. Use only the excerpts and cite them as [n].",
    "example": "Walk through the example and name the sample data. Use only the excerpts and cite them as [n].",
    "scripting": "Show code in a fence and explain its arguments. Use only the excerpts and cite them as [n].",
    "where_is_it": "Name the exact menu path. Use only the excerpts and cite them as [n].",
    "troubleshoot": "List likely causes and a check for each. Use only the excerpts and cite them as [n].",
}


def system_prompt(intent_: Column) -> Column:
    flat = [F.lit(x) for kv in PROMPTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), intent_), F.lit(PROMPTS["how_to"]))


def user_turns(turns: DataFrame) -> DataFrame:
    """User turns with their number in the conversation (``n_user``) and the user's turn before (``previous``)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    mine = turns.where("role = 'user'")
    return mine.withColumns({"n_user": F.row_number().over(order), "previous": F.lag("text").over(order)})


def classified(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """User turns with route and intent; a given ``intent`` column wins."""
    own = F.col("intent") if "intent" in turns.columns else F.lit(None).cast("string")
    return turns.withColumns({"route": route("text"), "intent": F.coalesce(own, intent("text", settings.script_name))})


def expanded(turns: DataFrame, extra: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """Output of ``user_turns`` plus ``queries``: the question, joined to the one before where it needs it, and lines of a rewriter."""
    text = F.col("text")
    follow = F.when(needs_expansion(text, F.col("n_user")) & F.col("previous").isNotNull(), F.concat("previous", F.lit(" "), text))
    found = F.array(text, follow) if extra is None else F.concat(F.array(text, follow), extra)
    return turns.withColumn("queries", F.slice(F.array_distinct(F.filter(found, lambda q: q.isNotNull() & (q != ""))), 1, settings.query_cap))


def history(turns: DataFrame, limit: int = HISTORY, clip: int = CLIP) -> DataFrame:
    """conv_id, history: the last turns, one line each."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit)
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, clip))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def context_block(rn: Column, title: Column, context: Column, text: Column, menu_paths: Column | None = None) -> Column:
    head = F.concat(F.lit("["), rn.cast("string"), F.lit("] "), title, F.lit(" - "), context)
    if menu_paths is not None:
        head = F.when(F.size(menu_paths) > 0, F.concat(head, F.lit("\n    Menu: "), F.array_join(F.slice(menu_paths, 1, 3), "; "))).otherwise(head)
    return F.concat(head, F.lit("\n"), text)


def context(blocks: DataFrame, budget: int = Settings.max_context_chars) -> DataFrame:
    """key, context: blocks (key, rn, block) in order while they fit; the one that overflows is cut, later ones go."""
    before = Window.partitionBy("key").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    used = blocks.withColumn("used", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0))).where(F.col("used") < budget)
    cut = used.withColumn("block", F.substring(F.col("block"), F.lit(1), (F.lit(budget) - F.col("used")).cast("int")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "block"))), lambda x: x["block"])
    return cut.groupBy("key").agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("n_blocks"))


def collected(hits: DataFrame, column: str, limit: int = SHOWN) -> DataFrame:
    """qid and the distinct values of a list column over hits in rank order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(column).alias("v")))), lambda x: x["v"])
    return hits.groupBy("qid").agg(F.slice(F.array_distinct(F.flatten(lists)), 1, limit).alias(column))


def sources(hits: DataFrame, clip: int = 420) -> DataFrame:
    """Citation lines: qid, rn, line, snippet (hits: title, page_type, citation, text)."""
    snippet = F.concat(F.substring("text", 1, clip), F.when(F.length("text") > clip, "...").otherwise(""))
    return hits.select("qid", "rn", F.concat(F.lit("["), F.col("rn").cast("string"), F.lit("] "), "title").alias("line"), "citation", F.replace(snippet, F.lit("\n"), F.lit(" ")).alias("snippet"))


def chips(menu_paths: Column, samples: Column, terms: Column) -> Column:
    bit = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"**{name}:** "), F.array_join(F.transform(F.slice(xs, 1, 3), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), " · ")))
    return F.array_join(F.array_compact(F.array(bit("Menu", menu_paths), bit("Sample data", samples), bit("Also called", terms))), "  \n")


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id, transcript: questions as headings, answers below."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return turns.where("role in ('user', 'assistant')").groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("transcript"))


def answers(rows: DataFrame, generator) -> DataFrame:
    """``rows`` (intent, context, question) plus answer, by a plug-in."""
    from tarnfield.plugins import generated

    prompt = F.concat(system_prompt(F.col("intent")), F.lit("\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return rows.withColumn("answer", generated(prompt, generator))


def stream(rows: DataFrame, column: str = "answer"):
    """Finished answers word by word, then the row itself."""
    for row in rows.toLocalIterator():
        for word in (row[column] or "").split(" "):
            yield "token", word
        yield "done", row
