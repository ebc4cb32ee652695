"""Scripted search rollouts: decide, repair, retrieve, answer, stop. The policy's first action is a column; models are not
run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action texts that stand for no action.
PLACEHOLDER_ACTIONS = ("", "query", "answer", "final answer", "visual query", "current image")
SEARCHES = ("text_search", "image_search")


def direct_answer(question: Column, known: dict[str, str]) -> Column:
    """The answer of the first keyword in the question, else "unknown"."""
    out = F.lit("unknown")
    for word, answer in reversed(known.items()):
        out = F.when(F.contains(F.lower(question), F.lit(word.lower())), answer).otherwise(out)
    return out


def decided(df: DataFrame, known: dict[str, str], default: str = "text_search") -> DataFrame:
    """(columns of df, direct, tool, action, invalid): the first action after the rules.

    df has question, needs_search, policy_tool and policy_action. A question that needs no search and has a direct answer
    stops with it; a policy that stops without an answer where search is needed searches for the question; an unknown tool
    searches for the question and counts as invalid; a placeholder query becomes the question, a placeholder answer
    "unknown" (invalid). A null tool is unknown, a null question empty.
    """
    q, tool, text = F.coalesce("question", F.lit("")), F.coalesce("policy_tool", F.lit("")), F.trim(F.coalesce("policy_action", F.lit("")))
    x = df.withColumn("direct", direct_answer(q, known)).withColumn("_needs", F.coalesce("needs_search", F.col("direct") == "unknown"))
    at_once = ~F.col("_needs") & (F.col("direct") != "unknown")
    forced = (tool == "stop") & F.col("_needs") & text.isin("", "unknown")
    strange = ~tool.isin(*SEARCHES, "stop")
    placeholder = F.lower(text).isin(*PLACEHOLDER_ACTIONS)
    act = lambda t, a, bad: F.struct(t.alias("tool"), a.alias("action"), F.lit(bad).alias("invalid"))
    choice = (
        F.when(at_once, act(F.lit("stop"), F.col("direct"), 0))
        .when(forced, act(F.lit(default), q, 0))
        .when(strange, act(F.lit(default), q, 1))
        .when(tool.isin(*SEARCHES) & placeholder, act(tool, q, 0))
        .when(placeholder, act(F.lit("stop"), F.lit("unknown"), 1))
        .otherwise(act(tool, text, 0))
    )
    return x.withColumn("_c", choice).select(*df.columns, "direct", "_c.tool", "_c.action", "_c.invalid")


def answered(actions: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(columns of actions, answer, steps): ``found`` is (key, rank, doc, answer) of the documents retrieved for the searches.

    A search answers with the first document that has an answer, else directly; then it stops. ``steps`` are the tools with
    their texts and the retrieved documents.
    """
    seen = found.groupBy(key).agg(
        F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("rank"))).alias("_said"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("_docs")
    )
    x = actions.join(seen, key, "left")
    searches = F.col("tool").isin(*SEARCHES)
    none = F.array().cast("array<bigint>")
    x = x.withColumn("answer", F.when(searches, F.coalesce("_said", "direct")).otherwise(F.col("action")))
    step = lambda n, tool, text, docs: F.struct(F.lit(n).alias("step_id"), tool.alias("tool"), text.alias("action"), docs.alias("docs"))
    searched = F.array(step(0, F.col("tool"), F.col("action"), F.coalesce("_docs", none)), step(1, F.lit("stop"), F.col("answer"), none))
    return x.withColumn("steps", F.when(searches, searched).otherwise(F.array(step(0, F.lit("stop"), F.col("answer"), none)))).drop("_said", "_docs")
