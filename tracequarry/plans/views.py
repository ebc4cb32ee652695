"""How the driver's tables stand in for rollouts, tokens and steps; each view in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.session import table

ROLLOUTS_SQL = "rollouts AS (SELECT o_custkey AS uid, o_orderkey AS rid, o_orderpriority AS source, o_orderstatus AS pred, o_totalprice / 997.0 AS score FROM orders)"

TOKENS_SQL = """tokens AS (SELECT l_orderkey AS rid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1)::INT AS pos,
(l_returnflag <> 'N')::INT AS mask, l_discount + 0.0 AS reward, 0.0 - l_tax AS old_logp, 0.0 - l_discount AS logp, l_tax + 0.0 AS value, l_quantity AS qty FROM lineitem)"""

STEPS_SQL = """raw_steps AS (SELECT row_id, data_source, unnest(steps) AS s, unnest(range(len(steps)))::INT AS pos FROM prompted_search_smoke WHERE len(steps) > 0),
steps AS (SELECT row_id, data_source, pos, s.step_id AS step_id, s.tool_type AS tool_type, s.action_text AS action_text, s.evidence_summary AS evidence, s.success AS success, s.action_span AS action_span, s.raw_observation AS obs FROM raw_steps WHERE s IS NOT NULL)"""


def rollouts(s: SparkSession, d: str) -> DataFrame:
    """(uid, rid, source, pred, score): one row per rollout, grouped by prompt."""
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("rid"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("pred"), (F.col("o_totalprice") / 997.0).alias("score")
    )


def tokens(s: SparkSession, d: str) -> DataFrame:
    """(rid, pos, mask, reward, old_logp, logp, value, qty): one row per response token."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("rid"),
        (F.row_number().over(w) - 1).alias("pos"),
        (F.col("l_returnflag") != "N").cast("int").alias("mask"),
        (F.col("l_discount") + 0.0).alias("reward"),
        (F.lit(0.0) - F.col("l_tax")).alias("old_logp"),
        (F.lit(0.0) - F.col("l_discount")).alias("logp"),
        (F.col("l_tax") + 0.0).alias("value"),
        F.col("l_quantity").alias("qty"),
    )


def steps(s: SparkSession, d: str) -> DataFrame:
    """(row_id, data_source, pos, step fields, obs): one row per non-null step of a rollout."""
    raw = table(s, d, "prompted_search_smoke").select("row_id", "data_source", F.posexplode("steps").alias("pos", "s")).where("s is not null")
    return raw.select("row_id", "data_source", "pos", "s.step_id", "s.tool_type", "s.action_text", F.col("s.evidence_summary").alias("evidence"), "s.success", "s.action_span", F.col("s.raw_observation").alias("obs"))


def rollout_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prompted_search_smoke")


def spanned_steps(s: SparkSession, d: str) -> DataFrame:
    """(row_id, final_correct, n_tokens, tool_type, first, last): the span of every non-null step; n_tokens, the tokens of
    the rollout, are the greatest end of its spans."""
    end = lambda x: F.try_element_at(x["action_span"], F.lit(2))
    raw = rollout_rows(s, d).select("row_id", "final_correct", F.array_max(F.transform("steps", end)).alias("n_tokens"), F.explode("steps").alias("s")).where("s is not null")
    return raw.select("row_id", "final_correct", "n_tokens", "s.tool_type", F.try_element_at("s.action_span", F.lit(1)).alias("first"), F.try_element_at("s.action_span", F.lit(2)).alias("last"))
