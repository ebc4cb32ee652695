"""Offline relabelling of rollouts: gains of every step against counterfactual observations, returns, edge rows.

Contexts are the question and the action and observation lines up to a step; a counterfactual context has another
step's evidence in that step's place. The gain of a step is scored on the first gold answer, that of an edge on the
next action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.operators import stepreward as S
from tracequarry.operators.typedpool import FIELDS, typed_counterfactuals

# Evidence of a masked counterfactual by tool; any other tool has the last one.
MASKED = {
    "stop": "Low-information context: no reliable evidence available.",
    "crop": "bbox=[0, 0, 1, 1] crop_path= visual=neighboring uninformative region",
    "ocr": "OCR text: [masked similar-length text]",
    "image_search": "1. image_id=masked caption=unrelated visual result score=0",
}
_MASKED_ELSE = "1. masked result: unrelated search result with similar format"


def relabelled_steps(df: DataFrame, gate: Column, cf_samples: int = 2, lam: float = 0.5, alpha: float = 0.4, beta: float = 0.2, gamma: float = 0.05) -> DataFrame:
    """(row, pos, tool, evidence, g, d, ret, total): local gain, gain of the edge to the next step (0 for the last),
    return and total of every step.

    ``df`` has row, pos, question, target and the columns of the typed pool; ``gate`` is the gate reward.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    masked = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MASKED.items() for x in kv]), F.col("tool")), F.lit(_MASKED_ELSE))
    cf = typed_counterfactuals(df.select(*FIELDS), cf_samples).select("key", "other", "rank")
    cf = cf.join(df.select(F.col("key").alias("other"), text("evidence").alias("_e"), F.lit(True).alias("_there")), "other", "left")
    cf = cf.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "_e"))).alias("cf"))
    action = F.concat(F.lit("Action["), F.col("pos"), F.lit(":"), text("tool"), F.lit("]: "), text("action"), F.lit("\nObservation["), F.col("pos"), F.lit("]: "))
    x = S.context_before(df.withColumn("_gate", gate), "row", "pos", F.concat(action, text("evidence")), "_before")
    by_row = W.partitionBy("row").orderBy("pos")
    x = x.withColumn("_next", F.lead(F.coalesce(F.nullif("action", F.lit("")), "tool")).over(by_row)).withColumn("_last", F.lead("pos").over(by_row).isNull())
    x = x.withColumn("_head", F.concat(F.lit("Question: "), text("question"), F.lit("\n"), F.col("_before"), F.lit("\n"), action)).join(cf, "key")
    real = lambda target: S.lexical_logprob(F.concat("_head", text("evidence")), F.col(target))
    against = lambda target: F.aggregate(F.transform("cf", lambda c: S.lexical_logprob(F.concat(F.col("_head"), F.coalesce(c["_e"], masked)), F.col(target))), F.lit(0.0), lambda a, v: a + v) / F.lit(float(cf_samples))
    x = x.withColumn("g", S.local_gain(real("target"), against("target"))).withColumn("d", F.when(F.col("_last"), 0.0).otherwise(S.future_gain(real("_next"), against("_next"))))
    x = S.step_total(S.propagated(x, "g", F.col("d"), lam, key="row"), "ret", F.col("_gate"), "tool", alpha, beta, gamma)
    return x.select("row", "pos", "tool", "evidence", "g", "d", "ret", "total")


def edge_rows(steps: DataFrame, rollouts: DataFrame, least: float = 0.02) -> DataFrame:
    """One row per rollout with a step: steps 0 and 1 (2) as columns, the edge tests, and whether it is selected for
    dependency training. ``steps`` as ``relabelled_steps`` gives them with pos counted from 0 without gaps;
    ``rollouts`` has row and golds. What a rollout without the step lacks is 0, false or a null tool."""
    at = lambda p, c: F.max(F.when(F.col("pos") == p, F.col(c)))
    e = steps.groupBy("row").agg(*[F.coalesce(at(p, c), F.lit(0.0)).alias(n) for p, c, n in ((0, "g", "g0"), (1, "g", "g1"), (2, "g", "g2"), (0, "d", "d01"), (1, "d", "d12"), (0, "ret", "r0"), (1, "ret", "r1"), (0, "total", "total0"), (1, "total", "total1"))], at(0, "tool").alias("tool0"), at(1, "tool").alias("tool1"), at(0, "evidence").alias("_e0"), at(1, "evidence").alias("_e1"))
    holds = lambda c: F.coalesce(F.exists("golds", lambda a: F.coalesce((a != "") & F.lower(c).contains(F.lower(a)), F.lit(False))), F.lit(False))
    e = e.join(rollouts.select("row", "golds"), "row").withColumn("answer0", holds("_e0")).withColumn("answer1", holds("_e1")).drop("_e0", "_e1", "golds")
    e = e.withColumn("r0_minus_g0", F.col("r0") - F.col("g0")).withColumn("active", F.col("d01") > least)
    e = e.withColumn("eligible", F.col("active") & (F.col("g1") > 0))
    return e.withColumn("selected", F.col("eligible") & ~F.col("answer0"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """One row of rates and means over all edges and the selected ones; means of none are 0."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    chosen = lambda c: F.coalesce(F.avg(F.when(F.col("selected"), F.col(c))), F.lit(0.0))
    cols = [("selected", rate("selected")), ("active", rate("active")), ("eligible", rate("eligible")), ("answer0", rate("answer0")), ("answer1", rate("answer1")), *[(f"{c}_mean", F.avg(c)) for c in ("g0", "g1", "d01", "r0_minus_g0")], *[(f"selected_{c}_mean", chosen(c)) for c in ("d01", "r0_minus_g0")]]
    return edges.agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("selected_n"), *[F.round(c, 6).alias(n) for n, c in cols])


def reward_figures(steps: DataFrame) -> DataFrame:
    """(figure, a, b, v): the mean total by tool, and the 2 x 2 matrix of the greatest edge gain of steps 0 and 1, whose
    edges all lead to column 1."""
    tools = steps.groupBy(F.coalesce("tool", F.lit("unknown")).alias("a")).agg(F.avg("total").alias("v")).select(F.lit("reward_by_tool").alias("figure"), "a", F.lit(None).cast("string").alias("b"), "v")
    best = steps.agg(*[F.coalesce(F.greatest(F.max(F.when(F.col("pos") == p, F.col("d"))), F.lit(0.0)), F.lit(0.0)).alias(f"d{p}") for p in (0, 1)])
    cells = best.select(F.explode(F.array(*[F.struct(F.lit(str(i)).alias("a"), F.lit(str(j)).alias("b"), (F.col(f"d{i}") if j else F.lit(0.0)).alias("v")) for i in (0, 1) for j in (0, 1)])).alias("c"))
    return tools.unionByName(cells.select(F.lit("edge_matrix").alias("figure"), "c.a", "c.b", "c.v")).withColumn("v", F.round("v", 6))
