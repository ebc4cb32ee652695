"""Queries of step rewards, trajectories and redacted corpora."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.functions import textnorm as N
from tracequarry.functions.hooks import Toolbox
from tracequarry.operators import stepreward as S
from tracequarry.operators.grouprel import with_group
from tracequarry.operators.typedpool import typed_counterfactuals
from tracequarry.plans.registry import Registry
from tracequarry.plans.textual import collapse, qa, redacted
from tracequarry.plans.views import STEPS_SQL, rollout_rows, spanned_steps, steps
from tracequarry.session import table

R = Registry()
_P = "prompted_search_smoke"
_EV = "ev AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_type AS tool, value / 20.0 - 1 AS g, event_id FROM events)"


def r6(c, name):
    return F.round(c, 6).alias(name)


def ev(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("pos"), F.col("event_type").alias("tool"), (F.col("value") / 20.0 - 1).alias("g"), "event_id")


_COST = "CASE tool_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.TOOL_COSTS.items()) + " ELSE 1.0 END"
R.add("w26_propagated_returns", lambda s, d: S.propagated(ev(s, d), "g", F.lit(0.5), 0.5).select("event_id", r6(F.col("ret"), "ret")), f"WITH {_EV} SELECT event_id, round(g + coalesce(0.5 * 0.5 * greatest(lead(g) OVER (PARTITION BY key ORDER BY pos), 0), 0), 6) AS ret FROM ev")
_SPAN = f"""WITH {STEPS_SQL}, z AS (SELECT row_id, final_correct, list_max(list_transform(steps, lambda x: x.action_span[2])) AS n FROM {_P}),
sp AS (SELECT row_id AS key, tool_type, final_correct, greatest(action_span[1], 0) AS s, least(action_span[2], n) AS e, {_COST}::DOUBLE AS t FROM steps JOIN z USING (row_id)), """
R.add(
    "w27_span_rewards",
    lambda s, d: S.spread_over_tokens(spanned_steps(s, d), "row_id", F.col("first"), F.col("last"), S.tool_cost(F.col("tool_type")), F.col("n_tokens")).select("row_id", "pos", r6(F.col("reward"), "reward")),
    _SPAN + "c AS (SELECT * FROM sp WHERE e > s) SELECT key AS row_id, pos::INT AS pos, round(sum(t / (e - s)), 6) AS reward FROM (SELECT *, unnest(range(s, e)) AS pos FROM c) GROUP BY key, pos",
)
R.add(
    "w34_success_shaping",
    lambda s, d: S.spread_over_tokens(spanned_steps(s, d).where("final_correct and tool_type in ('text_search', 'image_search')"), "row_id", F.col("first"), F.col("last"), F.lit(0.5), F.col("n_tokens")).select("row_id", "pos", r6(F.col("reward"), "bonus")),
    _SPAN + "c AS (SELECT * FROM sp WHERE e > s AND final_correct AND tool_type IN ('text_search', 'image_search')) SELECT key AS row_id, pos::INT AS pos, round(sum(0.5 / (e - s)), 6) AS bonus FROM (SELECT *, unnest(range(s, e)) AS pos FROM c) GROUP BY key, pos",
)
_G = "(CASE WHEN success THEN 1.0 ELSE -0.5 END)"
R.add(
    "w28_step_totals",
    lambda s, d: S.step_total(S.propagated(steps(s, d).withColumn("g", F.when(F.col("obs").isNull(), -0.2).otherwise(F.size("obs") / 5.0 - 0.2)), "g", F.lit(1.0), 0.5, key="row_id"), "ret", F.when(F.col("success"), 1.0).otherwise(-0.5), "tool_type", 1.0, 0.2, 0.1).select("row_id", "pos", r6(F.col("total"), "total")),
    f"WITH {STEPS_SQL}, g AS (SELECT *, coalesce(len(obs) / 5.0 - 0.2, -0.2) AS g FROM steps), r AS (SELECT *, g + coalesce(0.5 * greatest(lead(g) OVER (PARTITION BY row_id ORDER BY pos), 0), 0) AS ret FROM g) SELECT row_id, pos, round(ret + 0.2 * {_G} - 0.1 * {_COST}, 6) AS total FROM r",
)


def _lp(ctx: str, tgt: str) -> str:
    k, w = f"regexp_extract_all(coalesce(lower({ctx}), ''), '[A-Za-z0-9_]+')", f"regexp_extract_all(coalesce(lower({tgt}), ''), '[A-Za-z0-9_]+')"
    hit = f"len(list_filter({w}, lambda t: list_contains({k}, t)))"
    return f"(CASE WHEN len({w}) = 0 THEN 0.0 ELSE ln(0.05 + 0.9 * {hit} / greatest(len({w}), 1)) - 0.02 * (len({w}) - {hit}) END)"


R.add("w31_lexical_logprob", lambda s, d: steps(s, d).select("row_id", "pos", r6(S.lexical_logprob(F.col("evidence"), F.col("action_text")), "lp")), f"WITH {STEPS_SQL} SELECT row_id, pos, round({_lp('evidence', 'action_text')}, 6) AS lp FROM steps")
_NEXT = f"WITH {STEPS_SQL}, n AS (SELECT row_id, pos, {_lp('evidence', 'action_text')} AS a, coalesce(lag({_lp('evidence', 'action_text')}) OVER (PARTITION BY row_id ORDER BY pos), -1.0) AS b FROM steps) "


def gains(s, d):
    x = steps(s, d).withColumn("a", S.lexical_logprob(F.col("evidence"), F.col("action_text")))
    return x.withColumn("b", F.coalesce(F.lag("a").over(W.partitionBy("row_id").orderBy("pos")), F.lit(-1.0)))


R.add("w29_local_gain", lambda s, d: gains(s, d).select("row_id", "pos", r6(S.local_gain(F.col("a"), F.col("b")), "g")), _NEXT + "SELECT row_id, pos, round(greatest(least(CASE WHEN abs(a - b) < 0.02 THEN 0 WHEN a - b < 0 THEN (a - b) * 0.25 ELSE a - b END, 2), -2), 6) AS g FROM n")
R.add("w30_future_gain", lambda s, d: gains(s, d).select("row_id", "pos", r6(S.future_gain(F.col("a"), F.col("b")), "g")), _NEXT + "SELECT row_id, pos, round(least(greatest(CASE WHEN abs(a - b) < 0.02 THEN 0 ELSE a - b END, 0), 2), 6) AS g FROM n")
R.add(
    "w32_context",
    lambda s, d: S.context_before(steps(s, d), "row_id", "pos", F.concat(F.lit("Action["), F.col("pos"), F.lit(":"), F.coalesce("tool_type", F.lit("?")), F.lit("]: "), F.coalesce("action_text", F.lit("")))).select("row_id", "pos", "context"),
    f"WITH {STEPS_SQL} SELECT row_id, pos, coalesce(string_agg('Action[' || pos || ':' || coalesce(tool_type, '?') || ']: ' || coalesce(action_text, ''), chr(10)) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM steps",
)
R.add(
    "w35_support_test",
    lambda s, d: steps(s, d).join(rollout_rows(s, d).select("row_id", "gold_answers"), "row_id").select("row_id", "pos", F.coalesce(F.exists("gold_answers", lambda g: (F.length(N.qa_normalize(g)) >= 3) & N.qa_normalize(F.col("evidence")).contains(N.qa_normalize(g))), F.lit(False)).alias("supported")),
    f"WITH {STEPS_SQL} SELECT s.row_id, s.pos, coalesce(len(list_filter(gold_answers, lambda g: coalesce(length({qa('g')}) >= 3 AND contains({qa('s.evidence')}, {qa('g')}), FALSE))) > 0, FALSE) AS supported FROM steps s JOIN {_P} USING (row_id)",
)
R.add(
    "w36_ablation_variants",
    lambda s, d: ev(s, d).join(F.broadcast(s.createDataFrame([("full", 0.5, 1.0), ("no_future", 0.0, 1.0), ("half", 0.5, 0.5)], "variant string, lam double, alpha double"))).withColumn("nxt", F.lead("g").over(W.partitionBy("variant", "key").orderBy("pos"))).groupBy("variant").agg(
        r6(F.avg(F.col("alpha") * (F.col("g") + F.coalesce(F.col("lam") * F.greatest("nxt", F.lit(0.0)), F.lit(0.0)))), "mean")
    ),
    f"WITH {_EV}, v AS (SELECT * FROM (VALUES ('full', 0.5, 1.0), ('no_future', 0.0, 1.0), ('half', 0.5, 0.5)) v(variant, lam, alpha)), x AS (SELECT variant, alpha, lam, g, lead(g) OVER (PARTITION BY variant, key ORDER BY pos) AS nxt FROM ev, v) SELECT variant, round(avg(alpha * (g + coalesce(lam * greatest(nxt, 0), 0))), 6) AS mean FROM x GROUP BY variant",
)
R.add(
    "w37_next_step_pairs",
    lambda s, d: steps(s, d).select("row_id", "pos", "tool_type", F.lead("tool_type").over(W.partitionBy("row_id").orderBy("pos")).alias("next_tool"), F.lead("pos").over(W.partitionBy("row_id").orderBy("pos")).alias("next_pos")),
    f"WITH {STEPS_SQL} SELECT row_id, pos, tool_type, lead(tool_type) OVER w AS next_tool, lead(pos) OVER w AS next_pos FROM steps WINDOW w AS (PARTITION BY row_id ORDER BY pos)",
)
R.add("w38_overlong_penalty", lambda s, d: table(s, d, "documents").select("doc_id", r6(S.overlong_penalty(F.col("n_chars"), 2000, 500, 1.0), "penalty")), "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 0.0 ELSE round(least(-(n_chars - 1500) / 500 * 1.0, 0), 6) END AS penalty FROM documents")
R.add(
    "w44_resampling_weights",
    lambda s, d: with_group(table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1e5).alias("x")), "o_custkey", t=F.sum(F.pow("x", 2))).select("o_orderkey", F.round(F.pow("x", 2) / F.col("t"), 6).alias("w")),
    "SELECT o_orderkey, round(pow(o_totalprice / 1e5, 2) / sum(pow(o_totalprice / 1e5, 2)) OVER (PARTITION BY o_custkey), 6) AS w FROM orders",
)
R.add(
    "w45_improvement_penalty",
    lambda s, d: ev(s, d).select("event_id", F.when(F.col("g") > F.lag("g", 1, 0.0).over(W.partitionBy("key").orderBy("pos")), 0.0).otherwise(-0.05).alias("r")),
    f"WITH {_EV} SELECT event_id, CASE WHEN g > lag(g, 1, 0.0) OVER (PARTITION BY key ORDER BY pos) THEN 0.0 ELSE -0.05 END::DOUBLE AS r FROM ev",
)
R.add(
    "w46_last_answer_feedback",
    lambda s, d: steps(s, d).groupBy("row_id").agg(F.max_by("action_text", F.when(F.col("tool_type") == "stop", F.col("pos"))).alias("said")).join(rollout_rows(s, d).select("row_id", "gold_answers"), "row_id").select("row_id", N.exact_match(F.col("said"), F.col("gold_answers"), N.alnum_normalize).alias("done")),
    f"WITH {STEPS_SQL}, l AS (SELECT row_id, arg_max(action_text, pos) FILTER (WHERE tool_type = 'stop') AS said FROM steps GROUP BY row_id) SELECT l.row_id, coalesce(len(list_filter(gold_answers, lambda g: coalesce(trim(regexp_replace(lower(g), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')), FALSE))) > 0, FALSE) AS done FROM l JOIN {_P} USING (row_id)",
)
R.add(
    "j09_step_rewards",
    lambda s, d: steps(s, d).select("row_id", "pos", "tool_type").join(steps(s, d).select("row_id", "pos", S.tool_cost(F.col("tool_type")).alias("cost")), ["row_id", "pos"]),
    f"WITH {STEPS_SQL} SELECT a.row_id, a.pos, a.tool_type, b.cost FROM steps a JOIN (SELECT row_id, pos, {_COST}::DOUBLE AS cost FROM steps) b USING (row_id, pos)",
)
R.add(
    "j10_ablation_delta",
    lambda s, d: S.propagated(S.propagated(ev(s, d), "g", F.lit(1.0), 0.5, out="full"), "g", F.lit(1.0), 0.0, out="cut").select("event_id", r6(F.col("full") - F.col("cut"), "delta"), r6(F.lead("g").over(W.partitionBy("key").orderBy("pos")), "next_gain")),
    f"WITH {_EV} SELECT event_id, round(coalesce(0.5 * greatest(lead(g) OVER w, 0), 0), 6) AS delta, round(lead(g) OVER w, 6) AS next_gain FROM ev WINDOW w AS (PARTITION BY key ORDER BY pos)",
)


def observed(s, d):
    """One key per step with an observation: its tool, number of items and length."""
    x = steps(s, d).where("obs is not null")
    return x.select((F.col("row_id") * 100 + F.col("pos")).alias("key"), F.col("tool_type").alias("tool"), F.size("obs").alias("items"), F.length(F.coalesce("evidence", F.lit(""))).alias("size"), F.col("action_text").alias("text"))


R.add(
    "j08_counterfactuals",
    lambda s, d: S.counterfactuals(observed(s, d), 3, "key", "tool", "size", "items", "text"),
    f"""WITH {STEPS_SQL}, o AS (SELECT row_id * 100 + pos AS key, tool_type AS tool, len(obs) AS items, length(coalesce(evidence, '')) AS size FROM steps WHERE obs IS NOT NULL)
SELECT key, other, rank FROM (SELECT a.key, b.key AS other, row_number() OVER (PARTITION BY a.key ORDER BY abs(a.size - b.size), b.key)::INT AS rank FROM o a JOIN o b ON a.tool = b.tool AND a.items = b.items AND a.key <> b.key) WHERE rank <= 3""",
)
def pooled(s, d):
    """Every step as the typed pool takes it."""
    x = table(s, d, "prompted_search_smoke").select("row_id", F.posexplode("steps").alias("pos", "s")).where("s is not null")
    of = lambda name: F.try_element_at("s.metadata", F.lit(name)).alias(name.removesuffix("_id"))
    return x.select((F.col("row_id") * 100 + F.col("pos")).alias("key"), F.col("s.tool_type").alias("tool"), F.coalesce(F.when(F.col("s.raw_observation").isNotNull(), F.size("s.raw_observation")), F.lit(1)).alias("items"), F.length(F.coalesce("s.evidence_summary", F.lit(""))).alias("size"), F.col("s.step_id").alias("step"), F.col("s.action_text").alias("action"), F.col("s.evidence_summary").alias("evidence"), of("answer"), of("semantic_id"), of("image_id"))


# j08_counterfactuals is what its SQL says; this one ranks the whole pool and pads.
R.add("j08_typed_pool", lambda s, d: typed_counterfactuals(pooled(s, d), 3))
def toolbox():
    """The tools of a step: what was retrieved, a region, the final answer."""
    tools = Toolbox()
    for name in ("text_search", "image_search"):
        tools.register(name, lambda a: F.concat(F.lit("retrieved "), F.coalesce(F.when(F.col("obs").isNotNull(), F.size("obs")), F.lit(0))))
    tools.register("crop", lambda a: F.lit("region"))
    tools.register("stop", lambda a: F.coalesce(a, F.lit("No new observation.")))
    return tools


R.add(
    "g04_tool_dispatch",
    lambda s, d: steps(s, d).select("row_id", "pos", toolbox().observe(F.col("tool_type"), F.col("action_text")).alias("observation")),
    f"WITH {STEPS_SQL} SELECT row_id, pos, CASE WHEN tool_type IN ('text_search', 'image_search') THEN 'retrieved ' || coalesce(len(obs), 0) WHEN tool_type = 'crop' THEN 'region' WHEN tool_type = 'stop' THEN coalesce(action_text, 'No new observation.') ELSE 'unknown tool' END AS observation FROM steps",
)
R.add(
    "g03_teacher_chain",
    lambda s, d: table(s, d, "toy_vqa").select("sample_id", "question", F.try_element_at("gold_answers", F.lit(1)).alias("gold")).select("sample_id", F.posexplode(F.array(F.struct(F.lit("image_search").alias("tool"), F.col("question").alias("action")), F.struct(F.lit("text_search").alias("tool"), N.evidence_anchor(F.col("question"), F.col("gold")).alias("action")), F.struct(F.lit("stop").alias("tool"), F.col("gold").alias("action")))).alias("step", "x")).select("sample_id", "step", "x.tool", "x.action", F.size(N.split_tokens(F.col("x.action"))).alias("n_tokens")),
    f"""WITH t AS (SELECT sample_id, question, gold_answers[1] AS gold FROM toy_vqa), a AS (SELECT *, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(regexp_extract_all(lower(gold), '[a-z0-9]+'), w))[1:8] AS own FROM t),
c AS (SELECT sample_id, 0::INT AS step, 'image_search' AS tool, question AS action FROM a UNION ALL SELECT sample_id, 1, 'text_search', CASE WHEN len(own) > 0 THEN array_to_string(own, ' ') ELSE gold END FROM a UNION ALL SELECT sample_id, 2, 'stop', gold FROM a)
SELECT sample_id, step, tool, action, len(list_filter(string_split({collapse('action')}, ' '), lambda x: x <> ''))::INT AS n_tokens FROM c""",
)
R.add(
    "g05_nonleaky_corpus",
    lambda s, d: table(s, d, "text_corpus").select("corpus_id", N.truncate_chars(N.redact(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.concat(F.lit("Answer: "), F.col("answer"))), F.array("answer")), 200).alias("evidence"), N.contains_answer(F.col("snippet"), F.array("answer")).alias("leaked")),
    f"""WITH t AS (SELECT corpus_id, answer, snippet, concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''), 'Answer: ' || answer) AS x FROM text_corpus)
SELECT corpus_id, CASE WHEN length(e) > 200 THEN rtrim(left(e, 197)) || '...' ELSE e END AS evidence, leaked FROM (SELECT corpus_id, {redacted('x', '[answer]')} AS e, coalesce(contains(lower(snippet), lower(answer)), FALSE) AS leaked FROM t)""",
)
R.add(
    "g06_diagnostic_index",
    lambda s, d: table(s, d, "fvqa_toy").where("question is not null and size(gold_answers) > 0").select("row_id", F.concat(F.lit("Question: "), F.col("question"), F.lit(" Answer: "), F.coalesce(F.try_element_at("gold_answers", F.lit(1)), F.lit(""))).alias("snippet"), "sample_id"),
    "SELECT row_id, 'Question: ' || question || ' Answer: ' || coalesce(gold_answers[1], '') AS snippet, sample_id FROM fvqa_toy WHERE question IS NOT NULL AND len(gold_answers) > 0",
)
