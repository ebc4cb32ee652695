"""Queries of parsers, balancing, queues and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import pyfn as Y
from tracequarry.operators import balance as K
from tracequarry.plans.registry import Registry
from tracequarry.plans.textual import strip
from tracequarry.plans.views import rollout_rows, steps
from tracequarry.session import table
from tracequarry.streaming import queues as Q

R = Registry()
_P = "prompted_search_smoke"
_LEN = "SELECT doc_id, doc_id // 64 AS batch, coalesce(n_chars, 0) + 1 AS n FROM documents"


def lengths(s, d):
    return table(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), (F.coalesce("n_chars", F.lit(0)) + 1).alias("n"))


_BOXED = "'so \\boxed{x} and \\boxed{' || CASE WHEN row_id % 3 = 0 THEN question ELSE '{' || coalesce(final_answer, '') || '} y' END || CASE WHEN row_id % 5 = 0 THEN '' ELSE '}' END"
R.add(
    "f14_last_boxed",
    lambda s, d: rollout_rows(s, d).where("not contains(final_answer, '{') and not contains(final_answer, '}')").select("row_id", Y.boxed(F.expr(_BOXED.replace("\\", "\\\\"))).alias("v")),
    f"WITH t AS (SELECT row_id, {_BOXED} AS t FROM {_P} WHERE NOT contains(final_answer, '{{') AND NOT contains(final_answer, '}}')) SELECT row_id, CASE WHEN row_id % 5 = 0 OR t IS NULL THEN NULL ELSE regexp_extract(t, '\\\\boxed\\{{([^\\\\]*)\\}}$', 1) END AS v FROM t",
)
_TEX = "CASE row_id % 5 WHEN 0 THEN 'x = \\tfrac' || (row_id % 9 + 1) || '7 \\text{ km}' WHEN 1 THEN (row_id % 97) || '/' || (row_id % 89 + 1) WHEN 2 THEN '\\sqrt' || (row_id % 9) || ' + .5' WHEN 3 THEN (row_id % 360) || '^\\circ' ELSE '\\left( ' || row_id || ' \\right)' END"
R.add(
    "f17_plain_latex",
    lambda s, d: rollout_rows(s, d).select("row_id", Y.latex(F.expr(_TEX.replace("\\", "\\\\"))).alias("v")),
    f"SELECT row_id, CASE row_id % 5 WHEN 0 THEN '\\frac{{' || (row_id % 9 + 1) || '}}{{7}}' WHEN 1 THEN '\\frac{{' || (row_id % 97) || '}}{{' || (row_id % 89 + 1) || '}}' WHEN 2 THEN '\\sqrt{{' || (row_id % 9) || '}}+0.5' WHEN 3 THEN (row_id % 360)::VARCHAR ELSE '(' || row_id || ')' END AS v FROM {_P}",
)
R.add("f34_agent_answer", lambda s, d: rollout_rows(s, d).where("length(trim(final_answer)) > 0").select("row_id", Y.agent_answer(F.concat(F.lit("thinking {\"tool\": \"x\"} "), F.to_json(F.struct(F.lit("stop").alias("action"), F.col("final_answer").alias("answer"))))).alias("v")), f"SELECT row_id, CASE WHEN lower({strip('final_answer')}) IN ('', 'query', 'answer', 'final answer', 'visual query', 'current image') THEN 'unknown' ELSE {strip('final_answer')} END AS v FROM {_P} WHERE length(trim(final_answer, ' ')) > 0")
R.add(
    "f35_tool_calls",
    lambda s, d: steps(s, d).where("action_text is not null").select("row_id", "pos", F.explode(Y.parsed_calls(F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.col("tool_type").alias("name"), F.struct(F.col("pos").alias("at")).alias("arguments"))), F.lit("</tool_call><tool_call>bad</tool_call>")))).alias("c")).where("c.name is not null").select("row_id", "pos", "c.name", "c.arguments"),
    f"SELECT row_id, pos, s.tool_type AS name, '{{\"at\": ' || pos || '}}' AS arguments FROM (SELECT row_id, unnest(steps) AS s, unnest(range(len(steps)))::INT AS pos FROM {_P} WHERE len(steps) > 0) WHERE s.action_text IS NOT NULL AND s.tool_type IS NOT NULL",
)
R.add(
    "f35_channel_calls",
    lambda s, d: steps(s, d).where("tool_type is not null").select("row_id", "pos", F.explode(Y.parsed_calls(F.concat(F.lit("<|channel|>analysis<|message|>call <|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|><|start|>assistant<|channel|>commentary to=functions."), F.col("tool_type"), F.lit(" <|constrain|>json<|message|>{\"at\": "), F.col("pos"), F.lit("}<|call|>")), "channel")).alias("c")).select("row_id", "pos", "c.name", "c.arguments"),
    f"SELECT row_id, pos, s.tool_type AS name, '{{\"at\": ' || pos || '}}' AS arguments FROM (SELECT row_id, unnest(steps) AS s, unnest(range(len(steps)))::INT AS pos FROM {_P} WHERE len(steps) > 0) WHERE s.tool_type IS NOT NULL",
)
R.add(
    "f35_xml_calls",
    lambda s, d: steps(s, d).where("tool_type is not null").select("row_id", "pos", F.explode(Y.parsed_calls(F.concat(F.lit("text <tool_call>\n<function="), F.col("tool_type"), F.lit(">\n<parameter=at>\n"), F.col("pos"), F.lit("\n</parameter>\n<parameter=far>\n"), F.col("pos") % 2 == 0, F.lit("\n</parameter>\n<parameter=none>\nnull\n</parameter>\n</function>\n</tool_call>")), "xml", {"at": "integer", "far": "bool"})).alias("c")).select("row_id", "pos", "c.name", "c.arguments"),
    f"SELECT row_id, pos, s.tool_type AS name, '{{\"at\": ' || pos || ', \"far\": ' || (pos % 2 = 0) || ', \"none\": null}}' AS arguments FROM (SELECT row_id, unnest(steps) AS s, unnest(range(len(steps)))::INT AS pos FROM {_P} WHERE len(steps) > 0) WHERE s.tool_type IS NOT NULL",
)
R.add("w33_gate_reward", lambda s, d: steps(s, d).join(rollout_rows(s, d).select("row_id", "gold_answers"), "row_id").select("row_id", "pos", Y.gate(F.col("gold_answers"), F.col("action_text"), F.coalesce(F.col("tool_type") == "stop", F.lit(False))).alias("gate")), None)
R.add("b15_balanced_parts", lambda s, d: K.by_batch(lengths(s, d), "batch", "doc_id", "n", lambda v: K.differencing(v, min(4, len(v)))).drop("place"), None)
R.add("b16_greedy_parts", lambda s, d: K.by_batch(lengths(s, d), "batch", "doc_id", "n", lambda v: K.greedy(v, 4)).drop("place"), None)
R.add("b17_micro_batches", lambda s, d: K.by_batch(lengths(s, d), "batch", "doc_id", "n", lambda v: K.micro_batches(v, 20000)).drop("place"), None)
# groups of four; two parts where the groups divide, else one
R.add("b19_group_parts", lambda s, d: K.by_batch(lengths(s, d), "batch", "doc_id", "n", lambda v: K.keep_groups(v, [i // 4 for i in range(len(v))], 2 - -(-len(v) // 4) % 2)).drop("place"), None)
# workers of a batch as its size divides
R.add("b20_balanced_order", lambda s, d: K.by_batch(lengths(s, d), "batch", "doc_id", "n", lambda v: K.balance_batch(v, next(k for k in (8, 4, 2, 1) if len(v) % k == 0))), None)
_EV = "SELECT user_id, event_id, event_type, value, ts FROM events"
R.add("st01_queue_replay", lambda s, d: Q.queue_replay(table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id", 16), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 16")
R.add("st02_queue_statistics", lambda s, d: Q.queue_statistics(table(s, d, "events"), "user_id", 64), "SELECT user_id, count(*) AS produced, least(count(*), 64) AS size, greatest(count(*) - 64, 0) AS dropped FROM events GROUP BY user_id")
_KIND = "CASE WHEN event_type IN ('click', 'view') THEN 'sample' WHEN event_type = 'error' THEN 'sync' ELSE 'consume' END"
_PACED = f"""WITH e AS (SELECT user_id, event_id, {_KIND} AS kind FROM events),
c AS (SELECT *, sum(CASE kind WHEN 'sample' THEN 1 WHEN 'consume' THEN -1 ELSE 0 END) OVER w AS t, count(*) FILTER (WHERE kind = 'sync') OVER w AS version FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT *, t - least(min(t) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS queued FROM c),
s AS (SELECT *, CASE WHEN version > 0 THEN first_value(queued) OVER v ELSE 0 END + count(*) FILTER (WHERE kind = 'sample') OVER v AS stale FROM q WINDOW v AS (PARTITION BY user_id, version ORDER BY event_id)) """


def paced(s, d):
    budget = Q.staleness_budget(3, 0.5, 2)
    return Q.staleness(table(s, d, "events").select("user_id", "event_id", F.expr(_KIND).alias("kind")), "user_id", "event_id", "kind", budget, 5)


R.add("st03_staleness_budget", lambda s, d: paced(s, d).select("user_id", "event_id", "queued", "stale", "pause"), _PACED + "SELECT user_id, event_id, queued::BIGINT AS queued, stale::BIGINT AS stale, stale >= 9 OR queued >= 5 AS pause FROM s")
R.add("st04_staleness_reset", lambda s, d: paced(s, d).where("kind = 'sync'").select("user_id", "version", F.col("stale").alias("carried")), _PACED + "SELECT user_id, version, stale::BIGINT AS carried FROM s WHERE kind = 'sync'")
R.add("st05_version_spans", lambda s, d: Q.version_spans(table(s, d, "events").select(F.floor(F.col("event_id") / 1000).alias("a"), F.floor((F.col("event_id") + F.col("user_id")) / 1000).alias("b")), "a", "b"), "SELECT round(avg(abs(b - a)), 6) AS mean_span, round(avg((abs(b - a) > 0)::INT), 6) AS partial_ratio FROM (SELECT event_id // 1000 AS a, (event_id + user_id) // 1000 AS b FROM events)")
R.add("st06_accumulate_until", lambda s, d: Q.accumulate_until(table(s, d, "events").withColumn("step", F.floor(F.col("event_id") / 100)), "step", F.countDistinct("user_id"), 500), "WITH p AS (SELECT event_id // 100 AS step, count(DISTINCT user_id) AS prompts FROM events GROUP BY 1), t AS (SELECT *, (sum(prompts) OVER (ORDER BY step))::BIGINT AS total FROM p) SELECT step, prompts, total, total >= 500 AS ready FROM t WHERE total - prompts < 500")
R.add(
    "st07_replay_pool",
    lambda s, d: Q.replay_pool(table(s, d, "events").select("event_type", (F.col("value") > 20).alias("positive"), F.floor(F.col("event_id") / 500).alias("block"), "event_id"), "event_type", "positive", "block", "event_id", 40).select("event_type", "positive", "event_id"),
    "WITH b AS (SELECT event_type, value > 20 AS positive, event_id // 500 AS block, event_id FROM events), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_type, positive, block ORDER BY event_id) <= 40) SELECT event_type, positive, event_id FROM c QUALIFY row_number() OVER (PARTITION BY event_type, positive ORDER BY block DESC, event_id DESC) <= 40",
)
R.add(
    "st08_balanced_counts",
    lambda s, d: s.createDataFrame([(n, p, q, *Q.balanced_counts(n, 0.5, p, q)) for n, p, q in ((8, 10, 10), (9, 10, 10), (8, 1, 20), (8, 20, 1), (8, 2, 2))], "size int, positives int, negatives int, p int, n int, padding int"),
    "SELECT size, positives, negatives, p, n, padding FROM (VALUES (8, 10, 10, 4, 4, 0), (9, 10, 10, 4, 5, 0), (8, 1, 20, 1, 7, 0), (8, 20, 1, 7, 1, 0), (8, 2, 2, 2, 2, 4)) t(size, positives, negatives, p, n, padding)",
)
R.add("st09_round_robin", lambda s, d: Q.round_robin(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id", 37).select("event_type", "event_id"), "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 37")
