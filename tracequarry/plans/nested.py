"""Queries of the shredding operators."""

from __future__ import annotations

from tracequarry.operators.shred import rollout_hits, rollout_nodes, rollout_steps
from tracequarry.plans.registry import Registry
from tracequarry.session import table

R = Registry()

_STEPS = """WITH l AS (SELECT line_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS j FROM agentic_rollout_smoke),
st AS (SELECT line_id, CASE json_type(j, '$.steps') WHEN 'ARRAY' THEN (j->'$.steps')::JSON[] WHEN 'OBJECT' THEN [j->'$.steps'] ELSE [] END AS s FROM l WHERE j IS NOT NULL),
e AS (SELECT line_id, unnest(s) AS step, unnest(range(len(s)))::INT AS step_pos FROM st),
n AS (SELECT line_id, step_pos, step, CASE json_type(step, '$.raw_observation') WHEN 'VARCHAR' THEN CASE WHEN json_valid(step->>'$.raw_observation') THEN (step->>'$.raw_observation')::JSON END ELSE step->'$.raw_observation' END AS o
    FROM e WHERE step IS NOT NULL AND json_type(step) <> 'NULL'),
h AS (SELECT line_id, step_pos, CASE WHEN json_type(o) = 'ARRAY' THEN o::JSON[] WHEN json_type(o, '$.results') = 'ARRAY' THEN (o->'$.results')::JSON[] ELSE [] END AS hs FROM n),
x AS (SELECT line_id, step_pos, unnest(hs) AS hit, unnest(range(len(hs)))::INT AS item_pos FROM h) """

R.add(
    "p4_found",
    lambda s, d: rollout_nodes(table(s, d, "agentic_rollout_smoke")),
    _STEPS
    + """SELECT line_id, 'step' AS node, step_pos, -1::INT AS item_pos FROM n
UNION ALL SELECT line_id, 'hit', step_pos, item_pos FROM x WHERE hit IS NOT NULL AND json_type(hit) <> 'NULL'
UNION ALL SELECT line_id, 'final', step_pos, -1 FROM n WHERE json_type(o) = 'OBJECT' AND coalesce(json_type(o, '$.final'), 'NULL') <> 'NULL'
UNION ALL SELECT line_id, 'success', step_pos, -1 FROM n WHERE json_type(step, '$.metadata.success') = 'BOOLEAN'""",
)
R.add(
    "p4_steps",
    lambda s, d: rollout_steps(table(s, d, "agentic_rollout_smoke")).select("line_id", "pos_1", "step_id", "tool_type", "action_text", "success", "meta_success"),
    _STEPS
    + """SELECT line_id, step_pos AS pos_1, step->>'$.step_id' AS step_id, step->>'$.tool_type' AS tool_type, step->>'$.action_text' AS action_text,
step->>'$.success' AS success, step->>'$.metadata.success' AS meta_success FROM n""",
)
R.add(
    "p4_hits",
    lambda s, d: rollout_hits(table(s, d, "agentic_rollout_smoke")).select("line_id", "pos_1", "pos_2", "title", "snippet", "answer"),
    _STEPS
    + """SELECT line_id, step_pos AS pos_1, item_pos AS pos_2, hit->>'$.title' AS title, hit->>'$.snippet' AS snippet, hit->>'$.answer' AS answer
FROM x WHERE hit IS NOT NULL AND json_type(hit) <> 'NULL'""",
)
