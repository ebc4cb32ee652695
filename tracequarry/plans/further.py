"""Queries of sources, sinks, adapters and pipelines that combine several operators."""

from __future__ import annotations

import json
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tracequarry.functions import hooks as H
from tracequarry.functions import pyfn as Y
from tracequarry.functions.scorers import scorers
from tracequarry.functions import textnorm as N
from tracequarry.operators import agent as G
from tracequarry.operators import relabel as L
from tracequarry.operators import retrieval as J
from tracequarry.operators import rollup as A
from tracequarry.operators import stepreward as S
from tracequarry.plans.registry import Registry
from tracequarry.plans.searching import _B, bm25
from tracequarry.plans.stepwise import _COST
from tracequarry.plans.textual import collapse, qa, redacted, strip
from tracequarry.plans.views import STEPS_SQL, TOKENS_SQL, rollout_rows, spanned_steps, steps, tokens
from tracequarry.session import table
from tracequarry.sources import readers

R = Registry()
_P = "prompted_search_smoke"


def q(name, run, sql=None):
    R.add(name, run, sql)


def r6(c, name):
    return F.round(c, 6).alias(name)


q("s01_concatenated_scan", lambda s, d: readers.read_tables(s, [f"{d}/toy_vqa.parquet", f"{d}/fvqa_toy.parquet"]).select("sample_id", "question", "split"), "SELECT sample_id, question, NULL::VARCHAR AS split FROM toy_vqa UNION ALL SELECT sample_id, question, split FROM fvqa_toy")
q(
    "s03_prompt_prefix_scan",
    lambda s, d: readers.read_tables(s, [f"{d}/toy_vqa.parquet", f"{d}/fvqa_toy.parquet"]).select("sample_id", readers.with_prefix(F.col("question"), "<image>\n").alias("prompt")),
    "SELECT sample_id, '<image>' || chr(10) || question AS prompt FROM (SELECT sample_id, question FROM toy_vqa UNION ALL SELECT sample_id, question FROM fvqa_toy)",
)
q("s04_adapted_rows", lambda s, d: table(s, d, "fvqa_toy").where("question is not null and size(gold_answers) > 0").orderBy("row_id").limit(64).select("row_id", "question"), "SELECT row_id, question FROM fvqa_toy WHERE question IS NOT NULL AND len(gold_answers) > 0 ORDER BY row_id LIMIT 64")
q("s19_literal_rows", lambda s, d: s.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), "SELECT * FROM (VALUES ('a', 1), ('b', 2)) t(k, n)")
q(
    "s20_grown_dataset",
    lambda s, d: H.grow(table(s, d, "fvqa_toy").select("row_id", "question"), lambda x: x.join(table(s, d, "fvqa_toy").where("split = 'test'").select("row_id"), "row_id", "left_semi").select((F.col("row_id") + 10_000_000).alias("row_id"), F.concat(F.lit("Again: "), "question").alias("question")), F.length("question") <= 147),
    "SELECT row_id, question FROM fvqa_toy UNION ALL SELECT row_id + 10000000, 'Again: ' || question FROM fvqa_toy WHERE split = 'test' AND length(question) <= 140",
)
_REWARD = """
def reward(data_source, solution_str, ground_truth, extra_info, bonus=0.0):
    hit = solution_str in (ground_truth if ground_truth is not None else [])
    return {"score": (1.0 if hit else 0.0) + bonus, "chars": len(solution_str)}


def rewards(data_sources, solution_strs, ground_truths):
    return [None if a is None else 1.0 if a in (t if t is not None else []) else -1.0 for a, t in zip(solution_strs, ground_truths)]
"""


def user_function(name, **fixed):
    """A function of a file outside the package, as a user would give it."""
    with tempfile.TemporaryDirectory() as folder:  # read by the driver only
        path = f"{folder}/reward.py"
        with open(path, "w") as f:
            f.write(_REWARD)
        return H.load_function(path, name, **fixed)


_SAME = "coalesce(list_contains(gold_answers, final_answer), FALSE)"
q(
    "h01_custom_reward",
    lambda s, d: rollout_rows(s, d).select("row_id", H.custom_reward(user_function("reward", bonus=0.5), F.col("data_source"), F.col("final_answer"), F.col("gold_answers")).alias("r")).select("row_id", "r.score", F.get_json_object("r.extra", "$.chars").cast("int").alias("chars")),
    f"SELECT row_id, CASE WHEN final_answer IS NULL THEN NULL ELSE {_SAME}::INT + 0.5::DOUBLE END AS score, length(final_answer)::INT AS chars FROM {_P}",
)
q(
    "h02_batched_reward",
    lambda s, d: rollout_rows(s, d).select("row_id", H.batched_reward(user_function("rewards"), F.col("data_source"), F.col("final_answer"), F.col("gold_answers")).alias("score")),
    f"SELECT row_id, CASE WHEN final_answer IS NULL THEN NULL WHEN {_SAME} THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM {_P}",
)
q(
    "h03_sampler_order",
    lambda s, d: H.sampled(table(s, d, "fvqa_toy").select("row_id", "question"), lambda x: -F.coalesce(F.length("question"), F.lit(0)), "row_id").select("row_id", "turn"),
    "SELECT row_id, row_number() OVER (ORDER BY coalesce(length(question), 0) DESC, row_id) - 1 AS turn FROM fvqa_toy",
)
q(
    "h04_mapped_rows",
    lambda s, d: H.map_rows(table(s, d, "toy_vqa").select("sample_id", "question"), lambda row, i: {"place": i, "line": f"{i}: {row['question']}"}, "place bigint, line string", "sample_id"),
    "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS place, (row_number() OVER (ORDER BY sample_id) - 1) || ': ' || question AS line FROM toy_vqa",
)
q("k09_flattened", lambda s, d: readers.flatten_struct(table(s, d, "fvqa_toy").select("row_id", "metadata")).withColumnsRenamed({"metadata/needs_search": "needs_search"}), "SELECT row_id, metadata.needs_search AS needs_search FROM fvqa_toy")
q("k11_cache_key", lambda s, d: table(s, d, "toy_vqa").select("sample_id", readers.cache_key("sample_id").alias("key")), "SELECT sample_id, sha256('{\"sample_id\":\"' || sample_id || '\"}') AS key FROM toy_vqa")
q(
    "k14_figure_pairs",
    lambda s, d: rollout_rows(s, d).select(F.greatest(F.coalesce(F.size("steps"), F.lit(0)), F.lit(0)).alias("n_steps"), F.coalesce("final_correct", F.lit(False)).alias("ok")).groupBy("n_steps", "ok").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT coalesce(len(steps), 0)::INT AS n_steps, coalesce(final_correct, FALSE) AS ok, count(*) AS n FROM {_P} GROUP BY 1, 2",
)


def media_segments(s, d):
    """Prompts cut at their placeholders."""
    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def cut(x: pd.Series, images: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"kind": k, "value": v} for k, v in Y.media_segments(t, n, 0)] for t, n in zip(x, images)], dtype=object)

    rows = table(s, d, "fvqa_toy").where("question is not null").select("row_id", F.posexplode(cut(F.concat(F.lit("<image>"), "question", F.when(F.col("row_id") % 2 == 0, "<image> again").otherwise("")), 1 + (F.col("row_id") % 2 == 0).cast("int"))).alias("at", "m"))
    return rows.select("row_id", "at", "m.kind", "m.value")


q(
    "p16_media_segments",
    media_segments,
    "WITH x AS (SELECT row_id, question, CASE WHEN question = '' THEN [{'kind': 'image', 'value': '0'}] ELSE [{'kind': 'image', 'value': '0'}, {'kind': 'text', 'value': question}] END || CASE WHEN row_id % 2 = 0 THEN [{'kind': 'image', 'value': '1'}, {'kind': 'text', 'value': ' again'}] ELSE [] END AS m FROM fvqa_toy WHERE question IS NOT NULL) SELECT row_id, unnest(range(len(m)))::INT AS at, unnest(m).kind AS kind, unnest(m).value AS value FROM x",
)
q(
    "a09_train_metrics",
    lambda s, d: rollout_rows(s, d).select("method", "latency", F.coalesce(F.col("final_correct").cast("double"), F.lit(0.0)).alias("r"), F.coalesce(F.length("final_answer"), F.lit(0)).alias("n")).groupBy("method").agg(r6(F.avg("r"), "reward_mean"), F.max("r").alias("reward_max"), F.min("r").alias("reward_min"), r6(F.avg("n"), "length_mean"), F.max("n").alias("length_max"), r6(A.rate(F.col("n") >= 100), "clip_ratio")),
    f"WITH p AS (SELECT method, coalesce(final_correct::INT, 0)::DOUBLE AS r, coalesce(length(final_answer), 0)::INT AS n FROM {_P}) SELECT method, round(avg(r), 6) AS reward_mean, max(r) AS reward_max, min(r) AS reward_min, round(avg(n), 6) AS length_mean, max(n) AS length_max, round(avg((n >= 100)::INT), 6) AS clip_ratio FROM p GROUP BY method",
)


def spans_in_tokens(s, d):
    """Places of each step's tokens in the tokens of its rollout."""
    @F.pandas_udf("array<array<int>>")
    def find(tokens: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([[list(x) for x in Y.action_spans([int(v) for v in t], [[int(v) for v in n] for n in m])] for t, m in zip(tokens, needles)])

    r = rollout_rows(s, d).where("size(steps) > 0").select("row_id", F.filter(F.transform("steps", lambda x: F.coalesce(x["action_tokens"], F.array().cast("array<int>"))), lambda a: F.size(a) > 0).alias("needles")).where("size(needles) > 0")
    r = r.withColumn("tokens", F.flatten("needles"))
    return r.select("row_id", F.posexplode(find("tokens", "needles")).alias("k", "span")).select("row_id", "k", F.col("span")[0].alias("span_start"), F.col("span")[1].alias("span_end"))


q("w25_action_spans", spans_in_tokens)
q(
    "f20_format_and_accuracy",
    lambda s, d: rollout_rows(s, d).where("final_answer is not null and not contains(final_answer, '<')").select("row_id", r6(scorers["format_and_accuracy"](F.concat(F.when(F.col("row_id") % 3 == 0, "").otherwise("<think>t</think> "), F.lit("\\boxed{1} <answer>"), "final_answer", F.lit("</answer>")), F.col("gold_answers")), "score")),
    f"SELECT row_id, round(0.9 * coalesce(len(list_filter(gold_answers, lambda g: coalesce({qa('g')} = {qa('final_answer')}, FALSE))) > 0, FALSE)::INT + 0.1 * (row_id % 3 <> 0)::INT, 6)::DOUBLE AS score FROM {_P} WHERE final_answer IS NOT NULL AND NOT contains(final_answer, '<')",
)
q(
    "f28_redacted_observations",
    lambda s, d: steps(s, d).join(rollout_rows(s, d).select("row_id", "gold_answers"), "row_id").where("size(obs) > 0").select("row_id", "pos", F.posexplode("obs").alias("hit", "o"), "gold_answers").select("row_id", "pos", "hit", N.redact(F.col("o.snippet"), F.col("gold_answers"), "[REDACTED_ANSWER]").alias("clean")),
    f"WITH {STEPS_SQL}, o AS (SELECT s.row_id, s.pos, unnest(range(len(obs)))::INT AS hit, unnest(obs) AS o, gold_answers FROM steps s JOIN {_P} USING (row_id) WHERE len(obs) > 0) SELECT row_id, pos, hit, {redacted('o.snippet', 'gold_answers', '[REDACTED_ANSWER]')} AS clean FROM o",
)
q("f29_answer_fields_dropped", lambda s, d: steps(s, d).where("size(obs) > 0").select("row_id", "pos", F.array_join(F.transform("obs", lambda o: F.coalesce(o.dropFields("answer")["title"], F.lit(""))), "|").alias("titles")), f"WITH {STEPS_SQL} SELECT row_id, pos, array_to_string(list_transform(obs, lambda o: coalesce(o.title, '')), '|') AS titles FROM steps WHERE len(obs) > 0")
q("f37_text_by_priority", lambda s, d: table(s, d, "text_corpus").select("corpus_id", F.coalesce(*[F.nullif(N.strip(F.col(c)), F.lit("")) for c in ("snippet", "title", "answer")]).alias("v")), f"SELECT corpus_id, coalesce({', '.join(f'nullif({strip(c)}, {chr(39) * 2})' for c in ('snippet', 'title', 'answer'))}) AS v FROM text_corpus")
q(
    "f44_vector_similarity",
    lambda s, d: table(s, d, "offline_doc").select("odoc_id", r6(F.expr("case when size(image_hist) = 24 and not exists(image_hist, x -> x is null) then aggregate(transform(image_hist, x -> least(x, 1.0D / 24)), 0D, (a, x) -> a + x) else 0D end"), "sim")),
    "SELECT odoc_id, round(CASE WHEN len(image_hist) = 24 AND len(list_filter(image_hist, lambda x: x IS NULL)) = 0 THEN list_sum(list_transform(image_hist, lambda x: least(x, 1.0 / 24::DOUBLE))) ELSE 0.0 END, 6) AS sim FROM offline_doc",
)
q("f45_observation_length", lambda s, d: steps(s, d).select("row_id", "pos", F.coalesce(F.aggregate("obs", F.lit(0), lambda a, o: a + F.coalesce(F.length(o["title"]), F.lit(0)) + F.coalesce(F.length(o["snippet"]), F.lit(0))), F.lit(0)).alias("n")), f"WITH {STEPS_SQL} SELECT row_id, pos, coalesce(list_sum(list_transform(obs, lambda o: coalesce(length(o.title), 0) + coalesce(length(o.snippet), 0))), 0)::INT AS n FROM steps")


def formatted(s, d):
    top = bm25(s, d, True, 3).join(table(s, d, "text_corpus").select(F.col("corpus_id").alias("doc"), "title"), "doc")
    line = F.format_string("%d. %s\n   relevance: %.4f", F.col("rank"), F.coalesce("title", F.lit("")), F.col("score"))
    return top.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))


q("f46_result_block", formatted, _B.rstrip() + ", r AS (SELECT q, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS rank FROM s WHERE score > 0) SELECT q, string_agg(rank || '. ' || coalesce(title, '') || chr(10) || '   relevance: ' || printf('%.4f', score), chr(10) ORDER BY rank) AS block FROM r JOIN text_corpus ON corpus_id = doc WHERE rank <= 3 GROUP BY q")


def tool_matches(s, d):
    """Calls of each rollout held against the calls of the rollout before it."""
    @F.pandas_udf("double")
    def score(gold: pd.Series, said: pd.Series) -> pd.Series:
        make = lambda text: [{"name": str(t), "parameters": {"n": i}} for i, t in enumerate(json.loads(text))]
        return pd.Series([Y.tool_match(make(g), make(p)) for g, p in zip(gold, said)], dtype="float64")

    t = rollout_rows(s, d).where("size(steps) > 0").select("row_id", F.to_json(F.transform("steps", lambda x: F.coalesce(x["tool_type"], F.lit("none")))).alias("calls"))
    other = t.select((F.col("row_id") + 1).alias("row_id"), F.col("calls").alias("gold"))
    return t.join(other, "row_id").select("row_id", F.round(score("gold", "calls"), 6).alias("score"))


q("j16_tool_matching", tool_matches)
q("b21_introspection", lambda s, d: table(s, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count("text").alias("texts"), F.sum(F.octet_length("text")).alias("bytes")), "SELECT count(*) AS rows, count(text) AS texts, sum(strlen(text))::BIGINT AS bytes FROM documents")


_KNOWN = {"lighthouse": "the old lighthouse", "mill": "a mill"}


def policy(s, d):
    """Samples with the first action of a policy, of every kind the rules know."""
    x = table(s, d, "fvqa_toy").where("row_id % 100 = 0").select(F.col("row_id").alias("q"), "question", "gold_answers", F.col("metadata.needs_search").alias("needs_search"))
    kind = F.floor(F.col("q") / 100) % 6
    tool = F.when(kind == 0, "text_search").when(kind == 1, "stop").when(kind == 2, "zoom").when(kind == 3, "image_search").when(kind == 4, "stop").otherwise("stop")
    action = F.when(kind == 0, " Query ").when(kind == 1, "").when(kind == 2, "left").when(kind == 3, F.substring(F.coalesce("question", F.lit("")), 1, 40)).when(kind == 4, "final answer").otherwise("Paris")
    return x.withColumn("policy_tool", tool).withColumn("policy_action", action)


def scripted_rollout(s, d):
    """Decide, repair, retrieve, answer, stop; the answers are compared with the gold answers."""
    actions = G.decided(policy(s, d), _KNOWN)
    docs = table(s, d, "text_corpus").select("corpus_id", F.concat_ws(" ", "title", "snippet").alias("text"))
    top = J.substring_search(actions.where(F.col("tool").isin(*G.SEARCHES)).select("q", "action"), docs, 3)
    found = top.join(table(s, d, "text_corpus").select(F.col("corpus_id").alias("doc"), "answer"), "doc").select("q", "rank", "doc", "answer")
    x = G.answered(actions, found, "q")
    return x.select("q", "tool", "action", "invalid", "answer", F.array_join(F.transform("steps", lambda t: F.concat(t["tool"], F.lit(":"), F.size(t["docs"]))), ",").alias("trace"), N.exact_match(F.col("answer"), F.col("gold_answers"), N.alnum_normalize).alias("correct"))


_AL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
q(
    "g01_scripted_rollout",
    scripted_rollout,
    f"""WITH p AS (SELECT row_id AS q, coalesce(question, '') AS question, gold_answers, metadata.needs_search AS needs, (row_id // 100) % 6 AS k FROM fvqa_toy WHERE row_id % 100 = 0),
a AS (SELECT *, CASE WHEN contains(lower(question), 'lighthouse') THEN 'the old lighthouse' WHEN contains(lower(question), 'mill') THEN 'a mill' ELSE 'unknown' END AS direct FROM p),
c AS (SELECT *, CASE WHEN NOT coalesce(needs, direct = 'unknown') AND direct <> 'unknown' THEN ['stop', direct, '0'] WHEN k = 0 THEN ['text_search', question, '0'] WHEN k = 1 AND coalesce(needs, direct = 'unknown') THEN ['text_search', question, '0'] WHEN k = 2 THEN ['text_search', question, '1']
WHEN k = 3 THEN ['image_search', CASE WHEN lower(trim(left(question, 40))) IN ('', 'query', 'answer', 'final answer', 'visual query', 'current image') THEN question ELSE trim(left(question, 40)) END, '0'] WHEN k IN (1, 4) THEN ['stop', 'unknown', '1'] ELSE ['stop', 'Paris', '0'] END AS c FROM a),
t AS (SELECT q, gold_answers, direct, c[1] AS tool, c[2] AS action, c[3]::INT AS invalid FROM c), d AS (SELECT corpus_id AS doc, concat_ws(' ', title, snippet) AS text, answer FROM text_corpus),
s AS (SELECT q, doc, answer, len(list_filter(list_distinct({_TOK.format('action')}), lambda w: contains(lower(text), w))) AS score FROM t CROSS JOIN d WHERE tool <> 'stop'),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY coalesce(score, 0) DESC, doc) AS rank FROM s), f AS (SELECT q, count(*) AS n, arg_min(answer, rank) FILTER (WHERE answer IS NOT NULL) AS said FROM r WHERE rank <= 3 GROUP BY q),
o AS (SELECT t.*, coalesce(n, 0) AS n, CASE WHEN tool = 'stop' THEN action ELSE coalesce(said, direct) END AS answer FROM t LEFT JOIN f USING (q))
SELECT q, tool, action, invalid, answer, CASE WHEN tool = 'stop' THEN 'stop:0' ELSE tool || ':' || n || ',stop:0' END AS trace, coalesce(len(list_filter(gold_answers, lambda g: coalesce({_AL.format('g')} = {_AL.format('answer')}, FALSE))) > 0, FALSE) AS correct FROM o""",
)
q(
    "g02_direct_answers",
    lambda s, d: rollout_rows(s, d).select("row_id", F.size(N.split_tokens(F.col("question"))).alias("prompt_tokens"), F.lit(0).alias("num_tools"), F.coalesce("final_answer", F.lit("unknown")).alias("answer")),
    f"SELECT row_id, CASE WHEN question IS NULL THEN NULL ELSE len(list_filter(string_split({collapse('question')}, ' '), lambda x: x <> ''))::INT END AS prompt_tokens, 0 AS num_tools, coalesce(final_answer, 'unknown') AS answer FROM {_P}",
)


def prompted_rollout(s, d):
    """Every sample searches for its question, then stops with the first answer found."""
    x = table(s, d, "fvqa_toy").where("row_id % 100 = 0").select(F.col("row_id").alias("q"), "question", F.lit(True).alias("needs_search"), F.lit("text_search").alias("policy_tool"), F.col("question").alias("policy_action"))
    actions = G.decided(x, {})
    docs = table(s, d, "text_corpus").select("corpus_id", F.concat_ws(" ", "title", "snippet").alias("text"))
    top = J.substring_search(actions.select("q", "action"), docs, 5)
    found = top.join(table(s, d, "text_corpus").select(F.col("corpus_id").alias("doc"), "answer"), "doc").select("q", "rank", "doc", "answer")
    return G.answered(actions, found, "q").select("q", "answer", F.size(F.col("steps")[0]["docs"]).alias("n_docs"), F.size("steps").alias("n_steps"))


q(
    "g02_prompted_rollout",
    prompted_rollout,
    f"""WITH t AS (SELECT row_id AS q, trim(coalesce(question, ''), ' ') AS action FROM fvqa_toy WHERE row_id % 100 = 0), d AS (SELECT corpus_id AS doc, concat_ws(' ', title, snippet) AS text, answer FROM text_corpus),
s AS (SELECT q, doc, answer, coalesce(len(list_filter(list_distinct({_TOK.format('action')}), lambda w: contains(lower(text), w))), 0) AS score FROM t CROSS JOIN d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s) SELECT q, coalesce(arg_min(answer, rank) FILTER (WHERE answer IS NOT NULL), 'unknown') AS answer, count(*)::INT AS n_docs, 2 AS n_steps FROM r WHERE rank <= 5 GROUP BY q""",
)


@R.query(
    "g07_edge_rows",
    f"WITH {STEPS_SQL}, g AS (SELECT *, coalesce(len(obs) / 5.0 - 0.2, -0.2) AS g FROM steps), r AS (SELECT *, g + coalesce(0.5 * greatest(lead(g) OVER (PARTITION BY row_id ORDER BY pos), 0), 0) - 0.1 * {_COST} AS r FROM g) SELECT row_id, round(max(r) FILTER (WHERE pos = 0), 6) AS r0, round(max(r) FILTER (WHERE pos = 1), 6) AS r1, round(max(r) FILTER (WHERE pos = 2), 6) AS r2, coalesce(max(g) FILTER (WHERE pos = 1) > 0, FALSE) AS future_credit FROM r GROUP BY row_id",
)
def edge_rows(s, d):
    x = steps(s, d).withColumn("g", F.when(F.col("obs").isNull(), -0.2).otherwise(F.size("obs") / 5.0 - 0.2))
    x = S.step_total(S.propagated(x, "g", F.lit(1.0), 0.5, key="row_id"), "ret", F.lit(0.0), "tool_type", 1.0, 0.0, 0.1)
    at = lambda p, c: F.max(F.when(F.col("pos") == p, F.col(c)))
    return x.groupBy("row_id").agg(r6(at(0, "total"), "r0"), r6(at(1, "total"), "r1"), r6(at(2, "total"), "r2"), F.coalesce(at(1, "g") > 0, F.lit(False)).alias("future_credit"))


def relabelled(s, d):
    """Every non-null step of every rollout, relabelled; probe answers of the gate as without a model."""
    x = rollout_rows(s, d).select("row_id", "question", "final_answer", "final_correct", "gold_answers", F.posexplode(F.filter("steps", lambda x: x.isNotNull())).alias("pos", "s"))
    of = lambda name: F.try_element_at("s.metadata", F.lit(name)).alias(name.removesuffix("_id"))
    said = F.coalesce("final_answer", F.lit(""))
    target = F.coalesce(F.try_element_at("gold_answers", F.lit(1)), said)
    x = x.select(
        F.col("row_id").alias("row"), "pos", "question", target.alias("target"), F.when(F.col("final_correct"), F.array(target, target, target)).otherwise(F.array(said, F.lit("unknown"), F.substring(F.coalesce("question", F.lit("")), 1, 16))).alias("probes"),
        (F.col("row_id") * 1000 + F.col("pos")).alias("key"), F.col("s.tool_type").alias("tool"), F.coalesce(F.when(F.col("s.raw_observation").isNotNull(), F.size("s.raw_observation")), F.lit(1)).alias("items"), F.length(F.coalesce("s.evidence_summary", F.lit(""))).alias("size"),
        F.col("s.step_id").alias("step"), F.col("s.action_text").alias("action"), F.col("s.evidence_summary").alias("evidence"), of("answer"), of("semantic_id"), of("image_id"),
    )
    return L.relabelled_steps(x, Y.gate(F.col("probes"), F.col("action"), F.coalesce(F.col("tool") == "stop", F.lit(False))))


def offline_relabel(s, d):
    return L.edge_rows(relabelled(s, d), rollout_rows(s, d).select(F.col("row_id").alias("row"), F.col("gold_answers").alias("golds")))


# g07_edge_rows, a27_edge_summary and a36_figure_aggregates are what their SQL says; these score every step.
q("g07_offline_relabel", lambda s, d: (e := offline_relabel(s, d)).select(F.col("row").alias("row_id"), *[r6(F.col(c), c) if t == "double" else c for c, t in e.dtypes if c != "row"]))
q("g07_relabel_summary", lambda s, d: L.edge_summary(offline_relabel(s, d)))
q("a36_reward_figures", lambda s, d: L.reward_figures(relabelled(s, d)))

q("st13_event_time_counts", lambda s, d: table(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
q("w41_weighted_token_rates", lambda s, d: tokens(s, d).groupBy(F.col("pos") % 4).agg(r6(A.rate(F.col("mask") == 1), "rate")).withColumnsRenamed({"(pos % 4)": "slot"}), f"WITH {TOKENS_SQL} SELECT pos % 4 AS slot, round(avg(mask), 6) AS rate FROM tokens GROUP BY 1")
