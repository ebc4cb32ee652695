"""Queries of the text functions, over the answers and questions of rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import pyfn as Y
from tracequarry.functions import textnorm as N
from tracequarry.functions.scorers import dispatch, scorers
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import rollout_rows
from tracequarry.session import table

R = Registry()
_WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def redacted(x: str, answers: str, mark: str = "[hidden]") -> str:
    """Clauses, then answers (longest first), masked."""
    x = f"regexp_replace(regexp_replace({x}, '(?i)\\banswer\\s*:\\s*[^.。\\n]+[.。]?', 'Answer: {mark}. ', 'g'), '(?i)\\bground[_ ]?truth\\s*:\\s*[^.。\\n]+[.。]?', 'Ground truth: {mark}. ', 'g')"
    own = f"list_filter(list_transform({answers}, lambda a: {strip('a')}), lambda a: a <> '')"
    longest = f"list_transform(list_sort(list_transform({own}, lambda a: {{'n': -length(a), 'a': a}})), lambda s: regexp_replace(s.a, '([\\\\\\[\\](){{}}.*+?^$|/-])', '\\\\\\1', 'g'))"
    return collapse(f"CASE WHEN len({own}) > 0 THEN regexp_replace({x}, '(?i)(?:' || array_to_string({longest}, '|') || ')', '{mark}', 'g') ELSE {x} END")


def articles(x: str) -> str:
    one = r"'(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'"
    return f"regexp_replace(regexp_replace({x}, {one}), {one})"


def qa(x: str) -> str:
    return collapse(articles(f"regexp_replace(lower({x}), '[[:punct:]]', '', 'g')"))


def ev(x: str) -> str:
    return collapse(f"regexp_replace({articles(f'lower({x})')}, '[^a-z0-9 ]+', ' ', 'g')")


def alnum(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def space(x: str) -> str:
    return collapse(f"lower({x})")


def A():
    return F.col("final_answer")


def G():
    return F.col("gold_answers")


_P = "prompted_search_smoke"


def over(name: str, build, sql: str, where: str = "true") -> None:
    """A query of row_id and named columns over all rollouts."""
    R.add(name, lambda s, d: rollout_rows(s, d).where(where).select("row_id", *build()), f"SELECT row_id, {sql} FROM {_P} WHERE {where}")


over("f01_qa_normalize", lambda: [N.qa_normalize(A()).alias("v")], f"{qa('final_answer')} AS v")
over("f02_eval_normalize", lambda: [N.eval_normalize(A()).alias("v")], f"{ev('final_answer')} AS v")
over("f03_alnum_normalize", lambda: [N.alnum_normalize(A()).alias("v")], f"{alnum('final_answer')} AS v")
over("f04_space_normalize", lambda: [N.space_normalize(A()).alias("v")], f"{space('final_answer')} AS v")
over(
    "f05_tokens",
    lambda: [F.array_join(N.ascii_tokens(A()), "|").alias("lower_tokens"), F.array_join(N.word_tokens(A()), "|").alias("word_tokens"), F.array_join(F.filter(N.split_tokens(A()), lambda t: F.length(t) > 2), "|").alias("long_tokens")],
    f"""array_to_string(regexp_extract_all(lower(final_answer), '[a-z0-9]+'), '|') AS lower_tokens, array_to_string(regexp_extract_all(final_answer, '[A-Za-z0-9_]+'), '|') AS word_tokens,
array_to_string(list_filter(string_split({collapse('final_answer')}, ' '), lambda t: length(t) > 2), '|') AS long_tokens""",
)
_EX = "coalesce(len(list_filter(gold_answers, lambda g: {})) > 0, FALSE)"
over("f06_exact_match", lambda: [N.exact_match(A(), G()).alias("em")], _EX.format(f"coalesce({qa('g')} = {qa('final_answer')}, FALSE)") + " AS em")
over("f07_substring_match", lambda: [N.substring_match(A(), G()).alias("sub")], _EX.format(f"coalesce(contains({qa('final_answer')}, {qa('g')}), FALSE)") + " AS sub")
over(
    "f07_either_way_match",
    lambda: [N.either_way_match(A(), G()).alias("hit")],
    _EX.format(f"coalesce({space('g')} <> '' AND {space('final_answer')} <> '' AND (contains({space('final_answer')}, {space('g')}) OR contains({space('g')}, {space('final_answer')})), FALSE)") + " AS hit",
)
_F1_SQL = f"""WITH p AS (SELECT row_id, list_filter(string_split({ev('final_answer')}, ' '), lambda t: t <> '') AS a, list_filter(string_split({ev('question')}, ' '), lambda t: t <> '') AS b FROM {_P}),
c AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))::DOUBLE AS common FROM p)
SELECT row_id, """
R.add(
    "f08_token_f1",
    lambda s, d: rollout_rows(s, d).select("row_id", F.round(N.token_f1(A(), F.col("question")), 6).alias("f1")),
    _F1_SQL + "round(coalesce(2 * (common / len(a)) * (common / len(b)) / nullif(common / len(a) + common / len(b), 0), 0), 6) AS f1 FROM c",
)
R.add(
    "f09_multiset_jaccard",
    lambda s, d: rollout_rows(s, d).select("row_id", F.round(N.multiset_jaccard(N.split_tokens(N.eval_normalize(A())), N.split_tokens(N.eval_normalize(F.col("question")))), 6).alias("j")),
    _F1_SQL + "round(CASE WHEN a = b THEN 1.0 ELSE coalesce(common / nullif(len(a) + len(b) - common, 0), 0) END, 6) AS j FROM c",
)


def _TAGGED():
    return F.concat(F.lit("<answer>draft</answer> then <answer> "), A(), F.lit("\n</answer> end"))


over("f10_last_answer_tag", lambda: [N.last_tag(_TAGGED()).alias("v")], f"{strip('''regexp_extract_all('<answer>draft</answer> then <answer> ' || final_answer || chr(10) || '</answer> end', '(?s)<answer>(.*?)</answer>', 1)[-1]''')} AS v")


@R.query(
    "f11_last_answering_turn",
    f"SELECT row_id, arg_max({strip('''regexp_extract_all(txt, '(?is)<answer>(.*?)</answer>', 1)[-1]''')}, i) AS v FROM (SELECT row_id, unnest(range(len(steps))) AS i, '<Answer>' || unnest(steps).action_text || '</ANSWER>' AS txt FROM {_P} WHERE len(steps) > 0) WHERE txt IS NOT NULL GROUP BY row_id",
)
def last_answering_turn(s, d):
    t = rollout_rows(s, d).select("row_id", F.posexplode("steps").alias("i", "s")).select("row_id", "i", F.concat(F.lit("<Answer>"), F.col("s.action_text"), F.lit("</ANSWER>")).alias("txt")).where("txt is not null")
    return t.groupBy("row_id").agg(F.max_by(N.strip(F.try_element_at(F.regexp_extract_all("txt", F.lit("(?is)<answer>(.*?)</answer>")), F.lit(-1))), "i").alias("v"))


_NUM = "question || ' #### ' || (row_id % 9999) || ',5 and 7. end'"


def _NUMC():
    return F.concat(F.col("question"), F.lit(" #### "), F.col("row_id") % 9999, F.lit(",5 and 7. end"))


over(
    "f12_hash_answer",
    lambda: [N.hash_answer(_NUMC()).alias("strict"), N.last_number(_NUMC()).alias("flexible")],
    rf"regexp_replace(regexp_extract_all(right({_NUM}, 300), '#### (\-?[0-9\.\,]+)', 1)[-1], '[,$]', '', 'g') AS strict, list_filter(regexp_extract_all(right({_NUM}, 300), '(\-?[0-9\.\,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS flexible",
)
over("f13_first_number", lambda: [F.regexp_extract("question", "([0-9]{4})", 1).alias("v")], "regexp_extract(question, '([0-9]{4})', 1) AS v")


def _final_sql(x: str) -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    x = f"string_split({x}, '=')[-1]"
    for a, b in N.SUBSTITUTIONS + [(r, "") for r in N.REMOVED]:
        x = f"replace({x}, {q(a)}, {q(b)})"
    for p, to in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")):
        x = f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"
    return f"replace({x}, '$', '')"


_LATEX = "'x = $\\frac' || (row_id % 10) || 'b$ \\text{m} ' || coalesce(question, '') || ' = \\boxed{' || (row_id * 1234) || ',000} units'"
R.add(
    "f15_final_answer",
    lambda s, d: rollout_rows(s, d).select("row_id", N.final_answer_normalize(F.concat(F.lit("x = $\\frac"), F.col("row_id") % 10, F.lit("b$ \\text{m} "), F.coalesce("question", F.lit("")), F.lit(" = \\boxed{"), F.col("row_id") * 1234, F.lit(",000} units"))).alias("v")),
    f"WITH x AS (SELECT row_id, {_final_sql(_LATEX)} AS x FROM {_P}) SELECT row_id, {strip('''CASE WHEN regexp_matches(replace(x, ',', ''), '^[0-9]+$') THEN replace(x, ',', '') ELSE x END''')} AS v FROM x",
)
over(
    "f16_answer_line",
    lambda: [N.strip(F.try_element_at(F.regexp_extract_all(F.right(F.concat(F.lit("Answer: 1\nAnswer:  "), A()), F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)")), F.lit(-1))).alias("v")],
    strip(r'''regexp_extract_all(right('Answer: 1' || chr(10) || 'Answer:  ' || final_answer, 300), '(?i)Answer\s*:\s*([^\n]+)', 1)[-1]''') + " AS v",
)

_SOLVED = "'So x = 2. Answer: 7' || chr(10) || CASE row_id % 3 WHEN 0 THEN 'answer : ' || final_answer WHEN 1 THEN 'Answer: ' || gold_answers[1] ELSE 'no line' END"
R.add(
    "f16_math_scores",
    lambda s, d: rollout_rows(s, d).where("size(gold_answers) > 0 and gold_answers[0] is not null and final_answer is not null and not contains(final_answer, '\\n')").select(
        "row_id",
        scorers["math_line"](F.concat(F.lit("So x = 2. Answer: 7\n"), F.expr("case row_id % 3 when 0 then 'answer : ' || final_answer when 1 then 'Answer: ' || gold_answers[0] else 'no line' end")), G()).alias("line"),
        scorers["math_box"](F.concat(F.lit("\\boxed{1} then \\boxed{"), F.regexp_replace("final_answer", "[{}]", ""), F.lit("}")), G()).alias("box"),
    ),
    f"""WITH x AS (SELECT row_id, gold_answers[1] AS gold, final_answer, regexp_extract_all(right({_SOLVED}, 300), '(?i)Answer\\s*:\\s*([^\n]+)', 1)[-1] AS said FROM {_P} WHERE len(gold_answers) > 0 AND gold_answers[1] IS NOT NULL AND final_answer IS NOT NULL AND NOT contains(final_answer, chr(10))),
n AS (SELECT *, {_final_sql("coalesce(said, '[INVALID]')")} AS a, {_final_sql('gold')} AS g FROM x), z AS (SELECT *, {strip("CASE WHEN regexp_matches(replace(a, ',', ''), '^[0-9]+$') THEN replace(a, ',', '') ELSE a END")} AS p, {strip("CASE WHEN regexp_matches(replace(g, ',', ''), '^[0-9]+$') THEN replace(g, ',', '') ELSE g END")} AS q FROM n)
SELECT row_id, CASE WHEN p = q THEN 1.0 ELSE -1.0 END::DOUBLE AS line, CASE WHEN length(final_answer) < 85 AND regexp_replace(final_answer, '[{{}}]', '', 'g') = gold THEN 1.0 ELSE -1.0 END::DOUBLE AS box FROM z""",
)

_TURN = {
    "answer": "'<reason>r</reason> <answer>' || final_answer || '</answer>'",
    "image": "'<reason>r</reason><search><img></search>'",
    "text": "'<reason>r</reason><text_search>' || question || '</text_search>'",
}
_TURNS = f"CASE row_id % 4 WHEN 0 THEN [{_TURN['answer']}] WHEN 1 THEN [{_TURN['image']}, {_TURN['answer']}] WHEN 2 THEN [{_TURN['text']}, {_TURN['answer']}] ELSE [{_TURN['image']}, {_TURN['text']}, {_TURN['answer']}] END"


def turns():
    a = F.concat(F.lit("<reason>r</reason> <answer>"), A(), F.lit("</answer>"))
    i = F.lit("<reason>r</reason><search><img></search>")
    t = F.concat(F.lit("<reason>r</reason><text_search>"), F.col("question"), F.lit("</text_search>"))
    k = F.col("row_id") % 4
    return F.when(k == 0, F.array(a)).when(k == 1, F.array(i, a)).when(k == 2, F.array(t, a)).otherwise(F.array(i, t, a))


_FULL = "final_answer IS NOT NULL AND question IS NOT NULL AND gold_answers IS NOT NULL"


def _ok(x: str, tail: str, once: list[str], never: list[str]) -> str:
    q = strip(x)
    return f"(regexp_matches({q}, '(?s)^<reason>.*</reason>.*{tail}\\n?$')" + "".join(f" AND len(string_split({q}, '{o}')) = 2" for o in once) + "".join(f" AND NOT contains({q}, '{n}')" for n in never) + ")"


_ANS = lambda x: _ok(x, "<answer>.*</answer>", ["<reason>", "</reason>", "<answer>", "</answer>"], ["<search><img></search>", "<text_search>", "</text_search>"])
_IMG = lambda x: _ok(x, "<search><img></search>", ["<reason>", "</reason>", "<search><img></search>"], ["<answer>", "</answer>", "<text_search>", "</text_search>"])
_TXT = lambda x: _ok(x, "<text_search>.*</text_search>", ["<reason>", "</reason>", "<text_search>", "</text_search>"], ["<answer>", "</answer>", "<search><img></search>"])
_CALL = lambda x: f"(contains({x}, '<search><img></search>') OR (contains({x}, '<text_search>') AND contains({x}, '</text_search>')))::INT"
_FORMAT = f"""WITH t AS (SELECT row_id, gold_answers, {_TURNS} AS t FROM {_P} WHERE {_FULL}),
f AS (SELECT *, (CASE len(t) WHEN 1 THEN {_ANS('t[1]')} WHEN 2 THEN ({_IMG('t[1]')} OR {_TXT('t[1]')}) AND {_ANS('t[2]')} ELSE {_IMG('t[1]')} AND {_TXT('t[2]')} AND {_ANS('t[3]')} END)::INT AS format_score,
{_CALL('t[1]')} + CASE WHEN len(t) = 3 THEN {_CALL('t[2]')} ELSE 0 END AS search_count FROM t) """
R.add(
    "f22_turn_formats",
    lambda s, d: rollout_rows(s, d).where(_FULL).select("row_id", N.valid_answer_turn(N.strip(F.element_at(turns(), -1))).alias("answer_ok"), N.valid_image_turn(N.strip(F.element_at(turns(), 1))).alias("image_ok"), N.valid_text_turn(N.strip(F.element_at(turns(), 1))).alias("text_ok")),
    _FORMAT + f"SELECT row_id, {_ANS('t[-1]')} AS answer_ok, {_IMG('t[1]')} AS image_ok, {_TXT('t[1]')} AS text_ok FROM f",
)


@R.query("f23_conversation_format", _FORMAT + "SELECT row_id, format_score, search_count FROM f")
def conversation_format(s, d):
    fmt, n = N.conversation_format(turns())
    return rollout_rows(s, d).where(_FULL).select("row_id", fmt.alias("format_score"), n.alias("search_count"))


_LAST = strip("regexp_extract_all(t[-1], '(?s)<answer>(.*?)</answer>', 1)[-1]")
_HIT = f"coalesce(len(list_filter(gold_answers, lambda g: coalesce({qa('g')} = {qa(_LAST)}, FALSE))) > 0, FALSE)"
R.add(
    "f24_search_score",
    lambda s, d: rollout_rows(s, d).where(_FULL).select("row_id", F.round(N.search_score(turns(), G()), 6).alias("score"), F.round(N.search_score(turns(), G(), per_search=True), 6).alias("score_per_search")),
    _FORMAT
    + f", h AS (SELECT *, {_HIT} AS hit FROM f) SELECT row_id, round(0.9 * CASE WHEN hit THEN CASE WHEN search_count > 0 THEN 0.9 ELSE 1.0 END ELSE 0.0 END::DOUBLE + 0.1 * format_score, 6) AS score, round(0.9 * CASE WHEN hit THEN pow(0.9, search_count) ELSE 0.0 END + 0.1 * format_score, 6) AS score_per_search FROM h",
)
over(
    "f21_tag_spam_score",
    lambda: [N.tag_spam_score(F.concat(F.repeat(F.lit("<answer>x</answer>"), (F.col("row_id") % 14).cast("int")), F.lit("<answer>"), A(), F.lit("</answer>")), G()).alias("score")],
    f"CASE WHEN {_EX.format('coalesce(' + qa('g') + ' = ' + qa(strip('''regexp_extract_all(repeat('<answer>x</answer>', (row_id % 14)::INT) || '<answer>' || final_answer || '</answer>', '(?s)<answer>(.*?)</answer>', 1)[-1]''')) + ', FALSE)')} THEN CASE WHEN row_id % 14 + 1 > 10 THEN 0.25 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS score",
)
_PARTS = {
    "gold": "CASE row_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<tool_call>{nl}{json}{nl}</tool_call>' WHEN 2 THEN '<response>x</response>' ELSE '<tool_call>{nl}{json}{nl}</tool_call>{nl}<response>x</response>' END",
    "said": "'<think>' || coalesce(final_answer, '') || '</think>' || CASE (row_id % 7 + row_id % 4) % 4 WHEN 0 THEN '' WHEN 1 THEN '{nl}<tool_call>{nl}{other}{nl}</tool_call>' WHEN 2 THEN '{nl}<response>' || coalesce(question, '') || '</response>' ELSE '{nl}<tool_call>{nl}{other}{nl}</tool_call>{nl}<response>y</response>' END",
}


def _parts(name: str, nl: str) -> str:
    return _PARTS[name].format(nl=nl, json='{"name": "find", "parameters": {"q": 1, "n": 2}}', other='{"name": "find", "parameters": {"q": 1, "m": 2}}')


R.add(
    "f25_tool_format",
    lambda s, d: rollout_rows(s, d).select("row_id", N.tool_format(F.expr(_parts("said", "\\n")), F.expr(_parts("gold", "\\n"))).alias("ok")),
    f"""WITH p AS (SELECT row_id, {_parts('gold', "' || chr(10) || '")} AS g, {_parts('said', "' || chr(10) || '")} AS t FROM {_P}), c AS (SELECT *, contains(g, '<tool_call>') AS a, contains(g, '<response>') AS b, (length(t) - length(replace(t, '<tool_call>', ''))) // 11 AS n, (length(t) - length(replace(t, '<response>', ''))) // 10 AS m FROM p)
SELECT row_id, (regexp_matches(t, CASE WHEN a AND b THEN '(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$' WHEN a THEN '(?s)^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>$' WHEN b THEN '(?s)^<think>.*?</think>\n<response>.*?</response>$' ELSE '(?s)^<think>.*?</think>$' END) AND (NOT a OR n = 1) AND (NOT b OR m = 1))::INT AS ok FROM c""",
)
# the calls differ in one of two parameters: 1 for the name, 1/3 for the keys, 1 for the equal value, of 4 in all
R.add(
    "f25_tool_total",
    lambda s, d: rollout_rows(s, d).where("not contains(coalesce(final_answer, ''), '<') and not contains(coalesce(question, ''), '<')").select("row_id", F.round(N.tool_format(F.expr(_parts("said", "\\n")), F.expr(_parts("gold", "\\n"))) + Y.tool_scores(F.expr(_parts("said", "\\n")), F.expr(_parts("gold", "\\n"))), 6).alias("total")),
    f"""WITH p AS (SELECT row_id, row_id % 4 AS g, (row_id % 7 + row_id % 4) % 4 AS t, NOT (coalesce(final_answer, '') LIKE '%<%' OR coalesce(question, '') LIKE '%<%') AS plain FROM {_P})
SELECT row_id, round((g = t)::INT + CASE WHEN g IN (0, 2) THEN 0 WHEN t IN (0, 2) THEN -3 ELSE 6 * (1 + 1.0 / 3 + 1) / 4 - 3 END, 6)::DOUBLE AS total FROM p WHERE plain""",
)
over(
    "f26_score_dispatch",
    lambda: [
        F.round(dispatch(F.coalesce("data_source", F.lit("none")), A(), G(), {"fvqa_index": "exact", "qa_pages": "exact", "wiki*": "substring", "*_*": "first_token_f1", "*": "zero"}), 6).alias("score"),
    ],
    f"""round(CASE WHEN data_source IN ('fvqa_index', 'qa_pages') THEN {_EX.format(f"coalesce({qa('g')} = {qa('final_answer')}, FALSE)")}::INT::DOUBLE WHEN starts_with(data_source, 'wiki') THEN {_EX.format(f"coalesce(contains({qa('final_answer')}, {qa('g')}), FALSE)")}::INT::DOUBLE
WHEN contains(data_source, '_') THEN (WITH w AS (SELECT list_filter(string_split({ev('final_answer')}, ' '), lambda t: t <> '') AS a, list_filter(string_split({ev('gold_answers[1]')}, ' '), lambda t: t <> '') AS b),
c AS (SELECT a, b, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))::DOUBLE AS k FROM w) SELECT CASE WHEN len(a) > 0 AND len(b) > 0 AND k > 0 THEN 2 * (k / len(a)) * (k / len(b)) / (k / len(a) + k / len(b)) ELSE 0 END FROM c) ELSE 0 END, 6) AS score""",
)
over(
    "f30_truncate",
    lambda: [N.truncate_chars(F.col("question"), 60).alias("chars"), N.truncate_words(F.col("question"), 7).alias("words")],
    f"CASE WHEN length(question) <= 60 THEN question ELSE regexp_replace(substring(question, 1, 57), '{_WS}+$', '') || '...' END AS chars, CASE WHEN len(list_filter(string_split({collapse('question')}, ' '), lambda t: t <> '')) <= 7 THEN question ELSE array_to_string(list_filter(string_split({collapse('question')}, ' '), lambda t: t <> '')[1:7], ' ') END AS words",
)
over(
    "f31_contains_answer",
    lambda: [N.contains_answer(F.concat(A(), F.lit(" / "), F.col("question")), G()).alias("hit")],
    _EX.format(f"coalesce({strip('g')} <> '' AND contains(lower(final_answer || ' / ' || question), lower({strip('g')})), FALSE)") + " AS hit",
)
over(
    "f32_evidence_anchor",
    lambda: [N.evidence_anchor(A(), F.col("question")).alias("v")],
    "CASE WHEN len(list_filter(regexp_extract_all(lower(final_answer), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(regexp_extract_all(lower(question), '[a-z0-9]+'), w))) > 0 THEN array_to_string(list_filter(regexp_extract_all(lower(final_answer), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(regexp_extract_all(lower(question), '[a-z0-9]+'), w))[1:8], ' ') ELSE question END AS v",
    "question IS NOT NULL AND final_answer IS NOT NULL",
)


@R.query(
    "f33_observation_summary",
    f"""WITH e AS (SELECT row_id, unnest(range(len(steps)))::INT AS pos, unnest(steps) AS s FROM {_P} WHERE len(steps) > 0), h AS (SELECT row_id, pos, unnest(range(least(len(s.raw_observation), 5)))::INT AS i, unnest(s.raw_observation[1:5]) AS o FROM e WHERE s.tool_type = 'text_search' AND len(s.raw_observation) > 0),
l AS (SELECT row_id, pos, string_agg((i + 1) || '. ' || coalesce(o.title, 'result ' || (i + 1)) || ': ' || coalesce(o.snippet, ''), ' ' ORDER BY i) AS t FROM h GROUP BY row_id, pos),
w AS (SELECT row_id, pos, t, list_filter(string_split({collapse('t')}, ' '), lambda x: x <> '') AS ws FROM l) SELECT row_id, pos, CASE WHEN len(ws) <= 96 THEN t ELSE array_to_string(ws[1:96], ' ') END AS summary FROM w""",
)
def observation_summary(s, d):
    e = rollout_rows(s, d).select("row_id", F.posexplode("steps").alias("pos", "s")).where("s.tool_type = 'text_search' and size(s.raw_observation) > 0")
    line = lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(o["title"], F.concat(F.lit("result "), (i + 1).cast("string"))), F.lit(": "), F.coalesce(o["snippet"], F.lit("")))
    return e.select("row_id", "pos", N.truncate_words(F.array_join(F.transform(F.slice("s.raw_observation", 1, 5), line), " "), 96).alias("summary"))


R.add(
    "f36_answer_list",
    lambda s, d: rollout_rows(s, d).select("row_id", F.array_join(N.answer_list(F.when(F.col("row_id") % 2 == 0, F.to_json(G())).otherwise(A())), "|").alias("v")),
    f"SELECT row_id, array_to_string(list_filter(list_transform(CASE WHEN row_id % 2 = 0 THEN coalesce(gold_answers, []) WHEN final_answer LIKE '[%]' AND json_valid(final_answer) THEN (final_answer::JSON)::VARCHAR[] ELSE [final_answer] END, lambda x: {strip('x')}), lambda x: x <> ''), '|') AS v FROM {_P}",
)
over("f38_metric_key", lambda: [N.metric_key(F.concat(F.lit("val//"), F.col("data_source"), F.lit("/acc@"), F.col("row_id") % 5, F.lit("#é"))).alias("v")], "regexp_replace(regexp_replace(replace('val//' || data_source || '/acc@' || (row_id % 5) || '#é', '@', '_at_'), '/{2,}', '/', 'g'), '[^a-zA-Z0-9_./ -]', '_', 'g') AS v")
over("f39_search_attempt", lambda: [(F.regexp_replace(F.lower("question"), f"{_WS}", "").contains("sketch") & F.regexp_replace(F.lower("question"), f"{_WS}", "").contains("in17")).alias("v")], f"contains(regexp_replace(lower(question), '{_WS}', '', 'g'), 'sketch') AND contains(regexp_replace(lower(question), '{_WS}', '', 'g'), 'in17') AS v")
_KINDS = "CASE WHEN NOT called THEN CASE WHEN attempt THEN 'malformed_search_attempt' ELSE 'search_protocol_failed' END WHEN NOT direct AND search THEN 'search_helpful' WHEN direct AND search THEN 'search_unnecessary' WHEN direct THEN 'search_harmful' ELSE 'hard' END"
R.add(
    "f40_need_class",
    lambda s, d: rollout_rows(s, d).select("row_id", F.expr("row_id % 3 = 0").alias("direct"), F.coalesce("final_correct", F.lit(False)).alias("search"), F.expr("coalesce(tool_stats['num_text_search'], 0) > 0").alias("called"), F.expr("size(steps) > 1").alias("attempt")).select("row_id", F.expr(_KINDS).alias("kind")),
    f"SELECT row_id, {_KINDS} AS kind FROM (SELECT row_id, row_id % 3 = 0 AS direct, coalesce(final_correct, FALSE) AS search, coalesce(tool_stats['num_text_search'], 0) > 0 AS called, coalesce(len(steps), -1) > 1 AS attempt FROM {_P})",
)
_BOX = "[(row_id % 97) * 1.5, (row_id % 89) * 2.5, (row_id % 97) * 1.5 + row_id % 50, (row_id % 89) * 2.5 + row_id % 41]"
R.add(
    "f41_boxes",
    lambda s, d: rollout_rows(s, d).select("row_id", F.array_join(N.finalize_box(F.expr("array((row_id % 97) * 1.5D, (row_id % 89) * 2.5D, (row_id % 97) * 1.5D + row_id % 50, (row_id % 89) * 2.5D + row_id % 41)"), F.lit(160), F.lit(200)), ",").alias("box")),
    f"""WITH b AS (SELECT row_id, list_transform({_BOX}, lambda x: x::DOUBLE) AS b FROM {_P}), u AS (SELECT row_id, CASE WHEN greatest(abs(b[1]), abs(b[2]), abs(b[3]), abs(b[4])) <= 1.5 THEN [b[1] * 160, b[2] * 200, b[3] * 160, b[4] * 200] ELSE b END AS b FROM b),
i AS (SELECT row_id, greatest(0, least(159, round_even(b[1], 0)::INT)) AS x1, greatest(0, least(199, round_even(b[2], 0)::INT)) AS y1, greatest(1, least(160, round_even(b[3], 0)::INT)) AS x2, greatest(1, least(200, round_even(b[4], 0)::INT)) AS y2 FROM u)
SELECT row_id, CASE WHEN x2 > x1 AND y2 > y1 THEN concat_ws(',', x1, y1, x2, y2) END AS box FROM i""",
)
R.add(
    "f42_grid_boxes",
    lambda s, d: s.range(3).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("i"), (F.col("id") + 1).alias("n")).select("n", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j")).select(
        "n", "i", "j", F.expr("cast(i * 640 / n as int)").alias("x1"), F.expr("cast(j * 480 / n as int)").alias("y1"), F.expr("cast((i + 1) * 640 / n as int)").alias("x2"), F.expr("cast((j + 1) * 480 / n as int)").alias("y2")
    ),
    "SELECT n, i, j, floor(i * 640 / n)::INT AS x1, floor(j * 480 / n)::INT AS y1, floor((i + 1) * 640 / n)::INT AS x2, floor((j + 1) * 480 / n)::INT AS y2 FROM range(1, 4) t(n), LATERAL range(0, n) u(i), LATERAL range(0, n) v(j)",
)
R.add("f43_workload", lambda s, d: table(s, d, "documents").select("doc_id", N.workload(F.col("n_chars")).alias("w")), "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS w FROM documents")
over("f47_variant_weights", lambda: [F.round(0.3 * F.greatest(F.lit(0.0), F.col("latency") - 0.5) + 0.7 * F.greatest(F.lit(0.0), F.col("latency")) + 1e-9, 6).alias("local"), F.greatest(F.lit(0.2), F.col("latency")).alias("answer")], "round(0.3 * greatest(0.0, latency - 0.5) + 0.7 * greatest(0.0, latency) + 1e-9, 6) AS local, greatest(0.2, latency) AS answer", "latency is not null")
over("f48_unit_weight", lambda: [N.unit_weight(F.when(F.col("row_id") % 3 == 0, A()).otherwise(F.col("latency").cast("string"))).alias("w")], "greatest(least(coalesce(TRY_CAST(CASE WHEN row_id % 3 = 0 THEN final_answer ELSE latency::VARCHAR END AS DOUBLE), 0), 1), 0)::DOUBLE AS w")
over("f49_clean_brackets", lambda: [F.replace(F.regexp_replace(F.replace(N.strip(F.concat(F.lit(" The "), A(), F.lit(" [title] x [header] y  z "))), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" ")).alias("v")], rf"replace(regexp_replace(replace({strip('''' The ' || final_answer || ' [title] x [header] y  z ' ''')}, ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS v")
over("f50_truthy", lambda: [N.truthy(F.when(F.col("row_id") % 4 == 0, " Yes ").when(F.col("row_id") % 4 == 1, "TRUE").when(F.col("row_id") % 4 == 2, "0").otherwise(A())).alias("v")], f"coalesce(lower({strip('''CASE row_id % 4 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' ELSE final_answer END''')}) IN ('1', 'true', 'yes', 'y'), FALSE) AS v")


@R.query(
    "f52_resize",
    """WITH a AS (SELECT row_id, (100 + row_id % 900)::INT AS w, (80 + row_id % 700)::INT AS h FROM prompted_search_smoke), b AS (SELECT row_id, CASE WHEN w * h > 250000 THEN floor(w * sqrt(250000.0 / (w * h)))::INT ELSE w END AS w, CASE WHEN w * h > 250000 THEN floor(h * sqrt(250000.0 / (w * h)))::INT ELSE h END AS h FROM a)
SELECT row_id, CASE WHEN w * h < 40000 THEN floor(w * sqrt(40000.0 / (w * h)))::INT ELSE w END AS w, CASE WHEN w * h < 40000 THEN floor(h * sqrt(40000.0 / (w * h)))::INT ELSE h END AS h FROM b""",
)
def resize(s, d):
    w, h = N.resize((100 + F.col("row_id") % 900).cast("int"), (80 + F.col("row_id") % 700).cast("int"), 250000, 40000)
    return rollout_rows(s, d).select("row_id", w.alias("w"), h.alias("h"))


over("p17_evidence_type", lambda: [N.evidence_type(F.col("question")).alias("kind")], "CASE WHEN regexp_matches(lower(question), 'logo|brand|emblem') THEN 'logo' WHEN regexp_matches(lower(question), 'screen|website|app|display|monitor') THEN 'screen' WHEN regexp_matches(lower(question), 'document|receipt|newspaper|paper|page|map') THEN 'document' WHEN regexp_matches(lower(question), 'text|sign|poster|caption|license plate') THEN 'text' WHEN regexp_matches(lower(question), 'person|face|human|celebrity') THEN 'person' WHEN regexp_matches(lower(question), 'part|detail|fine-grained|close-up') THEN 'fine_grained_part' WHEN regexp_matches(lower(question), 'object|product|vehicle|animal|building') THEN 'object' ELSE 'mixed' END AS kind")
over("u06_ordered_dedupe", lambda: [F.array_join(N.ordered_dedupe(F.concat(G(), F.array(A(), F.lit(" "), F.lower(A())))), "|").alias("v")], f"array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(list_concat(gold_answers, [final_answer, ' ', lower(final_answer)]), lambda x: {strip('x')}), lambda x: x IS NOT NULL AND x <> ''), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda y: lower(y)), lower(x[1])) THEN acc ELSE list_concat(acc, x) END), '|') AS v", "gold_answers IS NOT NULL")
R.add(
    "f27_redact",
    lambda s, d: rollout_rows(s, d).select("row_id", N.redact(F.concat(F.lit("Note. Answer: "), A(), F.lit(". then "), F.col("question"), F.lit(" ground_truth : x. "), A()), F.array_append(G(), A())).alias("v")),
    f"SELECT row_id, {redacted("'Note. Answer: ' || final_answer || '. then ' || question || ' ground_truth : x. ' || final_answer", 'CASE WHEN gold_answers IS NOT NULL THEN list_append(gold_answers, final_answer) END')} AS v FROM {_P}",
)
