"""Queries and SQL of the training-data operators tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.leakage import leak_report, leaked_items, near_items
from tracequarry.llm.lookalikes import CYRILLIC, GREEK, look_alike_pairs, visual_forms
from tracequarry.llm.neighbours import nearest_rows, similar_pairs
from tracequarry.llm.overlap import overlap_counts, split_overlaps
from tracequarry.llm.packing import pack_documents
from tracequarry.llm.pair_defects import broken_pairs, pair_labels
from tracequarry.llm.spans import shared_share, shared_spans
from tracequarry.llm.tokens import encode_corpus
from tracequarry.llm.truncation import truncated_values, truncation_rates
from tracequarry.session import table


def held_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "offline_doc").where("split in ('validation', 'test')")


def leaks(s: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(s, d, "text_corpus"), held_items(s, d), "corpus_id", "snippet", "odoc_id", ["question", "answer"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: broken_pairs(table(s, d, "prompted_search_smoke")),
        "p1_labels": lambda s, d: pair_labels(table(s, d, "prompted_search_smoke")),
        "p2_found": lambda s, d: truncated_values(table(s, d, "prompted_search_smoke")).drop("source"),
        "p2_rates": lambda s, d: truncation_rates(table(s, d, "prompted_search_smoke")),
        "p3_found": leaks,
        "p3_near": lambda s, d: near_items(table(s, d, "text_corpus"), held_items(s, d), "corpus_id", "snippet", "odoc_id", ["question", "answer"]),
        "p3_report": lambda s, d: leak_report(leaks(s, d), held_items(s, d), "odoc_id", "split"),
        "p5_found": lambda s, d: split_overlaps(table(s, d, "fvqa_toy")),
        "p5_counts": lambda s, d: overlap_counts(split_overlaps(table(s, d, "fvqa_toy")), table(s, d, "fvqa_toy")),
        "p6_found": lambda s, d: similar_pairs(table(s, d, "offline_doc")),
        "p6_nearest": lambda s, d: nearest_rows(table(s, d, "offline_doc").where("odoc_id is not null"), "odoc_id", "image_dhash", "image_hist").withColumn("sim", F.round("sim", 6)),
        "p7_found": lambda s, d: look_alike_pairs(table(s, d, "prompted_search_smoke")),
        "p7_forms": lambda s, d: visual_forms(table(s, d, "prompted_search_smoke"), "row_id", "final_answer"),
        "p8_ids": lambda s, d: encode_corpus(table(s, d, "documents")),
        "p9_pack": lambda s, d: pack_documents(table(s, d, "documents")),
        "p10_found": lambda s, d: shared_spans(table(s, d, "documents")),
        "p10_share": lambda s, d: shared_share(table(s, d, "documents")),
    }


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""WITH h AS (SELECT odoc_id, split, {_WORDS.format('t')} AS w FROM (SELECT odoc_id, split, unnest([question, answer]) AS t FROM offline_doc WHERE split IN ('validation', 'test'))),
hw AS (SELECT odoc_id, split, list_slice(w, i, i + 7) AS g FROM (SELECT odoc_id, split, w, unnest(range(1, len(w) - 6)) AS i FROM h)),
c AS (SELECT corpus_id, {_WORDS.format('snippet')} AS w FROM text_corpus),
cw AS (SELECT corpus_id, list_slice(w, i, i + 7) AS g FROM (SELECT corpus_id, w, unnest(range(1, len(w) - 6)) AS i FROM c)),
found AS (SELECT DISTINCT corpus_id, odoc_id, split FROM cw JOIN hw USING (g))"""
_NEAR = """WITH v AS (SELECT odoc_id AS id, image_dhash AS b, image_hist AS h FROM offline_doc WHERE len(image_dhash) = 64 AND len(image_hist) = 24
    AND len(list_filter(image_dhash, lambda x: x IS NULL)) = 0 AND len(list_filter(image_hist, lambda x: x IS NULL)) = 0),
s AS (SELECT x.id, y.id AS other, round(0.7 * (list_sum(list_transform(range(1, 65), lambda i: (x.b[i] = y.b[i])::INT)) / 64.0) + 0.3 * list_sum(list_transform(range(1, 25), lambda i: least(x.h[i], y.h[i]))), 9) AS sim
    FROM v x JOIN v y ON x.id <> y.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rn FROM s)"""


def _form_sql(x: str) -> str:
    """The visual form in SQL: widths, look-alike letters and spaces translated, hidden characters dropped, accents composed."""
    spaces = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\t\n\r\x0b\x0c\x85"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    pairs = {**CYRILLIC, **GREEK}
    source, target = wide + spaces + "".join(pairs), narrow + " " * len(spaces) + "".join(pairs.values())
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    hidden = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}\x{0000}-\x{0008}\x{000e}-\x{001f}\x{007f}]"
    return f"nfc_normalize(translate(regexp_replace({x}, '{hidden}', '', 'g'), {quote(source)}, {quote(target)}))"


def _overlaps_sql() -> str:
    """Pairs by id, or by a word edit distance of at most 2 (furthest reaching rows on the diagonals -2..2)."""

    def run(i: str, j: str) -> str:
        left = f"greatest(0, least(len(a) - ({i}), len(b) - ({j})))"
        same = f"list_transform(range({left}), lambda k: a[({i}) + k + 1] = b[({j}) + k + 1])"
        return f"CASE WHEN list_contains({same}, FALSE) THEN list_position({same}, FALSE) - 1 ELSE {left} END"

    def level(e: int) -> str:
        cols = []
        for d in range(-e, e + 1):
            from_ = [f"f{e - 1}_{d - 1 + 9}" * (abs(d - 1) <= e - 1), f"f{e - 1}_{d + 9} + 1" * (abs(d) <= e - 1), f"f{e - 1}_{d + 1 + 9} + 1" * (abs(d + 1) <= e - 1)]
            cols.append(f"least(greatest({', '.join(x for x in from_ if x)}), len(a), len(b) - ({d})) AS s_{d + 9}")
        return ", ".join(cols)

    steps = [f"e0 AS (SELECT *, {run('0', '0')} AS f0_9 FROM c)"]
    for e in (1, 2):
        steps.append(f"g{e} AS (SELECT * , {level(e)} FROM e{e - 1})")
        steps.append(f"e{e} AS (SELECT * EXCLUDE ({', '.join(f's_{d + 9}' for d in range(-e, e + 1))}), {', '.join(f'CASE WHEN s_{d + 9} + {d} < 0 THEN -99 ELSE s_{d + 9} + ' + run(f's_{d + 9}', f's_{d + 9} + {d}') + f' END AS f{e}_{d + 9}' for d in range(-e, e + 1))} FROM g{e})")
    ends = " OR ".join(f"(len(b) - len(a) = {d} AND f{e}_{d + 9} >= len(a))" for e in range(3) for d in range(-e, e + 1))
    return (
        f"WITH q AS (SELECT row_id, split, data_source, lower(regexp_replace(sample_id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS sample, {_WORDS.format('question')} AS w FROM fvqa_toy),\n"
        "t AS (SELECT DISTINCT w FROM q WHERE split = 'train' AND w IS NOT NULL), h AS (SELECT DISTINCT w FROM q WHERE split <> 'train' AND w IS NOT NULL),\n"
        "c AS (SELECT t.w AS a, h.w AS b FROM t JOIN h ON abs(len(t.w) - len(h.w)) <= 2 AND len(list_intersect(t.w, h.w)) >= len(list_distinct(t.w)) - 2),\n"
        + ",\n".join(steps)
        + f",\nnear AS (SELECT a, b FROM e2 WHERE {ends}),\n"
        "p AS (SELECT x.row_id AS r, y.row_id AS s FROM near JOIN q x ON x.w = a AND x.split = 'train' JOIN q y ON y.w = b AND y.split <> 'train'\n"
        "UNION SELECT x.row_id, y.row_id FROM q x JOIN q y ON x.sample = y.sample AND x.split = 'train' AND y.split <> 'train'),\n"
        "found AS (SELECT DISTINCT least(r, s) AS row_id_a, greatest(r, s) AS row_id_b FROM p)"
    )


_SPANS = """WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i - 1 AS s, md5(substring(text, i, 200)) AS h FROM p),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, s FROM w SEMI JOIN r USING (h)),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM m)),
spans AS (SELECT doc_id, min(s)::INT AS span_start, (max(s) + 200)::INT AS span_end FROM g GROUP BY doc_id, k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _LEAKS + " SELECT DISTINCT corpus_id, odoc_id FROM found",
        "p3_report": _LEAKS + " SELECT odoc_id, split, count(*) AS n_rows FROM found GROUP BY odoc_id, split",
        "p5_found": _overlaps_sql() + " SELECT * FROM found",
        "p5_counts": _overlaps_sql() + " SELECT split, data_source, count(*) AS n_rows FROM fvqa_toy WHERE row_id IN (SELECT row_id_a FROM found UNION SELECT row_id_b FROM found) GROUP BY split, data_source",
        "p6_found": _NEAR + " SELECT DISTINCT least(id, other) AS odoc_id_a, greatest(id, other) AS odoc_id_b FROM k WHERE rn <= 5 AND sim >= 0.9",
        "p6_nearest": _NEAR + " SELECT id, other, round(sim, 6) AS sim FROM k WHERE rn <= 5 AND sim >= 0.9",
        "p7_found": f"WITH g AS (SELECT row_id, final_answer, unnest(gold_answers) AS gold, unnest(range(len(gold_answers)))::INT AS gold_pos FROM prompted_search_smoke WHERE len(gold_answers) > 0) SELECT row_id, gold_pos FROM g WHERE final_answer <> gold AND {_form_sql('final_answer')} = {_form_sql('gold')}",
        "p10_found": _SPANS + " SELECT * FROM spans",
        "p10_share": _SPANS
        + """ SELECT d.doc_id, length(d.text) AS n_chars, coalesce(c.n, 0)::BIGINT AS shared_chars, round(CASE WHEN length(d.text) > 0 THEN coalesce(c.n, 0) / length(d.text) ELSE 0.0 END, 6) AS shared_share
FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM spans GROUP BY doc_id) c USING (doc_id) WHERE d.text IS NOT NULL""",
    }
