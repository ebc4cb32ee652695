"""Texts cut off by field limits (problem 2).

Method: a structural completeness check. A stack automaton reads the quotes, brackets and markup of every value
and tells what is left open; further signs are a broken multibyte sequence or escape at the end, a cut mark,
an abbreviation at the end, and a missing terminator. A value that ends earlier sentences of its own and not its
last one was cut. What a missing terminator means elsewhere depends on the source: the share of sentences that
show a terminator is counted per source and field over all rows, and a missing terminator counts as a cut unless these
counts, and those of the field over all sources, show beyond chance (upper confidence limit) that sentences end with one less
often than ``BASELINE``; so a source that cuts most of its values is measured by the others. Values that never have one (fact lines, keyword queries, questions without a question
mark) are told apart by their form and do not count. A question without its mark is complete if it ends as questions with a
mark do: the last words of all terminated questions are counted (digits alike), and those that end at least ``END_SHARE`` of
them form the profile. A query is also held against the question it was made from, where a last word that is the beginning
of a question's word was cut.

Plan: one scan of the needed nested columns, one ``mapInArrow`` whose result, the values with a sign of a cut and
a few counts a batch, is staged; a partial aggregate of (source, field) counts and a join with those few rows. The profile of
last words is an aggregate over the questions, of which at most 1 / END_SHARE rows reach the driver.

Defined results: null and empty values are complete; null steps and entries are skipped, positions count
them; a null source is a source of its own; a null question leaves the checks that do not need it; repeated
rows each give their rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.session import staged

#: Share of sentences with a terminator from which a missing one counts as a cut.
BASELINE = 0.5

#: Share of the terminated questions that a last word must end to belong to the profile.
END_SHARE = 0.01
#: Standard errors between a share and its confidence limit.
LIMIT = 1.0

# Abbreviations, opening and closing characters, words that ask and verbs that begin a question.
ABBREVIATIONS = ("approx", "ca", "env", "aprox", "no", "nr", "núm", "num", "bzw", "vgl", "cf", "vs")
CLOSERS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
ASK_WORDS = frozenset(
    "who which when where why how whose whom what wer wen wem was welche welcher welches welchen welchem wann wo warum wie qui que quel quelle quels quelles quand où pourquoi comment combien quién quiénes qué cuál cuándo dónde cómo cuánto cuántos".split()
)
ASK_VERBS = frozenset("is are was were did does do has have can could will ist sind war waren hat haben kann wird est sont es son está están".split())
_INVERSION = re.compile(r"\w-(?:t-)?(?:il|elle|ils|elles|on)\b", re.I)

_MARKS = re.compile(r"""["“”«»()\[\]{}]|</?[A-Za-z][^<>]*>|<""")
_ENDED = re.compile(r"[.!?。！？…][\"”»'’)\]*_]*$")
_INNER = re.compile(r"""(\w{3,})[.!?][\"”»'’)\]*_]*\s+[\"“«(\[¿¡*_]*([^\W\d_])""")
_CUT_MARK = re.compile(r"(?:\.\.\.|…)$")
_BROKEN = re.compile(r"(?:�|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&[A-Za-z#0-9]{0,8}|%[0-9a-fA-F]?)$")
_FACTS = re.compile(r"^[^|:]{1,40}: [^|]+\|")
_QUESTION_WORD = re.compile(r"\w+", re.U)
_ABBREVIATED = re.compile(r"\b(?:" + "|".join(ABBREVIATIONS) + r")\.$", re.I)


def left_open(text: str) -> bool:
    """Stack automaton: True if a quote, bracket or tag is still open at the end."""
    stack: list[str] = []
    for sign in _MARKS.findall(text):
        if sign == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append(sign)
        elif sign in CLOSERS:
            if CLOSERS[sign] in stack:
                while stack.pop() != CLOSERS[sign]:
                    pass
        elif sign[0] == "<":
            if sign == "<":
                continue
            name = re.match(r"</?([A-Za-z]+)", sign)[1].lower()
            if sign[1] == "/":
                if f"<{name}" in stack:
                    while stack.pop() != f"<{name}":
                        pass
            elif not sign.endswith("/>") and name not in ("br", "img", "hr"):
                stack.append(f"<{name}")
        else:
            stack.append(sign)
    return bool(stack)


def is_fact_line(text: str) -> bool:
    return bool(_FACTS.match(text))


def asks(sentence: str) -> bool:
    """Begins as a question: with a word that asks, after a preposition or a first phrase as well, or with a verb."""
    words = words_of(sentence)
    if not words:
        return False
    if words[0] in ASK_WORDS and words[1:2] not in (["a"], ["an"]) or words[0] in ASK_VERBS or words[1:2] and words[1] in ASK_WORDS:
        return True
    after = words_of(sentence.partition(",")[2])
    return bool(after) and after[0] in ASK_WORDS or bool(_INVERSION.search(sentence))


def end_shape(text: str) -> str:
    """The last word in lower case, digits alike."""
    words = words_of(text)
    return re.sub(r"\d", "9", words[-1]) if words else ""


def asks_in_full(text: str, ends: frozenset[str]) -> bool:
    """A question that only lacks its mark: it begins as one and ends as terminated questions do."""
    tail = text.rstrip(" *_")
    sentence = re.sub(r"\s+", " ", re.split(r"(?<=[.!?]) +(?=[^\W\d_]|¿)", tail)[-1]).strip(" *_")
    return (sentence.startswith("¿") or asks(sentence)) and end_shape(sentence) in ends


def ends_early(text: str, ends: frozenset[str] = frozenset()) -> bool | None:
    """True: a sure sign of a cut. False: properly ended, or of a form without terminator. None: only the
    terminator is missing. ``ends`` is the profile of last words of questions."""
    bare = text.rstrip()
    if not bare or is_fact_line(bare):
        return False
    if _CUT_MARK.search(bare) or _BROKEN.search(bare):
        return True
    core = bare.rstrip("*_")
    if _ENDED.search(core):
        return bool(_ABBREVIATED.search(core)) or left_open(core)
    if left_open(core):
        return True
    if asks_in_full(bare, ends):
        return False
    return None


def ends_inner_sentence(text: str) -> bool:
    """True if a sentence before the last one has its terminator."""
    return any(m[2].isupper() and m[1].lower() not in ABBREVIATIONS for m in _INNER.finditer(text))


def words_of(text: str) -> list[str]:
    return _QUESTION_WORD.findall(text.lower())


def query_ends_early(text: str, question: str | None, ends: frozenset[str] = frozenset()) -> bool | None:
    """The same for a search query, held against the question it serves."""
    bare = text.rstrip()
    whole = (question or "").strip()
    if not bare or bare == whole:
        return False
    low, full = bare.lower(), whole.lower()
    sure = ends_early(text, ends)
    # a question that reads as complete can still be the beginning of a longer one
    if sure or sure is False and not (full.startswith(low) and asks_in_full(bare, ends)):
        return sure
    if full.startswith(low):
        return bool(words_of(full[len(low) :])) or full[len(low) :].strip(" ?!.") != ""
    parts = bare.split()
    keyword = len(parts) <= 7 and not (bare[0] == "¿" or (bare[0].isupper() and any(p[0].islower() for p in parts)))
    if not keyword:
        return None
    known = words_of(whole)
    if not known:
        return None if len(parts) < 3 else False
    tail = words_of(" ".join(parts))
    if not tail:
        return False
    last = tail[-1]
    before = tail[-2] if len(tail) > 1 else ""
    if last not in known:
        # the word cut short is the one that follows in the question, or begins some word of it
        follows = [b for a, b in zip(known, known[1:]) if a == before]
        return any(b != last and b.startswith(last) for b in follows) or (before in known and any(k != last and k.startswith(last) for k in known)) or (len(tail) > 1 and before not in known and any(len(k) > len(last) >= 3 and k.startswith(last) for k in known)) or (before not in known and not any(p[:1].isupper() for p in parts[1:]) and parts[0][:1].islower())
    return before not in known and len(known) > 1 and any(a == last for a in known[:-1])


def truncated_values(df: DataFrame, id_col: str = "row_id", source_col: str = "data_source", question_col: str = "question", steps_col: str = "steps", baseline: float = BASELINE) -> DataFrame:
    """(id_col, step_id, hit_pos, field, source): every value that was cut."""
    return _cut(*_judge(df, id_col, source_col, question_col, steps_col), id_col, baseline)


def _cut(judged: DataFrame, counts: DataFrame, id_col: str, baseline: float) -> DataFrame:
    # few rows: sources x fields; a source below the baseline is measured by its field over all sources
    own = counts.groupBy("source", "field").agg(F.sum("sentences").alias("sentences"), F.sum("ended").alias("ended"))
    field = own.groupBy(F.col("field").alias("_g")).agg(F.sum("sentences").alias("_sentences"), F.sum("ended").alias("_ended"))

    def reaches(ended: str, n: str) -> Column:
        """The share ended / n may be the baseline or more: its upper confidence limit (Wilson) is not below."""
        size, share = F.nullif(F.col(n).cast("double"), F.lit(0.0)), F.try_divide(F.col(ended), F.col(n))
        z = LIMIT * LIMIT
        high = (share + z / (2 * size) + LIMIT * F.sqrt(share * (1 - share) / size + z / (4 * size * size))) / (1 + z / size)
        return F.coalesce(high >= baseline, F.lit(False))

    usual = own.join(field, F.col("field") == F.col("_g")).select("source", "field", (reaches("ended", "sentences") | reaches("_ended", "_sentences")).alias("usual"))
    sure = judged.where("sure")
    likely = judged.where("not sure").join(usual.where("usual").withColumnsRenamed({"source": "_s", "field": "_f"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")), "left_semi")
    return sure.unionByName(likely).select(id_col, "step_id", "hit_pos", "field", "source")


def truncation_rates(df: DataFrame, id_col: str = "row_id", source_col: str = "data_source", question_col: str = "question", steps_col: str = "steps") -> DataFrame:
    """(source, field, n_values, n_cut, share): how often each source truncates, over non-empty values."""
    judged, counts = _judge(df, id_col, source_col, question_col, steps_col)
    total = counts.groupBy("source", "field").agg(F.sum("n").alias("n_values"), F.lit(0).cast("bigint").alias("n_cut"))
    cut = _cut(judged, counts, id_col, BASELINE).groupBy("source", "field").agg(F.lit(0).cast("bigint").alias("n_values"), F.count(F.lit(1)).alias("n_cut"))
    return total.unionByName(cut).groupBy("source", "field").agg(F.sum("n_values").alias("n_values"), F.sum("n_cut").alias("n_cut")).withColumn("share", F.round(F.try_divide("n_cut", "n_values"), 6))


def question_ends(df: DataFrame, question_col: str) -> frozenset[str]:
    """The profile: last words (digits alike) of at least END_SHARE of the questions that show their mark."""
    last = F.regexp_extract(df[question_col], r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*[?][^\p{L}\p{N}_]*$", 1)
    words = df.select(F.regexp_replace(F.lower(last), r"\p{N}", "9").alias("w")).where("w <> ''")
    # the most frequent words, and, as the row without one, their total; at most 1 / END_SHARE words reach the share
    top = words.rollup("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1 + int(1 / END_SHARE)).collect()
    total = max((r["n"] for r in top if r["w"] is None), default=0)
    return frozenset(r["w"] for r in top if r["w"] is not None and r["n"] >= END_SHARE * total)


def _judge(df: DataFrame, id_col: str, source_col: str, question_col: str, steps_col: str) -> tuple[DataFrame, DataFrame]:
    """The values with a sign of a cut (sure or not), and per scanned batch the number of values, of sentences among
    them and of those that show a terminator."""
    element = df.schema[steps_col].dataType.elementType
    step_type = element["step_id"].dataType
    rows = df.select(
        df[id_col].alias("id"),
        df[source_col].alias("source"),
        df[question_col].alias("question"),
        F.transform(
            df[steps_col],
            lambda s: F.when(
                s.isNotNull(),
                F.struct(s["step_id"].alias("step_id"), F.when(s["tool_type"] == "text_search", s["action_text"]).alias("action"), F.transform(s["raw_observation"], lambda h: h["snippet"]).alias("snippets")),
            ),
        ).alias("steps"),
    ).where(F.size("steps") > 0)
    id_type, src_type = df.schema[id_col].dataType.simpleString(), df.schema[source_col].dataType.simpleString()
    schema = f"id {id_type}, source {src_type}, step_id {step_type.simpleString()}, hit_pos int, field string, sure boolean, n bigint, sentences bigint, ended bigint"

    ends = question_ends(df, question_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool | None] = {}

        def verdict(text: str) -> bool | None:
            if text not in seen:
                if len(seen) > 20_000:
                    seen.clear()
                seen[text] = ends_early(text, ends)
            return seen[text]

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            ids, sources, questions = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            counts: dict[tuple, list[int]] = {}
            for key, source, question, steps in zip(ids, sources, questions, batch.column(3)):
                for step in steps.as_py() or ():
                    if step is None:
                        continue
                    values = [(-1, "action_text", step["action"])] + [(j, "snippet", t) for j, t in enumerate(step["snippets"] or ())]
                    for place, field, text in values:
                        if not text:
                            continue
                        early = query_ends_early(text, question, ends) if place < 0 else verdict(text)
                        ended = early is False and bool(_ENDED.search(text.rstrip().rstrip("*_")))
                        inner = early is None and ends_inner_sentence(text)
                        c = counts.setdefault((source, field), [0, 0, 0])
                        c[0] += 1
                        c[1] += ended or early is None
                        c[2] += ended or inner
                        if early is not False:
                            out.append((key, source, step["step_id"], place, field, early is True or inner, 0, 0, 0))
            out += [(None, s, None, None, f, None, *c) for (s, f), c in counts.items()]
            cols = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, arrow_types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    arrow_types, names = [f.type for f in arrow], [f.name for f in arrow]
    every = staged(rows.mapInArrow(run, schema))
    judged = every.where("sure is not null").select(F.col("id").alias(id_col), "source", "step_id", "hit_pos", "field", "sure")
    return judged, every.where("sure is null").select("source", "field", "n", "sentences", "ended")
