"""Visually identical text with different characters (problem 7).

Method: after compatibility normalization and deletion of ignorable characters every token becomes a lattice:
each letter stands for all letters of Latin, Cyrillic and Greek shaped like it, the written one among them. Viterbi picks
the path with the best script-consistent character n-gram score: the share of the script and the bigrams of letters within
it, with a penalty for every change of script. Scores are fitted on all texts, from tokens in the script of their text
(the one of most letters which no other script shares); so a word is written in the script whose words look like it, not
letter by letter in Latin.

The lattice depends on the shapes only, not on which of the look-alikes was written, so with the same scores texts that look
the same get the same form, and texts with different shapes never do. Letter case and accents stay.

Plan: the scores are counted per task in one scan of the text column and summed by letters, so that only counts are shuffled
and their number is that of an alphabet, whatever the number of texts; candidate pairs are found by JVM expressions (two different
strings without a character outside printable ASCII cannot look the same); only those go to one ``mapInArrow``, without a shuffle.

Defined results: null stays null, an empty or invisible text becomes empty; kinds of space become the plain
space, their number stays; a null gold list or entry gives no pair; repeated rows each give their rows; other
columns are ignored. Without fitted scores (``visual_form``) Latin is preferred.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters shaped like Latin ones (single letters of the Unicode confusables).
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏѵүьАВЕЅІЈКМНОРСТУХҮѴЬԌԚԜҺӀ", "aeopcyxsijhdqwlvybABESIJKMHOPCTYXYVbGQWhI"))
GREEK = dict(zip("αγικνορσυχϱϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϒϹͿ", "ayikvopouxpcjABEZHIKMNOPTYXYCJ"))
# Characters that are not shown, besides those of category Cf.
HIDDEN = {chr(c) for c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))}

LATIN, CYR, GRK, COMMON = range(4)
#: Counts a task holds before it hands them on.
HELD = 200_000
#: Score of a change of script between neighbouring letters.
CHANGE_SCORE = -8.0
#: Weight of a bigram that was not seen, and the number of letters it may be of.
SMOOTH, LETTERS = 0.1, 60


def _options() -> dict[str, tuple[tuple[str, int], ...]]:
    shapes: dict[str, list[tuple[str, int]]] = {}
    for script, table in ((CYR, CYRILLIC), (GRK, GREEK)):
        for other, latin in table.items():
            shapes.setdefault(latin, [(latin, LATIN)]).append((other, script))
    return {x: tuple(of) for of in shapes.values() for x, _ in of}


OPTIONS = _options()


def script_of(ch: str) -> int:
    c = ord(ch)
    if 0x0400 <= c <= 0x052F:
        return CYR
    if 0x0370 <= c <= 0x03FF or 0x1F00 <= c <= 0x1FFF:
        return GRK
    return LATIN if ch.isalpha() else COMMON


SHARED = frozenset(OPTIONS)
# Letters of the lattice that compatibility normalization would turn into other ones.
KEPT = frozenset(c for c in SHARED if unicodedata.normalize("NFKD", c) != c)
# Letters of which a bigram can tell paths apart: between two others every path has the same letters.
TELLING = frozenset(c.lower() for c in SHARED) | {""}


def base_letters(text: str) -> str:
    """Decomposed, without characters that are not shown, kinds of space as spaces."""
    kept = []
    flat = unicodedata.normalize("NFKD", text) if KEPT.isdisjoint(text) else "".join(c if c in KEPT else unicodedata.normalize("NFKD", c) for c in text)
    for ch in flat:
        kind = unicodedata.category(ch)
        if ch in "\t\n\r\x0b\x0c\x85" or kind in ("Zs", "Zl", "Zp"):
            kept.append(" ")
        elif not (kind in ("Cf", "Cc") or ch in HIDDEN):
            kept.append(ch)
    return unicodedata.normalize("NFD", "".join(kept))


#: Tokens of each script before anything is seen: Latin is preferred.
PRIOR = {LATIN: 3, CYR: 2, GRK: 1}


class Scores:
    """Character bigrams by script (letters in lower case, "" before the first), and how common each script is.

    Bigrams that cannot tell paths apart are left out of ``pairs``, not of ``firsts``.
    """

    def __init__(self) -> None:
        self.pairs: dict[tuple[int, str, str], int] = {}
        self.firsts: dict[tuple[int, str], int] = {}
        self.tokens = dict(PRIOR)

    def add(self, text: str | None) -> None:
        """Counts the tokens written in the script of the text: that of most letters which no other script shares."""
        tokens = base_letters(text or "").split(" ")
        own = Counter(script_of(c) for t in tokens for c in t if c.isalpha() and c not in SHARED)
        if not own:
            return
        of_text = max(own, key=lambda k: (own[k], -k))
        for token in tokens:
            letters = [c for c in token if c.isalpha()]
            scripts = {script_of(c) for c in letters}
            if scripts != {of_text}:
                continue
            script, before = scripts.pop(), ""
            self.tokens[script] += 1
            for c in map(str.lower, letters):
                if before in TELLING or c in TELLING:
                    self.pairs[script, before, c] = self.pairs.get((script, before, c), 0) + 1
                self.firsts[script, before] = self.firsts.get((script, before), 0) + 1
                before = c

    def counts(self) -> Iterator[tuple[int, str | None, str | None, int]]:
        """What was seen as (script, before, letter, n): bigrams, first letters without a letter, tokens without both."""
        yield from ((*k, n) for k, n in self.pairs.items())
        yield from ((*k, None, n) for k, n in self.firsts.items())
        yield from ((k, None, None, n - PRIOR[k]) for k, n in self.tokens.items())

    def merge(self, counts: Iterable[tuple[int, str | None, str | None, int]]) -> None:
        for script, before, letter, n in counts:
            if letter is not None:
                self.pairs[script, before, letter] = self.pairs.get((script, before, letter), 0) + n
            elif before is not None:
                self.firsts[script, before] = self.firsts.get((script, before), 0) + n
            else:
                self.tokens[script] += n

    def share(self, script: int) -> float:
        return math.log(self.tokens[script] / sum(self.tokens.values()))

    def pair(self, script: int, before: str, letter: str) -> float:
        seen = self.pairs.get((script, before, letter.lower()), 0)
        return math.log((seen + SMOOTH) / (self.firsts.get((script, before), 0) + SMOOTH * LETTERS))


class VisualForms:
    """The one form of all texts that look alike, under given scores."""

    def __init__(self, scores: Scores):
        self.scores = scores
        self.memo: dict[str, str] = {}

    def token(self, token: str) -> str:
        """Best path through the look-alike lattice of a decomposed token."""
        # by (script, last letter): score and path; ties go to the path that sorts last, whatever was written
        best: dict[tuple[int, str], tuple[float, str]] = {(COMMON, ""): (0.0, "")}
        for ch in token:
            if unicodedata.combining(ch) or (ch not in OPTIONS and script_of(ch) == COMMON):
                best = {k: (score, path + ch) for k, (score, path) in best.items()}
                continue
            step: dict[tuple[int, str], tuple[float, str]] = {}
            for option, script in OPTIONS.get(ch) or ((ch, script_of(ch)),):
                for (s, before), (score, path) in best.items():
                    if s == COMMON:
                        score += self.scores.share(script)
                    elif s != script:
                        score, before = score + CHANGE_SCORE + self.scores.share(script), ""
                    value, key = (round(score + self.scores.pair(script, before, option), 9), path + option), (script, option.lower())
                    if key not in step or value > step[key]:
                        step[key] = value
            best = step
        return max(best.values())[1]

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        out = []
        for token in base_letters(text).split(" "):
            if token not in self.memo:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[token] = self.token(token)
            out.append(self.memo[token])
        return unicodedata.normalize("NFC", " ".join(out))


#: The form without fitted scores.
visual_form = VisualForms(Scores())


def fit_scores(texts: DataFrame) -> Scores:
    """Scores of all texts (the only column): counts of each task, summed."""
    arrow = pa.schema([("script", pa.int32()), ("before", pa.string()), ("letter", pa.string()), ("n", pa.int64())])

    def rows(part: Scores) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*part.counts()), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Scores()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                part.add(text)
            if len(part.pairs) + len(part.firsts) > HELD:
                yield rows(part)
                part = Scores()
        yield rows(part)

    scores = Scores()
    counted = texts.mapInArrow(run, "script int, before string, letter string, n bigint")
    scores.merge(counted.groupBy("script", "before", "letter").agg(F.sum("n")).collect())
    return scores


def needs_form(c: Column) -> Column:
    """True if the text holds anything but printable ASCII."""
    return F.coalesce(c.rlike(r"[^\x20-\x7e]"), F.lit(False))


def visual_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, form): the consistent form of every text of a column."""
    src = df.select(df[id_col], df[text_col])
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("form", T.StringType())])
    scores = fit_scores(src.select(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = VisualForms(scores)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([form(x) for x in batch.column(1).to_pylist()], type=pa.string())], names=[id_col, "form"])

    return src.mapInArrow(run, schema)


def look_alike_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "final_answer", list_col: str = "gold_answers") -> DataFrame:
    """(id_col, gold_pos): entries of ``list_col`` that look like the text but are another sequence of characters."""
    src = df.select(df[id_col], df[text_col].alias("_text"), F.posexplode(df[list_col]).alias("gold_pos", "_gold"))
    src = src.where(F.col("_text").isNotNull() & F.col("_gold").isNotNull() & (F.col("_text") != F.col("_gold")) & (needs_form(F.col("_text")) | needs_form(F.col("_gold"))))
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("gold_pos", T.IntegerType())])
    scores = fit_scores(df.select(df[text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = VisualForms(scores)
        for batch in batches:
            text, gold = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            same = pa.array([form(a) == form(b) for a, b in zip(text, gold)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=[id_col, "gold_pos"]).filter(same)

    return src.mapInArrow(run, schema)
