"""Broken prompt and response pairs (problem 1).

Method: for every kind of defect several noisy labelling functions vote for (+1), against (-1) or abstain
(0). They read form, structure and closed-class words only; but for one function of ``cut_gold`` none knows whether the
answer is a gold answer. An expectation-maximization label model per defect estimates from all rows how often each function
votes which way on defective and on sound pairs, and gives each vote pattern a posterior; a function that is often wrong
weighs little, whatever its vote. A defect is kept where its posterior exceeds its cutoff; several may be kept
(``pair_labels``), the most specific one is reported by ``broken_pairs``.

Cutoffs are validated on labelled pairs of both kinds: a bounded sample (``VALIDATION`` rows, by hash) of pairs known to be
sound - the answer is a gold answer, or a complete sentence with a gold answer which its question lacks - and the same pairs
damaged in known ways (emptied, cut, answered with their question, with a sentence of another language, or with a refusal).
Sound answers are voted on without the gold answers they equal. The cutoff with the best F1 at the estimated share of
defective pairs is taken.

Plan: one ``mapInArrow`` turns rows into (id, votes code); its small result is staged once. Vote patterns are
counted by partial aggregates (at most 3**6 rows per defect, whatever the input), the model is fitted on these
counts on the driver, and the posteriors come back as a lookup over patterns. The sample is a top-n by hash. No shuffle of rows.

Defined results: a null or blank answer is ``empty``; a null question or gold list only silences the functions
that need it; null gold entries are skipped; repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm.lookalikes import visual_form
from tracequarry.llm.truncation import left_open
from tracequarry.llm.words import edits_within, hashed_sample
from tracequarry.session import staged

#: Defects in the order in which one of several is reported; each has a label model. The two ways of being cut leave different
#: signs, so a sentence and a gold answer that stop early have a model each; both are reported as ``truncated``.
DEFECTS = ("empty", "copied_question", "cut_sentence", "cut_gold", "refusal", "other_language")
VOTERS = {"empty": 3, "copied_question": 4, "cut_sentence": 4, "cut_gold": 3, "refusal": 6, "other_language": 4}
REPORTED = {"cut_sentence": "truncated", "cut_gold": "truncated"}
CUTOFF_GRID = (0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
#: Bound of the sample of rows from which labelled pairs are made.
VALIDATION = 400

# Stand-ins for a missing value, particles of names, closed-class words of the languages (articles, pronouns,
# prepositions, conjunctions, auxiliaries, question words).
STAND_INS = frozenset("none null nil nan na n/a undefined missing tbd empty blank unknown unbekannt keine kein aucun aucune ninguno ninguna nulo vide leer vacío".split())
PARTICLES = frozenset("the of de du des la le les l el los las del von der die das van di da et y and".split())
FUNCTION_WORDS = {
    "en": "the a an is are was were be been has have had do does did can could will would should must not no and or but if because that this these those there it its he she they we you i my your his her their who whom whose which what when where why how in on at by for with from of to as than about after before between into over under until while so".split(),
    "fr": "le la les l un une des du de d est sont était été être a ont avait peut ne n pas et ou mais si car parce que qu qui quoi dont où quand comment pourquoi quel quelle quels quelles ce cet cette ces c il elle ils elles on nous vous je j me m se s lui leur son sa ses mon ma mes dans sur sous pour par avec sans chez entre vers avant après au aux en y plus".split(),
    "de": "der die das den dem des ein eine einen einem einer eines ist sind war waren wird wurde wurden hat haben hatte kann nicht kein keine und oder aber wenn weil denn dass ob als wie wer wen wem was wann wo warum welche welcher welches welchem welchen dies diese dieser dieses es er sie wir ihr ich mir mich sich sein seine ihre in im an am auf aus bei beim mit nach von vom vor zu zum zur für über unter um durch neben bevor nur auch".split(),
    "es": "el la los las lo un una unos unas es son era fue ser está están ha han había puede no ni y e o u pero si porque que qué quien quién cual cuál cuándo dónde cómo por para con sin de del al a en entre sobre hasta desde antes después este esta estos estas esto ese esa eso se me te le les nos yo él ella ellos su sus mi tu ya más muy también según".split(),
    "it": "il lo la i gli le l un uno una è sono era ha hanno non e o ma se perché che chi cosa quale quando dove come di del della dello dei degli delle da dal dalla in nel nella a al alla su sul sulla con per tra fra questo questa si mi ti ci suo sua anche più dato".split(),
    "nl": "de het een is zijn was waren heeft had kan niet geen en of maar als omdat want dat die dit deze wie wat welke wanneer waar waarom hoe in op aan bij met naar van voor over onder om door uit te er ze hij wij je ik mijn hun ook al nog".split(),
    "pt": "o a os as um uma uns é são era foi ser está tem não nem e ou mas se porque pois que quem qual quando onde como de do da dos das em no na nos nas por pelo pela para com sem entre sobre até este esta isto ele ela eu me seu sua já mais também".split(),
    "sv": "och är var inte det den de ett en som på i för med av att om eller men när vad vem vilken hur har hade kan till från under över mellan han hon jag vi du sin också eftersom".split(),
    "pl": "jest są był była nie i oraz lub albo ale bo że to ta ten te kto co który która kiedy gdzie jak w we na do z ze od po za o przez przy dla pod nad się jego jej ja on ona już też".split(),
}
# Words that negate, that speak of being able or willing to answer, of regret, of contrast, and of oneself.
NEGATIONS = frozenset(
    "not no nor nothing never cannot can't couldn't won't wouldn't don't doesn't didn't isn't unable impossible decline refuse pas rien aucun aucune jamais impossible refuse nicht kein keine keinen keinerlei nichts nie ablehnen ablehne verweigere unmöglich no ni nada nunca ningún ninguna imposible niego rechazo".split()
)
ABLE = frozenset(
    "can able allow allowed permitted access information answer answers respond help assist say tell determine identify guess discuss provide share given peux peut puis autorisé autorisée accès information informations réponse répondre aider dire identifier parler kann können darf dürfen zugriff auskunft antwort antworten informationen angaben beantworten helfen weiterhelfen sagen puedo puede permite permitido acceso información respuesta responder contestar ayudar decir hablar identificar".split()
)
REGRETS = frozenset("sorry unfortunately apologies apologize regret afraid thank désolé désolée malheureusement regrette pardon leider leid entschuldigung bedaure siento lamento lamentablemente desgraciadamente perdón disculpa".split())
CONTRASTS = frozenset("but however yet mais cependant pourtant aber jedoch doch sondern pero sino aunque".split())
SELVES = frozenset("i me my we i'm je j me m moi nous ich mir mich wir yo me mí mi nos puedo dispongo tengo prefiero lamento siento".split())
# Refusals in the four languages, the labelled examples of that kind.
REFUSALS = {
    "en": ["I'm sorry, but I can't help with that.", "I cannot answer this question.", "Unfortunately I do not have enough information to respond.", "I am not allowed to talk about this person.", "I must refuse to identify anyone here."],
    "fr": ["Je suis désolé, je ne peux pas répondre.", "Je n'ai aucune information à ce sujet.", "Il m'est impossible de vous aider.", "Je ne suis pas autorisé à répondre à cette question."],
    "de": ["Es tut mir leid, das kann ich nicht beantworten.", "Dazu habe ich keine Informationen.", "Leider darf ich dazu nichts sagen.", "Ich kann Ihnen dabei nicht helfen."],
    "es": ["Lo siento, no puedo responder a eso.", "No tengo información sobre este tema.", "Me es imposible contestar.", "No se me permite decir nada de esta persona."],
}
_ENDED = re.compile(r"[.!?。！？]['\"”»)\]*_]*$")
_CUT_MARK = re.compile(r"(?:\.\.\.|…)['\"”»)]*$")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_ANY_FUNCTION = frozenset(w for v in _SETS.values() for w in v)


@lru_cache(maxsize=10_000)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def script_of(text: str) -> str | None:
    """Another script than Latin if three letters in ten are of it (names may stay Latin), else Latin."""
    count = Counter(_script(c) for c in text if c.isalpha())
    if not count:
        return None
    other = Counter({k: n for k, n in count.items() if k != "LATIN"}).most_common(1)
    return other[0][0] if other and other[0][1] >= 0.3 * count.total() else "LATIN"


def split_words(text: str) -> list[str]:
    """Words in lower case; both parts of an elision besides the whole."""
    words = _WORD.findall(text.lower().replace("’", "'"))
    return words + [p for w in words if "'" in w for p in w.split("'") if p]


def language_of(text: str) -> str | None:
    """The language by closed-class words, another script than Latin by its name; None if neither is clear."""
    script = script_of(text)
    if script not in (None, "LATIN"):
        return script
    words = split_words(text)
    score = sorted(((sum(w in s for w in words), k) for k, s in _SETS.items()), reverse=True)
    return score[0][1] if score[0][0] >= 2 and score[0][0] > score[1][0] else None


def is_sentence(text: str) -> bool:
    """Reads as (a part of) a sentence rather than a name or number."""
    words = _WORD.findall(text)
    lower = [w for w in words if w[0].islower() and w.lower() not in PARTICLES]
    if text != text.lower() and text != text.upper():
        inside = [w for w in lower if f"({w})" not in text]
        return len(inside) >= 1 and len(words) >= 2
    return len([w for w in words if w.lower() in _ANY_FUNCTION and w.lower() not in PARTICLES]) >= 2


def _form(text: str | None) -> str:
    return _short_form(text) if text is not None and len(text) < 1000 else _make_form(text)


def _make_form(text: str | None) -> str:
    return " ".join((visual_form(text) or "").split())


_short_form = lru_cache(maxsize=20_000)(_make_form)


def _sides(x: bool) -> int:
    return 1 if x else -1


def votes(question: str | None, answer: str | None, golds: list[str | None] | None, q_language: str | None) -> tuple[tuple[int, ...], ...]:
    """The votes of all labelling functions, by defect."""
    form = _form(answer)
    low = form.lower()
    bare = _TAG.sub(" ", low)
    words = _PLAIN_WORD.findall(bare)
    kernel = bare.strip(" \t.,;:!?-–—_*'\"()[]{}<>/\\|")
    empty = (_sides(not words), _sides(not words or kernel in STAND_INS), _sides(len(kernel.split()) <= 1 and len(kernel) < 10 and not any(c.isdigit() for c in kernel)))

    asked = _PLAIN_WORD.findall(_form(question).lower())
    copied = (0, 0, 0, 0)
    if asked and words:
        limit = max(2, len(asked) // 5)
        once = words
        if len(words) > len(asked) + limit and words[: len(words) // 2] == words[(len(words) + 1) // 2 :]:
            once = words[: len(words) // 2]
        known = set(asked)
        apart = (Counter(once) - Counter(asked)).total(), (Counter(asked) - Counter(once)).total()
        near = len(asked) >= 3 and max(apart) <= limit and edits_within(once, asked, limit) <= limit
        own = sum(w not in known for w in words)
        covered = len(known & set(words)) / len(known)
        copied = (_sides(near), _sides(covered >= 0.8), _sides(own <= limit), _sides(abs(len(once) - len(asked)) <= limit))

    sentence = is_sentence(form)
    ended, mark = bool(_ENDED.search(form)), bool(_CUT_MARK.search(form) or form.endswith("\ufffd"))
    trunk = low.rstrip(".…\ufffd ")
    gold_forms = [_form(g).lower() for g in golds or [] if g]
    rests = [g[len(trunk) :] for g in gold_forms if trunk and g.startswith(trunk) and len(g) > len(trunk)]  # of longer gold answers
    cut_sentence, cut_gold = (0,) * VOTERS["cut_sentence"], (0,) * VOTERS["cut_gold"]
    tail = _WORD.findall(low)[-1:]
    if words and sentence:
        cut_sentence = (_sides(mark or not ended), _sides(mark), _sides(left_open(form)), _sides(not ended and bool(tail) and (tail[0] in _ANY_FUNCTION or len(tail[0]) <= 2)))
    if words and gold_forms and not sentence:
        cut_gold = (_sides(bool(rests) and low not in gold_forms), _sides(any(x[0].isalnum() for x in rests)), _sides(all(len(trunk) < len(g) for g in gold_forms)))

    refusal = (0,) * VOTERS["refusal"]
    if words and sentence:
        told = split_words(low)
        clauses = [set(split_words(c)) for c in re.split(r"[.,;:!?]| (?:" + "|".join(sorted(CONTRASTS)) + ") ", low)]
        denies = any(c & NEGATIONS and c & ABLE for c in clauses)
        at = next((i for i, w in enumerate(told) if w in NEGATIONS), None)
        after = _PLAIN_WORD.findall(form)
        names = [w for w in after[1:] if (w[0].isupper() or w[0].isdigit()) and w.lower() not in asked]
        turn = at is not None and any(w in CONTRASTS for w in told[at + 1 :])
        refusal = (
            _sides(denies),
            _sides(any(w in REGRETS for w in told)),
            _sides(not names),
            _sides(any(c & NEGATIONS and c & SELVES for c in clauses)),
            _sides(not (turn and names)),
            _sides(ended and len(words) <= 20),
        )

    other = (0,) * VOTERS["other_language"]
    if words and sentence and q_language:
        told, own = split_words(form), _SETS.get(q_language, frozenset())
        language = language_of(form)
        only_own = sum(w in own and not any(w in s for k, s in _SETS.items() if k != q_language) for w in told)
        only_other = max(sum(w in s and w not in own for w in told) for k, s in _SETS.items() if k != q_language)
        script = script_of(form)
        other = (
            0 if language is None else _sides(language != q_language),
            _sides(script is not None and script != (script_of(question or "") or script)),
            0 if len(told) < 4 else _sides(sum(w in own for w in told) < 0.1 * len(told)),
            0 if not only_own + only_other else _sides(only_other > only_own),
        )
    return empty, copied, cut_sentence, cut_gold, refusal, other


def known_sound(question: str | None, answer: str | None, golds: list[str | None] | None) -> bool:
    """Sound for another reason than the votes: a gold answer, or a complete sentence with one which the question lacks."""
    if not answer or not golds:
        return False
    form = _form(answer)
    if answer in golds:  # a gold answer that begins a longer one tells nothing about cut answers
        return not any(len(g) > len(form) and g.lower().startswith(form.lower()) for g in (_form(x) for x in golds if x))
    if not is_sentence(form) or not _ENDED.search(form) or _CUT_MARK.search(form) or left_open(form):
        return False
    said, asked = (f" {' '.join(_PLAIN_WORD.findall(_form(t).lower()))} " for t in (answer, question))
    inside = [f" {' '.join(_PLAIN_WORD.findall(_form(g).lower()))} " for g in golds if g]
    return any(g.strip() and g in said and g not in asked for g in inside)


def labelled_pairs(rows: list[tuple[str | None, str | None, list[str | None] | None]]) -> list[tuple[str | None, tuple]]:
    """(defect or None, (question, answer, golds)): the sound pairs among the rows, and the same pairs damaged."""
    sound = [r for r in rows if known_sound(*r)]
    out: list[tuple[str | None, tuple]] = []
    sentences: dict[str | None, list[str]] = {}
    for question, answer, _ in sound:
        if is_sentence(_form(answer)):
            sentences.setdefault(language_of(answer), []).append(answer)
    for n, (question, answer, golds) in enumerate(sound):
        language = language_of(question or "")
        sentence = is_sentence(_form(answer))
        if not sentence or language_of(answer) in (None, language):
            out.append((None, (question, answer, [g for g in golds if g != answer])))
        seed = xxhash.xxh64_intdigest(f"{question} {answer}")
        damaged = [("empty", ("", " - ", "<answer></answer>", "N/A", "null", "\u200b")[seed % 6])]
        if len(answer) >= 8:
            end = max(4, int(len(answer) * (0.3 + 0.6 * (seed % 97) / 97)))
            damaged.append(("cut_sentence", answer[:end].rstrip() + ("", "", "...")[n % 3]) if sentence else ("cut_gold", answer[: min(end, len(answer) - 2)]))
        if question:
            asked = question.split()
            damaged.append(("copied_question", (question, question.lower(), question.upper(), question.rstrip("?"), " ".join(asked[:-2] + asked[-1:]))[seed % 5]))
            foreign = [k for k in sentences if k not in (None, language)]
            if language and foreign:
                pool = sentences[sorted(foreign)[seed % len(foreign)]]
                damaged.append(("other_language", pool[seed % len(pool)]))
        known = REFUSALS.get(language or "en", REFUSALS["en"])
        damaged.append(("refusal", known[seed % len(known)]))
        out += [(kind, (question, text, golds)) for kind, text in damaged]
    return out


def encode(v: tuple[tuple[int, ...], ...]) -> int:
    code = 0
    for group in v:
        for x in group:
            code = code * 3 + x + 1
    return code


def pattern_of(defect: str, code: str = "code"):
    """Column: the pattern of one defect's votes within a code."""
    later = sum(VOTERS[d] for d in DEFECTS[DEFECTS.index(defect) + 1 :])
    return ((F.col(code) / F.lit(3**later)).cast("bigint") % F.lit(3 ** VOTERS[defect])).cast("int")


def fit_label_model(
    counts: dict[int, int], voters: int, sound: dict[int, int] | None = None, defective: dict[int, int] | None = None, rounds: int = 100, strength: float = 0.01
) -> tuple[dict[int, float], float]:
    """(posterior of each vote pattern, share of defective pairs) by expectation-maximization.

    A function that abstains says nothing; of its votes, the share "for" on defective and on sound pairs is
    estimated. ``strength`` is the weight of the prior belief (functions are mostly right, defects are rare; the shares
    on labelled ``sound`` and ``defective`` pairs, where given) relative to the number of rows, so that the two classes
    cannot trade places. Patterns in which all abstain say nothing about the share of defective pairs.
    """
    patterns = np.array(sorted(counts))
    if patterns.size == 0:
        return {}, 0.0
    n = np.array([counts[p] for p in patterns], dtype=float)
    digits = np.stack([(patterns // 3 ** (voters - 1 - j)) % 3 for j in range(voters)], axis=1)
    against, favour = (digits == 0).astype(float), (digits == 2).astype(float)
    n[(favour + against).sum(axis=1) == 0] = 0
    # share "for" among votes on sound and on defective pairs; the first function of a model is its plainest sign
    prior = np.array([[0.05] * voters, [0.9] + [0.5] * (voters - 1)])
    for c, labelled in enumerate((sound, defective)):
        m = np.array([(labelled or {}).get(p, 0) for p in patterns.tolist()], dtype=float)
        prior[c] = (m @ favour + 4 * prior[c]) / (m @ (favour + against) + 4)
    rare, total = 0.03, n.sum()
    p, share = prior.copy(), rare
    post = np.zeros(patterns.size)
    for _ in range(rounds):
        log = favour @ np.log(p.T) + against @ np.log(1 - p.T) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            weight = strength * total * (rare if c else 1 - rare) + 1e-9
            p[c] = (w @ favour + weight * prior[c]) / (w @ (favour + against) + weight)
        share = (float((n * post).sum()) + strength * total * rare + 1e-9) / (total * (1 + strength) + 1e-9)
    return dict(zip(patterns.tolist(), post.tolist())), share


def choose_cutoff(posterior: dict[int, float], sound: dict[int, int], defective: dict[int, int], share: float) -> float:
    """The cutoff of the grid with the best F1 on labelled pairs of both kinds, weighed by the share of defective pairs;
    of equal ones that next to even odds."""
    n, m = sum(sound.values()) or 1, sum(defective.values()) or 1
    score = {}
    for cutoff in CUTOFF_GRID:
        hit = share * sum(k for p, k in defective.items() if posterior.get(p, 0.0) > cutoff) / m
        false = (1 - share) * sum(k for p, k in sound.items() if posterior.get(p, 0.0) > cutoff) / n
        score[cutoff] = round(2 * hit / (hit + false + share), 4) if hit else 0.0
    return min((c for c in CUTOFF_GRID if score[c] == max(score.values())), key=lambda c: abs(c - 0.5))


def fit_cutoffs(counted: dict[str, dict[int, int]], sample: list[tuple[str | None, str | None, list[str | None] | None]]) -> dict[str, tuple[dict[int, float], float]]:
    """By defect: posteriors of the vote patterns and the cutoff."""
    labelled = []
    languages: dict[str | None, str | None] = {}
    for kind, (question, answer, golds) in labelled_pairs(sample):
        if question not in languages:
            languages[question] = language_of(question or "")
        labelled.append((kind, votes(question, answer, golds, languages[question])))
    out = {}
    for i, d in enumerate(DEFECTS):
        code = lambda v, i=i: sum((x + 1) * 3 ** (len(v[i]) - 1 - j) for j, x in enumerate(v[i]))
        sound, bad = Counter(code(v) for kind, v in labelled if kind is None), Counter(code(v) for kind, v in labelled if kind == d)
        # patterns of labelled pairs only do not weigh
        posterior, share = fit_label_model({p: 0 for p in (*sound, *bad)} | counted.get(d, {}), VOTERS[d], sound, bad)
        out[d] = posterior, choose_cutoff(posterior, sound, bad, share)
    return out


def pair_labels(df: DataFrame, id_col: str = "row_id", question_col: str = "question", answer_col: str = "final_answer", gold_col: str = "gold_answers") -> DataFrame:
    """(id_col, defect, posterior): every defect of a pair whose posterior exceeds the defect's cutoff."""
    src = df.select(df[id_col], df[question_col], df[answer_col], df[gold_col])
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str | None, str | None] = {None: None}
        memo: dict[tuple, int] = {}
        for batch in batches:
            found = []
            for question, answer, golds in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                key = (question, answer, tuple(golds or ()))
                if key not in memo:
                    if question not in languages:
                        if len(languages) > 50_000:
                            languages = {None: None}
                        languages[question] = language_of(question)
                    if len(memo) > 50_000:
                        memo.clear()
                    memo[key] = encode(votes(question, answer, golds, languages[question]))
                found.append(memo[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.int64())], names=[id_col, "code"])

    coded = staged(src.mapInArrow(run, schema))
    table = F.explode(F.array(*[F.struct(F.lit(d).alias("model"), pattern_of(d).alias("pattern")) for d in DEFECTS])).alias("v")
    counted: dict[str, dict[int, int]] = {}
    for r in coded.select(table).groupBy("v.model", "v.pattern").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 3**6 per defect
        counted.setdefault(r["model"], {})[r["pattern"]] = r["n"]
    question, answer, golds = (F.col(f"`{c}`") for c in (question_col, answer_col, gold_col))
    may_be_sound = F.exists(golds, lambda g: F.coalesce(F.contains(answer, g), F.lit(False)) & (F.length(g) > 0))
    sound = src.where(may_be_sound).select(question.alias("q"), answer.alias("a"), golds.alias("g"))
    sample = hashed_sample(sound, F.xxhash64("q", "a"), VALIDATION).collect()
    fitted = fit_cutoffs(counted, list(dict.fromkeys((r["q"], r["a"], tuple(r["g"])) for r in sample)))
    flagged = [(d, REPORTED.get(d, d), p, float(q)) for d, (posterior, cutoff) in fitted.items() for p, q in posterior.items() if q > cutoff]
    lookup = df.sparkSession.createDataFrame(flagged, "model string, defect string, pattern int, posterior double")  # bounded as above
    return coded.select(id_col, table).select(id_col, "v.model", "v.pattern").join(F.broadcast(lookup), ["model", "pattern"]).select(id_col, "defect", F.round("posterior", 6).alias("posterior"))


def broken_pairs(df: DataFrame, id_col: str = "row_id", **columns: str) -> DataFrame:
    """(id_col, defect): one defect per pair. Where several exceed their cutoffs the first of DEFECTS is taken,
    which go from the most specific to the most general.

    Rows must have unique ids (a repeated id is one pair).
    """
    order = dict.fromkeys(REPORTED.get(d, d) for d in DEFECTS)
    rank = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("defect"))
    return pair_labels(df, id_col, **columns).groupBy(id_col).agg(F.min(F.struct(rank.alias("r"), "defect")).alias("m")).select(id_col, "m.defect")
