"""Text functions as column expressions (no UDF).

The five normalisers differ on purpose and are not interchangeable. All give null for null; an empty text
gives an empty text. White space and word limits follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_ARTICLE = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def qa_normalize(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, spaces collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{Punct}", ""), _ARTICLE, " "))


def eval_normalize(c: Column) -> Column:
    """Lower case, articles dropped, everything but ASCII letters and digits becomes a space."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), _ARTICLE, " "), "[^a-z0-9 ]+", " "))


def alnum_normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def space_normalize(c: Column) -> Column:
    return collapse(F.lower(c))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"))


def split_tokens(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def exact_match(pred: Column, golds: Column, norm=qa_normalize) -> Column:
    """True if an alternative equals the prediction under a normaliser; null alternatives are skipped."""
    return F.coalesce(F.exists(golds, lambda g: F.coalesce(norm(g) == norm(pred), F.lit(False))), F.lit(False))


def substring_match(pred: Column, golds: Column) -> Column:
    """True if a normalised alternative occurs in the prediction (an empty one occurs in every text)."""
    return F.coalesce(F.exists(golds, lambda g: F.coalesce(qa_normalize(pred).contains(qa_normalize(g)), F.lit(False))), F.lit(False))


def either_way_match(pred: Column, golds: Column) -> Column:
    """True if one contains the other, both non-empty."""
    p = space_normalize(pred)
    return F.coalesce(F.exists(golds, lambda g: F.coalesce((space_normalize(g) != "") & (p != "") & (p.contains(space_normalize(g)) | space_normalize(g).contains(p)), F.lit(False))), F.lit(False))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Number of common elements of two arrays, with their multiplicity."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def token_f1(pred: Column, gold: Column) -> Column:
    """Harmonic mean of token precision and recall; 0 if either has no tokens or none is shared."""
    p, g = split_tokens(eval_normalize(pred)), split_tokens(eval_normalize(gold))
    common = multiset_overlap(p, g)
    precision, recall = F.try_divide(common, F.size(p)), F.try_divide(common, F.size(g))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Common elements over all, with multiplicity; equal arrays 1, an empty one 0."""
    common = multiset_overlap(a, b)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0)))


def last_tag(c: Column, tag: str = "answer") -> Column:
    """Content of the last <tag>…</tag>, stripped; null if there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>")), F.lit(-1)))


def hash_answer(c: Column) -> Column:
    """Number after the last ``#### `` among the last 300 characters, without commas and dollar signs."""
    return F.regexp_replace(F.try_element_at(F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"#### (\-?[0-9\.\,]+)")), F.lit(-1)), "[,$]", "")


def last_number(c: Column) -> Column:
    """Last number among the last 300 characters that is more than a dot."""
    return F.try_element_at(F.filter(F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"(\-?[0-9\.\,]+)")), lambda x: ~x.isin("", ".")), F.lit(-1))


# Ordered replacements of the final-answer normaliser, then expressions it removes.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = (
    "square ways integers dollars mph inches hours km units \\ldots sue points feet minutes digits cents degrees cm gm pounds meters meals edges students childrentickets multiples".split()
    + ["\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]
)


def final_answer_normalize(c: Column) -> Column:
    """Normal form of a quantitative final answer (text after the last '=')."""
    x = F.element_at(F.split(c, "="), -1)
    for before, after in SUBSTITUTIONS + [(r, "") for r in REMOVED]:
        x = F.replace(x, F.lit(before), F.lit(after))
    for pattern, to in ((r"(.*?)(\$)(.*?)(\$)(.*)", "\\$$3\\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}")):
        x = F.regexp_replace(x, pattern, to)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return strip(F.when(bare.rlike("^[0-9]+$"), bare).otherwise(x))


def tool_format(response: Column, truth: Column) -> Column:
    """1 if the response is a thought followed by the parts that the truth has (calls on lines of their own, a reply), each
    once and nothing else; 0 otherwise, null counts as another text."""
    out = F.lit(0)
    for calls in (False, True):
        for reply in (False, True):
            ok = response.rlike("(?s)^<think>.*?</think>" + r"\n<tool_call>\n.*?\n</tool_call>" * calls + r"\n<response>.*?</response>" * reply + "$")
            for tag in ["tool_call"] * calls + ["response"] * reply:
                ok = ok & (count_of(response, f"<{tag}>") == 1) & (count_of(response, f"</{tag}>") == 1)
            out = F.when((truth.contains("<tool_call>") == F.lit(calls)) & (truth.contains("<response>") == F.lit(reply)), F.coalesce(ok, F.lit(False)).cast("int")).otherwise(out)
    return out


def math_answer(solution: Column) -> Column:
    """Normal form of the last ``Answer: ...`` line among the last 300 characters; "[INVALID]" without one."""
    line = F.try_element_at(F.regexp_extract_all(F.right(solution, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)")), F.lit(-1))
    return final_answer_normalize(F.coalesce(line, F.when(solution.isNotNull(), F.lit("[INVALID]"))))


def math_score(solution: Column, truth: Column) -> Column:
    """1 if the answer line and the truth have one normal form, else -1."""
    return F.when(math_answer(solution) == final_answer_normalize(truth), 1.0).otherwise(-1.0)


def count_of(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _turn_ok(c: Column, pattern: str, once: list[str], never: list[str]) -> Column:
    ok = c.rlike("(?s)" + pattern)
    for x in once:
        ok = ok & (count_of(c, x) == 1)
    for x in never:
        ok = ok & ~c.contains(x)
    return ok


def valid_answer_turn(c: Column) -> Column:
    return _turn_ok(c, r"^<reason>.*</reason>.*<answer>.*</answer>\n?$", ["<reason>", "</reason>", "<answer>", "</answer>"], ["<search><img></search>", "<text_search>", "</text_search>"])


def valid_image_turn(c: Column) -> Column:
    return _turn_ok(c, r"^<reason>.*</reason>.*<search><img></search>\n?$", ["<reason>", "</reason>", "<search><img></search>"], ["<answer>", "</answer>", "<text_search>", "</text_search>"])


def valid_text_turn(c: Column) -> Column:
    return _turn_ok(c, r"^<reason>.*</reason>.*<text_search>.*</text_search>\n?$", ["<reason>", "</reason>", "<text_search>", "</text_search>"], ["<answer>", "</answer>", "<search><img></search>"])


def calls_search(c: Column) -> Column:
    return c.contains("<search><img></search>") | (c.contains("<text_search>") & c.contains("</text_search>"))


def conversation_format(turns: Column) -> tuple[Column, Column]:
    """(format score 0/1, search count) of one to three turns; any other number raises."""
    t = lambda i: strip(F.try_element_at(turns, F.lit(i)))
    n = F.size(turns)
    two = (valid_image_turn(t(1)) | valid_text_turn(t(1))) & valid_answer_turn(t(2))
    three = valid_image_turn(t(1)) & valid_text_turn(t(2)) & valid_answer_turn(t(3))
    score = F.when(n == 1, valid_answer_turn(t(1))).when(n == 2, two).when(n == 3, three).otherwise(F.raise_error(F.lit("one to three turns are supported")).cast("boolean"))
    count = calls_search(t(1)).cast("int") + F.when(n == 3, calls_search(t(2)).cast("int")).otherwise(0)
    return score.cast("int"), count


def search_score(turns: Column, golds: Column, search_penalty: float = 0.1, format_penalty: float = 0.1, substring: bool = False, per_search: bool = False) -> Column:
    """(1 - fp) * score + fp * format; a correct answer that searched loses the search penalty once or per search."""
    answer = last_tag(F.element_at(turns, -1))
    correct = F.coalesce((substring_match if substring else exact_match)(answer, golds), F.lit(False)) & answer.isNotNull()
    fmt, n = conversation_format(turns)
    keep = F.lit(1 - search_penalty)
    worth = F.when(n > 0, F.pow(keep, n) if per_search else keep).otherwise(1.0)
    return (1 - format_penalty) * F.when(correct, worth).otherwise(0.0) + format_penalty * fmt


def tag_spam_score(text: Column, golds: Column) -> Column:
    """1 if the last answer matches, a quarter of it with more than ten opening or closing tags, else 0."""
    hit = exact_match(last_tag(text), golds)
    return F.when(hit, F.when((count_of(text, "<answer>") > 10) | (count_of(text, "</answer>") > 10), 0.25).otherwise(1.0)).otherwise(0.0)


def redact(c: Column, answers: Column, mark: str = "[hidden]") -> Column:
    """Answer and ground-truth clauses masked, then every answer (longest first, any case), spaces collapsed."""
    x = F.regexp_replace(c, r"(?iU)\banswer\s*:\s*[^.。\n]+[.。]?", f"Answer: {mark}. ")
    x = F.regexp_replace(x, r"(?iU)\bground[_ ]?truth\s*:\s*[^.。\n]+[.。]?", f"Ground truth: {mark}. ")
    quoted = F.transform(
        F.array_sort(F.filter(F.transform(answers, strip), lambda a: a != ""), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)),
        lambda a: F.regexp_replace(a, r"([\\\[\](){}.*+?^$|/-])", r"\\$1"),
    )
    pattern = F.concat(F.lit("(?iu)(?:"), F.array_join(quoted, "|"), F.lit(")"))
    return collapse(F.when(F.size(quoted) > 0, F.regexp_replace(x, pattern, F.lit(mark))).otherwise(x))


def truncate_chars(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, max(0, limit - 3)), f"{WS}+$", ""), F.lit("...")))


def truncate_words(c: Column, n: int) -> Column:
    t = split_tokens(c)
    return F.when(F.size(t) <= n, c).otherwise(F.array_join(F.slice(t, 1, n), " "))


def contains_answer(c: Column, answers: Column) -> Column:
    return F.coalesce(F.exists(answers, lambda a: F.coalesce((strip(a) != "") & F.lower(c).contains(F.lower(strip(a))), F.lit(False))), F.lit(False))


def evidence_anchor(evidence: Column, question: Column, n: int = 8) -> Column:
    """First n words of at least three characters that the question lacks; the question if there are none."""
    asked = ascii_tokens(question)
    own = F.slice(F.filter(ascii_tokens(evidence), lambda w: (F.length(w) >= 3) & ~F.array_contains(asked, w)), 1, n)
    return F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(question)


def answer_list(c: Column) -> Column:
    """A JSON list text becomes its entries, any other text a list of itself; blanks are dropped."""
    parsed = F.when(strip(c).startswith("[") & strip(c).endswith("]"), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).otherwise(F.array(c))
    return F.filter(F.transform(parsed, strip), lambda x: x.isNotNull() & (x != ""))


def ordered_dedupe(c: Column) -> Column:
    """First occurrence of every entry, compared without case; blanks dropped."""
    clean = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def metric_key(c: Column) -> Column:
    """Characters a tracker does not take are replaced."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("@"), F.lit("_at_")), "/{2,}", "/"), r"[^a-zA-Z0-9_./ -]", "_")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def unit_weight(c: Column) -> Column:
    """Clamped to [0, 1]; not a number is 0."""
    return F.greatest(F.least(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def evidence_type(hint: Column) -> Column:
    """First keyword group found in the lower-case hint."""
    # Keyword groups in order.
    groups = [
        ("logo", "logo brand emblem"), ("screen", "screen website app display monitor"), ("document", "document receipt newspaper paper page map"), ("text", "text sign poster caption license_plate"),
        ("person", "person face human celebrity"), ("fine_grained_part", "part detail fine-grained close-up"), ("object", "object product vehicle animal building"),
    ]
    out, h = F.lit("mixed"), F.lower(hint)
    for name, words in reversed(groups):
        out = F.when(h.rlike("|".join(w.replace("_", " ") for w in words.split())), name).otherwise(out)
    return out


def workload(n: Column) -> Column:
    return 24576 * n + n * n


def resize(width: Column, height: Column, largest: int, least: int) -> tuple[Column, Column]:
    """Size after scaling down to ``largest`` pixels, then up to ``least``."""
    big = width * height > largest
    k = F.sqrt(F.lit(float(largest)) / (width * height))
    w, h = F.when(big, (width * k).cast("int")).otherwise(width), F.when(big, (height * k).cast("int")).otherwise(height)
    small = w * h < least
    q = F.sqrt(F.lit(float(least)) / (w * h))
    return F.when(small, (w * q).cast("int")).otherwise(w), F.when(small, (h * q).cast("int")).otherwise(h)


def finalize_box(box: Column, width: Column, height: Column, xywh: bool = False) -> Column:
    """Corner box in pixels from four numbers (fractions of the size if none exceeds 1.5); null if degenerate."""
    at = lambda i: F.element_at(box, i)
    unit = F.greatest(*[F.abs(at(i)) for i in range(1, 5)]) <= 1.5
    x1, a3 = (F.when(unit, at(i) * width).otherwise(at(i)) for i in (1, 3))
    y1, a4 = (F.when(unit, at(i) * height).otherwise(at(i)) for i in (2, 4))
    x2, y2 = (x1 + a3, y1 + a4) if xywh else (a3, a4)
    r = lambda v: F.bround(v, 0).cast("int")
    ix1, iy1 = F.greatest(F.lit(0), F.least(width - 1, r(x1))), F.greatest(F.lit(0), F.least(height - 1, r(y1)))
    ix2, iy2 = F.greatest(F.lit(1), F.least(width, r(x2))), F.greatest(F.lit(1), F.least(height, r(y2)))
    return F.when((ix2 > ix1) & (iy2 > iy1), F.array(ix1, iy1, ix2, iy2))
