"""Functions no built-in expression can state, as Arrow-batched pandas UDFs with plain Python cores.

All give null for null. The cores work on single values and are what the tests exercise.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.operators.shred import parse_json


def last_boxed(text: str) -> str | None:
    """Content of the last ``\\boxed{...}`` with balanced braces; null if there is none or it never closes."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 0, at + 7
    for i in range(start - 1, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i]
    return None


def plain_latex(text: str) -> str:
    """One spelling for short LaTeX answers: no spaces, sizes, degrees, percent or trailing units; fractions and
    roots with braces; simple a/b and 0.5 as fractions."""
    for gone in ("\n", "\\!", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "\\%"):
        text = text.replace(gone, "") if gone != "\\!" else text.replace(gone, "").replace("\\\\", "\\")
    text = re.sub(r"\\?[td]frac", lambda m: m[0][:-5] + "frac", text)
    head, unit, tail = text.partition("\\text{ ")
    if unit and "\\text{ " in tail:
        raise ValueError("more than one unit")
    text = re.sub(r"(^|[ {])\.", r"\g<1>0.", head)
    sides = text.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        text = sides[1]
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    if not re.search(r"\\frac.?$", text):
        text = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", text)
        text = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", text)
    if text == "0.5":
        return "\\frac{1}{2}"
    whole = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", text)
    return f"\\frac{{{whole[1]}}}{{{whole[2]}}}" if whole else text


def json_objects(text: str) -> list[dict]:
    """All top-level JSON objects in a text, braces in strings respected; what does not parse is skipped."""
    out, decoder, at = [], json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        if isinstance(value, dict):
            out.append(value)
        at = end
    return out


# Words that stand for no answer, keys of an answer, names of the final action.
PLACEHOLDERS = frozenset(("", "query", "answer", "final answer", "visual query", "current image"))
ANSWER_KEYS = ("answer", "final_answer", "prediction", "response", "value")
FINAL_ACTIONS = frozenset(("stop", "answer", "final_answer", "final"))


def final_answer_of(text: str) -> str:
    """The answer an agent's turn gives: from its best JSON object, else its answer tag, else a short plain text;
    "unknown" where there is none."""
    raw, best = text.strip(), None
    for obj in json_objects(raw):
        action = str(obj.get("action", obj.get("tool", obj.get("tool_type", "")))).strip().lower()
        value = next((str(obj[k]).strip() for k in ANSWER_KEYS if obj.get(k) is not None and str(obj[k]).strip()), "")
        if action in FINAL_ACTIONS or any(obj.get(k) is not None for k in ANSWER_KEYS):
            valid = value.lower() not in PLACEHOLDERS
            rank = (valid, len(value) if valid else 0, value if valid else "unknown")
            best = rank if best is None or rank[:2] > best[:2] else best
    if best:
        return best[2]
    if tag := re.search(r"(?is)<answer>(.*?)</answer>", raw):
        return tag[1].strip() or "unknown"
    if "{" not in raw and "}" not in raw and len(raw.split()) <= 12:
        return raw if raw.lower() not in PLACEHOLDERS else "unknown"
    return raw or "unknown"


def tool_calls(text: str) -> list[dict]:
    """Calls in ``<tool_call>`` tags: {"name", "arguments"}; a call that is no such object is skipped."""
    out = []
    for body in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text):
        call = parse_json(body.strip())
        if isinstance(call, dict) and "name" in call and "arguments" in call:
            out.append({"name": str(call["name"]), "arguments": json.dumps(call["arguments"], ensure_ascii=False)})
    return out


def typed_parameter(text: str, kind: str):
    """A parameter's text by its declared type; what does not convert stays text (nothing is evaluated)."""
    if text.strip().lower() == "null":
        return None
    kind = kind.strip().lower()
    try:
        if kind.startswith(("int", "uint", "long", "short", "unsigned")):
            return int(text)
        if kind.startswith(("num", "float")):
            value = float(text)
            return int(value) if value.is_integer() and "." not in text and "e" not in text.lower() else value
        if kind in ("boolean", "bool"):
            return text.strip().lower() == "true"
        if kind in ("object", "array", "arr", "dict", "list"):
            return json.loads(text)
    except ValueError:
        return text
    return text


def xml_calls(text: str, types: dict[str, str]) -> list[dict]:
    """Calls written as ``<function=name><parameter=key>value</parameter></function>`` in ``<tool_call>`` tags; tags left open
    end with the text, and without call tags the whole text is searched."""
    out = []
    for body in re.findall(r"(?s)<tool_call>(.*?)(?:</tool_call>|$)", text) or [text]:
        for call in re.findall(r"(?s)<function=(.*?)(?:</function>|$)", body):
            name, closed, rest = call.partition(">")
            if not closed:
                continue
            pairs = [p.partition(">") for p in re.findall(r"(?s)<parameter=(.*?)(?:</parameter>|$)", rest)]
            values = {k: typed_parameter(v.removeprefix("\n").removesuffix("\n"), types.get(k, "string")) for k, closed, v in pairs if closed}
            out.append({"name": name, "arguments": json.dumps(values, ensure_ascii=False)})
    return out


def channel_calls(text: str) -> list[dict]:
    """Calls on the commentary channel of role-tagged text: after ``to=functions.name`` the JSON message up to the call mark,
    as it is. What is said on the analysis channel is no call."""
    head = "<|channel|>analysis<|message|>"
    while (at := text.find(head)) >= 0 and (end := text.find("<|end|>", at)) >= 0:
        start = at - len("<|start|>assistant") if text[:at].endswith("<|start|>assistant") else at
        text = text[:start] + text[end + len("<|end|>") :]
    out = []
    for part in text.split("<|start|>assistant<|channel|>")[1:]:
        message, called, _ = part.partition("<|call|>")
        to, typed, arguments = message.partition(" <|constrain|>json<|message|>")
        channel, named, name = to.partition(" to=functions.")
        if called and typed and named and name and "<" not in channel + name:
            out.append({"name": name, "arguments": arguments})
    return out


DIALECTS = {"tagged": tool_calls, "channel": channel_calls, "xml": xml_calls}


def action_spans(tokens: list[int], needles: list[list[int]]) -> list[tuple[int, int]]:
    """Leftmost occurrence of each needle that begins at an unused place, in order; missing ones are (-1, -1)."""
    used, out = set(), []
    for needle in needles:
        n = len(needle)
        at = next((i for i in range(len(tokens) - n + 1) if n and i not in used and tokens[i : i + n] == needle), -1)
        if at >= 0:
            used.add(at)
        out.append((at, at + n) if at >= 0 else (-1, -1))
    return out


def jaccard_bags(a: list, b: list) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / (len(a) + len(b) - sum((x & y).values()))


def tool_match(gold: list[dict], said: list[dict], least: float = -3.0, most: float = 3.0) -> float:
    """Score of predicted calls: each gold call takes the best unused predicted call of its name."""
    if gold == said:
        return most
    score, possible, free = jaccard_bags([g["name"] for g in gold], [p["name"] for p in said]), 1.0, dict(enumerate(said))
    for g in gold:
        want = g["parameters"]
        possible += 1 + len(want)
        worth = {
            i: jaccard_bags(list(want), list(p["parameters"])) + sum(k in p["parameters"] and p["parameters"][k] == v for k, v in want.items())
            for i, p in free.items()
            if p["name"] == g["name"]
        }
        if worth and (top := max(worth.values())) > 0:
            score += top
            del free[min(i for i, w in worth.items() if w == top)]
    return (most - least) * score / possible + least


def tool_score(response: str, truth: str, least: float = -3.0, most: float = 3.0) -> float:
    """Score of the calls in the first call tag, one JSON object a line, against those of the truth; 0 where the truth has none,
    the least where the response has none that parse."""
    calls = lambda t: [json.loads(x) for x in t.split("<tool_call>", 1)[1].split("</tool_call>", 1)[0].split("<tool_call>", 1)[0].strip().split("\n")]
    if "<tool_call>" not in truth:
        return 0.0
    gold = calls(truth)
    if "<tool_call>" not in response or "</tool_call>" not in response:
        return least
    try:
        return tool_match(gold, calls(response), least, most)
    except (ValueError, KeyError, TypeError, AttributeError):
        return least


def gate_reward(answers: list[str], action: str, is_stop: bool, threshold: float = 0.8) -> float:
    """Agreement of probe answers against the decision to stop."""
    norm = [re.sub(r"[^a-z0-9]+", " ", a.lower()).strip() for a in answers if a]
    pairs = [difflib.SequenceMatcher(None, a, b).ratio() for i, a in enumerate(norm) for b in norm[i + 1 :]]
    agreed = (sum(pairs) / len(pairs) if pairs else 1.0) >= threshold
    if not is_stop:
        return -0.25 if agreed else 0.5
    if not agreed:
        return -0.5
    common = max(sorted(set(norm), key=norm.index), key=norm.count) if norm else ""
    said = re.sub(r"[^a-z0-9]+", " ", action.lower()).strip()
    if not said or not common:
        match = 0.0
    elif said == common:
        match = 1.0
    elif said in common or common in said:
        match = 0.9
    else:
        match = difflib.SequenceMatcher(None, said, common).ratio()
    return 1.0 if match >= threshold else -0.5


def media_segments(content: str, n_images: int, n_videos: int) -> list[tuple[str, str]]:
    """(kind, value) segments of a prompt: text, or the number of the image or video its placeholder takes."""
    out, counts = [], {"<image>": 0, "<video>": 0}
    for part in re.split("(<image>|<video>)", content):
        if part in counts:
            out.append((part[1:-1], str(counts[part])))
            counts[part] += 1
        elif part:
            out.append(("text", part))
    if counts != {"<image>": n_images, "<video>": n_videos}:
        raise ValueError("placeholders and media differ in number")
    return out


def _map(f):
    return lambda s: s.map(lambda v: None if v is None else f(v))


def boxed(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _map(last_boxed)(s)

    return run(c)


def latex(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _map(plain_latex)(s)

    return run(c)


def agent_answer(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return _map(final_answer_of)(s)

    return run(c)


def parsed_calls(c: Column, dialect: str = "tagged", types: dict[str, str] | None = None) -> Column:
    """The calls of a turn in one of DIALECTS; ``types`` are those of the parameters (xml only)."""
    parse = DIALECTS[dialect]

    @F.pandas_udf("array<struct<name:string,arguments:string>>")
    def run(s: pd.Series) -> pd.Series:
        return _map(lambda t: parse(t, types or {}) if dialect == "xml" else parse(t))(s)

    return run(c)


def tool_scores(response: Column, truth: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else tool_score(x, y) for x, y in zip(a, t)], dtype="float64")

    return run(response, truth)


def gate(answers: Column, action: Column, stop: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([gate_reward([x for x in (v if v is not None else []) if x], u or "", bool(w)) for v, u, w in zip(a, t, s)], dtype="float64")

    return run(answers, action, stop)
