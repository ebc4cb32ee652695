"""Plug-in points: named scorers, advantages and losses, each a function that builds a column or a frame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.functions import pyfn as Y
from tracequarry.functions import textnorm as N


class Named:
    """Name to function; giving a name another function raises."""

    def __init__(self) -> None:
        self._items: dict[str, Callable] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def wrap(f: Callable) -> Callable:
            if self._items.get(name, f) is not f:
                raise ValueError(f"{name} is already registered")
            self._items[name] = f
            return f

        return wrap

    def __getitem__(self, name: str) -> Callable:
        if name not in self._items:
            raise KeyError(f"unknown name {name!r}; known: {sorted(self._items)}")
        return self._items[name]

    def __iter__(self):
        return iter(sorted(self._items))


scorers, advantages, losses = Named(), Named(), Named()


@scorers.register("exact")
def exact(answer: Column, golds: Column) -> Column:
    return N.exact_match(answer, golds).cast("double")


@scorers.register("substring")
def substring(answer: Column, golds: Column) -> Column:
    return N.substring_match(answer, golds).cast("double")


@scorers.register("token_f1")
def token_f1(answer: Column, golds: Column) -> Column:
    """Best over the alternatives."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: N.token_f1(answer, g))), F.lit(0.0))


@scorers.register("format_and_accuracy")
def format_and_accuracy(answer: Column, golds: Column, weight: float = 0.1) -> Column:
    shaped = answer.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return (1 - weight) * exact(N.last_tag(answer), golds) + weight * F.coalesce(shaped, F.lit(0.0))


@scorers.register("math_line")
def math_line(answer: Column, golds: Column) -> Column:
    """1 or -1: the answer line against the first gold answer."""
    return N.math_score(answer, F.try_element_at(golds, F.lit(1)))


@scorers.register("math_box")
def math_box(answer: Column, golds: Column) -> Column:
    """1 or -1: the last box among the last 100 characters is the first gold answer, as it is."""
    box = Y.boxed(F.right(answer, F.lit(100)))
    return F.when(box == F.try_element_at(golds, F.lit(1)), 1.0).otherwise(-1.0)


@scorers.register("first_token_f1")
def first_token_f1(answer: Column, golds: Column) -> Column:
    return N.token_f1(answer, F.try_element_at(golds, F.lit(1)))


@scorers.register("zero")
def zero(answer: Column, golds: Column) -> Column:
    return F.lit(0.0)


def dispatch(source: Column, answer: Column, golds: Column, rules: dict[str, str]) -> Column:
    """Score by source with the named scorer of the first matching rule (exact name, or a pattern with * for
    any characters); a source without a rule raises."""
    out = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(source, F.lit("null")))).cast("double")
    for pattern, name in reversed(rules.items()):
        hit = source.rlike("(?s)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$") if "*" in pattern else source == pattern
        out = F.when(hit, scorers[name](answer, golds)).otherwise(out)
    return out


def _install() -> None:
    from tracequarry.operators import grouprel as G
    from tracequarry.operators import losses as L

    for name in ("grpo", "grpo_floored", "rloo", "rloo_batched", "gpg", "mean_baseline", "pass_at_k", "opo"):
        advantages.register(name)(getattr(G, name))
    for name in ("ppo_token", "gpg_token", "cispo_token", "sapo_token", "dppo_tv_token", "dppo_kl_token"):
        losses.register(name.removesuffix("_token"))(getattr(L, name))


_install()
