"""Plug-points for a user's own code: rewards, generators, samplers, row maps and tools."""

from __future__ import annotations

import importlib.util
import inspect
import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.batch import with_row_number


def load_function(path: str, name: str, **fixed) -> Callable:
    """A function of a Python file, with some keyword arguments fixed. It is sent to the executors by value, so they need
    not have the file. A missing file, a file that fails and a missing name raise."""
    spec = importlib.util.spec_from_file_location(f"user_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    try:
        spec.loader.exec_module(module)
    except FileNotFoundError:
        raise
    except Exception as e:
        raise RuntimeError(f"{path} cannot be loaded") from e
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    cloudpickle.register_pickle_by_value(module)
    f = getattr(module, name)
    return (lambda *a, **k: f(*a, **{**k, **fixed})) if fixed else f


def _result(value) -> tuple[float, str]:
    """Score and extra values as JSON: a reward gives a number or a dictionary with a score."""
    if isinstance(value, dict):
        return float(value["score"]), json.dumps({k: v for k, v in value.items() if k != "score"}, ensure_ascii=False, sort_keys=True, default=str)
    return float(value), "{}"


def custom_reward(f: Callable, source: Column, solution: Column, truth: Column, extra: Column | None = None) -> Column:
    """struct<score, extra>: f(data_source, solution_str, ground_truth, extra_info) of every row, in Arrow batches; plain or
    ``async``. Null solutions give null without a call."""

    @F.pandas_udf("struct<score:double,extra:string>")
    def run(s: pd.Series, a: pd.Series, t: pd.Series, e: pd.Series) -> pd.DataFrame:
        import asyncio

        call = (lambda *x: asyncio.run(f(*x))) if inspect.iscoroutinefunction(f) else f
        got = [_result(call(*row)) if row[1] is not None else (None, None) for row in zip(s, a, t, e)]
        return pd.DataFrame(got, columns=["score", "extra"])

    return run(source, solution, truth, F.lit(None).cast("string") if extra is None else extra)


def batched_reward(f: Callable, source: Column, solution: Column, truth: Column) -> Column:
    """f(list of sources, list of solutions, list of truths) -> list of scores, once per Arrow batch."""

    @F.pandas_udf("double")
    def run(s: pd.Series, a: pd.Series, t: pd.Series) -> pd.Series:
        got = list(f(s.tolist(), a.tolist(), t.tolist()))
        if len(got) != len(a):
            raise ValueError("a batched reward must give one score a row")
        return pd.Series(got, dtype="float64")

    return run(source, solution, truth)


def grow(df: DataFrame, generate: Callable[[DataFrame], DataFrame], keep: Column | None = None) -> DataFrame:
    """The table and the rows a generator makes of it that pass ``keep``; columns the generator leaves out are null, other
    columns raise."""
    more = generate(df)
    if unknown := [c for c in more.columns if c not in df.columns]:
        raise ValueError(f"the generator adds columns: {unknown}")
    return df.unionByName(more.where(keep) if keep is not None else more, allowMissingColumns=True)


def sampled(df: DataFrame, sampler: Callable[[DataFrame], Column] | None, *key: str, out: str = "turn") -> DataFrame:
    """The place of every row in the order a sampler's column gives, ties by key; without one the order of the key."""
    if sampler is None:
        return with_row_number(df, *key, out=out)
    return with_row_number(df.withColumn("_o", sampler(df)), "_o", *key, out=out).drop("_o")


def map_rows(df: DataFrame, f: Callable[[dict, int], dict], schema: str, *key: str) -> DataFrame:
    """f(row, its place in the order of the key) of every row, in Arrow batches."""
    names = df.columns

    def run(batches):
        for batch in batches:
            places = batch.pop("_place")
            yield pd.DataFrame([f(dict(zip(names, row)), int(i)) for row, i in zip(batch[names].itertuples(index=False), places)])

    return with_row_number(df, *key, out="_place").mapInPandas(run, schema)


class Toolbox:
    """Named tools, each a function of the action column and the step's other columns that gives the observation."""

    def __init__(self, unknown: str = "unknown tool"):
        self.tools: dict[str, Callable[[Column], Column]] = {}
        self.unknown = unknown

    def register(self, name: str, tool: Callable[[Column], Column]) -> None:
        if self.tools.get(name, tool) is not tool:
            raise ValueError(f"{name} is already registered")
        self.tools[name] = tool

    def observe(self, name: Column, action: Column) -> Column:
        """The observation of each step's tool; a name without a tool is told so."""
        out = F.lit(self.unknown)
        for tool, f in self.tools.items():
            out = F.when(name == tool, f(action)).otherwise(out)
        return out
