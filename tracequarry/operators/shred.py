"""Deeply nested semi-structured records to related flat tables (problem 4).

Method: columnar shredding. A record is taken apart into one column per leaf path; each entry of a column has a
repetition level (the repeated ancestor at which it continues) and a definition level (how much of its path is
there). A flat table per repeated ancestor is put together again from the level sequences alone: a place of
the ancestor begins where the repetition level is not above its own and the definition level reaches its slot,
and positions are counts of such places since the parent's last one.

A path is a tuple of steps, ``"name"`` for a field and ``"name[]"`` for a repeated one. Levels of a path: a field
that is there adds one definition level; a repeated field adds one for the slot (the list has this place) and
one for the element (it is not null). Empty lists and missing lists have no slot.

Plan: one ``mapInArrow`` over the scan of two columns; no shuffle, whatever the nesting; only the asked leaves
are shredded (column pruning inside the text).

Defined results: null, empty and invalid lines, and lines whose top is not an object, have no rows (JSON as in
RFC 8259: NaN and Infinity are invalid; of repeated keys the last holds); repeated lines each give their rows;
a value of another kind than its path expects counts as missing; extra keys and columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Path = tuple[str, ...]


@dataclass
class LeafColumn:
    """A shredded leaf: parallel lists of repetition levels, definition levels and values."""

    path: Path
    rep: list[int]
    define: list[int]
    value: list

    @classmethod
    def empty(cls, path: Path) -> LeafColumn:
        return cls(path, [], [], [])


def shred(record: object, column: LeafColumn) -> None:
    """Append a record to a leaf column."""
    path = column.path
    last = len(path)
    rep, define, value = column.rep.append, column.define.append, column.value.append

    def walk(node: object, i: int, r: int, d: int, depth: int) -> None:
        if i == last:
            rep(r), define(d), value(node)
            return
        name = path[i]
        repeated = name.endswith("[]")
        child = node.get(name[:-2] if repeated else name) if isinstance(node, dict) else None
        if child is None or (repeated and not (isinstance(child, list) and child)):
            rep(r), define(d), value(None)
        elif not repeated:
            walk(child, i + 1, r, d + 1, depth)
        else:
            for element in child:
                if element is None:
                    rep(r), define(d + 1), value(None)
                else:
                    walk(element, i + 1, r, d + 2, depth + 1)
                r = depth + 1

    walk(record, 0, 0, 0, 0)


def levels_of(path: Path) -> tuple[int, list[int]]:
    """(greatest definition level, definition level of the slot of each repeated step)."""
    d, slots = 0, []
    for name in path:
        if name.endswith("[]"):
            slots.append(d + 1)
            d += 2
        else:
            d += 1
    return d, slots


def assemble(column: LeafColumn, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of the repeated ancestor at ``depth`` (the leaf's own depth if None), from the levels alone:
    (record number, position at each repeated ancestor, index into the column, definition level)."""
    rep, define = np.asarray(column.rep, dtype=np.int32), np.asarray(column.define, dtype=np.int32)
    _, slots = levels_of(column.path)
    depth = len(slots) if depth is None else depth
    record = np.cumsum(rep == 0) - 1
    positions = []
    for level in range(1, depth + 1):
        begins = (rep <= level) & (define >= slots[level - 1])  # a place of this ancestor
        parent = rep < level  # its parent's place begins
        count = np.cumsum(begins)
        at_parent = np.flatnonzero(parent)
        base = (count - begins)[at_parent][np.cumsum(parent) - 1] if at_parent.size else count
        positions.append(count - base - 1)
    keep = (rep <= depth) & (define >= slots[depth - 1]) if depth else rep == 0
    index = np.flatnonzero(keep)
    return record[index], [p[index] for p in positions], index, define[index]


def refuse_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON value")


def parse_json(text: str | None) -> object:
    """The value of a JSON text; None if it is null, empty or invalid."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=refuse_constant)
    except (ValueError, RecursionError):
        return None


def canonical_rollout(record: object) -> dict:
    """One shape for the shapes a rollout comes in: ``steps`` is a list; an observation is an object with a list
    ``results``; an observation kept as text is read."""
    if not isinstance(record, dict):
        return {}
    steps = record.get("steps")
    steps = [steps] if isinstance(steps, dict) else steps if isinstance(steps, list) else []
    shaped = []
    for step in steps:
        if isinstance(step, dict):
            seen = step.get("raw_observation")
            if isinstance(seen, str):
                seen = parse_json(seen)
            if isinstance(seen, list):
                seen = {"results": seen}
            step = step | {"raw_observation": seen if isinstance(seen, dict) else None}
        shaped.append(step)
    return record | {"steps": shaped}


STEP: Path = ("steps[]",)
HIT: Path = ("steps[]", "raw_observation", "results[]")
FINAL: Path = ("steps[]", "raw_observation", "final")
SUCCESS: Path = ("steps[]", "metadata", "success")


def shred_lines(texts: Sequence[str | None], paths: Sequence[Path], shape: Callable[[object], dict] = canonical_rollout) -> list[LeafColumn]:
    """Leaf columns of a batch of lines; every line is one record, whether valid or not."""
    columns = [LeafColumn.empty(p) for p in paths]
    for text in texts:
        record = shape(parse_json(text))
        for column in columns:
            shred(record, column)
    return columns


def rollout_nodes(df: DataFrame, id_col: str = "line_id", raw_col: str = "raw") -> DataFrame:
    """(id_col, node, step_pos, item_pos): every step, retrieved entry, final and success flag of every line."""
    src = df.select(df[id_col], df[raw_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            step, hit, final, success = shred_lines(batch.column(1).to_pylist(), (STEP, HIT, FINAL, SUCCESS))
            for node, column in (("step", step), ("hit", hit), ("final", final), ("success", success)):
                full, _ = levels_of(column.path)
                record, at, index, define = assemble(column)
                keep = define == full
                if node == "success":
                    keep &= np.fromiter((isinstance(column.value[i], bool) for i in index), bool, index.size)
                record = record[keep]
                item = at[1][keep] if len(at) > 1 else np.full(record.size, -1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(record)), pa.array([node] * record.size, type=pa.string()), pa.array(at[0][keep].astype(np.int32)), pa.array(item.astype(np.int32))], names=[id_col, "node", "step_pos", "item_pos"])

    return src.mapInArrow(run, f"{id_col} {src.schema[0].dataType.simpleString()}, node string, step_pos int, item_pos int")


def flat_table(df: DataFrame, paths: dict[str, Path], id_col: str = "line_id", raw_col: str = "raw", depth: int | None = None, shape: Callable[[object], dict] = canonical_rollout) -> DataFrame:
    """The flat table of one repeated ancestor: (id_col, pos_1..pos_depth, one string column per leaf).

    All leaves must share the repeated ancestors of the table. Scalars are given as text, everything else as
    JSON; an absent leaf is null.
    """
    names, leaves = list(paths), list(paths.values())
    depths = {sum(s.endswith("[]") for s in p) for p in leaves}
    if len(depths) > 1 and depth is None:
        raise ValueError("the leaves belong to different repeated ancestors")
    depth = depths.pop() if depth is None else depth
    stem = [s for s in leaves[0]]
    cut_at = [i for i, s in enumerate(stem) if s.endswith("[]")][depth - 1] + 1 if depth else 0
    if any(p[:cut_at] != leaves[0][:cut_at] for p in leaves):
        raise ValueError("the leaves belong to different repeated ancestors")
    src = df.select(df[id_col], df[raw_col])
    positions = [f"pos_{i + 1}" for i in range(depth)]

    def text_of(v: object) -> str | None:
        if v is None or isinstance(v, str):
            return v
        return json.dumps(v, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = shred_lines(batch.column(1).to_pylist(), leaves, shape)
            record, at, index, define = assemble(columns[0], depth)
            need = levels_of(leaves[0][:cut_at])[0]
            keep = define >= need
            values = []
            for column in columns:
                _, _, own, _ = assemble(column, depth)
                values.append(pa.array([text_of(column.value[i]) for i in own[keep]], type=pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record[keep])), *(pa.array(p[keep].astype(np.int32)) for p in at), *values], names=[id_col, *positions, *names])

    fields = [f"`{id_col}` {src.schema[0].dataType.simpleString()}", *(f"{p} int" for p in positions), *(f"`{n}` string" for n in names)]
    return src.mapInArrow(run, ", ".join(fields))


STEP_LEAVES = {"step_id": ("steps[]", "step_id"), "tool_type": ("steps[]", "tool_type"), "action_text": ("steps[]", "action_text"), "success": ("steps[]", "success"), "meta_success": SUCCESS, "final": FINAL, "confidence": ("steps[]", "raw_observation", "confidence")}
HIT_LEAVES = {k: (*HIT, k) for k in ("title", "snippet", "answer", "score")} | {"rank": (*HIT, "meta", "rank")}


def rollout_steps(df: DataFrame) -> DataFrame:
    """(line_id, pos_1, leaves): the table of steps, linked to its line."""
    return flat_table(df, STEP_LEAVES)


def rollout_hits(df: DataFrame) -> DataFrame:
    """(line_id, pos_1, pos_2, leaves): the table of retrieved entries, linked to line and step."""
    return flat_table(df, HIT_LEAVES)
