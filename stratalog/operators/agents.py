"""Decisions of many agents at once: blackboards, behaviour trees, goal plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 16


def board_set(board: Column, key: Column, value: Column) -> Column:
    """A map with a key set; a 17th key is left out."""
    has = F.map_contains_key(board, key)
    others = F.map_filter(board, lambda k, _: k != key)
    return F.when(has | (F.size(board) < MOST_KEYS), F.map_concat(others, F.create_map(key, value))).otherwise(board)


def as_number(kind: Column, f: Column, i: Column, b: Column) -> Column:
    """A tagged value as a double; booleans are 0 and 1."""
    return F.when(kind == "float", f.cast("double")).when(kind == "int", i.cast("double")).when(kind == "bool", b.cast("int").cast("double"))


@dataclass(frozen=True)
class Node:
    """A behaviour tree: kind is "selector", "sequence" or "leaf"; a leaf names a status column."""

    kind: str
    children: tuple[Node, ...] = ()
    leaf: str = ""

    def check(self) -> Node:
        if self.kind == "leaf":
            if self.children:
                raise ValueError("a leaf has no children")
        elif self.kind not in ("selector", "sequence") or not self.children:
            raise ValueError(f"bad node {self.kind}")
        for child in self.children:
            child.check()
        return self

    def status(self, leaves: dict[str, Column]) -> Column:
        """SUCCESS, FAILURE or RUNNING as one expression; unknown leaves succeed."""
        if self.kind == "leaf":
            return leaves.get(self.leaf, F.lit("SUCCESS"))
        skip, rest = ("FAILURE", "FAILURE") if self.kind == "selector" else ("SUCCESS", "SUCCESS")
        out = None
        for child in self.children:
            s = child.status(leaves)
            out = F.when(s != skip, s) if out is None else out.when(s != skip, s)
        return out.otherwise(rest)


class Trees:
    """Registered trees by name, each with a version."""

    def __init__(self) -> None:
        self.trees: dict[str, tuple[Node, int]] = {}

    def register(self, name: str, tree: Node) -> int:
        version = self.trees.get(name, (tree, 0))[1] + 1
        self.trees[name] = (tree.check(), version)
        return version


@dataclass(frozen=True)
class Action:
    id: int
    effect: str
    value: float
    needs: str | None = None
    needs_value: float = 0.0
    cost: float = 1.0


def plan(state: dict[str, float], goal: dict[str, float], actions: Sequence[Action], most: int = 8, steps: int = 256) -> list[int] | None:
    """Greedy regression: the first action whose effect's key is still wanted; what it needs is wanted next."""
    want, found = dict(goal), []
    for _ in range(steps):
        if all(state.get(k) == v for k, v in want.items()):
            return found[::-1][-most:] if len(found) <= most else found[:most][::-1]
        action = next((a for a in actions if a.effect in want), None)
        if action is None:
            return None
        found.append(action.id)
        del want[action.effect]
        if action.needs is not None:
            want[action.needs] = action.needs_value
    return None


def plans(agents: DataFrame, keys: Sequence[str], goal: dict[str, float], actions: Sequence[Action]) -> DataFrame:
    """agents with a column plan (action ids; null: none): equal states are planned once, by an Arrow function."""

    @F.pandas_udf("array<long>")
    def each(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([plan({k: v for k, v in zip(keys, row) if v == v}, goal, actions) for row in frame.itertuples(index=False)])

    states = agents.select(*keys).distinct().withColumn("plan", each(F.struct(*keys)))
    states = states.withColumnsRenamed({k: "__" + k for k in keys})
    same = [F.col(k).eqNullSafe(F.col("__" + k)) for k in keys]
    return agents.join(states, same, "left").drop(*("__" + k for k in keys))
