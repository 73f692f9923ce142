"""Directed relations (src, kind, dst, payload) over an append-only log with tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .temporal import as_of

KEY = ("src", "kind", "dst")


def current(log: DataFrame, live: DataFrame | None = None, tick: int | None = None) -> DataFrame:
    """The edges at a tick: last writes that aren't removals, later than the births of both ends, which must live."""
    edges = as_of(log, tick, KEY, ("payload", "op")).where("op = 'add'").select(*KEY, "payload", "tick", "seq")
    for end in ("src", "dst") if live is not None else ():
        born = live.select(F.col("entity").alias(end), F.struct("born", "born_seq").alias("__born"))
        edges = edges.join(born, end).where(F.struct("tick", "seq") > F.col("__born")).drop("__born")
    return edges.select(*KEY, "payload", "tick")


def outgoing(edges: DataFrame, sources: DataFrame, kind: int | None = None) -> DataFrame:
    """One hop forwards from sources (entity)."""
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    return rows.join(sources.select(F.col("entity").alias("src")), "src").select(*KEY, "payload")


def incoming(edges: DataFrame, targets: DataFrame, kind: int | None = None) -> DataFrame:
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    return rows.join(targets.select(F.col("entity").alias("dst")), "dst").select(*KEY, "payload")


def related(rows: DataFrame, edges: DataFrame, on: Sequence[str] = KEY, negate: bool = False) -> DataFrame:
    """The rows for which there is an edge, or for negate, none."""
    return rows.join(edges.select(*on), list(on), "left_anti" if negate else "left_semi")


def degrees(edges: DataFrame, end: str = "src") -> DataFrame:
    return edges.groupBy(F.col(end).alias("entity"), "kind").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """Sorted neighbour lists in pages of at most so many, numbered from 0: a hot node's list is never in one row."""
    number = F.row_number().over(Window.partitionBy("src", "kind").orderBy("dst"))
    paged = edges.select("src", "kind", "dst", F.floor((number - 1) / most).alias("page"))
    return paged.groupBy("src", "kind", "page").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


def canonical(edges: DataFrame) -> DataFrame:
    """Edges in the order that replicas agree on; a range-partitioned sort."""
    return edges.orderBy(*KEY)


def changed_sources(log: DataFrame, kind: int, since: int) -> DataFrame:
    rows = log.where((F.col("kind") == kind) & (F.col("tick") > since) & (F.col("op") == "add"))
    return rows.groupBy("src").agg(F.max("tick").alias("tick"))


def removed_since(log: DataFrame, since: int) -> DataFrame:
    """Tombstones later than since that no later write undid."""
    return as_of(log, None, KEY, ("payload", "op")).where((F.col("op") == "remove") & (F.col("tick") > since)).select(*KEY, "tick")


def pruned(log: DataFrame, tick: int) -> DataFrame:
    """The log with tombstones up to a tick, and what they removed, forgotten."""
    last = as_of(log, None, KEY, ("payload", "op"))
    gone = last.where((F.col("op") == "remove") & (F.col("tick") <= tick)).select(*KEY)
    return log.join(gone, list(KEY), "left_anti").select(*log.columns)


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Entities within so many hops of start (entity), with the least number.

    A frontier at a time: what it leads to, less what is known. Each is settled, so plans stay short and work is linear in
    the edges, cycles and many paths included.
    """
    ties = edges.select("src", "dst").distinct()
    known = settled(start.select("entity", F.lit(0).cast("long").alias("hops")).distinct(), "reach")
    frontier = known
    for hop in range(1, hops + 1):
        new = ties.join(frontier.select(F.col("entity").alias("src")), "src").select(F.col("dst").alias("entity")).distinct()
        frontier = settled(new.join(known, "entity", "left_anti").select("entity", F.lit(hop).cast("long").alias("hops")), "reach")
        if frontier.isEmpty():
            break
        known = known.unionAll(frontier)
    return known
