"""A world of entities as append-only logs, of which all states, past and present, are views.

component_log(tick, seq, entity, comp, value), lifecycle_log(tick, seq, entity, prefab, spawned) and
edge_log(tick, seq, src, kind, dst, payload, op). (tick, seq) orders writes; seq comes from the source. Values are
doubles here; typed components are columns of wide tables made by ``operators.temporal.wide``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, temporal

COMPONENTS = "tick long, seq long, entity long, comp string, value double"
LIFECYCLE = "tick long, seq long, entity long, prefab string, spawned boolean"
EDGES = "tick long, seq long, src long, kind int, dst long, payload double, op string"
SCHEMAS = (COMPONENTS, LIFECYCLE, EDGES)
#: Rows written one by one that are kept until they become part of a log.
PENDING = 10_000


class World:
    """Writes only append rows; whether one counts (a spawn of one who lives, a write to one who doesn't, an edge between
    such) is decided where states are read, so a log's plan grows by a union each ``PENDING`` rows and never by a join."""

    def __init__(self, components: DataFrame, lifecycle: DataFrame, edges: DataFrame, tick: int = 0, seq: int = 0, pending: tuple = ((), (), ())):
        self.logs, self.tick, self.seq, self.pending = (components, lifecycle, edges), tick, seq, pending
        self._whole: dict[int, DataFrame] = {}

    @staticmethod
    def empty(spark: SparkSession) -> World:
        return World(*(spark.createDataFrame([], s) for s in SCHEMAS))

    def _log(self, k: int) -> DataFrame:
        if k not in self._whole:
            log = self.logs[k]
            self._whole[k] = log.unionByName(log.sparkSession.createDataFrame(list(self.pending[k]), SCHEMAS[k])) if self.pending[k] else log
        return self._whole[k]

    components = property(lambda self: self._log(0))
    lifecycle = property(lambda self: self._log(1))
    edges = property(lambda self: self._log(2))

    def at(self, tick: int) -> World:
        """The same world with its clock at a tick, never earlier than it stands."""
        return World(*self.logs, max(tick, self.tick), self.seq, self.pending)

    def advance(self, ticks: int = 1) -> World:
        return self.at(self.tick + ticks)

    def _with(self, k: int, rows: list[tuple]) -> World:
        new = tuple((self.tick, self.seq + i, *r) for i, r in enumerate(rows))
        pending = tuple(own + new if i == k else own for i, own in enumerate(self.pending))
        if len(pending[k]) <= PENDING:
            return World(*self.logs, self.tick, self.seq + len(rows), pending)
        logs = [log.unionByName(log.sparkSession.createDataFrame(list(own), schema)) if own else log for log, own, schema in zip(self.logs, pending, SCHEMAS)]
        return World(*logs, self.tick, self.seq + len(rows))

    def appended(self, components: DataFrame | None = None, lifecycle: DataFrame | None = None, edges: DataFrame | None = None, seqs: int = 1) -> World:
        """The world with tables of rows, which use up so many numbers."""
        logs = [own if more is None else own.unionByName(more) for own, more in zip((self._log(k) for k in range(3)), (components, lifecycle, edges))]
        return World(*logs, self.tick, self.seq + seqs)

    def spawn(self, *entities: int, prefab: str | None = None) -> World:
        """Idempotent: an entity that lives isn't made anew."""
        return self._with(1, [(e, prefab, True) for e in entities])

    def despawn(self, *entities: int) -> World:
        """Unknown entities are passed over."""
        return self._with(1, [(e, None, False) for e in entities])

    def write(self, *rows: tuple[int, str, float]) -> World:
        """Components (entity, comp, value); writes to entities that don't live are never seen."""
        return self._with(0, list(rows))

    def relate(self, *rows: tuple[int, int, int, float], op: str = "add") -> World:
        """Edges (src, kind, dst, payload), seen while both ends live; op "remove" leaves a tombstone."""
        return self._with(2, [(*r, op) for r in rows])

    def unrelate(self, *rows: tuple[int, int, int]) -> World:
        return self.relate(*((*r, None) for r in rows), op="remove")

    def live(self, tick: int | None = None) -> DataFrame:
        return temporal.live(self.lifecycle, self.tick if tick is None else tick)

    def state(self, tick: int | None = None) -> DataFrame:
        """(entity, comp, value, tick) of all that live at a tick, the present by default."""
        t = self.tick if tick is None else tick
        return temporal.living_state(self.components, self.lifecycle, t)

    def wide(self, comps: list[str], tick: int | None = None) -> DataFrame:
        return temporal.wide(self.state(tick), self.live(tick), comps)

    def relations(self, tick: int | None = None) -> DataFrame:
        t = self.tick if tick is None else tick
        return graph.current(self.edges, self.live(t), t)

    def changed(self, comp: str, since: int) -> DataFrame:
        """Rows of a component last written after a tick, one an entity."""
        return temporal.changed_since(temporal.living_state(self.components, self.lifecycle, self.tick), since).where(F.col("comp") == comp)

    def matching(self, comps: list[str], tick: int | None = None) -> DataFrame:
        """Entities that have all of comps."""
        w = self.wide(comps, tick)
        return w.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in comps), F.lit(True)))
