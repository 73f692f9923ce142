"""An engine: named tables, a clock, and statements of the query language. Results are DataFrames."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .gql import compile as c
from .gql.lexer import GqlError
from .gql.parser import Explain, Find, Select, Write, parse
from .operators import delta, temporal
from .session import settled
from .sources import saves
from .world import World


@dataclass
class Table:
    """A DataFrame, or components of the engine's world by name; stream: what LISTEN reads."""

    df: DataFrame | None = None
    comps: tuple[str, ...] = ()
    prefab: str | None = None
    stream: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, world: World | None = None, slots: str | None = None):
        self.spark, self.world, self.slots = spark, world or World.empty(spark), slots
        self.tables: dict[str, Table] = {}
        self.last_delta = (0, -1)
        self.next_entity = 0

    # --- catalogue and clock ---

    def register(self, name: str, df: DataFrame, stream: DataFrame | None = None) -> Engine:
        self.tables[name] = Table(df, stream=stream)
        return self

    def register_components(self, name: str, *comps: str, prefab: str | None = None) -> Engine:
        self.tables[name] = Table(comps=comps, prefab=prefab)
        return self

    def advance_tick(self, ticks: int = 1) -> int:
        self.world = self.world.advance(ticks)
        return self.world.tick

    @property
    def tick(self) -> int:
        return self.world.tick

    def table(self, name: str, tick: int | None = None, since: int | None = None, listen: bool = False) -> DataFrame:
        t = self.tables.get(name)
        if t is None:
            raise GqlError(f"unknown table {name}")
        if listen and t.stream is not None:
            return t.stream
        if t.df is not None:
            rows = t.df if tick is None else t.df.where(F.col("tick") <= tick)
            return rows if since is None else rows.where(F.col("tick") > self.tick - since)
        at = self.tick if tick is None else tick
        rows = self.world.wide(list(t.comps), at).drop("signature").dropna(subset=list(t.comps))
        if t.prefab is not None:
            rows = rows.join(self.world.live(at).where(F.col("prefab") == t.prefab).select("entity"), "entity", "left_semi")
        if since is not None:
            changed = self.world.state(at).where((F.col("tick") > self.tick - since) & F.col("comp").isin(list(t.comps)))
            rows = rows.join(changed.select("entity").distinct(), "entity", "left_semi")
        return rows

    # --- statements ---

    def query(self, text: str) -> DataFrame:
        """Run a statement; a write gives one row with the table's name."""
        return self.run(parse(text))

    def run(self, s) -> DataFrame:
        if isinstance(s, Explain):
            lines = self.spark._jvm.PythonSQLUtils.explainString(self.run(s.statement)._jdf.queryExecution(), "formatted")
            return self.spark.createDataFrame([(lines,)], "plan string")
        if isinstance(s, Select):
            return c.select(s, self.table)
        if isinstance(s, Find):
            return self.find(s)
        getattr(self, "do_" + s.kind)(s)
        return self.spark.createDataFrame([(s.kind, s.name)], "done string, name string")

    def find(self, s: Find, exact: bool = False) -> DataFrame:
        """NEAR is the cube round a point; exact: the sphere."""
        df = self.table(s.table)
        if s.near is not None:
            at = [F.col(n) for n in c.position(df)]
            df = df.where(g.near_box(at, s.near, s.within))
            if exact:
                df = df.where(g.in_sphere(at, s.near, s.within))
        if s.where:
            df = df.where(c.truth(s.where))
        return df.limit(s.limit) if s.limit else df

    def _plain(self, name: str) -> Table:
        t = self.tables.get(name)
        if t is None:
            raise GqlError(f"unknown table {name}")
        return t

    def do_create(self, s: Write) -> None:
        if s.name in self.tables:
            raise GqlError(f"table {s.name} exists")
        kinds = [(n, c.TYPES.get(k.lower())) for n, k in s.columns]
        if bad := [n for n, k in kinds if k is None]:
            raise GqlError(f"unknown type of {bad[0]}")
        self.register(s.name, self.spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in kinds)))

    def do_drop(self, s: Write) -> None:
        self._plain(s.name)
        del self.tables[s.name]

    def do_insert(self, s: Write) -> None:
        t = self._plain(s.name)
        values = [[c.column(e) for e in row] for row in s.values]
        one = self.spark.range(1)
        if t.df is None:
            names = s.columns or t.comps
            found = one.select(F.array(*(F.array(*(v.cast("double") for v in row)) for row in values)).alias("v")).first().v
            for row in found:
                entity = self._next()
                self.world = self.world.spawn(entity, prefab=t.prefab).write(*((entity, n, v) for n, v in zip(names, row) if v is not None))
            return
        names = s.columns or tuple(t.df.columns)
        if len(names) != len(values[0]) or set(names) - set(t.df.columns):
            raise GqlError("values don't fit the table's columns")
        cast = lambda row: F.struct(*((dict(zip(names, row)).get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in t.df.schema))
        t.df = t.df.unionByName(one.select(F.inline(F.array(*map(cast, values)))))

    def _next(self) -> int:
        if not self.next_entity:
            self.next_entity = (self.world.lifecycle.agg(F.max("entity")).first()[0] or 0) + 1
        self.next_entity += 1
        return self.next_entity - 1

    def do_update(self, s: Write) -> None:
        t = self._plain(s.name)
        test = c.truth(s.where) if s.where else F.lit(True)
        new = {n: c.column(e) for n, e in zip(s.columns, s.values)}
        if t.df is not None:
            if set(new) - set(t.df.columns):
                raise GqlError("no such column")
            kinds = {f.name: f.dataType for f in t.df.schema}
            t.df = t.df.withColumns({n: F.when(test, v).otherwise(F.col(n)).cast(kinds[n]) for n, v in new.items()})
            return
        rows = self.table(s.name).where(test)
        writes = rows.select("entity", F.explode(F.map_from_arrays(F.array(*map(F.lit, new)), F.array(*(v.cast("double") for v in new.values())))).alias("comp", "value"))
        at = self.world
        log = writes.select(F.lit(at.tick).cast("long").alias("tick"), F.lit(at.seq).cast("long").alias("seq"), "entity", "comp", "value")
        self.world = at.appended(components=settled(log, "update"))

    def do_delete(self, s: Write) -> None:
        t = self._plain(s.name)
        test = c.truth(s.where) if s.where else F.lit(True)
        if t.df is not None:
            t.df = t.df.where(~F.coalesce(test, F.lit(False)))
            return
        self._bury(self.table(s.name).where(test).select("entity"))

    def _bury(self, rows: DataFrame) -> None:
        at = self.world
        log = rows.select(F.lit(at.tick).cast("long").alias("tick"), F.lit(at.seq).cast("long").alias("seq"), "entity", F.lit(None).cast("string").alias("prefab"), F.lit(False).alias("spawned"))
        self.world = at.appended(lifecycle=settled(log, "delete"))

    def do_spawn(self, s: Write) -> None:
        entity = self._next()
        self.world = self.world.spawn(entity, prefab=s.name)
        if s.columns:
            got = self.spark.range(1).select(*(c.column(e).cast("double").alias(n) for n, e in zip(s.columns, s.values))).first()
            self.world = self.world.write(*((entity, n, got[n]) for n in s.columns))

    def do_despawn(self, s: Write) -> None:
        self.world = self.world.despawn(int(s.name))

    def do_snapshot(self, s: Write) -> None:
        saves.save_world(self.world, self._slot(s.name))

    def do_restore(self, s: Write) -> None:
        self.world = saves.load_world(self.spark, self._slot(s.name))

    def _slot(self, name: str) -> str:
        if self.slots is None:
            raise GqlError("the engine has no folder for slots")
        if "/" in name or name.startswith("."):
            raise GqlError("a slot is a plain name")
        return f"{self.slots}/slot={name}"

    # --- scripts and the wire ---

    def get(self, entity: int, comp: str) -> float | None:
        row = self.world.state().where((F.col("entity") == entity) & (F.col("comp") == comp)).first()
        return row.value if row else None

    def set(self, entity: int, comp: str, value: float) -> None:
        self.world = self.world.write((entity, comp, value))

    def spawn(self, prefab: str | None = None) -> int:
        entity = self._next()
        self.world = self.world.spawn(entity, prefab=prefab)
        return entity

    def run_script(self, script: Callable[[Engine], None], when: bool = True) -> None:
        if when:
            script(self)

    def delta(self) -> DataFrame:
        """What happened since the last call."""
        w, (tick, seq) = self.world, self.last_delta
        self.last_delta = (w.tick, w.seq - 1)
        return delta.capture(w.components, w.lifecycle, w.edges, tick, seq)

    def apply(self, rows: DataFrame, tick: int) -> None:
        self.world = delta.applied(self.world, rows, tick)

    def rollback(self, tick: int) -> None:
        w = self.world
        self.world = World(*(temporal.rollback(x, tick) for x in (w.components, w.lifecycle, w.edges)), tick, w.seq)


def main(argv: list[str]) -> int:
    """python -m stratalog [--tables DIR] "STATEMENT"; without one it is read from standard input."""
    from pathlib import Path

    from .session import local_session

    spark = local_session()
    engine = Engine(spark)
    if argv[:1] == ["--tables"]:
        for path in sorted(Path(argv[1]).glob("*.parquet")):
            engine.register(path.stem, spark.read.parquet(str(path)))
        argv = argv[2:]
    try:
        engine.query(" ".join(argv) or sys.stdin.read()).show(100, truncate=False)
    except GqlError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
