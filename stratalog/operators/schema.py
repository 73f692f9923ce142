"""Component schemas: migrations, overlays of mods, capability-checked views, write-ahead logs, schedules, sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fnv64

FIRST_MOD_ID = 4096


def migrated(df: DataFrame, comp: str, fields: dict[str, Column | str | None], fill: float = 0.0) -> DataFrame:
    """A struct column rebuilt: new field names to old ones, expressions, or None for the fill value; null stays null."""
    old = {f.name for f in df.schema[comp].dataType.fields}
    pick = lambda v: v if isinstance(v, Column) else F.col(f"{comp}.{v}") if v in old else F.lit(fill)
    return df.withColumn(comp, F.when(F.col(comp).isNotNull(), F.struct(*(pick(v).alias(k) for k, v in fields.items()))))


@dataclass(frozen=True)
class Rule:
    start: int
    end: int
    fields: dict


def path(rules: Sequence[Rule], current: int, target: int) -> list[Rule]:
    """The first rule from the current version that doesn't overshoot, again and again; empty if the target isn't met."""
    found = []
    while current < target:
        rule = next((r for r in rules if r.start == current and r.start < r.end <= target), None)
        if rule is None:
            return []
        found.append(rule)
        current = rule.end
    return found


def upgrade(df: DataFrame, comp: str, rules: Sequence[Rule], current: int, target: int) -> DataFrame:
    steps = path(rules, current, target)
    if current < target and not steps:
        raise ValueError(f"no way from version {current} to {target}")
    for rule in steps:
        df = migrated(df, comp, rule.fields)
    return df


@dataclass
class Overlay:
    """Core components and those of mods: a patch keeps its core component's id, new ones start at 4096."""

    core: dict[str, int]
    mods: dict[str, dict[str, int]] = field(default_factory=dict)
    hashes: list[int] = field(default_factory=list)
    next_id: int = FIRST_MOD_ID

    def resolve(self, mod: str, patches: Sequence[str] = (), new: Sequence[str] = ()) -> bool:
        """False, and nothing changed, for a known mod, an unknown or doubled patch, or a name that is taken."""
        taken = {n for ids in self.mods.values() for n in ids if n not in self.core} | set(self.core)
        if mod in self.mods or len(set(patches)) < len(patches) or len(set(new)) < len(new) or set(patches) - set(self.core) or set(new) & taken:
            return False
        ids = {p: self.core[p] for p in patches}
        for name in new:
            ids[name] = self.next_id
            self.next_id += 1
        self.mods[mod] = ids
        self.hashes.append(fnv64("\x00".join([mod, *(f"{k}={v}" for k, v in sorted(ids.items()))]).encode()))
        return True

    def owner(self, comp_id: int) -> str | None:
        return next((m for m, ids in self.mods.items() if comp_id in ids.values() and comp_id >= FIRST_MOD_ID), "core" if comp_id in self.core.values() else None)

    def schema_hash(self) -> int:
        out = 0
        for h in self.hashes:
            out ^= h
        return out


@dataclass(frozen=True)
class Sandbox:
    """A view with grants: writing implies reading; anything else raises PermissionError."""

    df: DataFrame
    reads: frozenset[str] = frozenset()
    writes: frozenset[str] = frozenset()

    def query(self, *columns: str) -> DataFrame:
        denied = set(columns) - self.reads - self.writes
        if denied:
            raise PermissionError(f"not readable: {', '.join(sorted(denied))}")
        return self.df.select("entity", *columns).dropna(subset=list(columns))

    def update(self, where: Column | None = None, **values: Column) -> Sandbox:
        denied = set(values) - self.writes
        if denied:
            raise PermissionError(f"not writable: {', '.join(sorted(denied))}")
        has = where if where is not None else F.lit(True)
        return replace(self, df=self.df.withColumns({c: F.when(has & F.col(c).isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}))


def recovered(log: DataFrame) -> DataFrame:
    """Page bytes after recovery: the last write of each (page, offset) among those of committed transactions and of
    transaction 0. log: lsn, txn, op (write, commit, abort), page, offset, data."""
    done = log.where("op = 'commit'").select("txn").distinct()
    own = log.where("op = 'write'")
    redo = own.where("txn = 0").unionByName(own.where("txn <> 0").join(done, "txn", "left_semi").select(own.columns))
    return redo.groupBy("page", "offset").agg(F.max_by("data", "lsn").alias("data"), F.max("lsn").alias("lsn"))


@dataclass(frozen=True)
class System:
    name: str
    run: Callable
    reads: frozenset[str] = frozenset()
    writes: frozenset[str] = frozenset()


def layers(systems: Sequence[System]) -> list[list[str]]:
    """Systems that may run together, in order of registration; one waits for each earlier one it conflicts with."""
    depth: list[int] = []
    for i, s in enumerate(systems):
        before = [depth[j] for j in range(i) if systems[j].writes & (s.reads | s.writes) or systems[j].reads & s.writes]
        depth.append(1 + max(before, default=-1))
    return [[s.name for s, d in zip(systems, depth) if d == level] for level in range(max(depth, default=-1) + 1)]


def step(world, systems: Sequence[System]):
    """Advance the clock once, then run the systems in order; a system maps worlds to worlds."""
    world = world.advance()
    for system in systems:
        world = system.run(world)
    return world


@dataclass(frozen=True)
class Session:
    """Edits by whoever possesses an entity, numbered, with undo."""

    world: object
    entity: int | None = None
    edits: tuple = ()

    def possess(self, entity: int | None) -> Session:
        return replace(self, entity=entity)

    def edit(self, comp: str, value: float) -> tuple[Session, int]:
        """The session and the edit's number; 0 if no entity is possessed."""
        if self.entity is None:
            return self, 0
        new = self.world.advance().write((self.entity, comp, value))
        return replace(self, world=new, edits=(*self.edits, (len(self.edits) + 1, self.entity, comp, value, self.world))), len(self.edits) + 1

    def undo(self) -> Session:
        """Back to the world before the last edit."""
        return replace(self, world=self.edits[-1][4], edits=self.edits[:-1]) if self.edits else self


def audit(edits: DataFrame) -> DataFrame:
    """Edits (seq, entity, comp, value) with what each replaced."""
    return edits.withColumn("old", F.lag("value").over(Window.partitionBy("entity", "comp").orderBy("seq")))
