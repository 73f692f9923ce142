"""As-of views, changes and histories over a log of (tick, seq, entity, comp, value).

An as-of view is one aggregation with a map-side combine (the row with the greatest (tick, seq)), whatever the length
of the history; ticks are pushed down to the scan. Logs written with ``sources.saves.write_log`` are sorted by tick
within files, so files and row groups after the tick are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("entity", "comp")


def as_of(log: DataFrame, tick: int | None, keys: Sequence[str] = KEY, values: Sequence[str] = ("value",)) -> DataFrame:
    """The last write of each key up to a tick (all writes, for None), with its tick."""
    rows = log if tick is None else log.where(F.col("tick") <= tick)
    order = F.struct("tick", "seq")
    last = F.max_by(F.struct(*values, "tick", "seq"), order).alias("__last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"__last.{v}").alias(v) for v in (*values, "tick", "seq")))


def live(lifecycle: DataFrame, tick: int | None = None) -> DataFrame:
    """Entities whose last event up to a tick is a spawn, with the prefab, tick and seq of their birth: the first spawn
    after the last despawn, as a spawn of one who lives changes nothing. One shuffle, by entity."""
    rows = lifecycle if tick is None else lifecycle.where(F.col("tick") <= tick)
    order = F.struct("tick", "seq")
    before = F.lag("spawned", 1, False).over(Window.partitionBy("entity").orderBy("tick", "seq"))
    rows = rows.withColumn("__birth", F.when(F.col("spawned") & ~before, F.struct("tick", "seq", "prefab")))
    last = rows.groupBy("entity").agg(F.max_by("spawned", order).alias("__lives"), F.max("__birth").alias("__b"))
    return last.where("__lives").select("entity", F.col("__b.prefab").alias("prefab"), F.col("__b.tick").alias("born"), F.col("__b.seq").alias("born_seq"))


def living_state(log: DataFrame, lifecycle: DataFrame, tick: int | None) -> DataFrame:
    """as_of for entities that live then; writes before the last birth are of an earlier life."""
    state, alive = as_of(log, tick), live(lifecycle, tick)
    later = (F.col("tick") > F.col("born")) | ((F.col("tick") == F.col("born")) & (F.col("seq") > F.col("born_seq")))
    return state.join(alive, "entity").where(later).select("entity", "comp", "value", "tick", "seq")


def wide(state: DataFrame, entities: DataFrame, comps: Sequence[str]) -> DataFrame:
    """A row an entity with a nullable column a component, and the signature: bit i for comps[i]."""
    picked = [F.max(F.when(F.col("comp") == c, F.col("value"))).alias(c) for c in comps]
    flat = state.where(F.col("comp").isin(list(comps))).groupBy("entity").agg(*picked)
    return entities.select("entity").join(flat, "entity", "left").withColumn("signature", signature(comps))


def signature(comps: Sequence[str]) -> Column:
    bits = F.lit(0).cast("long")
    for i, c in enumerate(comps):
        bits = bits + F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0)
    return bits


def has_all(sig: Column, mask: int) -> Column:
    """Whether a signature holds all components of a mask."""
    return sig.bitwiseAND(F.lit(mask)) == mask


def changed_since(state: DataFrame, since: int) -> DataFrame:
    """Strictly later than since: writes at tick 0 are never changes."""
    return state.where(F.col("tick") > since)


def last_write(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return log.groupBy(*keys).agg(F.coalesce(F.max("tick"), F.lit(0)).alias("last_tick"))


def dirty(log: DataFrame, since: int, upto: int | None = None) -> DataFrame:
    """Distinct keys written after since, up to a tick if one is given."""
    rows = log.where(F.col("tick") > since)
    return (rows if upto is None else rows.where(F.col("tick") <= upto)).select(*KEY).distinct()


def scrub(log: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """The value of each key at every step-th tick of a range, null before its first write.

    One sort a key instead of a join a tick: ticks asked for and writes are united, and the last value is carried.
    """
    before = as_of(log, first).select(*KEY, F.lit(first).cast("long").alias("tick"), F.lit(-1).cast("long").alias("seq"), "value", F.lit(False).alias("asked"))
    within = log.where((F.col("tick") > first) & (F.col("tick") <= last)).select(*KEY, "tick", "seq", "value", F.lit(False).alias("asked"))
    keys = log.where(F.col("tick") <= last).select(*KEY).distinct()
    ticks = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long")))
    asked = keys.select(*KEY, ticks.alias("tick"), F.lit(2**62).alias("seq"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked"))
    w = Window.partitionBy(*KEY).orderBy("tick", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = before.unionByName(within).unionByName(asked)
    return rows.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("asked").select(*KEY, "tick", "value")


def previous(log: DataFrame) -> DataFrame:
    """Each write with the value it replaced."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy(*KEY).orderBy("tick", "seq")))


def pruned(log: DataFrame, now: int, window: int = 600) -> DataFrame:
    """The log without writes before the window, but for the last one of each key, so states stay whole."""
    edge = now - window
    base = as_of(log, edge).select(*log.columns)
    return base.unionByName(log.where(F.col("tick") > edge).select(*base.columns)).select(*log.columns)


def first_difference(a: DataFrame, b: DataFrame, first: int, last: int) -> DataFrame:
    """The first tick of a range at which two logs' states differ, one past the range if none; one row.

    States can differ from one tick to the next only where either log has a write: the last writes of a tick are
    compared key by key, each side carrying its last value.
    """
    ends = [as_of(x, first).withColumn("tick", F.lit(first).cast("long")).select(*KEY, "tick", "value") for x in (a, b)]
    for i, x in enumerate((a, b)):
        later = x.where((F.col("tick") > first) & (F.col("tick") <= last)).groupBy(*KEY, "tick").agg(F.max_by("value", "seq").alias("value"))
        ends[i] = ends[i].unionByName(later)
    both = ends[0].withColumnRenamed("value", "x").withColumn("in_a", F.lit(True)).join(ends[1].withColumnRenamed("value", "y").withColumn("in_b", F.lit(True)), [*KEY, "tick"], "full_outer")
    w = Window.partitionBy(*KEY).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    x = F.last(F.when(F.col("in_a"), F.struct("x")), ignorenulls=True).over(w)
    y = F.last(F.when(F.col("in_b"), F.struct(F.col("y").alias("x"))), ignorenulls=True).over(w)
    return both.select("tick", (~x.eqNullSafe(y)).alias("differs")).agg(F.coalesce(F.min(F.when(F.col("differs"), F.col("tick"))), F.lit(last + 1).cast("long")).alias("tick"))


def rollback(log: DataFrame, tick: int) -> DataFrame:
    """The log up to a tick."""
    return log.where(F.col("tick") <= tick)


def resimulated(log: DataFrame, inputs: DataFrame, first: int, last: int) -> DataFrame:
    """The log with inputs (tick, seq, entity, comp, value) of ticks in (first, last] written over it: an input comes
    after all recorded writes of its tick. Inputs of other ticks are passed over, as are recorded writes after last."""
    late = F.lit(1 << 40)
    picked = inputs.where((F.col("tick") > first) & (F.col("tick") <= last)).withColumn("seq", F.col("seq") + late)
    return log.where(F.col("tick") <= last).unionByName(picked.select(*log.columns))
