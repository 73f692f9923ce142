"""Interest subscriptions: who is inside which volume, enter and leave events, levels of detail, perception, streaming."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numeric import lod_tier, quantized

#: Subscriptions that are sent to all tasks; more are matched by a grid join.
BROADCAST = 10_000


def inside(points: DataFrame, subs: DataFrame, names: Sequence[str] = ("x", "y", "z"), prefab: bool = False) -> DataFrame:
    """Pairs (sub, entity) of points in spherical volumes; subs: sub, cx, cy, cz, r.

    Few subscriptions (counted first) are sent to every task; more go to cells of the greatest radius' width.
    """
    stats = subs.agg(F.count("*"), F.max("r")).first()
    at = [F.col(n) for n in names]
    within = g.in_sphere(at, [F.col("cx"), F.col("cy"), F.col("cz")], F.col("r"))
    if prefab:
        within = within & (F.col("prefab").isNull() | F.col("prefab").eqNullSafe(F.col("of")))
        points = points.withColumnRenamed("prefab", "of")
    if stats[0] <= BROADCAST:
        return points.join(F.broadcast(subs), within).select("sub", "entity", F.sqrt(g.squared(at, [F.col("cx"), F.col("cy"), F.col("cz")])).alias("d"))
    size = float(stats[1]) or 1.0
    cells = subs
    for n, c in zip(names, ("cx", "cy", "cz")):
        cells = cells.withColumn("__" + n, F.explode(F.sequence(g.cell(F.col(c), size).cast("long") - 1, g.cell(F.col(c), size).cast("long") + 1)))
    placed = points.withColumns({"__" + n: g.cell(F.col(n), size).cast("long") for n in names})
    return placed.join(cells, ["__" + n for n in names]).where(within).select("sub", "entity", F.sqrt(g.squared(at, [F.col("cx"), F.col("cy"), F.col("cz")])).alias("d"))


def edges(series: DataFrame, keys: Sequence[str], flag: str, order: str = "tick", names: tuple[str, str] = ("enter", "leave")) -> DataFrame:
    """Changes of a boolean over time, from false at first: one row a change."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag(flag).over(w), F.lit(False))
    rows = series.withColumn("__before", before).where(F.col("__before") != F.col(flag))
    return rows.select(*keys, order, F.when(F.col(flag), names[0]).otherwise(names[1]).alias("event"))


def difference(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("sub", "entity")) -> DataFrame:
    """Enter and leave events between two inside-sets."""
    keys = list(keys)
    entered = new.select(*keys).join(old, keys, "left_anti").withColumn("event", F.lit("enter"))
    return entered.unionByName(old.select(*keys).join(new, keys, "left_anti").withColumn("event", F.lit("leave")))


def replication(relevant: DataFrame, known: DataFrame, keys: Sequence[str] = ("sub", "entity")) -> tuple[DataFrame, DataFrame]:
    """What a subscriber must learn of and forget, and what it knows then."""
    return difference(known, relevant, keys), relevant.select(*keys)


def following(subs: DataFrame, owners: DataFrame) -> DataFrame:
    """Volumes of subscriptions with an owner, moved to base offset + owner's position (owner, x, y, z)."""
    moved = subs.join(owners.select(F.col("entity").alias("owner"), "x", "y", "z"), "owner", "left")
    return moved.withColumns({"c" + n: F.col("c" + n) + F.coalesce(n, F.lit(0.0)) for n in "xyz"}).drop("x", "y", "z")


def level_rows(pairs: DataFrame, rules: Sequence[tuple[float, int, float]]) -> DataFrame:
    """pairs with d, plus tier, every and step by rules (max distance, every n ticks, quantisation step)."""
    tier = lod_tier(F.col("d"), [r[0] for r in rules])
    pick = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in rules)), tier + 1) if rules else F.lit((1, 0.0)[i - 1])
    return pairs.withColumns({"tier": tier, "every": pick(1), "step": pick(2).cast("double")})


def send_times(rows: DataFrame) -> DataFrame:
    """Rate limit: of rows (sub, entity, comp, tier, tick, last_write, every) those that are sent.

    Never sent at this tier: sent; else if written since and at least so many ticks passed. Unstamped or out of reach:
    never. Each decision needs the one before, so keys are walked tick by tick, each in its own group.
    """

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        keep, sent = [], None
        batch = batch.sort_values("tick")
        for tick, last, every in zip(batch.tick, batch.last_write, batch.every):
            go = last > 0 and (sent is None or (last > sent and tick - sent >= every))
            keep.append(bool(go))
            if go:
                sent = tick
        return batch[keep]

    return rows.where("tier is not null").groupBy("sub", "entity", "comp", "tier").applyInPandas(walk, rows.schema)


def subscriber_delta(now: DataFrame, known: DataFrame, values: DataFrame, rules: Sequence[tuple[float, int, float]], since: int, cold: Sequence[str] = ()) -> DataFrame:
    """For each subscription: leaves, enters, then values written after since, quantised by distance; no cold ones.

    now: (sub, entity, d); known: (sub, entity); values: (entity, comp, value, tick).
    """
    moves = difference(known, now).select("sub", "entity", F.when(F.col("event") == "enter", "spawn").otherwise("despawn").alias("op"), F.lit(None).cast("string").alias("comp"), F.lit(None).cast("double").alias("value"))
    fresh = values.where((F.col("tick") > since) & ~F.col("comp").isin(list(cold)) if cold else F.col("tick") > since)
    rows = level_rows(now, rules).where("tier is not null").join(fresh, "entity")
    return moves.unionByName(rows.select("sub", "entity", F.lit("update").alias("op"), "comp", quantized(F.col("value"), F.col("step")).alias("value")))


def visible(observers: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """Pairs (observer, target) in vision cones: observers entity, x, y, z, fx, fy, fz, range, cos_half; none sees itself."""
    from .spatial import join_within

    o, t = [F.col(f"l.{n}") for n in "xyz"], [F.col(f"r.{n}") for n in "xyz"]
    cone = g.sees(o, [F.col(f"l.f{n}") for n in "xyz"], t, F.col("l.range"), F.col("l.cos_half"))
    pairs = join_within(observers, targets, reach, cone & (F.col("l.entity") != F.col("r.entity")))
    return pairs.select(F.col("l.entity").alias("observer"), F.col("r.entity").alias("target"), "d")


def heard(hearers: DataFrame, sounds: DataFrame, reach: float) -> DataFrame:
    """Pairs of hearers (entity, x, y, z, radius) and sounds (sound, x, y, z, loudness); reach: the greatest product."""
    from .spatial import join_within

    test = g.hears([F.col(f"l.{n}") for n in "xyz"], F.col("l.radius"), [F.col(f"r.{n}") for n in "xyz"], F.col("r.loudness"))
    return join_within(hearers, sounds, reach, test).select(F.col("l.entity").alias("observer"), F.col("r.sound").alias("sound"))


def chunk_plan(chunks: DataFrame, observer: dict[str, float], *, load: float = 1000.0, prefetch: float = 2000.0, ahead: float = 2.0, frustum_bonus: float = 200.0, active_bonus: float = 100.0, budget: int = 16, in_view: Column | None = None) -> DataFrame:
    """Chunks (cx, cy, cz, state) with distance, predicted distance, priority and action: load, unload or null.

    The best of those to load get the budget, ties by coordinates; a partial sort a task, then one of the winners.
    """
    c = [F.col(n) * g.SECTOR for n in ("cx", "cy", "cz")]
    here = [observer[n] for n in "xyz"]
    there = [observer[n] + observer.get("v" + n, 0.0) * ahead for n in "xyz"]
    d, p = g.distance(c, here), g.distance(c, there)
    active = F.col("state") == "ACTIVE"
    priority = F.when(d < load, load - d).otherwise(0.0) + (F.lit(prefetch) - p) * 0.5 + F.when(in_view if in_view is not None else F.lit(False), frustum_bonus).otherwise(0.0) + F.when(active, active_bonus).otherwise(0.0)
    rows = chunks.withColumns({"d": d, "p": p, "priority": F.greatest(priority, F.lit(0.0))})
    near, far = (F.col("d") <= load) | (F.col("p") <= load), (F.col("d") > prefetch) & (F.col("p") > prefetch)
    winners = rows.where(near & ~active).orderBy(F.col("priority").desc(), "cx", "cy", "cz").limit(budget).select("cx", "cy", "cz", F.lit("load").alias("action"))
    out = rows.join(F.broadcast(winners), ["cx", "cy", "cz"], "left")
    return out.withColumn("action", F.when(far & active, "unload").otherwise(F.col("action")))


