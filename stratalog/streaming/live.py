"""Streaming forms: enter and leave events, rate-limited updates, windows over event time, change feeds to a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry as g

EVENTS = "sub long, entity long, tick long, event string"


def enter_leave(moves: DataFrame, subs: DataFrame) -> DataFrame:
    """Events of a stream of moves (entity, tick, x, y, z) against spherical subscriptions (sub, cx, cy, cz, r).

    Volumes, a static table, lie in cells about twice as wide as they are, at most eight each, by powers of two, so wide ones don't
    crowd the cells of small ones; a move meets those of its cells only, by an equi-join. A move then has the list of
    volumes that it is inside, and the state of an entity is the list of its last move.
    """
    levels = [r.level for r in _levelled(subs).select("level").distinct().collect()]  # some tens: exponents of doubles
    cells = _levelled(subs)
    for n in "xyz":
        low, high = (F.floor((F.col("c" + n) + sign * F.col("r")) / F.pow(F.lit(2.0), "level")).cast("long") for sign in (-1, 1))
        cells = cells.withColumn("__" + n, F.explode(F.sequence(low, high)))
    rows = moves.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array(F.lit(0))))
    rows = rows.withColumns({"__" + n: F.floor(F.col(n) / F.pow(F.lit(2.0), "level")).cast("long") for n in "xyz"})
    met = rows.join(cells, ["level", "__x", "__y", "__z"], "left")
    inside = g.in_sphere([F.col(n) for n in "xyz"], [F.col("cx"), F.col("cy"), F.col("cz")], F.col("r"))
    flagged = met.select("entity", "tick", F.when(inside, F.col("sub")).alias("sub"))

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside = set(state.get[0]) if state.exists else set()
        out = []
        rows = pd.concat(list(frames))
        for tick, own in rows.groupby("tick", sort=True):
            now = {int(s) for s in own["sub"].dropna()}
            out += [(s, *key, tick, "leave") for s in sorted(inside - now)] + [(s, *key, tick, "enter") for s in sorted(now - inside)]
            inside = now
        state.update((sorted(inside),))
        yield pd.DataFrame(out, columns=["sub", "entity", "tick", "event"])

    return flagged.groupBy("entity").applyInPandasWithState(walk, EVENTS, "inside array<long>", "append", GroupStateTimeout.NoTimeout)


def _levelled(subs: DataFrame) -> DataFrame:
    """Volumes with the power of two that their diameter doesn't exceed."""
    return subs.withColumn("level", F.ceil(F.log2(F.greatest(2 * F.col("r"), F.lit(1e-6)))).cast("int"))


def rate_limited(updates: DataFrame) -> DataFrame:
    """Of a stream (sub, entity, comp, tier, every, tick, value) what is sent: the first, then one each so many ticks."""

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("tick")
        keep = []
        for tick, every in zip(rows.tick, rows.every):
            go = sent is None or tick - sent >= every
            keep.append(go)
            sent = int(tick) if go else sent
        if sent is not None:
            state.update((int(sent),))
        yield rows[keep]

    return updates.groupBy("sub", "entity", "comp", "tier").applyInPandasWithState(walk, updates.schema, "sent long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding windows of event time; events later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def feed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch, a network tick, to a sink of (DataFrame, batch number); a repeated number is a repeated batch."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
