"""Navigation tiles and graphs, generated instances, lanes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numeric import Stream, chain_seed, first_draws

TILE = 1024.0
STEP = 64.0
#: Resident tiles that are sent to all tasks; more are joined by tile.
BROADCAST = 10_000


def tile(*xyz) -> list[Column]:
    return [F.floor(g.col(v) / TILE).cast("long") for v in xyz]


def tiles_in_radius(tiles: DataFrame, r: int, names: Sequence[str] = ("tx", "ty", "tz")) -> DataFrame:
    """All (2 r + 1) ** 3 tiles round each."""
    for n in names:
        tiles = tiles.withColumn(n, F.explode(F.sequence(F.col(n) - r, F.col(n) + r)))
    return tiles.distinct()


def straight_paths(routes: DataFrame, resident: DataFrame, step: float = STEP) -> tuple[DataFrame, DataFrame]:
    """Routes (route, x0, y0, z0, x1, y1, z1) sampled in a straight line over resident tiles (tx, ty, tz).

    Returns the points (route, i, x, y, z) of passable routes, the last one at their end, and the missing tiles that the
    others ask to load (the first one on the way): a route whose ends aren't both resident asks for such an end.

    Few resident tiles (counted first) are sent to every task; more meet the routes by tile, once a visit of a tile. The
    other routes are taken out before points are made, so routes are shuffled and sorted, not their points.
    """
    names = ["tx", "ty", "tz"]
    i, n = F.col("i"), F.col("n")
    d = g.distance([F.col(v) for v in ("x0", "y0", "z0")], [F.col(v) for v in ("x1", "y1", "z1")])

    def sampled(some: DataFrame) -> DataFrame:
        last = F.when(d <= step, 0).otherwise(F.floor(d / step)).cast("int")
        return some.withColumn("n", last).withColumn("i", F.explode(F.sequence(F.lit(0), n + 1)))

    def place(k: Column) -> list[Column]:
        t = F.when(k > n, 1.0).otherwise(k / F.greatest(n, F.lit(1)))
        return [F.col(v + "0") + (F.col(v + "1") - F.col(v + "0")) * t for v in "xyz"]

    entered = (i == 0) | (F.struct(*tile(*place(i))) != F.struct(*tile(*place(i - 1))))
    at = sampled(routes).select("route", "n", "i", *(c.alias(v) for v, c in zip(names, tile(*place(i)))), entered.alias("entered"))
    known = resident.select(*names).distinct()
    few = known.limit(BROADCAST + 1).count() <= BROADCAST
    missing = at.where("entered or i > n").join(F.broadcast(known) if few else known, names, "left_anti")
    # ends are asked for first, then what lies between, in order
    rank = F.struct(F.when(i == 0, 0).when(i > n, 1).otherwise(2).alias("a"), "i")
    wanted = missing.groupBy("route").agg(F.min_by(F.struct(*names), rank).alias("t")).select("route", "t.*")
    passable = routes.join(missing.where("entered").select("route"), "route", "left_anti")
    points = sampled(passable).where("i > 0").select("route", "i", *(c.alias(v) for v, c in zip("xyz", place(i))))
    return points, wanted


def obstacle_patch(nodes: DataFrame, edges: DataFrame, low: Sequence[int], high: Sequence[int], block: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, cx, cy, cz, blocked) whose flag an obstacle flips, and edges (a, b) that touch a node in it.

    A repeated blocking, or freeing of what is free, is empty.
    """
    inside = nodes.where(g.in_box([F.col(c).cast("double") for c in ("cx", "cy", "cz")], low, high))
    flips = inside.where(F.col("blocked") != block).select("node", F.lit(block).alias("blocked"))
    touched = flips.select("node")
    a = edges.join(touched.withColumnRenamed("node", "a"), "a", "left_semi").select("a", "b")
    b = edges.join(touched.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    return flips, a.unionByName(b).distinct()


def patched(nodes: DataFrame, edges: DataFrame, flips: DataFrame, touched: DataFrame, block: bool) -> tuple[DataFrame, DataFrame]:
    new = nodes.join(flips.withColumnRenamed("blocked", "__b"), "node", "left").withColumn("blocked", F.coalesce("__b", "blocked")).drop("__b")
    ties = edges.join(touched, ["a", "b"], "left_anti") if block else edges.unionByName(touched).distinct()
    return new, ties


def linked(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) with a direct edge between nodes that aren't blocked."""
    free = nodes.where("not blocked").select("node")
    out = pairs.join(edges.select("a", "b").distinct(), ["a", "b"], "left_semi")
    for end in "ab":
        out = out.join(free.withColumnRenamed("node", end), end, "left_semi")
    return out.select("a", "b")


def generate(spark: SparkSession, world: int, sector: Sequence[int], count: int, low: Sequence[float], high: Sequence[float], index: int = 0) -> DataFrame:
    """Instances (id, x, y, z) of one seeded stream, three draws each. A stream is a sequence, so one task draws it;
    worlds are many sectors, generated by generate_sectors."""
    seed = chain_seed(world, *sector, index)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream(seed)
        for frame in frames:
            u = np.array([[stream.fix01() / 65536 for _ in range(3)] for _ in range(len(frame))]).reshape(-1, 3)
            yield pd.DataFrame({"id": frame["id"], **{n: low[i] + u[:, i] * (high[i] - low[i]) for i, n in enumerate("xyz")}})

    return spark.range(0, count, 1, 1).mapInPandas(draw, "id long, x double, y double, z double")


def generate_sectors(sectors: DataFrame, count: int, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Instances of many seeded sectors (world, sx, sy, sz), each independent of the others."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seeds = np.array([chain_seed(*map(int, r), 0) for r in frame[["world", "sx", "sy", "sz"]].to_numpy()], np.uint64)
            u = (first_draws(seeds, 3 * count) & np.uint64(0xFFFF)).astype(float).reshape(len(frame) * count, 3) / 65536
            out = frame.loc[frame.index.repeat(count)].reset_index(drop=True)
            out["id"] = np.tile(np.arange(count), len(frame))
            for i, n in enumerate("xyz"):
                out[n] = low[i] + u[:, i] * (high[i] - low[i])
            yield out

    return sectors.select("world", "sx", "sy", "sz").mapInPandas(draw, "world long, sx long, sy long, sz long, id long, x double, y double, z double")


def readback(instances: DataFrame, mask: int) -> DataFrame:
    return instances.where(F.col("id").bitwiseAND(F.lit(mask)) != 0)


def lane_best(rows: DataFrame, a: str, b: str, width: int = 8) -> DataFrame:
    """Lanes of rows (row, ...): sums of a + b by lane, and the lane with the greatest sum, the first of equal ones."""
    lanes = rows.groupBy(F.floor(F.col("row") / width).alias("lane")).agg(F.sum(F.col(a) + F.col(b)).alias("total"))
    return lanes.agg(F.max_by("lane", F.struct("total", -F.col("lane"))).alias("lane"), F.max("total").alias("total"))
