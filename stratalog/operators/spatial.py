"""Range, ray and nearest-neighbour queries over positions (entity, x, y, z).

A join of two point sets within a radius puts both on a grid of cells as wide as the radius. Each point of the side with
fewer rows per cell goes to the cells that its sphere touches, at most 27, and the join is an equi-join on cells, so it is
hashed, spilled and split when skewed like any other, where the plain condition would make a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

XYZ = ("x", "y", "z")


def axes(names: Sequence[str] = XYZ, side: str | None = None) -> list[Column]:
    return [F.col(f"{side}.{n}" if side else n) for n in names]


def in_range(points: DataFrame, center: Sequence[float], r: float, exact: bool = False, names: Sequence[str] = XYZ) -> DataFrame:
    """Points in the cube of half side r, or for exact, in the sphere. The cube's bounds reach the scan either way."""
    found = points.where(g.near_box(axes(names), center, r))
    return found.where(g.in_sphere(axes(names), center, r)) if exact else found


def with_cells(points: DataFrame, size: float, names: Sequence[str] = XYZ) -> DataFrame:
    return points.withColumns({"c" + n: g.cell(F.col(n), size).cast("long") for n in names})


def grid_candidates(points: DataFrame, center: Sequence[float], r: float, size: float, names: Sequence[str] = XYZ) -> DataFrame:
    """All points of the cells that the range touches, before any exact test."""
    size = size if size > 0 else 10.0
    rows = with_cells(points, size, names)
    for n, c in zip(names, center):
        rows = rows.where(F.col("c" + n).between(int((c - r) // size), int((c + r) // size)))
    return rows


def join_within(left: DataFrame, right: DataFrame, r: float, on: Column | None = None, names: Sequence[str] = XYZ) -> DataFrame:
    """Pairs of left and right points at most r apart, as structs l and r with their distance d."""
    size = r if r > 0 else 1.0
    ls = left.select(F.struct(*left.columns).alias("l"), *(g.cell(F.col(n), size).cast("long").alias("__" + n) for n in names))
    rs = right.select(F.struct(*right.columns).alias("r"), *(g.cell(F.col(n), size).cast("long").alias("__" + n) for n in names))
    for n in names:
        rs = rs.withColumn("__" + n, F.explode(F.sequence(F.col("__" + n) - 1, F.col("__" + n) + 1)))
    d = g.distance(axes(names, "l"), axes(names, "r"))
    pairs = ls.join(rs, ["__" + n for n in names]).select("l", "r", d.alias("d")).where(F.col("d") <= r)
    return pairs if on is None else pairs.where(on)


def sector_range(points: DataFrame, center: Sequence[float], r: float) -> DataFrame:
    """Exact sphere over sectors: points hold a column p made by geometry.sector_of."""
    reach = int(-(-r // g.SECTOR))
    at = [int((c + g.SECTOR / 2) // g.SECTOR) for c in center]
    rows = points
    for n, s in zip(XYZ, at):
        rows = rows.where(F.col(f"p.s{n}").between(s - reach, s + reach))
    here = g.sector_of(*(F.lit(float(c)) for c in center))
    return rows.where(g.sector_squared(F.col("p"), here) <= r * r)


def raycast(points: DataFrame, origin: Sequence[float], direction: Sequence[float], r: float, most: float = 0.0, names: Sequence[str] = XYZ) -> DataFrame:
    """The first sphere of radius r round a point that the ray enters, ties to the least entity; most <= 0: no limit."""
    hit = g.ray_sphere(origin, direction, axes(names), r)
    rows = points.withColumn("distance", hit).where(F.col("distance") >= 0)
    if most > 0:
        rows = rows.where(F.col("distance") <= most)
    return rows.orderBy("distance", "entity").limit(1)


def raycast_all(points: DataFrame, rays: DataFrame, r: float, most: float) -> DataFrame:
    """The first hit of each ray (ray, ox, oy, oz, dx, dy, dz; unit directions), at most so far away.

    A ray is cut to steps of the sphere's diameter; each step looks in its cells only, so this is an equi-join too.
    """
    size = 2 * r
    n = int(most / size) + 2
    steps = rays.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(n))))
    at = {a: F.floor((F.col("o" + a) + F.col("d" + a) * F.col("__t") * size) / size).cast("long") for a in XYZ}
    cells = steps.select(*rays.columns, *(at[a].alias("__" + a) for a in XYZ))
    for a in XYZ:
        cells = cells.withColumn("__" + a, F.explode(F.sequence(F.col("__" + a) - 1, F.col("__" + a) + 1)))
    cells = cells.distinct()
    grid = points.select("entity", *XYZ, *(g.cell(F.col(a), size).cast("long").alias("__" + a) for a in XYZ))
    oc = [F.col(a) - F.col("o" + a) for a in XYZ]
    along = sum((x * F.col("d" + a) for x, a in zip(oc, XYZ)), F.lit(0.0))
    off = sum((x * x for x in oc), F.lit(0.0)) - along * along
    enter = along - F.sqrt(F.lit(r * r) - off)
    hits = grid.join(cells, ["__" + a for a in XYZ]).where((along >= 0) & (off <= r * r)).select("ray", "entity", enter.alias("distance"))
    hits = hits.where((F.col("distance") >= 0) & (F.col("distance") <= most))
    best = F.min(F.struct("distance", "entity")).alias("b")
    return hits.groupBy("ray").agg(best).select("ray", "b.entity", "b.distance")


def in_volume(points: DataFrame, volume: g.Volume, names: Sequence[str] = XYZ) -> DataFrame:
    """Two steps: the bounding sphere's box, which a scan can prune by, then the shape itself."""
    center, r = volume.bounding_sphere()
    return points.where(g.near_box(axes(names), center, r)).where(volume.contains(axes(names)))


def neighbour_pairs(points: DataFrame, r: float) -> DataFrame:
    """Pairs a < b of entities at most r apart: the broad phase of collisions."""
    pairs = join_within(points, points, r, F.col("l.entity") < F.col("r.entity"))
    return pairs.select(F.col("l.entity").alias("a"), F.col("r.entity").alias("b"), "d")
