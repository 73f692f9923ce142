"""Column expressions over points, boxes, volumes and rays; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence  # of two or three numbers or columns


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def squared(a: Point, b: Point) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b):
        d = col(x) - col(y)
        total = total + d * d
    return total


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(squared(a, b))


def in_box(p: Point, low: Point, high: Point) -> Column:
    """Closed on every side."""
    test = F.lit(True)
    for x, a, b in zip(p, low, high):
        test = test & (col(x) >= col(a)) & (col(x) <= col(b))
    return test


def boxes_meet(low_a: Point, high_a: Point, low_b: Point, high_b: Point) -> Column:
    test = F.lit(True)
    for a, b, c, d in zip(low_a, high_a, low_b, high_b):
        test = test & (col(a) <= col(d)) & (col(b) >= col(c))
    return test


def near_box(p: Point, center: Point, r) -> Column:
    """The cube of half side r round the center: what the index of the language's NEAR returns."""
    return in_box(p, [col(c) - col(r) for c in center], [col(c) + col(r) for c in center])


def in_sphere(p: Point, center: Point, r) -> Column:
    return squared(p, center) <= col(r) * col(r)


def cell(x, size: float) -> Column:
    """The place on a uniform grid; a size that isn't positive means 10."""
    return F.floor(col(x) / F.lit(float(size if size > 0 else 10.0)))


@dataclass(frozen=True)
class Volume:
    """A sphere (center, r), a box (center = low corner, high) or a camera's frustum (center = eye)."""

    shape: str
    center: tuple[float, float, float]
    r: float = 10.0
    high: tuple[float, float, float] = (0.0, 0.0, 0.0)
    forward: tuple[float, float, float] = (0.0, 0.0, -1.0)
    up: tuple[float, float, float] = (0.0, 1.0, 0.0)
    near: float = 0.1
    far: float = 1000.0
    hfov: float = 1.0472
    vfov: float = 0.7854

    def contains(self, p: Point) -> Column:
        if self.shape == "sphere":
            return in_sphere(p, self.center, self.r)
        if self.shape == "box":
            return in_box(p, self.center, self.high)
        if self.shape != "frustum":
            raise ValueError(f"unknown shape {self.shape}")
        f, right = self.forward, cross(self.forward, self.up)
        length = math.sqrt(sum(x * x for x in right)) + 1e-9
        right = tuple(x / length for x in right)
        top = cross(right, f)
        v = [col(x) - F.lit(c) for x, c in zip(p, self.center)]
        along = lambda axis: v[0] * axis[0] + v[1] * axis[1] + v[2] * axis[2]
        depth = along(f)
        inside = (F.abs(along(right)) <= depth * math.tan(self.hfov / 2)) & (F.abs(along(top)) <= depth * math.tan(self.vfov / 2))
        return depth.between(self.near, self.far) & inside

    def bounding_sphere(self) -> tuple[tuple[float, float, float], float]:
        if self.shape == "sphere":
            return self.center, self.r
        if self.shape == "box":
            return tuple((a + b) / 2 for a, b in zip(self.center, self.high)), math.dist(self.center, self.high) / 2
        half = (self.far - self.near) / 2
        widest = max(math.tan(self.hfov / 2), math.tan(self.vfov / 2))
        return tuple(c + f * (self.near + half) for c, f in zip(self.center, self.forward)), self.far * widest + half


def cross(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float]:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def ray_sphere(origin: Sequence[float], direction: Sequence[float], center: Point, r) -> Column:
    """Distance at which the ray enters the sphere; -1: behind, missed, or the origin is inside.
    Directions are normalised here."""
    size = math.sqrt(sum(d * d for d in direction))
    unit = [d / size for d in direction]
    oc = [col(c) - F.lit(float(o)) for c, o in zip(center, origin)]
    along = oc[0] * unit[0] + oc[1] * unit[1] + oc[2] * unit[2]
    off = squared(oc, [0, 0, 0]) - along * along
    enters = along - F.sqrt(col(r) * col(r) - off)
    hit = (along >= 0) & (off <= col(r) * col(r))
    return F.when(hit & (enters >= 0), enters).otherwise(F.lit(-1.0))


def ray_box(origin: Sequence[float], direction: Sequence[float], low: Point, high: Point) -> Column:
    """Slab test: distance at which the ray meets the box, 0 from inside, -1: missed."""
    first, last, beside = [F.lit(0.0)], [F.lit(math.inf)], F.lit(False)
    for o, d, a, b in zip(origin, direction, low, high):
        if d == 0:  # along a slab: inside it all the way, or never
            beside = beside | (col(a) > F.lit(float(o))) | (col(b) < F.lit(float(o)))
            continue
        s, t = ((col(x) - F.lit(float(o))) / float(d) for x in (a, b))
        first.append(F.least(s, t))
        last.append(F.greatest(s, t))
    enter = F.greatest(*first) if len(first) > 1 else first[0]
    leave = F.least(*last) if len(last) > 1 else last[0]
    return F.when((enter <= leave) & ~beside, enter).otherwise(F.lit(-1.0))


def sees(eye: Point, forward: Point, target: Point, reach, cos_half) -> Column:
    """Vision cone; a target at the eye is seen."""
    d = [col(t) - col(e) for t, e in zip(target, eye)]
    squares = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    dot = d[0] * col(forward[0]) + d[1] * col(forward[1]) + d[2] * col(forward[2])
    return (squares <= col(reach) * col(reach)) & ((squares == 0) | (dot >= col(cos_half) * F.sqrt(squares)))


def hears(ear: Point, radius, source: Point, loudness) -> Column:
    return squared(ear, source) <= (col(radius) * col(loudness)) * (col(radius) * col(loudness))


SECTOR = 1024.0


def sector_of(*xyz) -> Column:
    """World coordinates as integer sectors and offsets in [-512, 512)."""
    names = "xyz"[: len(xyz)]
    sectors = [F.floor((col(v) + SECTOR / 2) / SECTOR).cast("int") for v in xyz]
    offsets = [(col(v) - s * SECTOR).alias("o" + n) for v, s, n in zip(xyz, sectors, names)]
    return F.struct(*(s.alias("s" + n) for s, n in zip(sectors, names)), *offsets)


def sector_world(p: Column, origin: Sequence[int] = (0, 0, 0)) -> Column:
    """World coordinates, or those relative to a sector."""
    return F.struct(*(((p["s" + n] - o) * SECTOR + p["o" + n]).alias(n) for n, o in zip("xyz", origin)))


def sector_delta(a: Column, b: Column) -> Column:
    return F.struct(*((b[k + n] - a[k + n]).alias("d" + k + n) for k in "so" for n in "xyz"))


def sector_squared(a: Column, b: Column) -> Column:
    total = F.lit(0.0)
    for n in "xyz":
        d = (a["s" + n].cast("double") - b["s" + n]) * SECTOR + (a["o" + n] - b["o" + n])
        total = total + d * d
    return total
