"""Fixed-point numbers, quantisation, utility curves and kernels as column expressions; seeded streams as Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 65536
PI, TAU, HALF_PI = 205887, 411775, 102943
MOST = 2**31 - 1
MASK = (1 << 64) - 1


def wrapped(x: Column) -> Column:
    """The low 32 bits of a bigint as a signed number."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low > MOST, low - (1 << 32)).otherwise(low)


def fix(x: Column) -> Column:
    """A number as Q16.16, truncated towards zero."""
    return wrapped((x.cast("double") * ONE).cast("bigint"))


def fix_value(raw: Column) -> Column:
    return raw.cast("double") / ONE


def fix_add(a: Column, b: Column) -> Column:
    return wrapped(a.cast("bigint") + b)


def fix_sub(a: Column, b: Column) -> Column:
    return wrapped(a.cast("bigint") - b)


def fix_mul(a: Column, b: Column) -> Column:
    return wrapped(F.shiftright(a.cast("bigint") * b + (ONE >> 1), 16))


def fix_div(a: Column, b: Column) -> Column:
    """Truncating; by zero: the greatest number."""
    n, d = F.shiftleft(a.cast("bigint"), 16), b.cast("bigint")
    return F.when(d == 0, F.lit(MOST).cast("bigint")).otherwise(wrapped(F.call_function("div", n, F.nullif(d, F.lit(0)))))


def fix_abs(a: Column) -> Column:
    return wrapped(F.abs(a.cast("bigint")))


def fix_sqrt(a: Column) -> Column:
    """Integer square root of raw << 16."""
    v = F.shiftleft(F.greatest(a.cast("bigint"), F.lit(0)), 16)
    r = F.floor(F.sqrt(v.cast("double"))).cast("bigint")
    r = F.when(r * r > v, r - 1).otherwise(r)
    return F.when((r + 1) * (r + 1) <= v, r + 1).otherwise(r)


SINES = [math.floor(math.sin(math.pi / 2 * i / 1024) * ONE + 0.5) for i in range(1025)]


def fix_sin(a: Column) -> Column:
    """By table and integer interpolation, as all replicas must."""
    n = a.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)) % TAU
    quarter = F.floor(n / HALF_PI)
    rest = F.when(quarter == 0, n).when(quarter == 1, 2 * HALF_PI - n).when(quarter == 2, n - 2 * HALF_PI).otherwise(TAU - n)
    table = F.array(*(F.lit(x).cast("bigint") for x in SINES))
    at = F.floor(rest * 1024 / HALF_PI).cast("int")
    part = F.floor(F.shiftleft((rest * 1024) % HALF_PI, 16) / HALF_PI)
    low, high = F.get(table, at), F.get(table, at + 1)
    value = F.when(at >= 1024, F.lit(SINES[-1]).cast("bigint")).otherwise(F.shiftright(low * (ONE - part) + high * part, 16))
    return F.when(quarter <= 1, value).otherwise(-value)


def fix_cos(a: Column) -> Column:
    return fix_sin(fix_add(a, F.lit(HALF_PI)))


def quantized(v: Column, step: Column | float) -> Column:
    """To the nearest multiple of step, halves away from zero; a step that isn't positive leaves v."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.when(step > 0, F.round(v / step) * step).otherwise(v)


def curve(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear and level beyond the ends; no points: 0."""
    if not points:
        return F.lit(0.0)
    out = F.when(x <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        slope = (y1 - y0) / (x1 - x0) if x1 != x0 else 0.0
        out = out.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope))
    return out.otherwise(float(points[-1][1]))


def utility(values: dict[str, Column], curves: dict[str, tuple[Sequence[tuple[float, float]], float]]) -> Column:
    """Sum of weighted curves; a key without a value, or whose value is null, adds nothing."""
    total = F.lit(0.0)
    for key, (points, weight) in curves.items():
        if key in values:
            total = total + F.coalesce(curve(values[key], points) * F.lit(float(weight)), F.lit(0.0))
    return total


def kernel(x: Column, ops: Sequence[tuple]) -> Column:
    """A chain of ("add", c), ("mul", c), ("lerp", to, t), ("clamp", low, high), ("scale", c)."""
    for name, *args in ops:
        a = [v if isinstance(v, Column) else F.lit(float(v)) for v in args]
        if name == "add":
            x = x + a[0]
        elif name in ("mul", "scale"):
            x = x * a[0]
        elif name == "lerp":
            x = x + (a[0] - x) * a[1]
        elif name == "clamp":
            x = F.least(F.greatest(x, a[0]), a[1])
        else:
            raise ValueError(f"unknown operation {name}")
    return x


def lod_tier(d: Column, limits: Sequence[float]) -> Column:
    """Place of the first limit at or beyond d; without limits 0, past the last null."""
    if not limits:
        return F.lit(0)
    out = None
    for i, limit in enumerate(limits[:3]):
        out = F.when(d <= limit, i) if out is None else out.when(d <= limit, i)
    return out


# --- seeded streams: 64-bit arithmetic that wraps, which SQL bigints don't under ANSI rules ---


def fnv32(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def fnv64(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) & MASK
    return h


class Stream:
    """xorshift64*; equal seeds give equal sequences on any machine."""

    def __init__(self, seed: int):
        self.state = seed & MASK or 1

    def u64(self) -> int:
        x = self.state
        x ^= (x << 13) & MASK
        x ^= x >> 7
        x ^= (x << 17) & MASK
        self.state = x
        return (x * 0x2545F4914F6CDD1D) & MASK

    def u32(self) -> int:
        return self.u64() >> 32

    def between(self, low: int, high: int) -> int:
        return low + self.u32() % (high - low + 1)

    def fix01(self) -> int:
        return self.u32() & 0xFFFF


FACTORS = (0x9E3779B97F4A7C15, 0xC6A4A7935BD1E995, 0xBF58476D1CE4E5B9, 0x9E3779B9)


def chain_seed(world: int, x: int, y: int, z: int, index: int) -> int:
    h = world & MASK
    for v, f in zip((x, y, z, index), FACTORS):
        h ^= ((v & MASK) * f) & MASK
    return h


def child_seed(seed: int, child: int) -> int:
    return seed ^ (((child + 1) * FACTORS[0]) & MASK)


def chain_seeds(world: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, index: np.ndarray) -> np.ndarray:
    """chain_seed of many; all arguments int64."""
    h = world.astype(np.uint64)
    for v, f in zip((x, y, z, index), FACTORS):
        h = h ^ (v.astype(np.int64).view(np.uint64) * np.uint64(f))
    return h


def first_draws(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first n 32-bit draws of each seed's stream, a column a draw."""
    x = np.where(seeds == 0, np.uint64(1), seeds)
    out = np.empty((len(seeds), n), np.uint64)
    for i in range(n):
        x = x ^ (x << np.uint64(13))
        x = x ^ (x >> np.uint64(7))
        x = x ^ (x << np.uint64(17))
        out[:, i] = (x * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)
    return out
