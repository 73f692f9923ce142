"""Change sets: capture, apply, fold, and the byte codecs of their payloads.

A delta is a table (op, tick, seq, entity, comp, value, kind, dst, payload); op is spawn, despawn, update, relate or
unrelate. Captures take rows after (tick, seq), so nothing written in a captured tick is lost; folding keeps the last
write of each key in the last life of its entity, bare entities included.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import temporal

COLUMNS = ("op", "tick", "seq", "entity", "comp", "value", "kind", "dst", "payload")


def shaped(df: DataFrame, op: Column, **given: str) -> DataFrame:
    kinds = {"tick": "long", "seq": "long", "entity": "long", "comp": "string", "value": "double", "kind": "int", "dst": "long", "payload": "double"}
    picked = [F.col(given.get(c, c)) if given.get(c, c) in df.columns else F.lit(None) for c in kinds]
    return df.select(op.alias("op"), *(x.cast(t).alias(c) for x, (c, t) in zip(picked, kinds.items())))


def capture(components: DataFrame, lifecycle: DataFrame, edges: DataFrame, since: int, seq: int | None = None) -> DataFrame:
    """All that happened after a tick, or after a write of it (tick, seq)."""
    after = F.col("tick") > since
    if seq is not None:
        after = after | ((F.col("tick") == since) & (F.col("seq") > seq))
    rows = shaped(lifecycle.where(after), F.when(F.col("spawned"), "spawn").otherwise("despawn"))
    # one row a component: its last value, not each write
    writes = temporal.as_of(components.where(after), None)
    rows = rows.unionByName(shaped(writes, F.lit("update")))
    last = temporal.as_of(edges.where(after), None, ("src", "kind", "dst"), ("payload", "op"))
    return rows.unionByName(shaped(last, F.when(F.col("op") == "add", "relate").otherwise("unrelate"), entity="src"))


def snapshot(state: DataFrame, live: DataFrame, edges: DataFrame) -> DataFrame:
    """A whole state as a delta: spawns, then values, then relations."""
    rows = shaped(live.withColumnsRenamed({"born": "tick", "born_seq": "seq"}), F.lit("spawn"))
    rows = rows.unionByName(shaped(state, F.lit("update")))
    return rows.unionByName(shaped(edges.withColumn("seq", F.lit(0).cast("long")), F.lit("relate"), entity="src"))


def fold(delta: DataFrame) -> DataFrame:
    """The least delta with the same outcome: of each living entity its spawn and last values."""
    order = F.struct("tick", "seq")
    own = delta.where(F.col("op").isin("spawn", "despawn", "update"))
    lives = own.groupBy("entity").agg(F.max(F.when(F.col("op") == "despawn", order)).alias("died"), F.max(F.when(F.col("op") != "despawn", order)).alias("acted"))
    alive = lives.where(F.col("died").isNull() | (F.col("acted") > F.col("died"))).select("entity", "died")
    kept = own.where("op <> 'despawn'").join(alive, "entity").where(F.col("died").isNull() | (order > F.col("died")))
    value = F.max_by(F.struct("value", "tick", "seq"), order).alias("v")
    updates = kept.where("op = 'update'").groupBy("entity", "comp").agg(value).select("entity", "comp", "v.value", "v.tick", "v.seq")
    births = kept.groupBy("entity").agg(F.min(order).alias("t")).select("entity", "t.tick", "t.seq")
    rows = shaped(births, F.lit("spawn")).unionByName(shaped(updates, F.lit("update")))
    ties = delta.where(F.col("op").isin("relate", "unrelate"))
    last = ties.groupBy("entity", "kind", "dst").agg(F.max_by(F.struct("op", "payload", "tick", "seq"), order).alias("v"))
    last = last.select("entity", "kind", "dst", "v.*").where("op = 'relate'")
    for end in ("entity", "dst"):
        gone = lives.join(alive.select("entity"), "entity", "left_anti").select(F.col("entity").alias(end))
        last = last.join(gone, end, "left_anti")
    return rows.unionByName(shaped(last.drop("op"), F.lit("relate")))


def applied(world, delta: DataFrame, tick: int):
    """The world with a delta written to its logs at a tick (its end), in the delta's order."""
    return applied_ticks(world, delta.withColumn("end_tick", F.lit(tick).cast("long")), tick)


def applied_ticks(world, deltas: DataFrame, last: int):
    """The world with the deltas of many ticks (end_tick, up to last) written to its logs: one pass, however many ticks.

    What a spawn of one who lives or the death of one who doesn't would change is nothing, which views see to."""
    at, seq = F.col("end_tick").alias("tick"), (F.col("seq") + F.lit(world.seq)).alias("seq")
    life = deltas.where(F.col("op").isin("spawn", "despawn")).select(at, seq, "entity", F.lit(None).cast("string").alias("prefab"), (F.col("op") == "spawn").alias("spawned"))
    values = deltas.where("op = 'update'").select(at, seq, "entity", "comp", "value")
    ties = deltas.where(F.col("op").isin("relate", "unrelate")).select(at, seq, F.col("entity").alias("src"), "kind", "dst", "payload", F.when(F.col("op") == "relate", "add").otherwise("remove").alias("op"))
    top = deltas.agg(F.max("seq")).first()[0] or 0
    return world.appended(values, life, ties, top + 1).at(last)


# --- codecs: column forms where SQL has them, byte forms for files and the wire ---


def quantize_floats(values: Column) -> Column:
    """An array of floats as a scale and 16-bit numbers."""
    most = F.array_max(F.transform(values, lambda v: F.abs(v.cast("double"))))
    scale = F.when(F.coalesce(most, F.lit(0.0)) > 0, most / 32767).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(values, lambda v: F.round(v.cast("double") / scale).cast("short")).alias("q"))


def restore_floats(packed: Column) -> Column:
    return F.transform(packed["q"], lambda q: q.cast("double") * packed["scale"])


class Codec:
    """Payload codecs by name; each encodes bytes and decodes them given the original size. Bad input raises."""

    @staticmethod
    def raw(data: bytes) -> bytes:
        return data

    @staticmethod
    def unraw(data: bytes, size: int) -> bytes:
        if len(data) != size:
            raise ValueError("raw payload of another size")
        return data

    @staticmethod
    def floats(data: bytes) -> bytes:
        if not data or len(data) % 4:
            raise ValueError("not an array of 32-bit floats")
        v = np.frombuffer(data, "<f4")
        most = np.float32(np.abs(v).max())
        scale = most / np.float32(32767) if most > 0 else np.float32(1)
        q = np.clip(v / scale, -32767, 32767)
        return struct.pack("<f", scale) + (np.sign(q) * np.floor(np.abs(q) + np.float32(0.5))).astype("<i2").tobytes()

    @staticmethod
    def unfloats(data: bytes, size: int) -> bytes:
        if size % 4 or not size or len(data) != 4 + size // 2:
            raise ValueError("quantised payload of another size")
        return (np.frombuffer(data[4:], "<i2").astype("<f4") * np.frombuffer(data[:4], "<f4")[0]).astype("<f4").tobytes()

    @staticmethod
    def runs(data: bytes) -> bytes:
        a = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else np.zeros(1, int)
        return struct.pack("<I", len(edge) - 1) + b"".join(struct.pack("<BI", a[s], e - s) for s, e in zip(edge[:-1], edge[1:]))

    @staticmethod
    def unruns(data: bytes, size: int) -> bytes:
        if len(data) < 4 or len(data) != 4 + 5 * struct.unpack("<I", data[:4])[0]:
            raise ValueError("run-length payload of another size")
        out = b"".join(bytes([v]) * n for v, n in struct.iter_unpack("<BI", data[4:]))
        if len(out) != size:
            raise ValueError("runs don't fill the value")
        return out

    @staticmethod
    def bits(data: bytes) -> bytes:
        if not data:
            raise ValueError("nothing to pack")
        size = next(s for s in (8, 4, 2, 1) if len(data) % s == 0)
        v = np.frombuffer(data, f"<u{size}").astype(np.uint64)
        width = int(v.max()).bit_length()
        flags = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        return struct.pack("<BBI", size, width, len(v)) + np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()

    @staticmethod
    def unbits(data: bytes, size: int) -> bytes:
        if len(data) < 6:
            raise ValueError("packed payload is too short")
        each, width, n = struct.unpack("<BBI", data[:6])
        if each not in (1, 2, 4, 8) or width > 8 * each or n * each != size or len(data) != 6 + (n * width + 7) // 8:
            raise ValueError("packed payload of another size")
        flags = np.unpackbits(np.frombuffer(data[6:], np.uint8), bitorder="little")[: n * width].reshape(n, width).astype(np.uint64)
        return (flags << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(f"<u{each}").tobytes()

    @staticmethod
    def sector(data: bytes) -> bytes:
        if len(data) != 24:
            raise ValueError("not a sector position")
        scale = np.float32(g.SECTOR / 2) / np.float32(32767)
        q = np.clip(np.frombuffer(data[12:], "<f4") / scale, -32767, 32767)
        return data[:12] + struct.pack("<f", scale) + (np.sign(q) * np.floor(np.abs(q) + np.float32(0.5))).astype("<i2").tobytes()

    @staticmethod
    def unsector(data: bytes, size: int) -> bytes:
        if size != 24 or len(data) != 22:
            raise ValueError("not a packed sector position")
        return data[:12] + (np.frombuffer(data[16:], "<i2").astype("<f4") * np.frombuffer(data[12:16], "<f4")[0]).astype("<f4").tobytes()


CODECS = {n: (getattr(Codec, n), getattr(Codec, "un" + n)) for n in ("raw", "floats", "runs", "bits", "sector")}
MAGIC, VERSION = b"SLDT", 1


def serialized(rows: list[tuple[int, int, int, bytes]], base: int, end: int, codecs: dict[int, str] | None = None) -> bytes:
    """Records (op, entity, comp, data) as one payload, values coded by component."""
    out = [MAGIC, struct.pack("<IQQI", VERSION, base, end, len(rows))]
    names = list(CODECS)
    for op, entity, comp, data in rows:
        name = (codecs or {}).get(comp, "raw") if data else "raw"
        coded = CODECS[name][0](data)
        out.append(struct.pack("<BQBBII", op, entity, comp, names.index(name), len(data), len(coded)) + coded)
    return b"".join(out)


def deserialized(data: bytes) -> tuple[int, int, list[tuple[int, int, int, bytes]]]:
    """What serialized() was given; short, overlong or unknown input raises ValueError."""
    head, each = struct.calcsize("<IQQI"), struct.calcsize("<BQBBII")
    if data[:4] != MAGIC or len(data) < 4 + head:
        raise ValueError("no change set")
    version, base, end, n = struct.unpack_from("<IQQI", data, 4)
    if version != VERSION:
        raise ValueError("unknown version")
    at, rows, coders = 4 + head, [], list(CODECS.values())
    for _ in range(n):
        if at + each > len(data):
            raise ValueError("change set ends early")
        op, entity, comp, codec, size, coded = struct.unpack_from("<BQBBII", data, at)
        at += each
        if op > 3 or codec >= len(coders) or at + coded > len(data):
            raise ValueError("broken record")
        rows.append((op, entity, comp, coders[codec][1](data[at : at + coded], size)))
        at += coded
    if at != len(data):
        raise ValueError("change set goes on after its end")
    return base, end, rows
