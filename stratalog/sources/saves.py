"""Saved worlds, logs laid out for pruning, replays, and compaction; all Parquet.

A save is a folder: base/ holds the logs as captured, delta/ those appended since, and clock/ one row. Logs are written
in order of (tick, seq) within files, so row groups' statistics let a scan skip what its ticks exclude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..world import COMPONENTS, EDGES, LIFECYCLE, World

LOGS = {"components": COMPONENTS, "lifecycle": LIFECYCLE, "edges": EDGES}


def write_log(log: DataFrame, path: str, bucket: int = 1000, mode: str = "append") -> None:
    """A log partitioned by ranges of ticks and sorted within files."""
    rows = log.withColumn("tick_bucket", F.floor(F.col("tick") / bucket))
    # by ranges, so that one bucket is several tasks' and files' work
    rows.repartitionByRange("tick_bucket", "tick", "seq").sortWithinPartitions("tick_bucket", "tick", "seq").write.mode(mode).partitionBy("tick_bucket").parquet(path)


def read_log(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, bucket: int = 1000) -> DataFrame:
    """The log, of a range of ticks if given: by partition, then by row group."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where((F.col("tick_bucket") >= first // bucket) & (F.col("tick") >= first))
    if last is not None:
        rows = rows.where((F.col("tick_bucket") <= last // bucket) & (F.col("tick") <= last))
    return rows.drop("tick_bucket")


def _clock(world: World, path: str) -> None:
    world.components.sparkSession.createDataFrame([(world.tick, world.seq)], "tick long, seq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/clock")


def save_world(world: World, path: str) -> None:
    for name, log in zip(LOGS, (world.components, world.lifecycle, world.edges)):
        log.sortWithinPartitions("tick", "seq").write.mode("overwrite").parquet(f"{path}/base/{name}")
        log.limit(0).write.mode("overwrite").parquet(f"{path}/delta/{name}")
    _clock(world, path)


def save_incremental(world: World, path: str) -> None:
    """Append what was written since the save's clock."""
    spark = world.components.sparkSession
    seq = spark.read.parquet(f"{path}/clock").first().seq
    for name, log in zip(LOGS, (world.components, world.lifecycle, world.edges)):
        log.where(F.col("seq") >= seq).write.mode("append").parquet(f"{path}/delta/{name}")
    _clock(world, path)


def load_world(spark: SparkSession, path: str) -> World:
    logs = [spark.read.schema(s).parquet(f"{path}/base/{n}", f"{path}/delta/{n}") for n, s in LOGS.items()]
    clock = spark.read.parquet(f"{path}/clock").first()
    return World(*logs, clock.tick, clock.seq)


def compact(world: World) -> World:
    """The same present state from the least logs."""
    whole = delta.capture(world.components, world.lifecycle, world.edges, -1)
    # captures keep last values only; births need all spawns, and a later life none of the earlier one's values
    life = delta.shaped(world.lifecycle, F.when(F.col("spawned"), "spawn").otherwise("despawn"))
    rows = delta.fold(whole.where(~F.col("op").isin("spawn", "despawn")).unionByName(life))
    comps = rows.where("op = 'update'").select("tick", "seq", "entity", "comp", "value")
    births = rows.where("op = 'spawn'").select("tick", "seq", "entity").join(world.live().select("entity", "prefab"), "entity")
    births = births.select("tick", "seq", "entity", "prefab", F.lit(True).alias("spawned"))
    ties = rows.where("op = 'relate'").select("tick", "seq", F.col("entity").alias("src"), "kind", "dst", "payload", F.lit("add").alias("op"))
    return World(comps, births, ties, world.tick, world.seq)


def record(rows: DataFrame, path: str, end: int) -> None:
    """Append one tick's delta to a replay."""
    rows.withColumn("end_tick", F.lit(end).cast("long")).write.mode("append").partitionBy("end_tick").parquet(path)


def replayed(spark: SparkSession, path: str, world: World, upto: int | None = None) -> World:
    """A world with a replay's deltas applied, each at its end tick, all in one pass."""
    rows = spark.read.parquet(path)
    rows = rows if upto is None else rows.where(F.col("end_tick") <= upto)
    last = rows.agg(F.max("end_tick")).first()[0]
    return world if last is None else delta.applied_ticks(world, rows.withColumn("end_tick", F.col("end_tick").cast("long")), last)


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """CSV, JSON, Parquet, ORC or text by Spark's own readers."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
