"""Explaining, profiling, comparing replicas, tiers, state checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 256


def archetypes(wide: DataFrame) -> DataFrame:
    return wide.groupBy("signature").agg(F.count("*").alias("entities"))


def explain(wide: DataFrame, mask: int) -> DataFrame:
    """One row: matched archetypes, entities, cost, and whether a query for a mask is slow (nothing found, over four
    archetypes, or a cost over 10000)."""
    matched = archetypes(wide.where(F.col("signature").bitwiseAND(F.lit(mask)) == mask))
    row = matched.agg(F.count("*").alias("archetypes"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.count_if(F.col("entities").between(1, 3)).alias("sparse"))
    cost = F.col("entities") * F.col("archetypes")
    return row.withColumn("cost", cost).withColumn("slow", (F.col("entities") == 0) | (F.col("archetypes") > 4) | (cost > 10_000))


def occupancy(count: Column) -> Column:
    full, rest = F.floor(count / PAGE), count % PAGE
    return F.when(count == 0, 0.0).when(rest == 0, 1.0).otherwise((full + rest / PAGE) / (full + 1))


def lines(stride: Column) -> Column:
    return (stride + 63) / 64


def efficiency(stride: Column) -> Column:
    return F.when(lines(stride) <= 1, 1.0).otherwise(1 / lines(stride))


def profile(counts: DataFrame, strides: DataFrame) -> DataFrame:
    """One row over archetypes (signature, entities) and component strides (comp, stride): mean occupancy, mean lines a
    row, sparse archetypes and the health score."""
    a = counts.agg(F.count("*").alias("n"), F.count_if(F.col("entities").between(1, 7)).alias("sparse"), F.avg(occupancy(F.col("entities"))).alias("occupancy"))
    s = strides.agg(F.avg(lines(F.col("stride"))).alias("lines"), F.avg(efficiency(F.col("stride"))).alias("efficiency"))
    health = (1 - F.coalesce(F.col("sparse") / F.col("n"), F.lit(0.0))) * 60 + F.when(F.col("lines") <= 1, 40.0).otherwise(40 / F.col("lines"))
    return a.join(F.broadcast(s)).withColumn("health", health)


def checksum(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), portable: bool = False) -> DataFrame:
    """Count and xor of row hashes: the same for equal contents in any order, and combined before the shuffle.

    portable: 60 bits of the MD5 of the values' texts, which other engines compute too; else Spark's faster xxhash64."""
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    one = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long") if portable else F.xxhash64(*columns)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(one).alias("hash"))


def states_equal(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    return checksum(a, columns).first() == checksum(b, columns).first()


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Writes (tick, seq, system, entity, comp, value) on which two replicas differ, with both values."""
    key = ["tick", "seq", "entity", "comp"]
    both = a.withColumnRenamed("value", "va").join(b.select(*key, F.col("value").alias("vb")), key, "full_outer")
    return both.where(~F.col("va").eqNullSafe(F.col("vb")))


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    return divergence(a, b).agg(F.min("tick").alias("tick"))


def causes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Divergent writes with the (tick, seq) of the latest earlier divergent write of their input on the same entity.

    Writes stand under their own component and, as questions, under their input: one sort by (entity, component)."""
    bad = divergence(a, b).select("tick", "seq", "entity", "comp", "system", "input")
    asks = bad.select(F.col("input").alias("of"), F.lit(0).alias("kind"), "*")
    rows = asks.unionAll(bad.select(F.col("comp").alias("of"), F.lit(1).alias("kind"), "*"))
    upto = Window.partitionBy("entity", "of").orderBy("tick", "seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("from", F.max(F.when(F.col("kind") == 1, F.struct("tick", "seq"))).over(upto))
    return found.where("kind = 0").select("tick", "seq", "entity", "comp", "system", "input", F.when(F.col("input").isNotNull(), F.col("from")).alias("from"))


def trace(a: DataFrame, b: DataFrame, hops: int = 64) -> list[tuple[str, int, int, str]]:
    """From the latest divergent write back along inputs: (system, tick, entity, comp), the root cause last.

    Writes name their input component. The chain is followed in the table of causes, one lookup a hop, at most so many.
    """
    linked = causes(a, b).cache()
    out, row = [], linked.orderBy(F.desc("tick"), F.desc("seq"), "entity").limit(1).collect()
    while row and len(out) < hops:
        r = row[0]
        out.append((r.system, r.tick, r.entity, r.comp))
        if r["from"] is None:
            break
        row = linked.where((F.col("entity") == r.entity) & (F.col("comp") == r.input) & (F.col("tick") == r["from"].tick) & (F.col("seq") == r["from"].seq)).limit(1).collect()
    linked.unpersist()
    return out


def tiers(accesses: DataFrame, hot: int = 64, cold: int = 8) -> DataFrame:
    """(comp, accesses) with a tier; hot wins."""
    n = F.col("accesses")
    return accesses.withColumn("tier", F.when(n >= hot, "HOT").when(n <= cold, "COLD").otherwise("WARM"))


def decayed(log: DataFrame, now: int) -> DataFrame:
    """Access counters that halve each tick, from writes: (comp, accesses)."""
    return log.where(F.col("tick") <= now).groupBy("comp", "tick").agg(F.count("*").alias("n")).groupBy("comp").agg(F.sum(F.col("n") * F.pow(F.lit(0.5), F.lit(now) - F.col("tick"))).alias("accesses"))


def dirty_pages(rows: DataFrame, size: int) -> DataFrame:
    """Pages of 256 rows that hold a changed row, and the bytes to send."""
    return rows.select(F.floor(F.col("row") / PAGE).alias("page")).distinct().agg(F.count("*").alias("pages"), (F.count("*") * PAGE * size).alias("bytes"))


def run_lengths(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order: keys, value, first and last order, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    rows = series.withColumn("__run", change).withColumn("__run", F.sum("__run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__run")
