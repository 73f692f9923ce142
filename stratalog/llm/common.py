"""Shared helpers of the corpus operators: row keys, written tables, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Rows and bytes that Spark hands to a Python worker at once; texts may be long.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Give the workers this package and keep Arrow batches small, by rows and by bytes. Spark reads these two settings when
    a plan runs, so they are the session's; smaller ones stay, and no result depends on them."""
    session.ship(spark)
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = "spark.sql.execution.arrow." + key
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return spark


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library frees as it likes
        return lambda _: 0


def trimmed() -> None:
    """Give memory that large arrays have left back to the system: workers are reused and share an executor."""
    _trim()(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.gettempdir() + "/stratalog-shared"
    return where.rstrip("/") + "/stratalog"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame | str) -> None:
    """Delete the files of a table made by written(), or a folder of new_path(), that nothing reads any more."""
    for name in [df] if isinstance(df, str) else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stratalog/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that tell rows of different id or text apart, null ids included."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("__k1"), F.xxhash64(text).alias("__k2")]


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with so many more underscores that no column is called so."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in columns}:
            name = "_" + name
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges as rows (node, root), root the smallest node of the component.

    Alternates the large-star and small-star steps until all edges lead straight to roots; each is an aggregation with a
    map-side combine and a join, and each result is written to the shared folder. Edges that are stars already, as those
    to the leaders of groups mostly are, take few rounds. Nodes without edges do not appear; self-loops are ignored. An
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # stars: every node has one edge to a smaller one, or is what others lead to
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionAll(now.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or n = 1 and low = 0").isEmpty():
            break
        # large star: every larger neighbour of a node goes to the smallest one of its neighbourhood
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and itself, go to its smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        dropped(spark, now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
