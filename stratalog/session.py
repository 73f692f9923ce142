"""Sessions for local use, and shipping this package to the workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit every operator here; a session may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("stratalog")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_stratalog_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), "stratalog.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("stratalog") / path.relative_to(root))
    sc.addPyFile(target)
    sc._stratalog_shipped = True


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir) and read back, so its lineage ends there;
    a temporary folder serves local sessions in which none is set."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.gettempdir() + "/stratalog-shared"
    path = f"{where.rstrip('/')}/stratalog/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
