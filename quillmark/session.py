"""Session settings that the engine's plans count on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quillmark", master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once per context: they
    may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillmark-"), "quillmark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillmark", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._quillmark_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer tasks than there are cores
    (one row group makes one task); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def map_pandas(df: DataFrame, run, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)
