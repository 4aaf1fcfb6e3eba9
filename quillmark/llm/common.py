"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``. Where that is unset, a session that
    runs on one machine alone (``local`` master, as in tests) gets a temporary
    folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmark-{name}-{uuid.uuid4().hex}"


#: What Spark sizes above this is not broadcast by plans that settle() writes.
#: It sizes a table by its files and knows nothing of what an explode adds or
#: Parquet packs, so a table may be fifty times as large in the driver.
BROADCAST_BYTES = 256 << 10


@contextlib.contextmanager
def broadcasts_bounded(spark: SparkSession):
    """Within it, joins without a hint broadcast up to BROADCAST_BYTES only."""
    static = "spark.sql.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (static, "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    most = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), BROADCAST_BYTES)
    for name in before:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides and broadcasts neither, whatever
    Spark takes their sizes to be."""
    return df.hint("merge")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage,
    computes df once, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    with broadcasts_bounded(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, Spark deletes a query's shuffle files as soon as it ends, and
    not whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def salted_hash(seed: int, *cols):
    return F.xxhash64(F.lit(seed), *cols)


#: How to forget what functions of this process remember between tasks, and
#: whose tasks ran last.
_FORGET: list[Callable[[], None]] = []
_LAST: list[str] = []


def remembered(forget: Callable[[], None]) -> None:
    """forget is called when a Python worker goes over to tasks of another
    operator: Spark keeps its workers, so they would hold both operators'
    remembered words."""
    _FORGET.append(forget)


def begin_tasks_of(operator: str) -> None:
    if _LAST and _LAST[0] != operator:
        for forget in _FORGET:
            forget()
    _LAST[:] = [operator]


def give_back() -> None:
    """Hands freed memory back to the machine; an idle worker keeps little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    operator = run.__module__

    def task(batches):
        begin_tasks_of(operator)
        yield from run(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)
