"""Tables written to the shared folder of the cluster to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_OPENED: ContextVar[list[str] | None] = ContextVar("opened", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by the session.

    Only a local session without the setting gets a folder of its own; a
    cluster must name one that all executors can reach.
    """
    context = spark.sparkContext
    root = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gradeloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = f"{shared_dir(spark)}/gradeloom/{uuid.uuid4().hex}"
    opened = _OPENED.get()
    if opened is not None:
        opened.append(folder)
    return f"{folder}/{name}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside at the end; results have to be written or collected by then."""
    token = _OPENED.set([])
    try:
        yield
    finally:
        for folder in _OPENED.get() or ():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _OPENED.reset(token)


def stage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return the written table.

    Unlike a cached frame it outlives the executors, later reads prune its
    columns, and Spark knows its size when it chooses a join.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)
