"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Tables stored in the innermost open scope, which drops them at its end; None outside of any.
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Writes the rows once as Parquet in the shared folder, partitioned by columns if asked, and reads them back.

    Later jobs start from the files: a lost executor costs a re-read, not a recomputation. The files stay until the
    scope (scratch) that they were stored in ends; without one, until the folder's owner clears it, as the returned
    rows are read lazily.
    """
    return stored_at(df, label, *partition_by)[0]


def stored_at(df: DataFrame, label: str, *partition_by: str) -> tuple[DataFrame, str]:
    """As stored, with the path, for drop_path as soon as nothing reads the table any more."""
    spark = df.sparkSession
    path, mine = new_path(spark, label), _scope.get()
    if mine is not None:
        mine.append((spark, path))
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns), path


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """A scope whose stored tables are dropped at its end, whether it ends well or not.

    Gives a function like stored for what outlives the scope: its tables belong to the scope around this one, or to
    the folder's owner. Rows that leave a scope must have been stored by it, as they can't read a dropped table.
    """
    outer, mine = _scope.get(), []

    def leave(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
        within = _scope.set(outer)
        try:
            return stored(df, label, *partition_by)
        finally:
            _scope.reset(within)

    token = _scope.set(mine)
    try:
        yield leave
    finally:
        _scope.reset(token)
        for spark, path in mine:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark's cleaner delete shuffle files that no reachable DataFrame needs, rather than at some later collection."""
    for _ in range(4):  # what one collection finds, the next can free; late listeners may hold the last query for a second or two
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
