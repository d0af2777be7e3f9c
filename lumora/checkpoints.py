"""Where lineage is cut: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own, but only if driver and executors are one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.lumora.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="lumora-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        root = "file://" + own
        spark.conf.set("spark.lumora.checkpoint.dir", root)
    return root.rstrip("/")


#: The tables written by scratch() blocks that are open, innermost last; each thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; lost executors cost only later stages."""
    path = f"{shared_root(df.sparkSession)}/lumora/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open.get():
        _open.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written within: for a block whose result is itself stored elsewhere by then."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        removed(spark, paths)
