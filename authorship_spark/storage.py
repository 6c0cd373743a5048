"""Intermediate tables in the folder that all executors share, each job's in a scope of its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the job that is running here; without one, what is stored belongs to the application.
_job: ContextVar[str | None] = ContextVar("job", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local session may lack the setting; it then gets a folder of its own,
    which goes when Python ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if at:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(at)
        return at
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def _application(spark: SparkSession) -> str:
    """This application's folder; it goes with the application, whether or not anyone removes it before."""
    path = f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}"
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """A job's scope: what is stored inside goes at its end, and nothing else does.

    DataFrames that were made inside can't be read after it, so a job ends in written
    results. Scopes of one session don't know of each other; one inside another is
    removed with it at the latest.
    """
    path = f"{_job.get() or _application(spark)}/job-{uuid.uuid4().hex}"
    outer = _job.set(path)
    try:
        yield path
    finally:
        _job.reset(outer)
        _remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path that isn't taken, in the running job's folder."""
    return f"{_job.get() or _application(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the running job's folder and read it back: lineage ends there, and no branch computes it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove all that this application has stored, whatever the job: for the end of an application."""
    _remove(spark, _application(spark))
