"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: With it, Spark removes what an execution has shuffled when that ends, and not when the driver happens to collect its garbage.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir).

    Where the session names none, as in tests on one machine, one is made there; elsewhere that is an error.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if folder := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(folder)
        elif context.master.startswith("local"):
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="boxwright-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that its lineage ends there and lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files; only for results that are read from where they are written."""
    before = spark.conf.get(_SHUFFLES_END, "false")
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_END, before)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a compressed table in the shared folder, for what is large; it stays there until drop_stored(). path: where df's rows are added to a table."""
    spark = df.sparkSession
    path = path or table_path(spark)
    with shuffles_end(spark):
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession) -> str:
    """A place for a new table of stored()."""
    return f"{shared_folder(spark)}/boxwright-{uuid.uuid4().hex}"


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/boxwright-" in f}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
