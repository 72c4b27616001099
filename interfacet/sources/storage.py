"""Where intermediate tables go."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


SENT = 10 << 20  # bytes; the planner's default limit for broadcasts


def honest(df: DataFrame, path: str) -> DataFrame:
    """df, the Parquet table at path, such that joins don't broadcast it by the size of its files where its rows are far larger.

    Columns of numbers take some bits a row in a file and eight bytes or more in memory, so that a table of millions of rows
    may look small enough to go through the driver; a row of a table that is sent takes some 64 bytes beside its columns.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(place).getLength()
    if size <= SENT // 100:
        return df
    return shuffled(df) if df.count() * (64 + 16 * len(df.columns)) > SENT else df


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose rows grow with the input, so that a join shuffles it whatever the planner makes of its size.

    A hint on a written table ends at the next join or grouping; after these the planner goes by the bytes of files or of a shuffle again.
    """
    return df.hint("merge")


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that loops keep no lineage."""
    path = shared_dir(df.sparkSession)
    if (tables := WRITTEN.get()) is not None:
        tables.append(path)
    df.write.parquet(path, compression="zstd")
    return honest(df.sparkSession.read.schema(df.schema).parquet(path), path)


WRITTEN: ContextVar[list[str] | None] = ContextVar("WRITTEN", default=None)  # tables of the innermost `tidy` function that runs


def tidy(f: Callable) -> Callable:
    """f, a function that returns tables, such that tables which it writes and which none of the returned ones reads are deleted when it ends.

    What f returns must come from tables that are written by then, or from what it was given: a table that is deleted can't be read later.
    Spark deletes the files of a shuffle once the driver has collected its plan as garbage, which a driver of much free memory puts off, so that is asked for here.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        token = WRITTEN.set([])
        try:
            out = f(*args, **kwargs)
            tables = WRITTEN.get()
        finally:
            WRITTEN.reset(token)
        results = [df for df in (out if isinstance(out, tuple) else (out,)) if isinstance(df, DataFrame)]
        read = {file.rsplit("/", 2)[-2] for df in results for file in df.inputFiles()}
        left = [path for path in tables if path.rsplit("/", 1)[1] in read]
        for path in set(tables) - set(left):
            delete(results[0].sparkSession, path)
        if (outer := WRITTEN.get()) is not None:
            outer += left
        if results:
            results[0].sparkSession._jvm.java.lang.System.gc()
        return out

    return run


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
