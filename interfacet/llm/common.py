"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_ROWS, HOT_KEYS = 1000, 100_000


def joined(rows_: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """rows_ joined with counts (one row for each key with n, how many of rows_ have it) without a hot task.

    Keys of more than HOT_ROWS rows, and of more than one in HOT_KEYS of all rows, are sent to all
    executors: HOT_KEYS of them at most, whatever the data. The other keys are shuffled. counts should
    be a written table.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    many = F.broadcast(counts.where(hot))
    few = rows_.join(F.broadcast(counts.where(hot).select(*key)), key, "left_anti").join(counts.where(~hot), key)
    return rows_.join(many, key).unionByName(few)


def sampled(df: DataFrame, sample: int, *key: str) -> DataFrame:
    """About `sample` rows of df and no more, chosen by the hash of key: all where df has no more. Only rows below a threshold are ever sorted."""
    h = F.xxhash64(*key)
    if (n := df.count()) <= sample:
        return df
    share = max(sample - 4 * sample**0.5, 1) / n  # so that more than `sample` hashes below the threshold are as good as never found
    return df.where(h < int(-(1 << 63) + share * (1 << 64))).orderBy(h, *key).limit(sample)


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text and the other columns of known, which has few rows of numbers, one for each doc_id; of several texts of a doc_id the one of lowest hash."""
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return found.groupBy(*known.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", *[c for c in known.columns if c != "doc_id"])


def rows(batch) -> Iterator[tuple]:
    """Rows of an Arrow batch one at a time, so that only one long text is a Python object."""
    columns = batch.columns
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)
    release()


def release() -> None:
    """Give freed Arrow buffers back: idle Python workers live on beside those of later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


NO_ID = -(1 << 63)  # stands for a null doc_id in join keys


def keyed(docs: DataFrame) -> DataFrame:
    """Adds id and h, the join key of a row: repeated rows share it, rows that only share doc_id don't."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "h": F.xxhash64("text")})


def byte_slices(batch, name: str, limit: int = 1 << 20):
    """(first row, offsets, bytes) of parts of a text column of about `limit` bytes, or one longer text; nulls are empty."""
    import numpy as np
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, 8 * col.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(col))
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j
    release()


def mix(x):
    """Finalizer of a 64-bit hash on a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Prefix polynomial hashes modulo 2**64 over random byte values: O(1) hash of any substring."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, seed: int = 0):
        import numpy as np

        self.values = np.random.default_rng(20240607 + seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        import numpy as np

        if len(self.up) <= n:
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, b, np.uint64)]), dtype=np.uint64) for b in (self.BASE, inverse))

    def prefix(self, data):
        import numpy as np

        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix, start, end):
        """Hashes of the substrings [start, end)."""
        return (prefix[end] - prefix[start]) * self.down[start]
