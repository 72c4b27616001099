"""Vectors as short codes: a product quantizer in whole numbers, whose searches are Orchard's.

A vector is cut into equal consecutive parts, and each part position has a codebook of its own. The
nearest entry of a part is found from lists that hold, for every entry, all entries by their distance
from it: a search walks the list of the best entry so far, goes over to the list of an entry that is
better, never looks at an entry twice, and ends where a list is further than twice the distance it has
(no entry beyond can be as near). All is done in 64-bit integers, so results don't depend on how
the rows are dealt out.

Training takes rounds over all rows: tasks add up their parts by entry, Spark adds up the tasks, and
only the sums (entries x components, whatever the data) reach the driver.

Rows whose vector is null or holds null or non-finite components are dropped, and so are those whose
length isn't that of the first kept vector (by vec_id, then vector) or no multiple of parts. Equal
distances go to the lower index. Repeated rows count, and are returned, as often as they stand; of several vectors
of one vec_id the smallest may be a first entry, those without vec_id never are; fewer kept ids than entries make
shorter codebooks. An empty table, or one without ids, gives no rows. Other columns are ignored, whatever their names.
Components of 2**31 / scale or more end the job with Spark's overflow error; none is clipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize, release


class Orchard:
    """Nearest entry by squared distance, lower index on ties."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None] - entries[None]
        gap = (gap * gap).sum(2)
        self.near = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.near, 1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance for each row of x; all rows go on together, each in its own list."""
        n, k = len(x), len(self.entries)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        dist = ((x - self.entries[0]) ** 2).sum(1)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        todo = np.arange(n)
        while len(todo):
            e = self.near[best[todo], at[todo]]
            beyond = self.gap[best[todo], at[todo]] > 4 * dist[todo]  # of squares: twice the distance
            at[todo] += 1
            look = ~beyond & ~marked[todo, e]
            i, e = todo[look], e[look]
            marked[i, e] = True
            d = ((x[i] - self.entries[e]) ** 2).sum(1)
            better = (d < dist[i]) | ((d == dist[i]) & (e < best[i]))
            i, e = i[better], e[better]
            best[i], dist[i], at[i] = e, d[better], 0
            todo = todo[~beyond & (at[todo] < k)]
        return best, dist


def whole_vectors(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, ints: the kept rows, their components as integers; written."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0)
    ints = F.when(good, F.transform(v, lambda x: F.floor(x * scale).cast("int")))  # only kept rows may overflow
    return materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("ints")).where("ints is not null"))


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks to start from, (part, entry, position): `entries` vectors at most."""
    known = rows.where("vec_id is not null")
    first = known.agg(F.min(F.struct("vec_id", "ints"))).first()[0]
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    same = known.where(F.size("ints") == len(first["ints"]))
    ids = [r[0] for r in same.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    start = same.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").collect()
    return np.array([r["ints"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)


def cut(batch, parts: int) -> np.ndarray:
    """The parts of a batch, (row, part, position)."""
    ints = batch.column(batch.schema.get_field_index("ints")).flatten().to_numpy(zero_copy_only=False)
    return ints.astype(np.int64).reshape(batch.num_rows, parts, -1)


def retrained(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows: entries become the floored mean of their parts, unused ones stay."""

    def run(batches):
        import pyarrow as pa

        index = [Orchard(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = cut(batch, len(books))
            for p, tree in enumerate(index):
                e, _ = tree.search(x[:, p])
                np.add.at(total[p], e, x[:, p])
                count[p] += np.bincount(e, minlength=books.shape[1])
        p, e, i = (k.ravel() for k in np.indices(books.shape))
        used = count[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(k[used]) for k in (p, e, i, total.ravel(), count[p, e])], names=["part", "entry", "at", "total", "n"])
        release()

    sums = rows.mapInArrow(run, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # parts x entries x positions at most
        out[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error."""

    def run(batches):
        import pyarrow as pa

        index = [Orchard(b) for b in books]
        for batch in batches:
            x = cut(batch, len(books))
            found = [tree.search(x[:, p]) for p, tree in enumerate(index)]
            code = np.stack([e for e, _ in found], 1).astype(np.uint8).tobytes().hex()
            w = 2 * len(books)
            code = pa.array([code[i : i + w] for i in range(0, len(code), w)], pa.string())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, code, pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])
        release()

    return rows.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of vectors(vec_id, embedding, label); entries may be 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    rows = whole_vectors(vectors, parts, scale)
    books = first_entries(rows, parts, entries)
    rows = rows.where(F.size("ints") == books.shape[2] * parts)
    for _ in range(rounds if books.shape[1] else 0):
        books = retrained(rows, books)
    text = ",".join(map(str, books.ravel().tolist()))
    key = {"no_label": F.col("label").isNull(), "of": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    found = materialize(coded(rows if books.shape[1] else rows.where("false"), books).withColumns(key))
    sums = materialize(found.groupBy("no_label", "of").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    out = joined(found, sums, ["no_label", "of"])
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
