"""Sparse voxel counts and their Gaussian smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def grids(atoms: DataFrame, res: float = 1.0, pad: float = 10.0) -> DataFrame:
    """structure_id, lo and hi and n for each axis."""
    out = atoms.groupBy("structure_id").agg(*[e for k in AXES for e in ((F.min(k) - pad).alias(f"lo{k}"), (F.max(k) + pad).alias(f"hi{k}"))])
    return out.withColumns({f"n{k}": F.ceil((F.col(f"hi{k}") - F.col(f"lo{k}")) / res) for k in AXES})


def voxels(atoms: DataFrame, grid: DataFrame) -> DataFrame:
    """structure_id, ix, iy, iz, d (atoms in the cell); a cell is extent / shape wide."""
    bins = {f"i{k}": F.floor((F.col(k) - F.col(f"lo{k}")) * F.col(f"n{k}") / (F.col(f"hi{k}") - F.col(f"lo{k}"))) for k in AXES}
    return atoms.join(grid, "structure_id").withColumns(bins).groupBy("structure_id", "ix", "iy", "iz").agg(F.count("*").cast("double").alias("d"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i - r, x / sum(w)) for i, x in enumerate(w)]


BLOCK = 32  # cells along an edge of a block


def dealt(cells: DataFrame, grid: DataFrame, reach: int | Column, more: int = 0) -> DataFrame:
    """The counted cells, with the columns of grid, once for every block (bx, by, bz) that has a cell within reach of them, or with `more` = 1 ends just below such a cell and isn't below the grid."""
    out = cells.join(grid, "structure_id")
    for k in AXES:
        i, n = F.col(f"i{k}"), F.col(f"n{k}")
        first = F.least(F.greatest(i - reach, F.lit(0)), 2 * n - 1 - i - reach)  # the second is less only where a grid is smaller than the kernel
        last = F.greatest(F.least(i + reach, n - 1), reach - 1 - i)
        low = F.greatest(F.floor((first - more) / BLOCK), F.lit(0)) if more else F.floor(first / BLOCK)
        out = out.withColumn(f"b{k}", F.explode(F.sequence(low, F.greatest(low, F.floor(last / BLOCK)))))
    return out


def smooth(cells: DataFrame, grid: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Three one-axis passes; what passes a border is reflected.

    Space is cut into blocks. The counted cells, far fewer than the smoothed ones, are dealt to every block that they
    reach, and each block makes its own cells by all three passes: one shuffle of counts, none of the sums or their terms.
    """
    taps = kernel(sigma)
    reach = taps[-1][0]
    spread = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in taps]))
    blocks, at = [f"b{k}" for k in AXES], [f"i{k}" for k in AXES]
    out = dealt(cells, grid.select("structure_id", *[f"n{k}" for k in AXES]), reach)
    out = out.repartition("structure_id", *blocks)
    for k in AXES:
        i, n = F.col(f"i{k}") + F.col("t.o"), F.col(f"n{k}")
        to = F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
        moved = out.withColumn("t", spread).withColumn(f"i{k}", to).where(F.floor(F.col(f"i{k}") / BLOCK) == F.col(f"b{k}"))
        out = moved.groupBy("structure_id", *blocks, *at, *[f"n{o}" for o in AXES if o > k]).agg(F.sum(F.col("d") * F.col("t.w")).alias("d"))
    return out.select("structure_id", *at, "d")
