"""Distance joins as equi-joins on grid cells of half the radius: a row meets those cells only that its sphere touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize

AXES = ("x", "y", "z")
REACH = 2  # cells along a radius: of the pairs that meet fewer are too far apart than with wider cells, rows have more copies


def cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / radius)


def box(df: DataFrame, keys: list[str], radius: float, prefix: str = "") -> DataFrame:
    """keys, and on each axis the first and last cell (fx, tx ..) that rows of df are in; coordinates that aren't finite are in none."""
    at = {k: F.when(F.abs(f"{prefix}{k}") < float("inf"), cell(f"{prefix}{k}", radius)) for k in AXES}
    return df.groupBy(*keys).agg(*[e for k, c in at.items() for e in (F.min(c).alias(f"f{k}"), F.max(c).alias(f"t{k}"))])


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """All pairs within `radius` (inclusive) of left(keys, x, y, z, ..) and right(keys, bx, by, bz, ..), with d.

    Rows of either side beyond the box of the other are dropped first. right is then copied to the cells within the box of
    left that its sphere touches, so pass the smaller side there. The planner doesn't see how often rows are copied, so a
    broadcast of the copies is ruled out.
    """
    ends = [f"{e}{k}" for k in AXES for e in "ft"]
    width = radius / REACH
    boxes = materialize(box(right, keys, width, "b"))  # written, so that left isn't shuffled to meet the boxes if these are few
    a = left.withColumns({f"c{k}": cell(k, width) for k in AXES}).join(boxes, keys)
    a = a.where(" and ".join(f"c{k} between f{k} - {REACH} and t{k} + {REACH}" for k in AXES)).drop(*ends)
    b = right.join(box(left, keys, width), keys)
    b = b.withColumns({f"f{k}": F.greatest(cell(f"b{k}", width) - REACH, f"f{k}") for k in AXES} | {f"t{k}": F.least(cell(f"b{k}", width) + REACH, f"t{k}") for k in AXES})
    b = b.where(" and ".join(f"f{k} <= t{k}" for k in AXES))
    apart = F.lit(0.0)
    for k in AXES:
        b = b.withColumn(f"c{k}", F.explode(F.sequence(f"f{k}", f"t{k}")))
        gap = F.greatest(F.col(f"c{k}") * width - F.col(f"b{k}"), F.col(f"b{k}") - (F.col(f"c{k}") + 1) * width, F.lit(0.0))
        apart = apart + gap * gap
        b = b.where(apart <= radius * radius * (1 + 1e-9) + 1e-9)
    d2 = sum((F.col(k) - F.col(f"b{k}")) * (F.col(k) - F.col(f"b{k}")) for k in AXES)
    return a.join(b.drop(*ends).hint("merge"), [*keys, "cx", "cy", "cz"]).withColumn("d", F.sqrt(d2)).where(F.col("d") <= radius).drop("cx", "cy", "cz")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], id_: str, cutoff: float, arg: str | None = None) -> DataFrame:
    """keys, id_, dist and the smallest `arg` at that distance, for rows of left closer than `cutoff` to right; without arg pairs need no sorting."""
    pairs = near_pairs(left, right, keys, cutoff).where(F.col("d") < cutoff)
    return pairs.groupBy(*keys, id_).agg(F.min("d").alias("dist"), *([] if arg is None else [F.min_by(arg, F.struct("d", arg)).alias(arg)]))
