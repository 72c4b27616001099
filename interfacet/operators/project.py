"""Plane coordinates of patches and how far they distort them. Tables are keyed by mesh_id, vid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .mesh import measured

METRICS = ("area_std", "angle_mae")


def spread(df: DataFrame, cols: dict[str, str], least_range: float, flat: str) -> DataFrame:
    """cols (new name: old name) moved to [0, 1] within each mesh; a range below least_range counts as 1 (flat='unit') or gives 0 (flat='zero')."""
    bounds = df.groupBy("mesh_id").agg(*[e for new, old in cols.items() for e in (F.min(old).alias(f"{new}_lo"), (F.max(old) - F.min(old)).alias(f"{new}_range"))])
    out = df.join(bounds, "mesh_id")
    for new, old in cols.items():
        width, shift = F.col(f"{new}_range"), F.col(old) - F.col(f"{new}_lo")
        narrow = shift if flat == "unit" else F.lit(0.0)
        out = out.withColumn(new, F.when(width < least_range, narrow).otherwise(shift / width))
    return out.drop(*[f"{new}_{s}" for new in cols for s in ("lo", "range")])


def normal_uv(uv: DataFrame) -> DataFrame:
    """mesh_id, vid, u, v in [0, 1]."""
    return spread(uv.select("mesh_id", "vid", F.col("u").alias("pu"), F.col("v").alias("pv")), {"u": "pu", "v": "pv"}, 1e-6, "unit").select("mesh_id", "vid", "u", "v")


def planar(frame: DataFrame) -> DataFrame:
    """Drops x, the direction of least variance."""
    return spread(frame, {"u": "y", "v": "z"}, 1e-9, "zero").select("mesh_id", "vid", "u", "v")


def around() -> Column:
    return (F.atan2("y", "x") + math.pi) / (2 * math.pi)


def spherical(frame: DataFrame) -> DataFrame:
    r = F.sqrt(F.expr("x*x + y*y + z*z"))
    r = F.when(r == 0, 1e-9).otherwise(r)
    return frame.select("mesh_id", "vid", around().alias("u"), (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / r))) / math.pi).alias("v"))


def cylindrical(frame: DataFrame) -> DataFrame:
    return spread(frame, {"v": "z"}, 1e-9, "zero").select("mesh_id", "vid", around().alias("u"), "v")


def covariance(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, area-weighted centroid cx, cy, cz and the six entries of the covariance of its vertices about that, divided by their number."""
    centre = measured(faces, vertices).groupBy("mesh_id").agg(*[(F.sum(F.col("area") * F.col(f"g{k}")) / F.sum("area")).alias(f"c{k}") for k in "xyz"])
    d = vertices.join(centre, "mesh_id")
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    return d.groupBy("mesh_id", "cx", "cy", "cz").agg(*[F.avg((F.col(p) - F.col(f"c{p}")) * (F.col(q) - F.col(f"c{q}"))).alias(f"{p}{q}") for p, q in pairs], F.count("*").alias("n"))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def principal_frame(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices about the centroid with axes of ascending variance as x, y, z.

    Eigenvalues of the 3 x 3 covariance by the trigonometric formula; each outer axis is the largest
    cross product of two rows of the shifted matrix, signed so that its largest component is positive;
    the middle one completes a right-handed frame. Meshes of fewer than 3 vertices, or of equal
    variances, stay as they are.
    """
    c = covariance(faces, vertices)
    c = c.withColumn("q", F.expr("(xx + yy + zz) / 3"))
    c = c.withColumn("p", F.sqrt(F.expr("((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6")))
    det = F.expr("((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p)")
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det))) / 3
    plain = (F.col("n") < 3) | (F.col("p") <= 1e-12)
    c = c.withColumn("phi", phi).withColumns({"high": F.expr("q + 2*p*cos(phi)"), "low": F.expr("q + 2*p*cos(phi + 2*pi()/3)")}).withColumn("plain", plain)

    def normal(value: str) -> Column:
        m = [[F.col("xx") - F.col(value), F.col("xy"), F.col("xz")], [F.col("xy"), F.col("yy") - F.col(value), F.col("yz")], [F.col("xz"), F.col("yz"), F.col("zz") - F.col(value)]]
        options = [cross(m[i], m[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        return F.array_max(F.array(*[F.struct(dot(o, o).alias("n"), F.array(*o).alias("v")) for o in options]))

    def signed(best: str) -> Column:
        unit = F.transform(F.col(f"{best}.v"), lambda e: e / F.sqrt(F.col(f"{best}.n")))
        big = F.array_max(F.transform(unit, lambda e: F.struct(F.abs(e).alias("size"), e.alias("e"))))["e"]
        return F.transform(unit, lambda e: e * F.signum(big))

    # One row a mesh; written between steps, since nested in each other these expressions grow without end.
    c = materialize(materialize(c).withColumns({"b0": normal("low"), "b2": normal("high")}))
    c = materialize(c.withColumns({"e0": signed("b0"), "e2": signed("b2")}))
    e0, e2 = ([F.col(e)[i] for i in range(3)] for e in ("e0", "e2"))
    e1 = cross(e2, e0)
    d = vertices.join(c, "mesh_id")
    shift = [F.col(k) - F.col(f"c{k}") for k in "xyz"]
    return d.select("mesh_id", "vid", *[F.when(F.col("plain"), F.col(k)).otherwise(dot(shift, e)).alias(k) for k, e in zip("xyz", (e0, e1, e2), strict=True)])


def distortion(faces: DataFrame, vertices: DataFrame, uv: DataFrame) -> DataFrame:
    """mesh_id, area_std, angle_mae, status: 0.0 and 'undefined' where a mesh has no coordinates or no valid face.

    area_std is the population deviation of the ratios of areas over their mean; angle_mae is the mean
    difference of corner angles in degrees.
    """
    out = faces
    both = vertices.join(uv, ["mesh_id", "vid"])
    for p in "abc":
        out = out.join(both.select("mesh_id", F.col("vid").alias(p), *[F.col(k).alias(f"{p}{k}") for k in "xyzuv"]), ["mesh_id", p])
    zero = F.lit(0.0)
    at3 = {p: [F.col(f"{p}{k}") for k in "xyz"] for p in "abc"}
    at2 = {p: [F.col(f"{p}u"), F.col(f"{p}v"), zero] for p in "abc"}
    minus = lambda s, t: [x - y for x, y in zip(s, t, strict=True)]
    norm = lambda s: F.sqrt(dot(s, s))

    def area(at) -> Column:
        return norm(cross(minus(at["b"], at["a"]), minus(at["c"], at["a"]))) / 2

    def angle(at, p: str, q: str, r: str) -> Column:
        s, t = minus(at[q], at[p]), minus(at[r], at[p])
        size = norm(s) * norm(t)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(size > 0, dot(s, t) / size).otherwise(0.0)))))

    off = sum((F.abs(angle(at3, *t) - angle(at2, *t)) for t in ("abc", "bca", "cab")), zero) / 3
    measured_ = out.select("mesh_id", area(at3).alias("a3"), area(at2).alias("a2"), off.alias("off")).where("a3 > 1e-12").withColumn("ratio", F.col("a2") / F.col("a3"))
    got = measured_.groupBy("mesh_id").agg((F.stddev_pop("ratio") / F.when(F.avg("ratio") > 0, F.avg("ratio")).otherwise(1.0)).alias("area_std"), F.avg("off").alias("angle_mae"))
    every = faces.select("mesh_id").distinct().join(got, "mesh_id", "left")
    status = F.when(F.col("area_std").isNull(), "undefined").otherwise("ok")
    return every.select("mesh_id", F.coalesce("area_std", zero).alias("area_std"), F.coalesce("angle_mae", zero).alias("angle_mae"), status.alias("status"))
