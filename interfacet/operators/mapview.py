"""Interface maps: residues placed on flattened patches, with interaction types, mesh edges and legend, as tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import COLORS, INTERACTIONS, rank
from ..sources.storage import materialize
from .contacts import typed_pairs
from .spatial import near_pairs


class InterfaceMap(NamedTuple):
    placed: DataFrame  # structure_id, patch_id, res_seq, icode, res_name, u, v, types; all that restyling needs
    points: DataFrame  # structure_id, patch_id, label, uid, u, v, type, color
    edges: DataFrame  # structure_id, patch_id, u0, v0, u1, v1
    legend: DataFrame  # structure_id, rank, type, color


def on_patch(atoms: DataFrame, vertices: DataFrame, radius: float = 3.0) -> DataFrame:
    """structure_id, patch_id, serial, dist, vid: the nearest vertex (the lowest vid on ties) of every patch closer than radius to an atom.

    vertices: structure_id, patch_id, vid, x, y, z.
    """
    at = vertices.select("structure_id", "patch_id", "vid", *[F.col(k).alias(f"b{k}") for k in "xyz"])
    pairs = near_pairs(atoms.select("structure_id", "serial", "x", "y", "z"), at, ["structure_id"], radius).where(F.col("d") < radius)
    return pairs.groupBy("structure_id", "patch_id", "serial").agg(F.min("d").alias("dist"), F.min_by("vid", F.struct("d", "vid")).alias("vid"))


def close_atoms(a: DataFrame, b: DataFrame, radius: float = 8.0) -> DataFrame:
    """Rows of a with an atom of b closer than radius."""
    points = b.select("structure_id", *[F.col(k).alias(f"b{k}") for k in "xyz"])
    hit = near_pairs(a.select("structure_id", "serial", "x", "y", "z"), points, ["structure_id"], radius).where(F.col("d") < radius).select("structure_id", "serial").distinct()
    return a.join(hit, ["structure_id", "serial"], "left_semi")


def placed_residues(placed: DataFrame, atoms: DataFrame, uv: DataFrame) -> DataFrame:
    """structure_id, patch_id, res_seq, icode, res_name, u, v: the mean of the coordinates of a residue's atoms on the patch."""
    icode = F.col("icode") if "icode" in atoms.columns else F.lit(None).cast("string")
    named = atoms.select("structure_id", "serial", "res_seq", F.coalesce(icode, F.lit("")).alias("icode"), "res_name")
    at = placed.join(named, ["structure_id", "serial"]).join(uv.where("u is not null and v is not null").select("structure_id", "patch_id", "vid", "u", "v"), ["structure_id", "patch_id", "vid"])
    return at.groupBy("structure_id", "patch_id", "res_seq", "icode").agg(F.min("res_name").alias("res_name"), F.avg("u").alias("u"), F.avg("v").alias("v"))


def color_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(COLORS[t]) for t in INTERACTIONS]), rank(kind).cast("int"))


def styled(placed: DataFrame, active: list[str] | None = None, color_by_type: bool = True, color: str = "#FF0000") -> DataFrame:
    """Points of placed residues. By type: the active type of lowest rank, residues without one are left out; else all, in one colour."""
    label = F.concat(F.col("res_name"), F.col("res_seq").cast("string"))
    kinds = F.array_intersect("types", F.array(*map(F.lit, INTERACTIONS if active is None else active)).cast("array<string>"))
    best = F.array_min(F.transform(kinds, lambda t: F.struct(rank(t).alias("rank"), t.alias("type"))))["type"]
    out = placed.withColumn("label", F.coalesce(label, F.col("res_seq").cast("string"))).withColumn("uid", F.concat_ws("_", "patch_id", "label"))
    if color_by_type:
        out = out.withColumn("type", best).where("type is not null").withColumn("color", color_of(F.col("type")))
    else:
        out = out.withColumn("type", F.lit(None).cast("string")).withColumn("color", F.lit(color))
    return out.select("structure_id", "patch_id", "label", "uid", "u", "v", "type", "color")


def legend(points: DataFrame) -> DataFrame:
    """structure_id, rank, type, color of the types that the points show, in order of rank (see its column)."""
    return points.where("type is not null").select("structure_id", rank(F.col("type")).cast("int").alias("rank"), "type", "color").distinct()


def drawn_edges(patches: DataFrame, uv: DataFrame) -> DataFrame:
    """structure_id, patch_id, u0, v0, u1, v1: every mesh edge once."""
    ends = F.explode(F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    edges = patches.select("structure_id", "patch_id", ends.alias("e")).select("structure_id", "patch_id", "e.lo", "e.hi").distinct()
    for i, end in enumerate(("lo", "hi")):
        edges = edges.join(uv.select("structure_id", "patch_id", F.col("vid").alias(end), F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}")), ["structure_id", "patch_id", end])
    return edges.select("structure_id", "patch_id", "u0", "v0", "u1", "v1")


def by_source(a: DataFrame, annotated: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(atoms of structures that have a row in annotated, atoms of the others)."""
    if annotated is None:
        return a.where("false"), a
    noted = annotated.select("structure_id").distinct()
    return a.join(noted, "structure_id", "left_semi"), a.join(noted, "structure_id", "left_anti")


def residue_types(near: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """structure_id, patch_id, res_seq, icode, types: the types of all pairs of a residue's atoms on the patch with atoms of b."""
    pairs = typed_pairs(a.join(near.select("structure_id", "serial").distinct(), ["structure_id", "serial"], "left_semi"), b)
    kind = F.explode(F.array_compact(F.array("type"))).alias("type")  # not a filter, which the planner would make part of the join and work out several times a pair
    found = pairs.select("structure_id", "serial", kind).distinct()
    icode = F.col("icode") if "icode" in a.columns else F.lit(None).cast("string")
    named = a.select("structure_id", "serial", "res_seq", F.coalesce(icode, F.lit("")).alias("icode"))
    at = near.join(found, ["structure_id", "serial"]).join(named, ["structure_id", "serial"])
    return at.groupBy("structure_id", "patch_id", "res_seq", "icode").agg(F.sort_array(F.collect_set("type")).alias("types"))


def interface_map(patches: DataFrame, vertices: DataFrame, uv: DataFrame, a: DataFrame, b: DataFrame, annotated: DataFrame | None = None, **style) -> InterfaceMap:
    """The map of every structure. patches: structure_id, patch_id, a, b, c; vertices and uv are keyed by structure_id, patch_id, vid.

    Each structure chooses for itself: one that has rows in annotated(structure_id, res_seq, types), as
    `annotated_types` gives them, takes its types from there, by residue number, whatever the insertion code, and places
    all residues on the patch. The others take them from atom pairs within 6.0, of atoms closer than 8.0 to b.
    """
    noted, plain = by_source(a, annotated)
    near = materialize(on_patch(materialize(noted.unionByName(close_atoms(plain, b))), vertices))
    placed = placed_residues(near, a, uv)
    placed = placed.join(residue_types(near, plain, b), ["structure_id", "patch_id", "res_seq", "icode"], "left")
    if annotated is not None:
        notes = annotated.select("structure_id", "res_seq", F.col("types").alias("noted"))
        placed = placed.join(notes, ["structure_id", "res_seq"], "left").withColumn("types", F.coalesce("noted", "types")).drop("noted")
    placed = materialize(placed.withColumn("types", F.coalesce("types", F.array().cast("array<string>"))))
    points = styled(placed, **style)
    return InterfaceMap(placed, points, drawn_edges(patches, uv), legend(points))


def restyled(drawn: InterfaceMap, **style) -> InterfaceMap:
    """The same map in another style, without any geometry."""
    points = styled(drawn.placed, **style)
    return drawn._replace(points=points, legend=legend(points))


def write_interface_map(drawn: InterfaceMap, root: str) -> None:
    """placed, points, edges and legend below root, as Parquet; legends in order of rank within each structure."""
    for name, df in drawn._asdict().items():
        out = df.repartitionByRange("structure_id", "rank").sortWithinPartitions("structure_id", "rank") if name == "legend" else df
        out.write.parquet(f"{root}/{name}")


def read_interface_map(spark: SparkSession, root: str) -> InterfaceMap:
    """What `write_interface_map` wrote; `restyled` gives it another style without its structures or meshes."""
    return InterfaceMap(*[spark.read.parquet(f"{root}/{name}") for name in InterfaceMap._fields])
