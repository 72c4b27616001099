"""Reports over many structures: distortion of flattened patches, interface maps, and what was left out and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contacts, flatten, mapview, structure
from ..operators.project import METRICS, cylindrical, distortion, planar, principal_frame, spherical
from ..sources.storage import materialize, tidy
from .sweeps import distances, interface, patch_meshes, surface

METHODS = ("conformal", "planar", "spherical", "cylindrical")
VALUES = [f"{n}_{m}" for n in METHODS for m in METRICS]


def digits(value: str) -> int:
    return 4 if value.endswith("std") else 2


def patch_distortion(patches: DataFrame, vertices: DataFrame) -> DataFrame:
    """structure_id, patch, vertices, the metrics of all methods and status, a row for each patch.

    Vertices are those of the patch after merging and without bad faces. Projections are measured on all of it. Only its largest component
    can be flattened, so a patch that has others has no conformal map of its own length: its conformal metrics
    are 0.0 and its status says so, as for one without a map.
    """
    faces, points, names = patch_meshes(patches, vertices, "structure_id", "patch_id")
    faces, points = flatten.clean(faces, points)
    count = lambda df, name: df.groupBy("mesh_id").agg(F.count("*").alias(name))
    part, corners = flatten.largest(faces, points)
    whole = count(faces, "all").join(count(part, "part"), "mesh_id", "left").where("all = part").select("mesh_id")
    uv, lost = flatten.flattened_or_not(names, part, corners)
    frame = materialize(principal_frame(faces, points))
    maps = {"conformal": uv.join(whole, "mesh_id", "left_semi"), "planar": planar(frame), "spherical": spherical(frame), "cylindrical": cylindrical(frame)}
    # One long table: a mesh stands once for each method, under a number of its own.
    m = len(METHODS)
    number = lambda i: F.col("mesh_id") * m + i
    often = lambda df: df.withColumn("mesh_id", F.explode(F.array(*[number(i) for i in range(m)])))
    long = reduce(DataFrame.unionByName, [maps[name].select(number(i).alias("mesh_id"), "vid", "u", "v") for i, name in enumerate(METHODS)])
    d = distortion(often(faces), often(points), long).withColumn("method", F.pmod("mesh_id", F.lit(m))).withColumn("mesh_id", F.expr(f"mesh_id div {m}"))
    of = lambda i, c: F.max(F.when(F.col("method") == i, F.col(c)))
    wide = d.groupBy("mesh_id").agg(*[of(i, metric).alias(f"{name}_{metric}") for i, name in enumerate(METHODS) for metric in METRICS], of(0, "status").alias("conformal_status"))
    out = names.select("mesh_id", "structure_id", F.col("patch_id").alias("patch")).join(count(points, "vertices"), "mesh_id", "left").join(wide, "mesh_id", "left")
    out = out.join(lost, "mesh_id", "left").join(whole.withColumn("whole", F.lit(True)), "mesh_id", "left")
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("whole").isNull(), "component dropped").otherwise(F.coalesce("conformal_status", F.lit("undefined")))
    return out.select("structure_id", "patch", F.coalesce("vertices", F.lit(0)).alias("vertices"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in VALUES], status.alias("status"))


def with_totals(rows: DataFrame, skip_failed: bool = False) -> DataFrame:
    """rows(structure_id, patch, vertices, metrics, status) with patch_id, and for each structure `weighted_avg` and `largest`.

    Patches have their metrics rounded, deviations to 4 digits and angles to 2. The average weighs what is
    rounded by the vertices of the patch, and has 4 digits in every metric; the largest patch is the first of most vertices.
    The status of an average is that of its worst patch. skip_failed leaves patches whose status isn't ok out of averages.
    """
    rows = rows.withColumns({v: F.round(v, digits(v)) for v in VALUES})
    counted = rows.where("status = 'ok'") if skip_failed else rows
    mean = [F.round(F.sum(F.col(v) * F.col("vertices")) / F.nullif(F.sum("vertices"), F.lit(0)), 4) for v in VALUES]
    worst = F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok"))
    total = counted.groupBy("structure_id").agg(F.lit("weighted_avg").alias("patch_id"), F.sum("vertices").alias("vertices"), *[F.coalesce(m, F.lit(0.0)).alias(v) for m, v in zip(mean, VALUES, strict=True)], worst.alias("status"))
    top = rows.groupBy("structure_id").agg(F.max_by(F.struct("vertices", *VALUES, "status"), F.struct("vertices", -F.col("patch"))).alias("t")).select("structure_id", F.lit("largest").alias("patch_id"), "t.*")
    return rows.withColumn("patch_id", F.col("patch").cast("string")).drop("patch").unionByName(total).unionByName(top)


@tidy
def distortion_report(patches: DataFrame, vertices: DataFrame, categories: DataFrame | None = None, skip_failed: bool = False, raw: bool = False) -> DataFrame:
    """structure_id, category, patch_id, vertices, the metrics of four methods and status: a row for each patch, `weighted_avg` and `largest`; see `with_totals`.

    categories(structure_id, category) names the structures, others are Uncategorized. raw adds the metrics of each patch as they were
    before rounding, as raw_<metric>, null in totals.
    """
    rows = materialize(patch_distortion(patches, vertices))
    every = with_totals(rows, skip_failed)
    if categories is None:
        every = every.withColumn("category", F.lit(None).cast("string"))
    else:
        every = every.join(categories.select("structure_id", "category").dropDuplicates(["structure_id"]), "structure_id", "left")
    more = []
    if raw:
        every = every.join(rows.select("structure_id", F.col("patch").cast("string").alias("patch_id"), *[F.col(v).alias(f"raw_{v}") for v in VALUES]), ["structure_id", "patch_id"], "left")
        more = [f"raw_{v}" for v in VALUES]
    category = F.coalesce("category", F.lit("Uncategorized")).alias("category")
    return every.select("structure_id", category, "patch_id", "vertices", *VALUES, "status", *more)


def maps_of(patches: DataFrame, vertices: DataFrame, a: DataFrame, b: DataFrame, annotated: DataFrame | None = None, **style) -> tuple[mapview.InterfaceMap, DataFrame]:
    """(the interface map of every structure, status of the patches, and of the structures, that can't be flattened)."""
    *meshes, names = patch_meshes(patches, vertices, "structure_id", "patch_id")
    faces, points = flatten.cleaned(*meshes)
    uv, lost = flatten.flattened_or_not(names, faces, points)
    split = lambda df, *cols: df.join(names, "mesh_id").select("structure_id", "patch_id", *cols)
    kept = points.join(uv.select("mesh_id").distinct(), "mesh_id", "left_semi")
    drawn = mapview.interface_map(split(faces, "a", "b", "c"), materialize(split(kept, "vid", "x", "y", "z")), split(uv, "vid", "u", "v"), a, b, annotated, **style)
    flat = split(uv).distinct()
    none = names.select("structure_id").distinct().join(flat, "structure_id", "left_anti")
    status = structure.missing(lost.join(names, "mesh_id"), "flatten", F.col("reason"), F.col("patch_id"))
    return drawn, status.unionByName(structure.missing(none, "flatten", "no patch could be flattened"))


def interface_maps(atoms: DataFrame, targets: DataFrame, contact_rows: DataFrame | None = None, cutoff: float = 5.0, least_vertices: int = 50, sigma: float = 1.5, res: float = 1.0, **style) -> tuple[mapview.InterfaceMap, DataFrame]:
    """(map, status) of targets(structure_id, chain_a, chain_b), whose atoms may hold any chains, models and records.

    status has structure_id, patch_id (null for a whole structure), stage (load, surface, patches, flatten) and reason. Each target's
    structure is drawn or has a row there whose patch_id is null; patches that are left out have a row too. A structure
    takes part once: of several pairs of chains the lowest, the others have a row at stage load. Contacts between the two
    chains of a target decide for its structure whether types come from them; see `mapview.interface_map`.
    """
    pairs = targets.select("structure_id", "chain_a", "chain_b").where("structure_id is not null").distinct()
    chosen = materialize(pairs.groupBy("structure_id").agg(F.min(F.struct("chain_a", "chain_b")).alias("t"), F.count("*").alias("n")))
    one = chosen.select("structure_id", "t.*")
    status = structure.missing(chosen.where("n > 1"), "load", "further pairs of chains left out", F.lit(0))
    lost = materialize(structure.missing_chains(atoms, one))
    status = status.unionByName(lost.select("structure_id", F.lit(None).cast("int").alias("patch_id"), "stage", "reason"))
    ready = one.join(lost, "structure_id", "left_anti")
    standard = structure.standard(structure.first_model(atoms))
    side = lambda k: materialize(standard.join(ready.select("structure_id", F.col(f"chain_{k}").alias("chain_id")), ["structure_id", "chain_id"], "left_semi"))
    a, b = side("a"), side("b")
    faces, at = surface(a, sigma, res)
    meshed = faces.select(F.col("mesh_id").alias("structure_id")).distinct()
    status = status.unionByName(structure.missing(ready.join(meshed, "structure_id", "left_anti"), "surface", "no surface"))
    b_points = b.select("structure_id", F.col("serial").alias("b_serial"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    patches = interface(faces, materialize(distances(at, b_points, cutoff)), cutoff, least_vertices)
    touching = patches.select("structure_id").distinct()
    status = status.unionByName(structure.missing(meshed.join(touching, "structure_id", "left_anti"), "patches", "no interface patch"))
    annotated = None if contact_rows is None else materialize(contacts.annotated_types(contact_rows.join(one, "structure_id"), F.col("chain_a"), F.col("chain_b")))
    drawn, flat = maps_of(patches, at, a, b, annotated, **style)
    return drawn, materialize(status.unionByName(flat))
