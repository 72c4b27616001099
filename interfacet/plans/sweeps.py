"""From atoms to interface patches, and how their area changes with a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, isosurface, mesh, spatial
from ..sources.storage import materialize, tidy


@tidy
def surface(a: DataFrame, sigma: float = 1.5, res: float = 1.0, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the smoothed isosurface of each structure, both written to the shared folder."""
    grid = materialize(density.grids(a, res))
    cubes = isosurface.level_cubes(materialize(density.voxels(a, grid)), grid, isosurface.needs(a), sigma)
    return surface_of(cubes, res, rounds)


def surface_of(cubes: DataFrame, res: float = 1.0, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of `isosurface.level_cubes`. Both are made from the cubes as often as they are read, which needs no join and no shuffle."""
    return mesh.finished(isosurface.cube_triangles(cubes), isosurface.level_vertices(cubes, res), rounds)


def distances(points: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """mesh_id, vid, dist of vertices closer than cutoff to b(structure_id, b_serial, bx, by, bz)."""
    left = points.withColumnRenamed("mesh_id", "structure_id")
    return spatial.nearest(left, b.select("structure_id", "bx", "by", "bz"), ["structure_id"], "vid", cutoff).select(F.col("structure_id").alias("mesh_id"), "vid", "dist")


def interface(faces: DataFrame, near: DataFrame, cutoff: float, least_vertices: int = 50) -> DataFrame:
    """Patches of the surface with a vertex closer than cutoff: structure_id, patch_id, fid, a, b, c, written; see `patch_meshes`."""
    return mesh.near_patches(faces, near, (cutoff,), least_vertices).drop("value").withColumnRenamed("mesh_id", "structure_id")


def numbers(keys: DataFrame, name: str) -> DataFrame:
    """The rows of keys once, each with a number, which is cheaper to join and to group by than several columns; written."""
    return materialize(keys.distinct().withColumn(name, F.monotonically_increasing_id()))


def named_patches(patches: DataFrame, points: DataFrame, keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, vertices, names) of patches(keys, fid, a, b, c); names has the keys of each mesh_id. The first key is the mesh_id of points; all are written, as patches should be."""
    names = numbers(patches.select(*keys), "mesh_id")
    faces = materialize(patches.join(names, list(keys)).select("mesh_id", "fid", "a", "b", "c"))
    named = mesh.corners(faces).distinct().join(names.select("mesh_id", F.col(keys[0]).alias("base")), "mesh_id")
    at = points.select(F.col("mesh_id").alias("base"), "vid", "x", "y", "z")
    return faces, materialize(named.join(at, ["base", "vid"]).select("mesh_id", "vid", "x", "y", "z")), names


@tidy
def patch_meshes(patches: DataFrame, points: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`named_patches`, sanitised."""
    faces, vertices, names = named_patches(patches, points, keys)
    return *mesh.sanitised(faces, vertices), names


@tidy
def patch_areas(patches: DataFrame, points: DataFrame, *keys: str) -> DataFrame:
    """keys, area of patches(keys, fid, a, b, c), sanitised; see `named_patches`."""
    faces, vertices, names = named_patches(patches, points, keys)
    return materialize(mesh.sanitised_areas(faces, vertices).join(names, "mesh_id").drop("mesh_id"))


SLICE = 24_000_000  # atoms, each once for every surface that it is in, whose surfaces are made together; some 6 GB of disk


@tidy
def in_slices(a: DataFrame, b: DataFrame, surfaces: int, make) -> DataFrame:
    """make(a, b) of all structures, by slices of some SLICE atoms: tables of a slice are deleted before the next one starts, so that disk doesn't grow with the number of structures.

    Atoms are written once, with what sweeps need of them; a slice has whole structures. make gives a table that is small beside its surfaces.
    """
    a, b = materialize(a.select("structure_id", "x", "y", "z")), materialize(b.select("structure_id", "b_serial", "bx", "by", "bz"))
    n = a.count() * surfaces // SLICE + 1
    number = F.pmod(F.xxhash64("structure_id"), F.lit(n))
    one = tidy(lambda i: materialize(make(*(df.where(number == i) for df in (a, b)))))
    return reduce(DataFrame.unionByName, [one(i) for i in range(n)])


def sweep_cutoff(a: DataFrame, b: DataFrame, values=tuple(3 + i / 2 for i in range(11)), least_vertices: int = 10) -> DataFrame:
    """Interface area for each cutoff; distances are joined once, at the largest, and each mesh goes through all cutoffs at once (`mesh.near_patches`)."""
    steps = F.explode(F.array(*map(F.lit, values)))

    def make(a, b):
        faces, points = surface(a)
        near = materialize(distances(points, b, max(values)))
        kept = mesh.near_patches(faces, near, values, least_vertices).withColumnRenamed("mesh_id", "structure_id")
        total = patch_areas(kept, points, "structure_id", "value", "patch_id").groupBy("structure_id", "value").agg(F.sum("area").alias("area"))
        every = faces.select(F.col("mesh_id").alias("structure_id")).distinct().withColumn("value", steps)
        return every.join(total, ["structure_id", "value"], "left").select("structure_id", F.lit("cutoff").alias("param"), "value", F.coalesce("area", F.lit(0.0)).alias("area"))

    return in_slices(a, b, 1, make)


def sweep_sigma(a: DataFrame, b: DataFrame, values=(0.5, 1.0, 1.5, 2.0, 2.5, 3.0), cutoff: float = 5.0, least_vertices: int = 10) -> DataFrame:
    """Interface area for each width of the kernel; a structure without a surface has 0.0.

    Voxels are counted once; the surfaces of all widths go through one plan, each under a number that tells its structure's.
    """
    values = [float(v) for v in values]
    of = F.posexplode(F.array(*map(F.lit, values))).alias("nth", "value")

    def make(a, b):
        grid = materialize(density.grids(a))
        names = numbers(grid.select("structure_id"), "no")
        surfaces = names.select("structure_id", "no", of).select("structure_id", (F.col("no") * len(values) + F.col("nth")).alias("surface"), "value")
        faces, points = sigma_surfaces(a, grid, surfaces)
        at = points.select(F.expr(f"mesh_id div {len(values)}").alias("no"), F.struct("mesh_id", "vid").alias("id"), "x", "y", "z")
        near = spatial.nearest(at, b.join(names, "structure_id").select("no", "bx", "by", "bz"), ["no"], "id", cutoff).select("id.mesh_id", "id.vid", "dist")
        patches = interface(faces, materialize(near), cutoff, least_vertices).withColumnRenamed("structure_id", "surface")
        total = patch_areas(patches, points, "surface", "patch_id").groupBy("surface").agg(F.sum("area").alias("area"))
        return surfaces.join(total, "surface", "left").select("structure_id", F.lit("sigma").alias("param"), "value", F.coalesce("area", F.lit(0.0)).alias("area"))

    return in_slices(a, b, len(values), make)


@tidy
def sigma_surfaces(a: DataFrame, grid: DataFrame, surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of surfaces(structure_id, surface, value): each structure's for several widths of the kernel."""
    keyed = lambda df: df.join(surfaces, "structure_id").drop("structure_id").withColumnRenamed("surface", "structure_id")
    cells = materialize(keyed(density.voxels(a, grid)).drop("value"))
    return surface_of(isosurface.level_cubes(cells, keyed(grid), keyed(isosurface.needs(a)).drop("value"), "value"))


def sensitivity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sweeps in one table: structure_id, param, value, area, in that order."""
    return sweep_cutoff(a, b).unionByName(sweep_sigma(a, b)).orderBy("structure_id", "param", "value")
