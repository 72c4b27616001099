"""What keeps disk bounded: tables that go when nothing reads them, one level of cubes, patches without joined corners, slices of structures."""

import numpy as np
from pyspark.sql import functions as F

from interfacet.operators import contacts, density, flatten, isosurface, mapview, mesh, project
from interfacet.plans import queries as plans
from interfacet.plans import reports, sweeps
from interfacet.sources.storage import materialize, tidy

SF = "/root/testdata/sf0.001"


def folders(spark):
    """Tables in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {f.getPath().getName() for f in fs.listStatus(place)} if fs.exists(place) else set()


def number(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_tables_go_unless_a_result_reads_them(spark):
    @tidy
    def inner():
        lost, kept = materialize(spark.range(5)), materialize(spark.range(7))
        return materialize(lost.join(kept, "id")), kept.where("id > 3")

    @tidy
    def outer():
        one, two = inner()
        return one.unionAll(two)

    before = folders(spark)
    given = materialize(spark.range(3))
    out = outer()
    assert len(folders(spark) - before) == 3  # given, and the two that out reads
    assert out.count() == 5 + 3 and given.count() == 3


def test_sweeps_leave_their_result_only_and_slices_agree(spark, monkeypatch):
    a, b = plans.sides(spark, SF)
    whole = {}
    for sweep, slice_ in ((sweeps.sweep_sigma, 10**9), (sweeps.sweep_sigma, 800), (sweeps.sweep_cutoff, 10**9), (sweeps.sweep_cutoff, 800)):
        monkeypatch.setattr(sweeps, "SLICE", slice_)
        values = (1.5, 2.0) if sweep is sweeps.sweep_sigma else (3.0, 5.0)
        before = folders(spark)
        out = sweep(a, plans.points(b), values)
        parts = a.count() * (2 if sweep is sweeps.sweep_sigma else 1) // slice_ + 1
        assert len(folders(spark) - before) <= parts
        rows = [r[:3] + (round(r[3], 6),) for r in number(out)]
        assert whole.setdefault(sweep, rows) == rows and len(rows) == 4 and all(r[3] > 0 for r in rows)


def test_cubes_of_one_level_equal_smoothed_cells(spark):
    """Several blocks, structures below the level, one that needs a lower level for its many atoms, one of another width."""
    rng = np.random.default_rng(4)
    shape = {"S": (70, 40, 33), "T": (22, 24, 34), "U": (31, 32, 65), "V": (30, 30, 30), "W": (40, 30, 30)}
    rows = {(s, *map(int, p)) for s, n in shape.items() for p in [[0, 0, 0], [31, 31, 32], [c - 1 for c in n], *rng.integers(0, n, (30, 3))] if s not in "TV" and all(c < m for c, m in zip(p, n, strict=True))} | {("T", 9, 9, 31), ("V", 15, 15, 15)}
    cells = spark.createDataFrame([(*k, 20.0 if k[0] in "SV" else 1.0) for k in rows], "structure_id string, ix long, iy long, iz long, d double")
    grid = spark.createDataFrame([(s, 0.5, 0.0, -3.0, *n, 2.0 if s == "W" else 1.5) for s, n in shape.items()], "structure_id string, lox double, loy double, loz double, nx long, ny long, nz long, sigma double")
    atoms = spark.createDataFrame([(s,) for s in shape for _ in range(1200 if s == "V" else 200)], "structure_id string")
    cubes = isosurface.level_cubes(cells, grid, isosurface.needs(atoms), "sigma")
    for sigma, some in ((1.5, "structure_id <> 'W'"), (2.0, "structure_id = 'W'")):
        all_cells = materialize(density.smooth(cells.where(some), grid.where(some).drop("sigma"), sigma))
        start = isosurface.starts(all_cells)
        edges = materialize(isosurface.crossing_edges(all_cells, grid.where(some), start))
        level = materialize(isosurface.levels(edges, start, atoms))
        got = cubes.where(some)
        assert number(got.select("structure_id", "level").distinct()) == number(level.select("structure_id", "level"))
        assert number(isosurface.level_vertices(got)) == number(isosurface.vertices(edges, level)) and edges.count() > 1000
        assert number(isosurface.cube_triangles(got)) == number(isosurface.faces(all_cells, grid.where(some), level))
        if sigma == 1.5:
            assert level.where("structure_id = 'V' and level < 0.1").count() and level.where("structure_id = 'S' and level = 0.1").count()


def test_near_patches_equal_joined_ones(spark):
    """Hundreds of meshes of equal ids in shared tasks, vertices near in some of them, two parts of a mesh, a mesh that is too large for a task."""
    rng = np.random.default_rng(3)
    spots = [(m, 2 * v + s, v, v + 1 if s == 0 else v + 6, v + 6 if s == 0 else v + 5) for m in range(60) for v in range(25) if v % 5 < 4 and v < 20 and (m % 2 or v // 5 != 1) for s in (0, 1)]
    faces = materialize(spark.createDataFrame(spots, "mesh_id long, fid long, a long, b long, c long").withColumn("mesh_id", F.concat(F.lit("M"), "mesh_id")))
    near = materialize(spark.createDataFrame([(f"M{m}", v, float(rng.uniform(1, 6))) for m in range(0, 60, 3) for v in range(30) if rng.random() < 0.4], "mesh_id string, vid long, dist double"))
    for large in (mesh.LARGE, 40):
        got = mesh.near_patches(faces, near, (3.0, 5.0), 4, large)
        for value in (3.0, 5.0):
            want = mesh.patches(materialize(mesh.touched_faces(faces, near.where(F.col("dist") < value))), 4)
            cols = ["mesh_id", "patch_id", "fid", "a", "b", "c"]
            assert number(got.where(F.col("value") == value).select(cols)) == number(want.select(cols)) and want.count()
    assert mesh.near_patches(faces, near, ()).count() == 0 and mesh.near_patches(faces.where("false"), near, (3.0,)).count() == 0


def test_areas_equal_those_of_sanitised_patches(spark):
    spots = [(m, 2 * v + s, v, v + 1 if s == 0 else v + 6, v + 6 if s == 0 else v + 5) for m in range(9) for v in range(20) if v % 5 < 4 for s in (0, 1)]
    faces = materialize(spark.createDataFrame(spots, "mesh_id long, fid long, a long, b long, c long"))
    at = materialize(spark.range(9 * 25).selectExpr("id div 25 AS mesh_id", "id % 25 AS vid", "1 + id % 5 + 0D AS x", "1 + id % 25 div 5 + 0D AS y", "CAST(3 + id * 7919 % 100 AS double) / 50 AS z"))
    want = {r["mesh_id"]: r["area"] for r in mesh.measured(*mesh.sanitised(faces, at)).groupBy("mesh_id").agg(F.sum("area").alias("area")).collect()}
    for large in (mesh.LARGE, 10):
        got = {r["mesh_id"]: r["area"] for r in mesh.sanitised_areas(faces, at, large=large).collect()}
        assert set(got) == set(want) == set(range(9)) and all(abs(got[m] - want[m]) < 1e-9 for m in want)


def test_maps_from_tasks_equal_those_by_joins(spark):
    """Meshes of equal ids in shared tasks: one of two parts, a closed one, one with a vertex that isn't finite, one with equal vertices; no matrix is left on disk."""
    grid = [(2 * v + s, v, v + 1 if s == 0 else v + 6, v + 6 if s == 0 else v + 5) for v in range(20) if v % 5 < 4 for s in (0, 1)]
    faces = [(m, *f) for m in range(12) for f in grid if m != 1 or f[0] // 10 != 1] + [(20, 0, 0, 1, 2), (20, 1, 0, 2, 3), (20, 2, 0, 3, 1), (20, 3, 1, 3, 2)]
    spot = lambda m, v: (float(v % 5), float(v // 5) + 0.2 * (v % 5), float((v * 7919 + m * 31) % 100) / 90)
    at = [(m, v, *(spot(m, v) if (m, v) != (2, 7) else (float("nan"), 0.0, 0.0))) for m in range(12) for v in range(25)]
    at = [(m, v, *(spot(m, 12) if (m, v) == (3, 13) else p)) for m, v, *p in at] + [(20, 0, 0.0, 0.0, 0.0), (20, 1, 1.0, 0.0, 0.0), (20, 2, 0.0, 1.0, 0.0), (20, 3, 0.0, 0.0, 1.0)]
    faces, at = materialize(spark.createDataFrame(faces, "mesh_id long, fid long, a long, b long, c long")), materialize(spark.createDataFrame(at, "mesh_id long, vid long, x double, y double, z double"))
    before = folders(spark)
    f, v = flatten.cleaned(faces, at)
    uv = flatten.flattened(f, v)
    assert len(folders(spark) - before) <= 4
    joined = flatten.cleaned(faces, at, 20)
    assert all(set(map(str, number(x))) == set(map(str, number(y))) for x, y in zip((f, v), joined, strict=True))
    assert number(flatten.boundary_loops(faces)) == number(flatten.boundary_loops(faces, 20))
    want = project.normal_uv(flatten.conformal(f, v, materialize(flatten.longest_loop(flatten.boundary_loops(f)))))
    got, want = ({(r["mesh_id"], r["vid"]): (r["u"], r["v"]) for r in df.collect()} for df in (uv, want))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in got)
    assert {m for m, _ in got} == set(range(12)) - {2} and not uv.where("method <> 'conformal'").count()


def test_pairs_of_atoms_are_neither_sorted_nor_compared_by_text(spark):
    a, b = plans.sides(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan(mapview.close_atoms(a, b)) and "SortAggregate" not in plan(sweeps.distances(a.withColumnsRenamed({"structure_id": "mesh_id", "serial": "vid"}), plans.points(b), 5.0))
    pairs = contacts.typed_pairs(a, b)
    assert not {"a_res_name", "b_element"} & set(pairs.columns)
    atom = "res_name string, atom_name string, element string, serial long, structure_id string, res_seq int, x double, y double, z double"
    kinds = [("ARG", "NZ", "N"), ("ASP", "OD1", "O"), (None, "OXT", "O"), (None, "CB", "C"), ("ALA", None, "C"), ("HIS", None, "C"), ("PHE", "CZ", "C"), ("CYS", "SG", "S"), ("ALA", "CB", None)]
    one, two = (spark.createDataFrame([(*k, i, "S", 1, 0.0, 0.0, z) for i, k in enumerate(kinds)], atom) for z in (0.0, 3.9))
    got = {(r["serial"], r["b_serial"]): r["type"] for r in contacts.typed_pairs(one, two).collect()}
    assert len(got) == 81 and got[0, 1] == got[0, 2] == "salt_bridge" and got[0, 6] == "cation_pi" and got[6, 7] == "sulfur_pi" and got[6, 6] == "pi_stack"
    assert got[3, 3] is None and got[4, 4] is None and got[5, 5] is None and got[8, 8] is None and got[1, 1] is None


def test_reports_leave_their_rows_only(spark):
    spots = [(2 * v + s, v, v + 1 if s == 0 else v + 6, v + 6 if s == 0 else v + 5) for v in range(20) if v % 5 < 4 for s in (0, 1)]
    patches = materialize(spark.createDataFrame([("S", 1, *f) for f in spots], "structure_id string, patch_id int, fid long, a long, b long, c long"))
    at = materialize(spark.range(25).selectExpr("'S' AS mesh_id", "id AS vid", "id % 5 + 0D AS x", "id div 5 + 0D AS y", "CAST(id * 7919 % 100 AS double) / 90 AS z"))
    before = folders(spark)
    rows = reports.distortion_report(patches, at)
    assert len(folders(spark) - before) == 1
    assert {r["patch_id"] for r in rows.collect()} == {"1", "weighted_avg", "largest"} and not rows.where("status <> 'ok'").count()
