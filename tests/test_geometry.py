"""Properties of surfaces, projections and files that SQL doesn't state."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from interfacet.operators import isosurface, mesh, project, structure
from interfacet.plans import queries as plans
from interfacet.plans import sweeps
from interfacet.sources import structures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sphere(spark):
    """(faces, vertices) of a sphere of radius 6 about (10, 10, 10)."""
    cells = [("S", x, y, z, max(0.0, 10 - math.dist((x, y, z), (10, 10, 10)))) for x in range(21) for y in range(21) for z in range(21)]
    cells = spark.createDataFrame([c for c in cells if c[4]], "structure_id string, ix long, iy long, iz long, d double")
    grid = spark.createDataFrame([("S", 0.0, 0.0, 0.0, 21, 21, 21)], "structure_id string, lox double, loy double, loz double, nx long, ny long, nz long")
    level = spark.createDataFrame([("S", 4.0)], "structure_id string, level double")
    return isosurface.faces(cells, grid, level).cache(), isosurface.vertices(isosurface.crossing_edges(cells, grid, level.withColumnRenamed("level", "start")), level).cache()


def test_every_case_crosses_the_right_edges():
    for mask in range(1, 255):
        want = {(min(a, b), (a ^ b).bit_length() - 1) for a in range(8) for b in range(8) if (a ^ b).bit_count() == 1 and (mask >> a & 1) != (mask >> b & 1)}
        assert {e for t in isosurface.triangles(mask) for e in t} == want


def test_sphere_is_closed(sphere):
    faces, points = sphere
    f, v, e = faces.count(), points.count(), mesh.adjacency(faces).count()
    assert mesh.boundary(faces).count() == 0 and v - e + f == 2 and 3 * f == 2 * e
    area = mesh.surface(mesh.measured(faces, points)).first()["area"]
    assert abs(area / (4 * math.pi * 36) - 1) < 0.03
    assert abs(abs(mesh.volume(faces, points).first()["volume"]) / (4 / 3 * math.pi * 216) - 1) < 0.03
    assert mesh.components(faces).select("component").distinct().count() == 1


def test_edges_equal_brute_force(spark):
    """Sparse cells with gaps, cells at every border and a density at a level; a structure of one cell, and one without a surface."""
    size, rng = 5, random.Random(3)
    dense = {("S", *at): rng.choice([0.0125, 0.02, 0.03, 0.06, 0.1, 0.4]) for at in itertools.product(range(size), repeat=3) if rng.random() < 0.6}
    cells = dense | {("T", 2, 2, 2): 0.04} | {("U", *at): 1.0 for at in itertools.product(range(size), repeat=3)}
    start = {"S": 0.1, "T": 0.02, "U": 0.1}
    want = set()
    for s, (x, y, z), axis in itertools.product(start, itertools.product(range(size), repeat=3), range(3)):
        to = tuple(c + (k == axis) for k, c in enumerate((x, y, z)))
        d0, d1 = cells.get((s, x, y, z), 0.0), cells.get((s, *to), 0.0)
        if max(to) < size and any((d0 > start[s] / 2**i) != (d1 > start[s] / 2**i) for i in range(4)):
            want.add((s, x, y, z, axis, d0, d1))
    rows = spark.createDataFrame([(*k, d) for k, d in cells.items()], "structure_id string, ix long, iy long, iz long, d double")
    grid = spark.createDataFrame([(s, size, size, size) for s in start], "structure_id string, nx long, ny long, nz long")
    first = isosurface.starts(rows)
    assert {r["structure_id"]: r["start"] for r in first.collect()} == start
    edges = isosurface.crossing_edges(rows, grid, first)
    got = [tuple(r) for r in edges.select("structure_id", "ix", "iy", "iz", "axis", "d0", "d1").collect()]
    assert len(got) == len(set(got)) and set(got) == want and "U" not in {r[0] for r in got}
    atoms = spark.createDataFrame([(s,) for s in start], "structure_id string")
    assert {(r["structure_id"], r["n0"]) for r in isosurface.levels(edges, first, atoms).collect()} >= {("T", 6), ("U", 0)}


def test_smoothing_keeps_the_volume(sphere):
    faces, points = sphere
    was, now = (mesh.volume(faces, p).first()["volume"] for p in (points, mesh.smoothed(faces, points, 2)))
    assert abs(was - now) < 1e-6 * abs(was)


def test_tasks_equal_joins(spark):
    """Components and smoothing of small meshes in tasks, and of the same by joins."""
    faces, points = (plans.view(spark, SF, v).where("mesh_id < 3") for v in ("mesh_faces", "mesh_vertices"))
    odd = spark.createDataFrame([(9, 5, 0, 1, 2), (9, 3, 1, 0, 3), (9, 4, 0, 1, 4), (9, 8, 5, 6, 7), (9, 7, 6, 5, 7)], faces.schema)  # one edge of three faces, a face twice
    faces = faces.unionByName(odd).cache()
    points = points.where("vid <> 44").unionByName(spark.createDataFrame([(9, v, float(v), 0.0, 1.0) for v in range(9)], points.schema)).cache()
    one, two = (sorted(mesh.components(faces, large).collect()) for large in (1000, 1))
    assert one == two and {(r["fid"], r["component"]) for r in one if r["mesh_id"] == 9} == {(3, 3), (4, 4), (5, 5), (7, 7), (8, 7)}
    one, two = ({(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in mesh.smoothed(faces, points, 2, large).collect()} for large in (1000, 1))
    assert one.keys() == two.keys() and len(one) == points.count()
    assert all(abs(x - y) < 1e-9 for v in one for x, y in zip(one[v], two[v], strict=True))
    assert one[9, 1] == (1.0, 0.0, 1.0)  # no volume: the mesh stays as it was


def test_cleaning_in_tasks_equals_cleaning_by_joins(spark):
    """Meshes with copies of vertices, repeated and empty faces, unknown corners and values that aren't finite."""
    faces, points = (plans.view(spark, SF, v).where("mesh_id < 3") for v in ("mesh_faces", "mesh_vertices"))
    at = points.withColumn("x", F.when((F.col("mesh_id") == 1) & (F.col("vid") == 7), F.lit(float("nan"))).otherwise(F.col("x")))
    at = at.unionByName(at.selectExpr("mesh_id", "vid + 1000 AS vid", "x", "y + 1e-10 AS y", "z")).unionByName(at.selectExpr("mesh_id", "vid + 5000 AS vid", "-x AS x", "y", "z"))
    more = faces.selectExpr("mesh_id", "fid + 1000 AS fid", "b + 1000 AS a", "c AS b", "a AS c").unionByName(faces.selectExpr("mesh_id", "fid + 2000 AS fid", "a", "a + 1000 AS b", "c")).unionByName(faces.selectExpr("mesh_id", "fid + 3000 AS fid", "a", "b", "c + 9000 AS c"))
    faces = faces.selectExpr("mesh_id", "fid", "a", "b", "c + 1000 AS c").unionByName(more).unionByName(spark.createDataFrame([(8, 1, 0, 1, 2)], faces.schema)).cache()
    at = at.unionByName(spark.createDataFrame([(9, 1, 0.0, 0.0, 0.0)], points.schema)).cache()  # faces alone, vertices alone
    for clean in (mesh.validated, lambda f, v, large: mesh.finished(f, v, 2, large), lambda f, v, large: mesh.sanitised(f, v.where("not isnan(x)"), 2, large)):
        (f1, v1), (f2, v2) = (clean(faces, at, large) for large in (100000, 1))
        assert sorted(map(str, f1.collect())) == sorted(map(str, f2.collect())) and f1.count() > 100
        one, two = ({(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in v.collect()} for v in (v1, v2))
        assert one.keys() == two.keys() and all(abs(x - y) < 1e-9 or x != x and y != y for k in one for x, y in zip(one[k], two[k], strict=True))


def test_frame_orders_variances_and_keeps_distances(spark, sphere):
    faces, _ = plans.meshes(spark, SF)
    faces, points = faces.where("mesh_id < 3"), plans.view(spark, SF, "mesh_vertices").where("mesh_id < 3")
    points = points.withColumn("x", F.col("x") * 3)  # the grid alone has two equal variances
    frame = project.principal_frame(faces, points)
    for r in frame.groupBy("mesh_id").agg(*[F.var_pop(k).alias(k) for k in "xyz"]).collect():
        assert r["x"] <= r["y"] <= r["z"]
    a, b = ({(r["mesh_id"], r["vid"]): (r["x"], r["y"], r["z"]) for r in df.collect()} for df in (points, frame))
    assert all(abs(math.dist(a[m, 0], a[m, k]) - math.dist(b[m, 0], b[m, k])) < 1e-9 for m in range(3) for k in range(1, 100))


def test_flat_patch_has_no_distortion(spark):
    faces, points = plans.meshes(spark, SF)
    flat = points.withColumn("z", F.lit(0.0))
    got = project.distortion(faces, flat, flat.selectExpr("mesh_id", "vid", "2*x AS u", "2*y AS v")).agg(F.max("area_std").alias("s"), F.max("angle_mae").alias("m")).first()
    assert got["s"] < 1e-9 and got["m"] < 1e-5
    none = project.distortion(faces, points, points.selectExpr("mesh_id", "vid", "x AS u", "y AS v").where("false")).select("area_std", "angle_mae", "status").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0.0, "undefined")]


def test_reports(spark, tmp_path):
    a, b = plans.sides(spark, SF)
    rows = sweeps.sensitivity(a, plans.points(b)).collect()
    assert rows == sorted(rows, key=lambda r: r[:3]) and len(rows) == 2 * (11 + 6)
    for s in {r["structure_id"] for r in rows}:
        cutoff, sigma = ({r["value"]: r["area"] for r in rows if r["structure_id"] == s and r["param"] == p} for p in ("cutoff", "sigma"))
        areas = [cutoff[v] for v in sorted(cutoff)]
        assert areas[-1] > 0 and areas == sorted(areas)
        assert abs(cutoff[5.0] - sigma[1.5]) < 1e-6 and all(v > 0 for v in sigma.values())
    structures.write_distortion(plans.QUERIES["p2_distortion_report"](spark, SF), str(tmp_path / "report"))
    report = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "report")).collect()
    assert {r["category"] for r in report} == {"Auto_Generated"}
    assert {"weighted_avg", "largest", "1"} <= {r["patch_id"] for r in report}
    assert all(0 <= r["planar_angle_mae"] <= 180 for r in report)


def test_files(spark, tmp_path):
    (tmp_path / "one.pdb").write_text("MODEL        1\nATOM      1  CA  ALA A   5A     1.000   2.500  -3.000  1.00  0.00           C  \nENDMDL\nMODEL        2\nATOM      1  CA  ALA A   5A     1.000   2.500  -3.000  1.00  0.00           C  \n")
    (tmp_path / "two.cif").write_text("data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.Cartn_x\nHETATM 7 \"O'\" B 1.5\n#\n")
    (tmp_path / "three.PDB").write_text("END\n")
    (tmp_path / "empty.pdb").write_text("")
    got = {(r["structure_id"], r["model"], r["atom_name"], r["chain_id"], r["res_seq"], r["icode"], r["x"]) for r in structures.read_atoms(spark, str(tmp_path)).collect()}
    assert got == {("one", 1, "CA", "A", 5, "A", 1.0), ("one", 2, "CA", "A", 5, "A", 1.0), ("two", None, "O'", "B", None, None, 1.5)}
    assert {r["structure_id"] for r in structures.list_structures(spark, str(tmp_path)).collect()} == {"one", "three"}
    (tmp_path / "one").write_text("END\n")
    wanted = spark.createDataFrame([("one", "A"), ("two.cif", "A"), ("three", "A"), ("empty", "B"), (None, "A")], "structure_id string, chain_a string")
    found, status = structure.resolved_targets(wanted, structures.list_files(spark, str(tmp_path)))
    assert {(r["structure_id"], r["file"].rsplit("/", 1)[1]) for r in found.collect()} == {("one", "one.pdb"), ("two.cif", "two.cif")}
    assert {(r["structure_id"], r["stage"], r["reason"]) for r in status.collect()} == {(i, "load", "no file") for i in ("three", "empty", None)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "targets.csv").write_text("PDB,Chain_A,Chain_B,Category\n1abc,A,B,\n2abc,H,L,x\n")
    assert [r["Category"] for r in structures.read_targets(spark, str(tmp_path / "t")).orderBy("PDB").collect()] == ["Uncategorized", "x"]
    sweep = spark.createDataFrame([("S0", "cutoff", 3.0, 1.5)], "structure_id string, param string, value double, area double")
    structures.write_sweep(sweep, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["area"] == "1.5"


def test_nested_patches_equal_copies(spark):
    """Patches at every cutoff: of each mesh in one task, by joins over copies, and each cutoff on its own."""
    faces, points = (plans.view(spark, SF, v).where("mesh_id < 4") for v in ("mesh_faces", "mesh_vertices"))
    odd = spark.createDataFrame([(9, 5, 0, 1, 2), (9, 3, 1, 0, 3), (9, 4, 0, 1, 4), (9, 8, 5, 6, 7), (9, 7, 6, 5, 7)], faces.schema)  # an edge that gets a third face, a face twice
    dist = F.when(F.col("mesh_id") == 9, F.col("fid") - 2.5).otherwise((F.col("fid") * 37 % 100) / 20)
    faces = faces.unionByName(odd).withColumn("dist", dist).cache()
    values = [0.5, 1.0, 1.0, 2.0, 3.0, 4.5, 5.0, 9.0]
    row = lambda r: (r["mesh_id"], r["value"], r["patch_id"], r["fid"], r["a"], r["b"], r["c"])
    for least in (1, 3, 20):
        one, two = (sorted(row(r) for r in mesh.nested_patches(faces, values, least, large).collect()) for large in (10000, 1))
        each = [(r["mesh_id"], v, r["patch_id"], r["fid"], r["a"], r["b"], r["c"]) for v in set(values) for r in mesh.patches(faces.where(F.col("dist") < v).drop("dist").cache(), least).collect()]
        assert one == two == sorted(each)
    assert mesh.nested_patches(faces.where("false"), values).count() == 0 and mesh.nested_patches(faces, []).count() == 0


def test_sinks_keep_order(spark, tmp_path):
    """The files of a sink, one after the other by name, hold the rows in order."""
    names = structure.residue_dictionary(plans.view(spark, SF, "atoms")).repartition(7)
    structures.write_dictionary(names, str(tmp_path / "names"))
    lines = [line for f in sorted((tmp_path / "names").glob("part-*.csv")) for line in f.read_text().splitlines()[1:]]
    assert lines == sorted(lines) and len(lines) == names.count()


def test_large_files_are_read_in_blocks(spark, tmp_path):
    """Files cut into blocks of a few lines give the atoms that whole texts give: numbers of lines, models and columns are carried on."""
    atom = "ATOM  {:>5d}  CA  ALA A{:>4d}    {:>8.3f}{:>8.3f}{:>8.3f}  1.00  0.00           C  \n"
    body = ["HEADER\n", "\n"]
    for model in range(3):
        body += [f"MODEL {model + 1:>8d}\n", *[atom.format(i, i, i / 2, model, -1.0) for i in range(40)], "ENDMDL\n"]
    (tmp_path / "many.pdb").write_text("".join(body))
    (tmp_path / "bare.pdb").write_text("".join(atom.format(i, i, 0.5, 1.5, 2.5) for i in range(30)))
    loop = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.auth_asym_id\n_atom_site.Cartn_x\n"
    (tmp_path / "wide.cif").write_text(loop + "".join(f"ATOM {i} \"O'\" B {i}.5\n" for i in range(60)) + "#\n")
    whole = structures.texts(spark, str(tmp_path))
    cif = F.col("file").endswith(".cif")
    want = sorted(map(str, structures.parse_pdb(whole.where(~cif)).unionByName(structures.parse_mmcif(whole.where(cif))).collect()))
    assert len(want) == 120 + 30 + 60
    for size in ("128m", "300b", "90b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = structures.read_atoms(spark, str(tmp_path))
            blocks = structures.file_lines(spark, str(tmp_path)).select("file", "block").distinct().count()
            assert (blocks > 20) == (size != "128m")
            assert sorted(map(str, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
