"""Properties of flattened patches and interface maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from interfacet.operators import flatten, mapview, project, structure
from interfacet.plans import queries as plans
from interfacet.plans import reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def patch(spark):
    """(faces, vertices, loop) of one whole height field."""
    faces, at = (df.where("mesh_id = 1").drop("status") for df in plans.meshes(spark, SF))
    faces, at = flatten.cleaned(faces, at)
    return faces, at, flatten.longest_loop(flatten.boundary_loops(faces)).cache()


def test_flat_patch_keeps_its_shape(patch):
    faces, at, loop = patch
    flat = at.withColumn("z", F.lit(0.0))
    got = project.distortion(faces, flat, flatten.conformal(faces, flat, loop)).first()
    assert got["area_std"] < 1e-8 and got["angle_mae"] < 1e-6


def test_harmonic_map_stays_in_the_disk(patch):
    faces, at, loop = patch
    ring = {r["vid"] for r in loop.collect()}
    uv = flatten.harmonic(faces, at, loop).collect()
    assert len(uv) == at.count()
    assert all(abs(r["u"] ** 2 + r["v"] ** 2 - 1) < 1e-9 if r["vid"] in ring else r["u"] ** 2 + r["v"] ** 2 < 1 for r in uv)


def test_joined_solver_equals_task_solver(patch):
    faces, at, _ = patch
    faces, at = flatten.cleaned(faces.where("a < 20 and a % 10 < 2"), at)
    loop = flatten.longest_loop(flatten.boundary_loops(faces)).cache()
    one, two = ({r["vid"]: (r["u"], r["v"]) for r in flatten.conformal(faces, at, loop, large).collect()} for large in (1000, 1))
    assert one.keys() == two.keys() and len(one) == 9
    assert all(abs(x - y) < 1e-9 for v in one for x, y in zip(one[v], two[v], strict=True))


def test_touching_loops_and_closed_surfaces(spark):
    bow = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 2, 3, 4)], "mesh_id string, fid long, a long, b long, c long")
    assert flatten.boundary_loops(bow).count() == 6
    ball = spark.createDataFrame([("t", i, *f) for i, f in enumerate([(0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2)])], bow.schema)
    at = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0), ("t", 1, 1.0, 0.0, 0.0), ("t", 2, 0.0, 1.0, 0.0), ("t", 3, 0.0, 0.0, 1.0)], "mesh_id string, vid long, x double, y double, z double")
    assert flatten.boundary_loops(ball).count() == 0 and flatten.flattened(ball, at).count() == 0


def test_loops_in_tasks_equal_loops_by_joins(spark):
    bow = [("bow", i, *f) for i, f in enumerate([(0, 1, 2), (2, 3, 4), (9, 5, 6), (9, 7, 8)])]
    ring = [("ring", i, *f) for i, f in enumerate([(0, 1, 4), (4, 1, 5), (1, 2, 5), (5, 2, 6), (2, 3, 6), (6, 3, 7), (3, 0, 7), (7, 0, 4)])]
    odd = [("odd", 0, 0, 1, 2), ("odd", 1, 0, 1, 3), ("odd", 2, 0, 1, 4), ("ball", 0, 0, 1, 2), ("ball", 1, 0, 2, 1)]  # an edge of three faces, and no boundary
    small = spark.createDataFrame(bow + ring + odd, "mesh_id string, fid long, a long, b long, c long")
    sheets = plans.meshes(spark, SF)[0].where("mesh_id < 4").withColumn("mesh_id", F.col("mesh_id").cast("string"))
    faces = sheets.unionByName(small).cache()
    one, two = (sorted(map(str, flatten.boundary_loops(faces, large).collect())) for large in (1000, 1))
    assert one == two and len(one) > 100


def dense_entries(faces, at):
    """The Hermitian matrix of conformal energy: for opposite edges e, conj(e_i) e_j / (2 area) in the plane of each face."""
    n = len(at)
    m = np.zeros((n, n), complex)
    for t in faces:
        p = at[list(t)]
        x = (p[1] - p[0]) / np.linalg.norm(p[1] - p[0])
        normal = np.cross(p[1] - p[0], p[2] - p[0])
        y = np.cross(normal / np.linalg.norm(normal), x)
        z = (p - p[0]) @ x + 1j * ((p - p[0]) @ y)
        e = np.array([z[2] - z[1], z[0] - z[2], z[1] - z[0]])
        for i in range(3):
            for j in range(3):
                m[t[i], t[j]] += np.conj(e[i]) * e[j] / np.linalg.norm(normal)
    return m


def test_curved_patch_equals_dense_solve(patch):
    """Both maps of a curved patch, against one dense linear system each."""
    faces, at, loop = patch
    points = {r["vid"]: np.array([r["x"], r["y"], r["z"]]) for r in at.collect()}
    names = sorted(points)
    place = {v: i for i, v in enumerate(names)}
    xyz = np.array([points[v] for v in names])
    m = dense_entries([[place[r[k]] for k in "abc"] for r in faces.collect()], xyz)
    ring = [place[r["vid"]] for r in loop.orderBy("pos").collect()]
    first = ring[0]
    far = max(ring, key=lambda i: (np.linalg.norm(xyz[i] - xyz[first]), -i))
    for known, got in (({first: 0, far: 1}, flatten.conformal), (None, flatten.harmonic)):
        if known is None:
            step = [np.linalg.norm(xyz[q] - xyz[p]) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
            known = {v: np.exp(2j * np.pi * sum(step[:k]) / sum(step)) for k, v in enumerate(ring)}
        a = m if got is flatten.conformal else m.real
        fixed = sorted(known)
        free = [i for i in range(len(names)) if i not in known]
        want = np.zeros(len(names), complex)
        want[fixed] = [known[i] for i in fixed]
        want[free] = np.linalg.solve(a[np.ix_(free, free)], -a[np.ix_(free, fixed)] @ want[fixed])
        uv = {r["vid"]: complex(r["u"], r["v"]) for r in got(faces, at, loop).collect()}
        if got is flatten.conformal:  # the other sense of rotation is as good
            want = min((want, want.conj()), key=lambda w: abs(uv[names[free[0]]] - w[free[0]]))
        assert max(abs(uv[v] - want[place[v]]) for v in names) < 1e-6


def test_map_restyles_and_round_trips(spark, tmp_path):
    rows = [("S", 1, 5, "", "ALA", 0.1, 0.2, ["default", "hbond"]), ("S", 1, 6, "A", None, 0.3, 0.4, [])]
    placed = spark.createDataFrame(rows, "structure_id string, patch_id int, res_seq int, icode string, res_name string, u double, v double, types array<string>")
    uv = spark.createDataFrame([("S", 1, i, i / 3, 0.0) for i in range(3)], "structure_id string, patch_id int, vid long, u double, v double")
    faces = spark.createDataFrame([("S", 1, 0, 1, 2)], "structure_id string, patch_id int, a long, b long, c long")
    points = mapview.styled(placed)
    drawn = mapview.InterfaceMap(placed, points, mapview.drawn_edges(faces, uv), mapview.legend(points))
    assert [(r["uid"], r["type"]) for r in points.collect()] == [("1_ALA5", "default")]
    assert drawn.edges.count() == 3
    other = mapview.restyled(drawn, active=["hbond"])
    assert [(r["type"], r["color"], r["rank"]) for r in other.legend.collect()] == [("hbond", "#0000FF", 5)]
    plain = mapview.restyled(drawn, color_by_type=False, color="red").points
    assert sorted(r["label"] for r in plain.collect()) == ["6", "ALA5"] and plain.where("type is not null").count() == 0
    mapview.write_interface_map(drawn, str(tmp_path / "map"))
    back = mapview.read_interface_map(spark, str(tmp_path / "map"))
    for name in mapview.InterfaceMap._fields:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(drawn, name).select(*getattr(back, name).columns).collect()))
    again = mapview.restyled(back, active=["hbond"])  # from what was saved alone
    for name in ("points", "legend"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(other, name).collect()))


def test_each_structure_chooses_its_types(spark):
    """Structures with annotated residues take types from them and place all residues on the patch, others go by distance."""
    a = [(s, k, k, "ALA", "CB", "C", 4.0 * k, 0.0, 0.0) for s in ("D", "N") for k in range(5)]
    a = spark.createDataFrame(a, "structure_id string, serial long, res_seq int, res_name string, atom_name string, element string, x double, y double, z double")
    b = a.where("serial < 2").withColumns({"z": F.col("z") + 4})
    patch = a.select("structure_id", F.lit(1).alias("patch_id"), F.col("serial").alias("vid"), "x", "y", "z")
    uv = patch.select("structure_id", "patch_id", "vid", (F.col("x") / 16).alias("u"), F.lit(0.0).alias("v"))
    none = patch.where("false").selectExpr("structure_id", "patch_id", "vid AS a", "vid AS b", "vid AS c")
    noted = spark.createDataFrame([("N", 3, ["hbond", "pi_stack"]), ("N", 9, ["hbond"])], "structure_id string, res_seq int, types array<string>")
    shown = lambda **k: {(r["structure_id"], r["uid"], r["type"]) for r in mapview.interface_map(none, patch, uv, a, b, noted, **k).points.collect()}
    assert shown() == {("N", "1_ALA3", "pi_stack"), *[("D", f"1_ALA{k}", "hydrophobic") for k in (0, 1)]}
    assert shown(color_by_type=False) == {*[("N", f"1_ALA{k}", None) for k in range(5)], *[("D", f"1_ALA{k}", None) for k in range(3)]}
    plain = mapview.interface_map(none, patch, uv, a, b).points
    assert {(r["structure_id"], r["label"]) for r in plain.collect()} == {(s, f"ALA{k}") for s in "DN" for k in (0, 1)}


def test_reasons_of_meshes_without_a_map(spark):
    sheet = [("flat", 0, 0, 1, 2), ("flat", 1, 1, 3, 2), ("ball", 0, 0, 1, 2), ("ball", 1, 0, 2, 3), ("ball", 2, 0, 3, 1), ("ball", 3, 1, 3, 2), ("line", 0, 0, 1, 4)]
    faces = spark.createDataFrame(sheet, "mesh_id string, fid long, a long, b long, c long")
    spot = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.5), (4, 2.0, 0.0, 0.0)]
    at = spark.createDataFrame([(m, *p) for m in ("flat", "ball", "line") for p in spot], "mesh_id string, vid long, x double, y double, z double")
    names = at.select("mesh_id").distinct().unionByName(spark.createDataFrame([("gone",)], "mesh_id string"))
    uv, lost = flatten.flattened_or_not(names, *flatten.cleaned(faces, at))
    assert {r["mesh_id"] for r in uv.collect()} == {"flat"}
    assert {tuple(r) for r in lost.collect()} == {("ball", "no boundary"), ("line", "no valid faces"), ("gone", "no valid faces")}


def test_patch_that_splits_has_no_conformal_metrics(spark):
    """Two parts in one patch: all vertices count, projections see all of it, the conformal metrics are 0.0 and the status says why."""
    faces, at = (df.where("mesh_id < 2").drop("status") for df in plans.meshes(spark, SF))
    patches = faces.selectExpr("'S' AS structure_id", "mesh_id + 1 AS patch_id", "mesh_id * 1000 + fid AS fid", *[f"mesh_id * 1000 + {c} AS {c}" for c in "abc"])
    vertices = at.selectExpr("'S' AS mesh_id", "mesh_id * 1000 + vid AS vid", "x", "y", "z")
    rows = {r["patch_id"]: r for r in reports.distortion_report(patches, vertices, raw=True).collect()}  # mesh 0 has two parts
    assert rows["1"]["status"] == "component dropped" and rows["2"]["status"] == "ok" and rows["weighted_avg"]["status"] == "component dropped"
    assert rows["1"]["vertices"] == rows["2"]["vertices"] == 100 and rows["weighted_avg"]["vertices"] == 200
    assert rows["1"]["conformal_angle_mae"] == rows["1"]["conformal_area_std"] == 0.0 and rows["1"]["planar_angle_mae"] > 0 and rows["2"]["conformal_angle_mae"] > 0
    assert rows["weighted_avg"]["conformal_angle_mae"] == round(rows["2"]["conformal_angle_mae"] / 2, 4)
    assert rows["largest"]["planar_angle_mae"] == rows["1"]["planar_angle_mae"] == round(rows["1"]["raw_planar_angle_mae"], 2)
    kept = {r["patch_id"]: r for r in reports.distortion_report(patches, vertices, skip_failed=True).collect()}
    assert kept["weighted_avg"]["vertices"] == 100 and kept["weighted_avg"]["conformal_angle_mae"] == kept["2"]["conformal_angle_mae"]


def test_dimers(spark):
    atoms = plans.view(spark, SF, "atoms")
    long_b = atoms.where("structure_id = 'S0' and (chain_id = 'B' or res_seq < 5)")  # the shorter chain is A
    long_b = long_b.withColumn("chain_id", F.when(F.col("chain_id") == "B", "C").otherwise("A"))
    kept, status = structure.normalized_dimers(long_b.unionByName(atoms.where("structure_id = 'S1' and chain_id = 'A'")))
    assert kept.count() == 0
    assert {(r["structure_id"], r["reason"]) for r in status.collect()} == {("S0", "name conflict"), ("S1", "not two chains")}
    swapped, _ = structure.normalized_dimers(long_b, "swap")
    assert swapped.where("chain_id = 'B'").agg(F.max("res_seq").alias("m")).first()["m"] < 5


def test_map_query(spark):
    rows = plans.QUERIES["p1_interface_map"](spark, SF).collect()
    assert rows and all(0 <= r["u"] <= 1 and 0 <= r["v"] <= 1 and r["type"] for r in rows)
