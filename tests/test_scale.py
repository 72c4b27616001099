"""What lets the geometry grow: plans and tables that stay bounded, with the results of plainer ways."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfacet.operators import density, flatten, isosurface, mesh, spatial
from interfacet.sources.storage import materialize


def test_copied_rows_are_not_broadcast(spark):
    left = spark.range(1000).selectExpr("id % 3 AS s", "id", "id / 7D AS x", "0D AS y", "0D AS z")
    right = spark.range(1000).selectExpr("id % 3 AS s", "id AS b", "id / 7D AS bx", "0D AS by", "0D AS bz")
    plan = spatial.near_pairs(left, right, ["s"], 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [s" in plan


def test_pairs_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    nan = float("nan")
    rows = [[(int(i % 4), int(i), *map(float, p)) for i, p in enumerate(rng.normal(c, 6, (150, 3)))] + [(0, 900, nan, 0.0, 0.0), (9 + int(c), 901, 0.0, 0.0, 0.0)] for c in (0, 5)]
    found = spatial.near_pairs(spark.createDataFrame(rows[0], "s int, id int, x double, y double, z double"), spark.createDataFrame(rows[1], "s int, b int, bx double, by double, bz double"), ["s"], 4.0)
    want = {(p[1], q[1]) for p in rows[0] for q in rows[1] if p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True)) <= 16}
    got = [(r["id"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many = materialize(spark.range(2_000_000).selectExpr("id", "id AS a", "0L AS b"))
    plan = spark.range(5_000_000).selectExpr("id", "id AS c").join(many.where("b = 0"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    few = materialize(spark.range(100).selectExpr("id", "id AS a"))
    assert "Broadcast" in spark.range(5_000_000).join(few, "id")._jdf.queryExecution().executedPlan().toString()


def test_smoothing_by_blocks_equals_dense_arrays(spark):
    """Grids of several blocks, counts at their borders; and one that is smaller than the kernel."""
    rng = np.random.default_rng(2)
    for shape, sigma in (((70, 40, 33), 1.5), ((40, 21, 65), 3.0)):
        at = np.unique(np.r_[rng.integers(0, shape, (40, 3)), [[0, 0, 0], [31, 31, 32], [32, 0, 31], [s - 1 for s in shape]]] % np.array(shape), axis=0)
        dense = np.zeros(shape)
        dense[tuple(at.T)] = 1 + np.arange(len(at)) % 3
        cells = spark.createDataFrame([("S", *map(int, p), float(dense[tuple(p)])) for p in at], "structure_id string, ix long, iy long, iz long, d double")
        grid = spark.createDataFrame([("S", *shape)], "structure_id string, nx long, ny long, nz long")
        got = np.zeros(shape)
        out = density.smooth(cells, grid, sigma)
        for r in out.collect():
            assert not got[r["ix"], r["iy"], r["iz"]]
            got[r["ix"], r["iy"], r["iz"]] = r["d"]
        for axis in range(3):
            pad = [(density.kernel(sigma)[-1][0],) * 2 if k == axis else (0, 0) for k in range(3)]
            dense = np.apply_along_axis(np.convolve, axis, np.pad(dense, pad, mode="symmetric"), [w for _, w in density.kernel(sigma)], "valid")
        assert np.allclose(got, dense, atol=1e-12)
    plan = density.smooth(cells, grid, sigma)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # two of the join of counts with their grid, one of counts
    tiny = density.smooth(spark.createDataFrame([("S", 0, 0, 0, 1.0)], "structure_id string, ix long, iy long, iz long, d double"), spark.createDataFrame([("S", 5, 50, 50)], "structure_id string, nx long, ny long, nz long"))
    assert abs(tiny.agg(F.sum("d")).first()[0] - 1) < 1e-9 and tiny.where("ix = 5").count()  # as SQL has it


def test_small_meshes_share_tasks_but_nothing_else(spark):
    """Hundreds of meshes of equal ids and places: few tasks, each mesh on its own, one without faces and one alone in its task."""
    faces = spark.range(400).selectExpr("id - 200 AS mesh_id", "explode(array(struct(5L AS fid, 1L AS a, 2L AS b, 3L AS c), struct(9L AS fid, 2L AS a, 4L AS b, 3L AS c), struct(-3L AS fid, 7L AS a, 8L AS b, 9L AS c))) AS t").select("mesh_id", "t.*")
    at = spark.range(401).selectExpr("id - 200 AS mesh_id", "explode(sequence(1L, 9L)) AS vid").selectExpr("mesh_id", "vid", "CAST(vid % 2 AS double) AS x", "CAST(vid % 3 AS double) AS y", "CAST(vid AS double) AS z")
    faces, at = materialize(faces), materialize(at)
    names = mesh.numbered(faces, at)
    assert names.select("task").distinct().count() <= 32 and names.count() == 401
    big = spark.range(mesh.BUNDLE + 1).selectExpr("1L AS mesh_id").unionAll(spark.range(5).selectExpr("id + 2 AS mesh_id"))
    tasks = {r["mesh_id"]: r["task"] for r in mesh.numbered(big).collect()}
    assert list(tasks.values()).count(tasks[1]) == 1
    parts = mesh.components(faces).groupBy("mesh_id").agg(F.sort_array(F.collect_set(F.struct("fid", "component"))).alias("p"))
    assert {tuple(map(tuple, r["p"])) for r in parts.collect()} == {((-3, -3), (5, 5), (9, 5))} and parts.count() == 400
    f, v = mesh.validated(faces, at)
    assert f.count() == 1200 and v.count() == 400 * 7
    moved, alone = mesh.smoothed(faces, at), mesh.smoothed(faces.where("mesh_id = 3"), at.where("mesh_id = 3"))
    want = {r["vid"]: (r["x"], r["y"], r["z"]) for r in alone.collect()}
    got = [r for r in moved.collect() if r["mesh_id"] != 200]
    assert len(got) == 3600 and all(np.allclose((r["x"], r["y"], r["z"]), want[r["vid"]]) for r in got)
    ones = spark.range(100).selectExpr("id AS key", "explode(array(struct(0L AS i, 0L AS j, 2D + id AS w), struct(4L AS i, 4L AS j, 1D AS w))) AS t").select("key", "t.*")
    x = flatten.solve(ones, ones.selectExpr("key", "i", "w * (key + i) AS w"))
    assert x.count() == 200 and not x.where("abs(x - key - i) > 1e-9").count()


def test_meshes_are_shuffled_not_sent(spark):
    """Small files of vertices and of meshes, whose rows grow with the input: no join of these sends either through the driver."""
    at = materialize(spark.range(2500).selectExpr("id div 25 AS mesh_id", "id % 25 AS vid", "id % 5 + 0D AS x", "id % 25 div 5 + 0D AS y", "0D AS z"))
    spots = spark.range(1600).selectExpr("id div 16 AS mesh_id", "id % 16 div 4 * 5 + id % 4 AS v")
    faces = materialize(spots.selectExpr("mesh_id", "explode(array(struct(2 * v AS fid, v AS a, v + 1 AS b, v + 6 AS c), struct(2 * v + 1 AS fid, v AS a, v + 6 AS b, v + 5 AS c))) AS f").select("mesh_id", "f.*"))
    loop = materialize(flatten.longest_loop(flatten.boundary_loops(faces)))
    for df in (mesh.valid_faces(*mesh.merged(faces, at), 1e-12), mesh.used_vertices(faces, at), flatten.conformal_entries(faces, at), flatten.farthest(loop, at)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count()
    assert flatten.harmonic(faces, at, loop).count() == 2500


def test_cubes_by_blocks_equal_smoothed_cells(spark):
    """Edges, levels and faces from blocks of counts and from all smoothed cells: several blocks, counts at their borders and at those of the grid, a structure below the level."""
    rng = np.random.default_rng(4)
    shape = {"S": (70, 40, 33), "T": (22, 24, 34), "U": (31, 32, 65)}
    rows = {(s, *map(int, p)) for s, n in shape.items() for p in [[0, 0, 0], [31, 31, 32], [c - 1 for c in n], *rng.integers(0, n, (30, 3))] if s != "T" and all(c < m for c, m in zip(p, n, strict=True))} | {("T", 9, 9, 31)}
    cells = spark.createDataFrame([(*k, 20.0 if k[0] == "S" else 1.0) for k in rows], "structure_id string, ix long, iy long, iz long, d double")
    grid = spark.createDataFrame([(s, 0.0, 0.0, 0.0, *n) for s, n in shape.items()], "structure_id string, lox double, loy double, loz double, nx long, ny long, nz long")
    atoms = spark.createDataFrame([(s,) for s in shape for _ in range(200)], "structure_id string")
    all_cells = materialize(density.smooth(cells, grid))
    start = isosurface.starts(all_cells)
    edges = materialize(isosurface.crossing_edges(all_cells, grid, start))
    level = materialize(isosurface.levels(edges, start, atoms))
    cubes = isosurface.cubes(cells, grid)
    got_edges = materialize(isosurface.cube_edges(cubes, grid))
    got_level = materialize(isosurface.levels(got_edges, isosurface.cube_starts(cubes), atoms))
    number = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    cols = ["structure_id", "ix", "iy", "iz", "axis", "d0", "d1", "start"]
    assert number(got_edges.select(cols)) == number(edges.select(cols)) and edges.count() > 1000
    assert number(got_level) == number(level) and level.where("structure_id = 'T' and level < 0.05").count()
    assert number(isosurface.cube_faces_at(cubes, grid, got_level)) == number(isosurface.faces(all_cells, grid, level))
    plan = isosurface.cube_edges(cubes, grid)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(structure_id" not in plan


def test_few_pairs_that_meet_are_too_far_apart(spark):
    """Evenly spread points, some of them just a radius from others: no pair is lost, and of those that meet a third or more are near enough."""
    grid = spark.range(12**3).selectExpr("1 AS s", "id", "id % 12 + 0D AS x", "id div 12 % 12 + 0D AS y", "id div 144 + 0D AS z")
    left, right = (grid.select("s", "id", "x", "y", "z"), grid.selectExpr("s", "id AS b", "x AS bx", "y AS by", "z AS bz"))
    found = spatial.near_pairs(left, right, ["s"], 3.0)
    at = np.stack(np.unravel_index(np.arange(12**3), (12, 12, 12)), 1)
    want = sum(int((((at - p) ** 2).sum(1) <= 9).sum()) for p in at)
    assert found.count() == want and found.select("id", "b").distinct().count() == want
    plan = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, c) for c in (plan.left(), plan.right())]
    count = [{tuple(r[k] for k in ("cx", "cy", "cz")): r["count"] for r in DataFrame(d, spark).groupBy("cx", "cy", "cz").count().collect()} for d in sides]
    assert sum(n * count[1].get(c, 0) for c, n in count[0].items()) < 3.2 * want
