"""Registered queries over the fixture views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chemistry import INTERACTIONS, PEPTIDES, RAW_TYPES
from ..operators import contacts, density, flatten, isosurface, mapview, mesh, project, spatial, structure
from ..sources import structures
from ..sources.storage import honest, materialize, shared_dir
from . import reports, sweeps
from .fixtures import VIEWS, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/orders.parquet"
    orders = honest(spark.read.parquet(path).select("o_orderkey"), path)
    return spark.sql(VIEWS[name].replace("FROM orders", "FROM {orders}"), orders=orders)


def query(sql: str, *views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
SIDES = "a AS (SELECT * FROM atoms WHERE record='ATOM' AND chain_id='A'), b AS (SELECT * FROM atoms WHERE record='ATOM' AND chain_id='B')"
FLAGS = ", ".join(
    f"({p}.res_name IN ('ARG','LYS','HIS') AND {p}.atom_name IN ('NZ','NH1','NH2','ND1','NE2')) AS {p}cat, (({p}.res_name IN ('ASP','GLU') AND {p}.atom_name IN ('OD1','OD2','OE1','OE2')) OR {p}.atom_name='OXT') AS {p}an, "
    f"({p}.res_name IN ('PHE','TYR','TRP','HIS') AND {p}.atom_name NOT IN ('CA','C','O','N')) AS {p}ar, {p}.element IN ('N','O','S','F') AS {p}po, {p}.atom_name IN ('SG','SD') AS {p}su, {p}.element='C' AS {p}c, ({p}.element='C' AND {p}.atom_name NOT IN ('CA','C')) AS {p}sc"
    for p in "ab"
)
PAIRS = f"""{SIDES}, p AS (SELECT a.structure_id, a.serial, a.res_seq, b.serial AS b_serial, {DIST} AS d, {FLAGS} FROM a JOIN b ON a.structure_id=b.structure_id AND {DIST} <= 6),
t AS (SELECT structure_id, serial, res_seq, b_serial, d, CASE
  WHEN d<4 AND ((acat AND ban) OR (aan AND bcat)) THEN 'salt_bridge' WHEN d<5 AND ((aar AND bcat) OR (acat AND bar)) THEN 'cation_pi'
  WHEN d<5 AND ((acat AND ban) OR (aan AND bcat)) THEN 'salt_bridge' WHEN d<3.8 AND ((apo AND bpo) OR (ac AND bpo) OR (apo AND bc)) THEN 'hbond'
  WHEN d<4.5 AND ((aar AND bsu) OR (asu AND bar)) THEN 'sulfur_pi' WHEN d<5.5 AND aar AND bar THEN 'pi_stack'
  WHEN d<4.5 AND ((aar AND bsc AND NOT bar) OR (bar AND asc_ AND NOT aar)) THEN 'hydrophobic'
  WHEN d<4.5 AND asc_ AND bsc AND NOT aar AND NOT bar THEN 'hydrophobic' END AS type FROM p)""".replace(" AS asc,", " AS asc_,")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    atoms = structure.standard(structure.first_model(view(spark, sf_dir, "atoms")))
    return structure.chain(atoms, "A"), structure.chain(atoms, "B")


def points(b: DataFrame) -> DataFrame:
    return b.select("structure_id", F.col("serial").alias("b_serial"), *[F.col(k).alias(f"b{k}") for k in "xyz"])


@query("SELECT structure_id, chain_id, count(*) AS n_atoms, count(DISTINCT res_seq) AS n_residues FROM atoms WHERE record='ATOM' GROUP BY 1, 2", "atoms")
def f1_f2_f3_selection(spark, sf_dir):
    atoms = structure.standard(structure.first_model(view(spark, sf_dir, "atoms")))
    return atoms.groupBy("structure_id", "chain_id").agg(F.count("*").alias("n_atoms"), F.count_distinct("res_seq").alias("n_residues"))


@query(f"WITH {SIDES} SELECT a.structure_id, a.serial, min({DIST}) AS dist, arg_min(b.serial, ({DIST}, b.serial)) AS b_serial FROM a JOIN b ON a.structure_id=b.structure_id WHERE {DIST} < 5 GROUP BY 1, 2", "atoms")
def j1_j2_nearest_atom(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return spatial.nearest(a, points(b), ["structure_id"], "serial", 5.0, "b_serial")


@query(f"WITH {SIDES} SELECT DISTINCT a.structure_id, a.serial FROM a JOIN b ON a.structure_id=b.structure_id WHERE {DIST} < 8", "atoms")
def j3_coarse_contacts(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return mapview.close_atoms(a, b, 8.0).select("structure_id", "serial")


@query(f"WITH {PAIRS} SELECT structure_id, serial, b_serial, round(d, 6) AS d, type FROM t", "atoms")
def j4_typed_pairs(spark, sf_dir):
    return contacts.typed_pairs(*sides(spark, sf_dir)).select("structure_id", "serial", "b_serial", F.round("d", 6).alias("d"), "type")


@query(f"WITH {PAIRS} SELECT structure_id, best AS type, count(*) AS n_residues FROM (SELECT structure_id, res_seq, arg_min(type, list_position([{quoted(INTERACTIONS)}], type)) AS best FROM t WHERE type IS NOT NULL GROUP BY 1, 2) q GROUP BY 1, 2", "atoms")
def w4_best_types(spark, sf_dir):
    best = contacts.best_types(contacts.typed_pairs(*sides(spark, sf_dir)))
    return best.groupBy("structure_id", "type").agg(F.count("*").alias("n_residues"))


@query("SELECT structure_id, chain_id, count(DISTINCT (record, res_seq, CASE WHEN serial % 3 = 0 THEN 'A' ELSE '' END)) AS residues, min(200000000 - serial) AS first FROM atoms GROUP BY 1, 2", "atoms")
def a16_chain_summary(spark, sf_dir):
    return structure.chain_summary(view(spark, sf_dir, "atoms").withColumns({"icode": F.when(F.col("serial") % 3 == 0, "A"), "line": 200000000 - F.col("serial")}))


@query("WITH s AS (SELECT structure_id, chain_id, min(serial) AS f FROM atoms GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY f) AS k FROM s) SELECT x.structure_id, x.chain_id AS chain_a, y.chain_id AS chain_b, 'Auto_Generated' AS category FROM r x JOIN r y ON x.structure_id=y.structure_id AND x.k=1 AND y.k=2", "atoms")
def w3_p6_auto_targets(spark, sf_dir):
    return structure.first_two_chains(view(spark, sf_dir, "atoms"))


@query("SELECT structure_id, chain_id, chain_id AS new_id, count(DISTINCT (record, res_seq)) AS residues FROM atoms GROUP BY 1, 2", "atoms")
def w1_f19_normal_chains(spark, sf_dir):
    return structure.normal_chains(view(spark, sf_dir, "atoms"))


@query(f"SELECT DISTINCT structure_id, res_name, CASE WHEN res_name IN ({quoted(PEPTIDES)}) THEN 'L-peptide linking' WHEN res_name='HOH' THEN 'water' ELSE 'non-polymer' END AS kind FROM atoms", "atoms")
def a20_residue_dictionary(spark, sf_dir):
    return structure.residue_dictionary(view(spark, sf_dir, "atoms"))


MAPPED = "CASE " + " ".join(f"WHEN raw_type IN ({quoted(v)}) THEN '{k}'" for k, v in RAW_TYPES.items()) + " END"


@query(f"WITH r AS (SELECT structure_id, TRY_CAST(nullif(regexp_extract(CASE WHEN bgn_chain='A' THEN bgn_seq ELSE end_seq END, '^\\s*(-?\\d+)', 1), '') AS INT) AS res_seq, {MAPPED} AS type FROM contacts WHERE least(bgn_chain, end_chain)='A' AND greatest(bgn_chain, end_chain)='B') SELECT structure_id, res_seq, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM r WHERE type IS NOT NULL AND res_seq IS NOT NULL GROUP BY 1, 2", "contacts")
def f16_a19_annotated_types(spark, sf_dir):
    return contacts.annotated_types(view(spark, sf_dir, "contacts")).withColumn("types", F.array_join("types", ","))


GRID = "g AS (SELECT structure_id, min(x)-10 AS lox, max(x)+10 AS hix, min(y)-10 AS loy, max(y)+10 AS hiy, min(z)-10 AS loz, max(z)+10 AS hiz FROM atoms WHERE record='ATOM' AND chain_id='A' GROUP BY 1), n AS (SELECT *, CAST(ceil(hix-lox) AS BIGINT) AS nx, CAST(ceil(hiy-loy) AS BIGINT) AS ny, CAST(ceil(hiz-loz) AS BIGINT) AS nz FROM g)"
BINS = ", ".join(f"CAST(floor(({k}-lo{k})*n{k}/(hi{k}-lo{k})) AS BIGINT) AS i{k}" for k in "xyz")
VOXELS = f"{GRID}, v0 AS (SELECT structure_id, ix, iy, iz, CAST(count(*) AS DOUBLE) AS d FROM (SELECT structure_id, {BINS} FROM atoms JOIN n USING (structure_id) WHERE record='ATOM' AND chain_id='A') q GROUP BY 1, 2, 3, 4)"


def smoothing_sql() -> str:
    taps = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in density.kernel(1.5))
    sql = f"{VOXELS}, k(o, w) AS (VALUES {taps})"
    for j, k in enumerate("xyz"):
        to = f"CASE WHEN i{k}+o<0 THEN -(i{k}+o)-1 WHEN i{k}+o>=n{k} THEN 2*n{k}-1-(i{k}+o) ELSE i{k}+o END"
        cols = ", ".join(f"{to} AS i{c}" if c == k else f"i{c}" for c in "xyz")
        sql += f", v{j + 1} AS (SELECT structure_id, ix, iy, iz, sum(m) AS d FROM (SELECT v{j}.structure_id, {cols}, d*w AS m FROM v{j} JOIN n USING (structure_id), k) q GROUP BY 1, 2, 3, 4)"
    return sql


def chain_a_voxels(spark, sf_dir):
    a, _ = sides(spark, sf_dir)
    grid = density.grids(a)
    return density.voxels(a, grid), grid


@query(f"WITH {VOXELS} SELECT * FROM v0", "atoms")
def a1_a2_voxels(spark, sf_dir):
    return chain_a_voxels(spark, sf_dir)[0]


@query(f"WITH {smoothing_sql()} SELECT structure_id, count(*) AS cells, round(max(d), 6) AS top, round(sum(d), 6) AS total FROM v3 GROUP BY 1", "atoms")
def a3_a4_density(spark, sf_dir):
    d = density.smooth(*chain_a_voxels(spark, sf_dir))
    return d.groupBy("structure_id").agg(F.count("*").alias("cells"), F.round(F.max("d"), 6).alias("top"), F.round(F.sum("d"), 6).alias("total"))


EDGES = "e AS (SELECT mesh_id, fid, least(a,b) AS u, greatest(a,b) AS v FROM mesh_faces UNION ALL SELECT mesh_id, fid, least(b,c), greatest(b,c) FROM mesh_faces UNION ALL SELECT mesh_id, fid, least(c,a), greatest(c,a) FROM mesh_faces)"


@query(f"WITH {EDGES} SELECT mesh_id, u, v, min(fid) AS f1, max(fid) AS f2 FROM e GROUP BY 1, 2, 3 HAVING count(*)=2", "mesh_faces")
def j6_face_adjacency(spark, sf_dir):
    return mesh.adjacency(view(spark, sf_dir, "mesh_faces"))


@query(f"WITH {EDGES} SELECT mesh_id, u, v FROM e GROUP BY 1, 2, 3 HAVING count(*)=1", "mesh_faces")
def g5_boundary_edges(spark, sf_dir):
    return mesh.boundary(view(spark, sf_dir, "mesh_faces"))


CROSS = "sqrt(((q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y))*((q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y))+((q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z))*((q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z))+((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x))*((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x)))/2"


@query(f"WITH m AS (SELECT f.mesh_id, {CROSS} AS area, (p.x+q.x+r.x)/3 AS gx, (p.y+q.y+r.y)/3 AS gy, (p.z+q.z+r.z)/3 AS gz FROM mesh_faces f JOIN mesh_vertices p ON f.mesh_id=p.mesh_id AND f.a=p.vid JOIN mesh_vertices q ON f.mesh_id=q.mesh_id AND f.b=q.vid JOIN mesh_vertices r ON f.mesh_id=r.mesh_id AND f.c=r.vid) SELECT mesh_id, round(sum(area), 6) AS area, round(sum(area*gx)/sum(area), 6) AS cx, round(sum(area*gy)/sum(area), 6) AS cy, round(sum(area*gz)/sum(area), 6) AS cz FROM m GROUP BY 1", "mesh_vertices", "mesh_faces")
def a6_a14_surface(spark, sf_dir):
    s = mesh.surface(mesh.measured(view(spark, sf_dir, "mesh_faces"), view(spark, sf_dir, "mesh_vertices")))
    return s.select("mesh_id", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy", "cz")])


def meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "mesh_faces"), view(spark, sf_dir, "mesh_vertices")


ADJ = f"{EDGES}, j AS (SELECT mesh_id, min(fid) AS f1, max(fid) AS f2 FROM e GROUP BY mesh_id, u, v HAVING count(*)=2), s AS (SELECT mesh_id, f1 AS p, f2 AS q FROM j UNION SELECT mesh_id, f2, f1 FROM j), r AS (SELECT mesh_id, fid, fid AS root FROM mesh_faces UNION SELECT r.mesh_id, s.q, r.root FROM r JOIN s ON r.mesh_id=s.mesh_id AND r.fid=s.p), comp AS (SELECT mesh_id, fid, min(root) AS component FROM r GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {ADJ} SELECT * FROM comp", "mesh_faces")
def g4_components(spark, sf_dir):
    return mesh.components(view(spark, sf_dir, "mesh_faces"))


@query(f"WITH RECURSIVE {ADJ}, k AS (SELECT c.mesh_id, component, unnest([a, b, c.c]) AS vid FROM (SELECT * FROM mesh_faces JOIN comp USING (mesh_id, fid)) c), z AS (SELECT mesh_id, component, count(DISTINCT vid) AS vertices, min(vid) AS low FROM k GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY low) AS original_index FROM z) SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY low) AS patch_id, original_index, vertices FROM o WHERE vertices >= 50", "mesh_faces")
def f8_w8_patches(spark, sf_dir):
    return mesh.patches(view(spark, sf_dir, "mesh_faces"), 50).select("mesh_id", "patch_id", "original_index", "vertices").distinct()


@query("SELECT f.* FROM mesh_faces f WHERE EXISTS (SELECT 1 FROM mesh_vertices v WHERE v.mesh_id=f.mesh_id AND v.z < 0.1 AND v.vid IN (f.a, f.b, f.c))", "mesh_faces", "mesh_vertices")
def f7_j5_touched_faces(spark, sf_dir):
    faces, points = meshes(spark, sf_dir)
    return mesh.touched_faces(faces, points.where("z < 0.1").select("mesh_id", "vid"))


def area_sql(p: str = "") -> str:
    return f"SELECT f.mesh_id, f.fid, f.a, f.b, f.c, {CROSS} AS area{p} FROM mesh_faces f JOIN mesh_vertices p ON f.mesh_id=p.mesh_id AND f.a=p.vid JOIN mesh_vertices q ON f.mesh_id=q.mesh_id AND f.b=q.vid JOIN mesh_vertices r ON f.mesh_id=r.mesh_id AND f.c=r.vid"


@query(f"WITH m AS ({area_sql()}) SELECT mesh_id, min(fid) AS fid, list_sort([a, b, c])[1] AS lowest FROM m WHERE area > 0.55 GROUP BY mesh_id, list_sort([a, b, c])", "mesh_faces", "mesh_vertices")
def f9_f10_valid_faces(spark, sf_dir):
    faces, points = meshes(spark, sf_dir)
    twice = faces.unionByName(faces.selectExpr("mesh_id", "fid + 1000000 AS fid", "b AS a", "c AS b", "a AS c"))
    return mesh.valid_faces(twice, points, 0.55).select("mesh_id", "fid", F.least("a", "b", "c").alias("lowest"))


@query("SELECT DISTINCT mesh_id, unnest([a, b, c]) AS vid FROM mesh_faces", "mesh_faces")
def a7_f11_merged_vertices(spark, sf_dir):
    faces, points = meshes(spark, sf_dir)
    copies = points.selectExpr("mesh_id", "vid + 1000 AS vid", "x", "y", "z")
    moved = faces.selectExpr("mesh_id", "fid", "a", "b", "c + 1000 AS c")
    faces, points = mesh.merged(moved, points.unionByName(copies))
    return mesh.used_vertices(faces, points).select("mesh_id", "vid")


@query("SELECT f.mesh_id, round(sum(p.x*(q.y*r.z-q.z*r.y)+p.y*(q.z*r.x-q.x*r.z)+p.z*(q.x*r.y-q.y*r.x))/6, 6) AS volume FROM mesh_faces f JOIN mesh_vertices p ON f.mesh_id=p.mesh_id AND f.a=p.vid JOIN mesh_vertices q ON f.mesh_id=q.mesh_id AND f.b=q.vid JOIN mesh_vertices r ON f.mesh_id=r.mesh_id AND f.c=r.vid GROUP BY 1", "mesh_faces", "mesh_vertices")
def a17_volume(spark, sf_dir):
    return mesh.volume(*meshes(spark, sf_dir)).withColumn("volume", F.round("volume", 6))


@query("WITH n AS (SELECT mesh_id, a AS i, b AS j FROM mesh_faces UNION SELECT mesh_id, b, a FROM mesh_faces UNION SELECT mesh_id, b, c FROM mesh_faces UNION SELECT mesh_id, c, b FROM mesh_faces UNION SELECT mesh_id, c, a FROM mesh_faces UNION SELECT mesh_id, a, c FROM mesh_faces), m AS (SELECT n.mesh_id, n.i, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM n JOIN mesh_vertices v ON v.mesh_id=n.mesh_id AND v.vid=n.j GROUP BY 1, 2) SELECT v.mesh_id, v.vid, round((v.x+coalesce(m.x, v.x))/2, 8) AS x, round((v.y+coalesce(m.y, v.y))/2, 8) AS y, round((v.z+coalesce(m.z, v.z))/2, 8) AS z FROM mesh_vertices v LEFT JOIN m ON m.mesh_id=v.mesh_id AND m.i=v.vid", "mesh_faces", "mesh_vertices")
def g3_relaxed_once(spark, sf_dir):
    return mesh.relaxed(*meshes(spark, sf_dir)).select("mesh_id", "vid", *[F.round(k, 8).alias(k) for k in "xyz"])


@query(f"WITH {smoothing_sql()}, t AS (SELECT structure_id, CASE WHEN max(d) <= 0.1 THEN max(d)/2 ELSE 0.1 END AS l FROM v3 GROUP BY 1), ax(axis, dx, dy, dz) AS (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)), g0 AS (SELECT structure_id, ix, iy, iz, axis, d AS d0, 0.0::DOUBLE AS d1 FROM v3, ax UNION ALL SELECT structure_id, ix-dx, iy-dy, iz-dz, axis, 0.0::DOUBLE, d FROM v3, ax), g1 AS (SELECT structure_id, ix, iy, iz, axis, sum(d0) AS d0, sum(d1) AS d1 FROM g0 GROUP BY 1, 2, 3, 4, 5), w AS (SELECT g1.*, l, lox, loy, loz, (l-d0)/(d1-d0) AS s FROM g1 JOIN t USING (structure_id) JOIN n USING (structure_id) JOIN ax USING (axis) WHERE least(ix, iy, iz) >= 0 AND ix+dx < nx AND iy+dy < ny AND iz+dz < nz AND (d0>l) <> (d1>l)) SELECT structure_id, count(*) AS n_vertices, round(sum(lox+ix+CASE WHEN axis=0 THEN s ELSE 0 END), 3) AS sx, round(sum(loy+iy+CASE WHEN axis=1 THEN s ELSE 0 END), 3) AS sy, round(sum(loz+iz+CASE WHEN axis=2 THEN s ELSE 0 END), 3) AS sz FROM w GROUP BY 1", "atoms")
def a5_g1_isosurface_vertices(spark, sf_dir):
    a, _ = sides(spark, sf_dir)
    cells, grid = chain_a_voxels(spark, sf_dir)
    cubes = isosurface.cubes(cells, grid)
    edges = isosurface.cube_edges(cubes, grid)
    points = isosurface.vertices(edges, isosurface.levels(edges, isosurface.cube_starts(cubes), a))
    return points.groupBy(F.col("mesh_id").alias("structure_id")).agg(F.count("*").alias("n_vertices"), *[F.round(F.sum(k), 3).alias(f"s{k}") for k in "xyz"])


def faces_sql() -> str:
    """G2 over the smoothed density: the case table as values, a bit for each corner inside."""
    corner = isosurface.corner
    spot = lambda e: f"{{'x': {corner(e[0])[0]}, 'y': {corner(e[0])[1]}, 'z': {corner(e[0])[2]}, 'axis': {e[1]}}}"
    cases = ", ".join(f"({m}, {n}, {', '.join(map(spot, t))})" for m in range(1, 255) for n, t in enumerate(isosurface.triangles(m)))
    offsets = ", ".join(f"({', '.join(map(str, corner(i)))}, {1 << i})" for i in range(8))
    vid = lambda k: f"(((ix+{k}.x)*ny+iy+{k}.y)*nz+iz+{k}.z)*3+{k}.axis AS {k}"
    return f"""WITH {smoothing_sql()}, t AS (SELECT structure_id, CASE WHEN max(d) <= 0.1 THEN max(d)/2 ELSE 0.1 END AS l FROM v3 GROUP BY 1),
cases(mask, nth, a, b, c) AS (VALUES {cases}), o(ox, oy, oz, bit) AS (VALUES {offsets}),
cube AS (SELECT structure_id, ix-ox AS ix, iy-oy AS iy, iz-oz AS iz, CAST(sum(bit) AS BIGINT) AS mask FROM v3 JOIN t USING (structure_id), o WHERE d > l GROUP BY 1, 2, 3, 4)
SELECT structure_id, ((ix*ny+iy)*nz+iz)*8+nth AS fid, {vid('a')}, {vid('b')}, {vid('c')} FROM cube JOIN n USING (structure_id) JOIN cases USING (mask) WHERE least(ix, iy, iz) >= 0 AND ix+1 < nx AND iy+1 < ny AND iz+1 < nz"""


@query(faces_sql(), "atoms")
def g2_j11_isosurface_faces(spark, sf_dir):
    """All triangles of the surfaces, by the vertex ids of G1."""
    a, _ = sides(spark, sf_dir)
    cells, grid = chain_a_voxels(spark, sf_dir)
    cubes = isosurface.cubes(cells, grid)
    level = isosurface.levels(isosurface.cube_edges(cubes, grid), isosurface.cube_starts(cubes), a)
    return isosurface.cube_faces_at(cubes, grid, level).withColumnRenamed("mesh_id", "structure_id")


@query("SELECT mesh_id, 'face' AS kind, fid AS id, a, b, c FROM mesh_faces WHERE 7 NOT IN (a, b, c) UNION ALL SELECT DISTINCT mesh_id, 'vertex', unnest([a, b, c]), 0, 0, 0 FROM mesh_faces WHERE 7 NOT IN (a, b, c)", "mesh_faces")
def g13_validated(spark, sf_dir):
    """Whole meshes in which every vertex stands twice, faces use both copies or stand twice, some have no area or a corner that isn't finite, and vertices are unused."""
    faces, at = meshes(spark, sf_dir)
    broken = F.when(F.col("vid") == 7, F.lit(float("nan"))).otherwise(F.col("x")).alias("x")
    at = at.select("mesh_id", "vid", broken, "y", "z")
    copies = at.selectExpr("mesh_id", "vid + 1000 AS vid", "x", "y + 1e-10 AS y", "z")
    unused = at.selectExpr("mesh_id", "vid + 5000 AS vid", "x + 100 AS x", "y", "z")
    mixed = faces.selectExpr("mesh_id", "fid", "a", "b", "c + 1000 AS c")
    again = faces.selectExpr("mesh_id", "fid + 1000000 AS fid", "b + 1000 AS a", "c AS b", "a AS c")
    empty = faces.selectExpr("mesh_id", "fid + 2000000 AS fid", "a", "a + 1000 AS b", "c")
    faces, at = mesh.validated(mixed.unionByName(again).unionByName(empty), at.unionByName(copies).unionByName(unused))
    none = [F.lit(0).cast("long").alias(k) for k in "abc"]
    return faces.select("mesh_id", F.lit("face").alias("kind"), F.col("fid").alias("id"), "a", "b", "c").unionByName(at.select("mesh_id", F.lit("vertex").alias("kind"), F.col("vid").alias("id"), *none))


COVARIANCE = f"m AS ({area_sql(', (p.x+q.x+r.x)/3 AS gx, (p.y+q.y+r.y)/3 AS gy, (p.z+q.z+r.z)/3 AS gz')}), o AS (SELECT mesh_id, sum(area*gx)/sum(area) AS cx, sum(area*gy)/sum(area) AS cy, sum(area*gz)/sum(area) AS cz FROM m GROUP BY 1), k AS (SELECT mesh_id, " + ", ".join(
    f"avg(({p}-c{p})*({q}-c{q})) AS {p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")
) + " FROM mesh_vertices JOIN o USING (mesh_id) GROUP BY 1)"


@query(f"WITH {COVARIANCE} SELECT mesh_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM k", "mesh_vertices", "mesh_faces")
def a15_covariance(spark, sf_dir):
    faces, at = meshes(spark, sf_dir)
    return project.covariance(faces, at).select("mesh_id", *[F.round(c, 6).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query(f"WITH {COVARIANCE}, q AS (SELECT *, (xx+yy+zz)/3 AS q FROM k), p AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q), f AS (SELECT *, acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 AS f FROM p) SELECT mesh_id, round(q+2*p*cos(f+2*pi()/3), 6) AS x, round(3*q-(q+2*p*cos(f))-(q+2*p*cos(f+2*pi()/3)), 6) AS y, round(q+2*p*cos(f), 6) AS z, 0.0::DOUBLE AS mixed FROM f", "mesh_vertices", "mesh_faces")
def g9_principal_variances(spark, sf_dir):
    """In its own frame a mesh has the eigenvalues of its covariance as variances, in ascending order, and no mixed moments."""
    frame = project.principal_frame(*meshes(spark, sf_dir))
    mixed = F.round(F.greatest(*[F.abs(F.avg(F.col(p) * F.col(q))) for p, q in ("xy", "xz", "yz")]), 6)
    return frame.groupBy("mesh_id").agg(*[F.round(F.avg(F.col(k) * F.col(k)), 6).alias(k) for k in "xyz"], mixed.alias("mixed"))


@query("WITH b AS (SELECT mesh_id, min(y) AS ly, max(y)-min(y) AS ry, min(z) AS lz, max(z)-min(z) AS rz FROM mesh_vertices GROUP BY 1) SELECT mesh_id, vid, round((y-ly)/ry, 6) AS pu, round((z-lz)/rz, 6) AS pv, round((atan2(y, x)+pi())/(2*pi()), 6) AS su, round(acos(z/CASE WHEN x=0 AND y=0 AND z=0 THEN 1e-9 ELSE sqrt(x*x+y*y+z*z) END)/pi(), 6) AS sv, round((z-lz)/rz, 6) AS cv FROM mesh_vertices JOIN b USING (mesh_id)", "mesh_vertices")
def g10_g11_g12_projections(spark, sf_dir):
    points = view(spark, sf_dir, "mesh_vertices")
    key = ["mesh_id", "vid"]
    both = project.planar(points).withColumnsRenamed({"u": "pu", "v": "pv"}).join(project.spherical(points).withColumnsRenamed({"u": "su", "v": "sv"}), key)
    both = both.join(project.cylindrical(points).select(*key, F.col("v").alias("cv")), key)
    return both.select(*key, *[F.round(c, 6).alias(c) for c in ("pu", "pv", "su", "sv", "cv")])


@query("SELECT mesh_id, vid, round((x-min(x) OVER w)/(max(x) OVER w-min(x) OVER w), 6) AS u, round((y-min(y) OVER w)/(max(y) OVER w-min(y) OVER w), 6) AS v FROM mesh_vertices WINDOW w AS (PARTITION BY mesh_id)", "mesh_vertices")
def g8_normal_uv(spark, sf_dir):
    uv = project.normal_uv(view(spark, sf_dir, "mesh_vertices").selectExpr("mesh_id", "vid", "x AS u", "y AS v"))
    return uv.select("mesh_id", "vid", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


def angle_sql(p: str, q: str, r: str, cols: str) -> str:
    dots = lambda s, t: "+".join(f"({s}.{k}-{p}.{k})*({t}.{k}-{p}.{k})" for k in cols)
    return f"degrees(acos(greatest(-1, least(1, ({dots(q, r)})/(sqrt({dots(q, q)})*sqrt({dots(r, r)}))))))"


OFF = "+".join(f"abs({angle_sql(*t, 'xyz')}-{angle_sql(*t, 'uv')})" for t in ("pqr", "qrp", "rpq"))


@query(f"WITH v AS (SELECT *, x/9 AS u, y/9 AS v FROM mesh_vertices), m AS (SELECT f.mesh_id, abs((q.u-p.u)*(r.v-p.v)-(q.v-p.v)*(r.u-p.u))/2/({CROSS}) AS ratio, ({OFF})/3 AS off FROM mesh_faces f JOIN v p ON f.mesh_id=p.mesh_id AND f.a=p.vid JOIN v q ON f.mesh_id=q.mesh_id AND f.b=q.vid JOIN v r ON f.mesh_id=r.mesh_id AND f.c=r.vid) SELECT mesh_id, round(stddev_pop(ratio)/avg(ratio), 4) AS area_std, round(avg(off), 2) AS angle_mae FROM m GROUP BY 1", "mesh_vertices", "mesh_faces")
def a9_a10_distortion(spark, sf_dir):
    faces, points = meshes(spark, sf_dir)
    d = project.distortion(faces, points, points.selectExpr("mesh_id", "vid", "x/9 AS u", "y/9 AS v"))
    return d.select("mesh_id", F.round("area_std", 4).alias("area_std"), F.round("angle_mae", 2).alias("angle_mae"))


@query("SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY -serial) AS nth, serial % 100000 AS serial, 1 AS model, record, chain_id, res_seq, CASE WHEN serial % 3 = 0 THEN 'A' ELSE '' END AS icode, res_name, atom_name, element, x, y, z FROM atoms", "atoms")
def s1_s8_pdb_files(spark, sf_dir):
    """Files keep the order of lines, here that of falling serials, and only the first of two models."""
    root = shared_dir(spark)
    atoms = view(spark, sf_dir, "atoms").withColumns({"icode": F.when(F.col("serial") % 3 == 0, "A"), "line": -F.col("serial")})
    structures.write_pdb_text(atoms.unionByName(atoms.withColumns({"model": F.lit(2), "x": F.col("x") + 1})), root)
    nth = F.row_number().over(Window.partitionBy("structure_id").orderBy("line")).alias("nth")
    return structures.read_atoms(spark, root).select("structure_id", nth, "serial", "model", "record", "chain_id", "res_seq", "icode", "res_name", "atom_name", "element", "x", "y", "z")


@query("SELECT structure_id, serial, model, record, chain_id, res_seq, res_name, atom_name, element, x, y, z FROM atoms", "atoms")
def s2_mmcif_text(spark, sf_dir):
    names = [options[0] for _, options, _ in structures.CIF_FIELDS]
    cell = {"altloc": F.lit("."), "icode": F.lit("?"), "occupancy": F.lit("1.00")}
    line = F.concat_ws(" ", *[cell[c] if c in cell else F.col(c).cast("string") for c, _, _ in structures.CIF_FIELDS])
    atoms = view(spark, sf_dir, "atoms").select("structure_id", "serial", line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("serial", "line"))), lambda r: r["line"]), "\n")  # one structure is one file
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names)
    whole = atoms.groupBy("structure_id").agg(F.concat(F.lit(head), body, F.lit("\n#\n")).alias("value"))
    return structures.parse_mmcif(whole).select("structure_id", "serial", "model", "record", "chain_id", "res_seq", "res_name", "atom_name", "element", "x", "y", "z")


@query("SELECT structure_id, bgn_chain, bgn_seq, end_chain, end_seq, raw_type FROM contacts UNION ALL SELECT structure_id, bgn_chain, bgn_seq, end_chain, end_seq, 'vdw' FROM contacts WHERE bgn_chain='A'", "contacts")
def s3_contact_json(spark, sf_dir):
    rows = view(spark, sf_dir, "contacts")
    kind = F.when(F.col("bgn_chain") == "A", F.format_string('["%s","vdw"]', "raw_type")).otherwise(F.format_string('"%s"', "raw_type"))
    item = F.format_string('{"bgn":{"auth_asym_id":"%s","auth_seq_id":"%s"},"end":{"auth_asym_id":"%s","auth_seq_id":"%s"},"type":%s}', "bgn_chain", "bgn_seq", "end_chain", "end_seq", kind)
    listed = rows.groupBy("structure_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("list"))
    odd = F.substring("structure_id", 2, 9).cast("int") % 2 == 1
    return structures.parse_contacts(listed.select("structure_id", F.when(odd, F.concat(F.lit('{"interactions":'), F.col("list"), F.lit("}"))).otherwise(F.col("list")).alias("value"))).drop("contact")


@query("SELECT structure_id, model, chain_id, record, res_seq, atom_name, CASE WHEN serial % 82 = 0 THEN serial + CASE WHEN serial % 3 = 0 THEN 200000000 ELSE 100000000 END ELSE serial END AS serial, round(CASE WHEN serial % 82 = 0 THEN x + 0.3 ELSE x END, 3) AS x FROM atoms", "atoms")
def f4_resolved(spark, sf_dir):
    """Atoms with two or three locations; where two have the highest occupancy, the first line wins, whatever its serial."""
    atoms = view(spark, sf_dir, "atoms").withColumns({"icode": F.lit(""), "occupancy": F.when(F.col("serial") % 82 == 0, 0.3).otherwise(1.0), "line": 2 * F.col("serial")})
    other = atoms.where("serial % 41 = 0").withColumns({"serial": F.col("serial") + 100000000, "x": F.col("x") + 0.3, "occupancy": F.lit(0.4), "line": F.col("line") + 1})
    third = other.where("serial % 3 = 1").withColumns({"serial": F.col("serial") + 100000000, "line": F.col("line") - 2})
    return structure.resolved(atoms.unionByName(other).unionByName(third)).select("structure_id", "model", "chain_id", "record", "res_seq", "atom_name", "serial", F.round("x", 3).alias("x"))


@query("SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 2")
def f5_catalogue(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    human = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Eukaryota"), F.lit("Homo sapiens"))).otherwise(F.array(F.lit("Eukaryota")))
    return structure.catalogue(orders.select(F.col("o_orderkey").alias("entry_id"), human.alias("lineage"), (F.col("o_orderkey") % 4).cast("int").alias("protein_entities")))


@query("WITH c AS (SELECT structure_id, bgn_seq AS contact, bgn_chain, end_chain, raw_type, CASE WHEN raw_type = 'polar' THEN 'x' || bgn_seq ELSE bgn_seq END AS bgn_seq, end_seq FROM contacts), t AS (SELECT *, least(bgn_chain, end_chain) || '-' || greatest(bgn_chain, end_chain) AS pair, bgn_chain <> end_chain AND regexp_matches(CASE WHEN bgn_chain = 'A' THEN bgn_seq ELSE end_seq END, '^-?[0-9]') AS used FROM c) SELECT structure_id, string_agg(DISTINCT pair, ',' ORDER BY pair) AS chain_pairs, coalesce(string_agg(DISTINCT raw_type, ',' ORDER BY raw_type) FILTER (WHERE used), '') AS raw_types, count(DISTINCT contact) FILTER (WHERE used AND raw_type <> 'unmapped') AS mapped FROM t GROUP BY 1", "contacts")
def a18_diagnostics(spark, sf_dir):
    rows = view(spark, sf_dir, "contacts").withColumn("contact", F.col("bgn_seq"))  # rows of one number are one contact of several types
    rows = rows.withColumn("bgn_seq", F.when(F.col("raw_type") == "polar", F.concat(F.lit("x"), "bgn_seq")).otherwise(F.col("bgn_seq")))
    d = contacts.diagnostics(rows)
    return d.withColumns({"chain_pairs": F.array_join("chain_pairs", ","), "raw_types": F.array_join("raw_types", ",")})


@query("WITH n AS (SELECT structure_id, chain_id, count(DISTINCT (record, res_seq)) AS c, min(serial) AS f FROM atoms GROUP BY 1, 2), l AS (SELECT structure_id, arg_max(chain_id, (c, -f)) AS longest FROM n GROUP BY 1), s AS (SELECT *, CAST(substr(structure_id, 2) AS INT) % 3 AS kind FROM atoms JOIN l USING (structure_id)) SELECT structure_id, serial, CASE kind WHEN 0 THEN chain_id WHEN 1 THEN CASE WHEN chain_id = longest THEN 'A' ELSE 'B' END ELSE CASE WHEN chain_id = 'A' THEN 'B' ELSE 'A' END END AS chain_id, res_seq, res_name FROM s WHERE record = 'ATOM'", "atoms")
def p5_w1_normalized_dimers(spark, sf_dir):
    kind = F.substring("structure_id", 2, 9).cast("int") % 3
    first = F.col("chain_id") == "A"
    name = F.when(kind == 0, F.col("chain_id")).when(kind == 1, F.when(first, "X").otherwise("Y")).otherwise(F.when(first, "L").otherwise("H"))
    atoms = view(spark, sf_dir, "atoms").withColumn("chain_id", name)
    second = atoms.withColumn("model", F.lit(2))
    return structure.normalized_dimers(atoms.unionByName(second))[0].select("structure_id", "serial", "chain_id", "res_seq", "res_name")


@query("SELECT structure_id, 'load' AS stage, 'no chain C' AS reason FROM atoms GROUP BY 1 UNION ALL SELECT DISTINCT structure_id || 'x', 'load', 'no file' FROM atoms", "atoms")
def f3_j8_missing(spark, sf_dir):
    atoms = view(spark, sf_dir, "atoms")
    one = atoms.select("structure_id", F.lit("A").alias("chain_a"), F.lit("C").alias("chain_b")).distinct()
    return structure.missing_chains(atoms, one.unionByName(one.withColumn("structure_id", F.concat("structure_id", F.lit("x")))))


PLACED = f"{SIDES}, n AS (SELECT a.structure_id, a.serial, a.res_seq, a.res_name, arg_min(b.serial, ({DIST}, b.serial)) AS vid FROM a JOIN b ON a.structure_id=b.structure_id WHERE {DIST} < 4 GROUP BY 1, 2, 3, 4), r AS (SELECT n.structure_id, n.res_seq, min(n.res_name) AS res_name, avg(b.x/12) AS u, avg(b.y/12) AS v FROM n JOIN b ON n.structure_id=b.structure_id AND n.vid=b.serial GROUP BY 1, 2)"


def placed(spark, sf_dir):
    """Residues of chain A on a patch whose vertices are the atoms of chain B."""
    a, b = sides(spark, sf_dir)
    patch = b.select("structure_id", F.lit(1).alias("patch_id"), F.col("serial").alias("vid"), "x", "y", "z")
    uv = patch.select("structure_id", "patch_id", "vid", (F.col("x") / 12).alias("u"), (F.col("y") / 12).alias("v"))
    return mapview.placed_residues(mapview.on_patch(mapview.close_atoms(a, b), patch, 4.0), a, uv)


@query(f"WITH {PLACED} SELECT structure_id, res_seq, res_name, round(u, 9) AS u, round(v, 9) AS v FROM r", "atoms")
def a8_f14_f15_placed_residues(spark, sf_dir):
    return placed(spark, sf_dir).select("structure_id", "res_seq", "res_name", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@query(f"WITH {PLACED}, c AS (SELECT structure_id, TRY_CAST(nullif(regexp_extract(CASE WHEN bgn_chain='A' THEN bgn_seq ELSE end_seq END, '^\\s*(-?\\d+)', 1), '') AS INT) AS res_seq, {MAPPED} AS type FROM contacts WHERE least(bgn_chain, end_chain)='A' AND greatest(bgn_chain, end_chain)='B'), t AS (SELECT structure_id, res_seq, arg_min(type, list_position([{quoted(INTERACTIONS)}], type)) AS type FROM c WHERE type IN ('pi_stack', 'hbond') GROUP BY 1, 2) SELECT structure_id, res_name || res_seq AS label, '1_' || res_name || res_seq AS uid, type, CASE type WHEN 'pi_stack' THEN '#8A2BE2' ELSE '#0000FF' END AS color FROM r JOIN t USING (structure_id, res_seq)", "atoms", "contacts")
def f17_j7_p7_styled_points(spark, sf_dir):
    types = contacts.annotated_types(view(spark, sf_dir, "contacts"))
    points = mapview.styled(placed(spark, sf_dir).join(types, ["structure_id", "res_seq"], "left"), active=["pi_stack", "hbond"])
    return points.select("structure_id", "label", "uid", "type", "color")


CHOSEN = f"""{PAIRS}, near AS (SELECT DISTINCT a.structure_id, a.serial FROM a JOIN b ON a.structure_id=b.structure_id AND {DIST} < 8),
notes AS (SELECT structure_id, res_seq, type FROM (SELECT structure_id, TRY_CAST(nullif(regexp_extract(CASE WHEN bgn_chain='A' THEN bgn_seq ELSE end_seq END, '^\\s*(-?\\d+)', 1), '') AS INT) AS res_seq, {MAPPED} AS type
  FROM contacts WHERE CAST(substr(structure_id, 2) AS INT) % 2 = 0 AND least(bgn_chain, end_chain)='A' AND greatest(bgn_chain, end_chain)='B') q WHERE type IS NOT NULL AND res_seq IS NOT NULL),
noted AS (SELECT DISTINCT structure_id FROM notes),
r AS (SELECT structure_id, res_seq, min(res_name) AS res_name, avg(x/12) AS u, avg(y/12) AS v FROM a WHERE structure_id IN (FROM noted) OR (structure_id, serial) IN (FROM near) GROUP BY 1, 2),
k AS (SELECT * FROM notes UNION ALL SELECT structure_id, res_seq, type FROM t WHERE type IS NOT NULL AND structure_id NOT IN (FROM noted)),
best AS (SELECT structure_id, res_seq, arg_min(type, list_position([{quoted(INTERACTIONS)}], type)) AS type FROM k GROUP BY 1, 2)"""


@query(f"WITH {CHOSEN} SELECT structure_id, '1_' || res_name || res_seq AS uid, round(u, 9) AS u, round(v, 9) AS v, type FROM r JOIN best USING (structure_id, res_seq)", "atoms", "contacts")
def a18_f15_j7_chosen_types(spark, sf_dir):
    """Maps of a batch in which every second structure has contacts of known types; the others have contacts, but of unknown types only, and fall back to distances."""
    a, b = sides(spark, sf_dir)
    odd = F.substring("structure_id", 2, 9).cast("int") % 2 == 1
    rows = view(spark, sf_dir, "contacts").withColumn("raw_type", F.when(odd, "unmapped").otherwise(F.col("raw_type")))
    patch = a.select("structure_id", F.lit(1).alias("patch_id"), F.col("serial").alias("vid"), "x", "y", "z")
    uv = patch.select("structure_id", "patch_id", "vid", (F.col("x") / 12).alias("u"), (F.col("y") / 12).alias("v"))
    none = patch.where("false").selectExpr("structure_id", "patch_id", "vid AS a", "vid AS b", "vid AS c")
    drawn = mapview.interface_map(none, patch.withColumn("z", F.col("z") + 0.1), uv, a, b, contacts.annotated_types(rows))
    return drawn.points.select("structure_id", "uid", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"), "type")


TARGETS = "t AS (SELECT structure_id, CAST(substr(structure_id, 2) AS INT) % 4 AS kind FROM (SELECT DISTINCT structure_id FROM atoms) q)"


@query(f"WITH {TARGETS} SELECT structure_id, 'found' AS stage, CASE kind WHEN 0 THEN structure_id || '.pdb' WHEN 1 THEN structure_id ELSE structure_id || '.pdb' END AS detail FROM t WHERE kind < 3 UNION ALL SELECT structure_id, 'load', 'no file' FROM t WHERE kind = 3", "atoms")
def j8_resolved_targets(spark, sf_dir):
    """Targets whose file has the extension, is called as the id itself, both, or neither."""
    ids = view(spark, sf_dir, "atoms").select("structure_id").distinct().withColumn("kind", F.substring("structure_id", 2, 9).cast("int") % 4)
    name = F.explode(F.when(F.col("kind") == 0, F.array(F.concat("structure_id", F.lit(".pdb")))).when(F.col("kind") == 1, F.array("structure_id"))
                     .when(F.col("kind") == 2, F.array("structure_id", F.concat("structure_id", F.lit(".pdb")))).otherwise(F.array(F.concat("structure_id", F.lit(".PDB"))))).alias("name")
    files = ids.select(name).withColumn("file", F.concat(F.lit("/in/"), "name"))
    found, status = structure.resolved_targets(ids.select("structure_id", F.lit("A").alias("chain_a")), files)
    have = found.select("structure_id", F.lit("found").alias("stage"), F.regexp_extract("file", "([^/]+)$", 1).alias("detail"))
    return have.unionByName(status.select("structure_id", "stage", F.col("reason").alias("detail")))


FATES = {0: ("drawn", "map"), 1: ("surface", "no surface"), 2: ("patches", "no interface patch"), 3: ("load", "no chain B"), 4: ("flatten", "no patch could be flattened"), 5: ("load", "no file")}


@query("WITH t AS (SELECT structure_id, CAST(substr(structure_id, 2) AS INT) % 5 AS kind FROM (SELECT DISTINCT structure_id FROM atoms) q UNION ALL SELECT DISTINCT structure_id || 'x', 5 FROM atoms), f(kind, stage, reason) AS (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in FATES.items()) + ") SELECT structure_id, 0 AS patch_id, stage, reason FROM t JOIN f USING (kind) UNION ALL SELECT structure_id, 1, 'flatten', 'no boundary' FROM t WHERE kind = 4", "atoms")
def p1_f18_status(spark, sf_dir):
    """What becomes of every target: drawn, or left out at a stage for a reason; and which patches were left out.

    By structure number: as it is; chain A only of waters and ligands; chain B far away; chain B called C; a chain A of one residue
    beside chain B, all of whose closed surface is the one patch; and targets without a file.
    """
    atoms = view(spark, sf_dir, "atoms").withColumn("kind", F.substring("structure_id", 2, 9).cast("int") % 5)
    first, kind = F.col("chain_id") == "A", F.col("kind")
    atoms = atoms.where((kind != 4) | ~first | (F.col("res_seq") == 1))
    atoms = atoms.withColumns({
        "record": F.when((kind == 1) & first, "HETATM").otherwise(F.col("record")), "z": F.when((kind == 2) & ~first, F.col("z") + 50).otherwise(F.col("z")),
        "chain_id": F.when((kind == 3) & ~first, "C").otherwise(F.col("chain_id")),
    })
    targets = atoms.select("structure_id", F.lit("A").alias("chain_a"), F.lit("B").alias("chain_b")).distinct()
    targets = materialize(targets.unionByName(targets.withColumn("structure_id", F.concat("structure_id", F.lit("x")))))
    drawn, status = reports.interface_maps(atoms.drop("kind"), targets)
    have = structure.missing(drawn.edges.select("structure_id").distinct(), "drawn", "map")
    return have.unionByName(status).withColumn("patch_id", F.coalesce("patch_id", F.lit(0)))  # 0: the whole structure


PATCH_ROWS = "rows0 AS (SELECT CONCAT('S', CAST(CAST(FLOOR(k/10) AS BIGINT) AS VARCHAR(20))) AS structure_id, CAST(k%10+1 AS INT) AS patch, 50+2*((k*7919)%97)+CASE WHEN k%10=0 THEN 1 ELSE 0 END AS vertices, " + ", ".join(
    f"CAST((k*{104729 + 2 * i})%100003 AS DOUBLE)/{'1000003' if v.endswith('std') else '1009'} AS {v}" for i, v in enumerate(reports.VALUES)
) + ", CASE WHEN k%7=3 THEN 'no boundary' ELSE 'ok' END AS status FROM (SELECT o_orderkey AS k FROM orders) o)"
ROUNDED = ", ".join(f"round({v}, {reports.digits(v)}) AS {v}" for v in reports.VALUES)


@query(f"WITH {PATCH_ROWS}, p AS (SELECT structure_id, patch, vertices, {ROUNDED}, status FROM rows0) SELECT structure_id, CAST(patch AS VARCHAR) AS patch_id, vertices, {', '.join(reports.VALUES)}, status FROM p UNION ALL SELECT structure_id, 'weighted_avg', sum(vertices)::BIGINT, {', '.join(f'round(sum({v}*vertices)/sum(vertices), 4)' for v in reports.VALUES)}, coalesce(max(status) FILTER (WHERE status <> 'ok'), 'ok') FROM p GROUP BY 1 UNION ALL SELECT structure_id, 'largest', vertices, {', '.join(reports.VALUES)}, status FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY vertices DESC, patch) AS nth FROM p) q WHERE nth = 1")
def a12_a13_u1_totals(spark, sf_dir):
    """Totals over the patches of structures whose weighted angles need four digits; odd totals of vertices, as even ones give averages halfway between two roundings."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    rows = spark.sql(f"WITH {PATCH_ROWS.replace('FROM orders', 'FROM {orders}')} SELECT * FROM rows0", orders=orders)
    return reports.with_totals(rows)


LOOPS = f"{EDGES}, d AS (SELECT mesh_id, a AS p, b AS q FROM mesh_faces UNION ALL SELECT mesh_id, b, c FROM mesh_faces UNION ALL SELECT mesh_id, c, a FROM mesh_faces), o AS (SELECT d.* FROM d LEFT JOIN d r ON d.mesh_id=r.mesh_id AND d.p=r.q AND d.q=r.p WHERE r.p IS NULL), w AS (SELECT mesh_id, p AS root, p AS vid, 0 AS pos FROM o UNION ALL SELECT w.mesh_id, w.root, o.q, w.pos+1 FROM w JOIN o ON o.mesh_id=w.mesh_id AND o.p=w.vid WHERE o.q <> w.root), k AS (SELECT mesh_id, root, min(vid) AS low, count(*) AS n FROM w GROUP BY 1, 2), lp AS (SELECT w.mesh_id, w.root AS loop, CAST(w.pos AS BIGINT) AS pos, n, w.vid FROM w JOIN k ON k.mesh_id=w.mesh_id AND k.root=w.root AND k.low=w.root), best AS (SELECT mesh_id, arg_max(loop, (n, -loop)) AS loop FROM lp GROUP BY 1), l1 AS (SELECT lp.* FROM lp JOIN best USING (mesh_id, loop))"


@query(f"WITH RECURSIVE {LOOPS} SELECT mesh_id, loop, pos, n, vid FROM lp", "mesh_faces")
def g5_boundary_loops(spark, sf_dir):
    return flatten.boundary_loops(view(spark, sf_dir, "mesh_faces"))


@query(f"WITH RECURSIVE {LOOPS}, z AS (SELECT l1.mesh_id, l1.pos, l1.vid, x, y, z FROM l1 JOIN mesh_vertices v ON v.mesh_id=l1.mesh_id AND v.vid=l1.vid) SELECT f.mesh_id, f.vid AS first, arg_max(t.vid, ((t.x-f.x)*(t.x-f.x)+(t.y-f.y)*(t.y-f.y)+(t.z-f.z)*(t.z-f.z), -t.vid)) AS far FROM z f JOIN z t ON f.mesh_id=t.mesh_id AND f.pos=0 GROUP BY 1, 2", "mesh_faces", "mesh_vertices")
def w5_w6_farthest(spark, sf_dir):
    faces, at = meshes(spark, sf_dir)
    return flatten.farthest(flatten.longest_loop(flatten.boundary_loops(faces)), at)


@query(f"WITH RECURSIVE {LOOPS}, z AS (SELECT l1.mesh_id, l1.pos, l1.n, l1.vid, x, y, z FROM l1 JOIN mesh_vertices v ON v.mesh_id=l1.mesh_id AND v.vid=l1.vid), s AS (SELECT z.mesh_id, z.vid, z.pos, sqrt((z.x-y.x)*(z.x-y.x)+(z.y-y.y)*(z.y-y.y)+(z.z-y.z)*(z.z-y.z)) AS len FROM z JOIN z y ON z.mesh_id=y.mesh_id AND y.pos=(z.pos+1)%z.n), c AS (SELECT mesh_id, vid, coalesce(sum(len) OVER (PARTITION BY mesh_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc, sum(len) OVER (PARTITION BY mesh_id) AS total FROM s) SELECT mesh_id, vid, round(arc, 6) AS arc, round(cos(2*pi()*arc/total), 6) + 0.0 AS u, round(sin(2*pi()*arc/total), 6) + 0.0 AS v FROM c", "mesh_faces", "mesh_vertices")
def w7_circle(spark, sf_dir):
    faces, at = meshes(spark, sf_dir)
    c = flatten.circle(flatten.longest_loop(flatten.boundary_loops(faces)), at)
    return c.select("mesh_id", "vid", F.round("arc", 6).alias("arc"), *[(F.round(k, 6) + 0.0).alias(k) for k in "uv"])


@query(f"WITH RECURSIVE {ADJ}, k AS (SELECT c.mesh_id, component, unnest([a, b, c.c]) AS vid FROM (SELECT * FROM mesh_faces JOIN comp USING (mesh_id, fid)) c), m AS (SELECT mesh_id, component, count(DISTINCT vid) AS n, min(vid) AS low FROM k GROUP BY 1, 2), best AS (SELECT mesh_id, arg_max(component, (n, -low)) AS component FROM m GROUP BY 1) SELECT f.mesh_id, f.fid, f.a, f.b, f.c FROM mesh_faces f JOIN comp USING (mesh_id, fid) JOIN best USING (mesh_id, component)", "mesh_faces")
def f12_largest_component(spark, sf_dir):
    return flatten.largest_component(view(spark, sf_dir, "mesh_faces"))


@query(f"WITH RECURSIVE {ADJ}, k AS (SELECT c.mesh_id, component, unnest([a, b, c.c]) AS vid FROM (SELECT * FROM mesh_faces JOIN comp USING (mesh_id, fid)) c), m AS (SELECT mesh_id, component, count(DISTINCT vid) AS n FROM k GROUP BY 1, 2) SELECT mesh_id, max(n) AS n_vertices FROM m GROUP BY 1 UNION ALL SELECT DISTINCT mesh_id + 1000000, 3 FROM mesh_faces WHERE mesh_id % 2 = 0", "mesh_faces")
def f11_f13_viable(spark, sf_dir):
    """All meshes, and beside each one that has one face: of three corners, or of two (not viable)."""
    faces, at = meshes(spark, sf_dir)
    third = F.when(F.col("mesh_id") % 2 == 0, F.col("t.c")).otherwise(F.col("t.a"))
    small = faces.groupBy("mesh_id").agg(F.min(F.struct("fid", "a", "b", "c")).alias("t")).select((F.col("mesh_id") + 1000000).alias("mesh_id"), "t.fid", "t.a", "t.b", third.alias("c"))
    _, points = flatten.cleaned(faces.unionByName(small), at.unionByName(at.withColumn("mesh_id", F.col("mesh_id") + 1000000)))
    return points.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))


def relaxed_sql(name: str, faces: str, at: str, rounds: int) -> str:
    """Tables up to `name`: the vertices of meshes m after rounds of smoothing that keep their volume, or as they were where a value isn't finite."""
    pairs = " UNION ".join(f"SELECT m, {p} AS i, {q} AS j FROM {faces}" for p in "abc" for q in "abc" if p != q)
    det = "p.x*(q.y*r.z-q.z*r.y)+p.y*(q.z*r.x-q.x*r.z)+p.z*(q.x*r.y-q.y*r.x)"
    size = lambda v: f"SELECT f.m, sum({det}) AS size FROM {faces} f JOIN {v} p ON f.m=p.m AND f.a=p.vid JOIN {v} q ON f.m=q.m AND f.b=q.vid JOIN {v} r ON f.m=r.m AND f.c=r.vid GROUP BY 1"
    sql, last = f"{name}n AS MATERIALIZED ({pairs}), {name}s AS MATERIALIZED ({size(at)})", at
    for k in range(rounds):
        sql += f""", {name}m{k} AS MATERIALIZED (SELECT v.m, v.vid, v.x+0.5*(coalesce(w.x, v.x)-v.x) AS x, v.y+0.5*(coalesce(w.y, v.y)-v.y) AS y, v.z+0.5*(coalesce(w.z, v.z)-v.z) AS z
  FROM {last} v LEFT JOIN (SELECT e.m, e.i, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {name}n e JOIN {last} v ON e.m=v.m AND e.j=v.vid GROUP BY 1, 2) w ON v.m=w.m AND v.vid=w.i),
{name}k{k} AS (SELECT m, CASE WHEN s.size/t.size > 0 THEN pow(s.size/t.size, 1.0::DOUBLE/3) ELSE 'nan'::DOUBLE END AS k FROM {name}s s JOIN ({size(f"{name}m{k}")}) t USING (m)),
{name}v{k} AS MATERIALIZED (SELECT m, vid, x*k AS x, y*k AS y, z*k AS z FROM {name}m{k} JOIN {name}k{k} USING (m))"""
        last = f"{name}v{k}"
    return f"{sql}, {name} AS MATERIALIZED (SELECT o.m, o.vid, {', '.join(f'CASE WHEN fine THEN w.{k} ELSE o.{k} END AS {k}' for k in 'xyz')} FROM {at} o JOIN {last} w USING (m, vid) JOIN (SELECT m, bool_and(isfinite(x) AND isfinite(y) AND isfinite(z)) AS fine FROM {last} GROUP BY 1) g USING (m))"


def sweep_sql(param: str, sigmas: list[float], cutoffs: list[float], least_vertices: int = 10) -> str:
    """P3 and P4 from atoms to areas: densities, levels, vertices and triangles, smoothing, distances, components, patches smoothed, areas."""
    head = faces_sql()
    cases = head[head.index("cases(mask") : head.index("cube AS")]
    taps = ", ".join(f"({s}::DOUBLE, {o}, {w!r}::DOUBLE)" for s in sigmas for o, w in density.kernel(s))
    cut = ", ".join(f"({c}::DOUBLE)" for c in cutoffs)
    sql = f"{SIDES}, {VOXELS}, k(sigma, o, w) AS (VALUES {taps}), u0 AS (SELECT structure_id, sigma, ix, iy, iz, d FROM v0, (SELECT DISTINCT sigma FROM k) q)"
    for j, x in enumerate("xyz"):
        to = f"CASE WHEN i{x}+o<0 THEN -(i{x}+o)-1 WHEN i{x}+o>=n{x} THEN 2*n{x}-1-(i{x}+o) ELSE i{x}+o END"
        at = ", ".join(f"{to} AS i{c}" if c == x else f"i{c}" for c in "xyz")
        sql += f", u{j + 1} AS MATERIALIZED (SELECT structure_id, sigma, ix, iy, iz, sum(m) AS d FROM (SELECT structure_id, sigma, {at}, d*w AS m FROM u{j} JOIN n USING (structure_id) JOIN k USING (sigma)) q GROUP BY 1, 2, 3, 4, 5)"
    counts = ", ".join(f"sum(CASE WHEN (d0 > s/{2**i}) <> (d1 > s/{2**i}) THEN 1 ELSE 0 END) AS n{i}" for i in range(4))
    sql += f""", st AS (SELECT structure_id, sigma, CASE WHEN max(d) <= 0.1 THEN max(d)/2 ELSE 0.1::DOUBLE END AS s FROM u3 GROUP BY 1, 2), ax(axis, dx, dy, dz) AS (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)),
g1 AS (SELECT structure_id, sigma, ix, iy, iz, axis, sum(d0) AS d0, sum(d1) AS d1 FROM (SELECT structure_id, sigma, ix, iy, iz, axis, d AS d0, 0.0::DOUBLE AS d1 FROM u3, ax UNION ALL SELECT structure_id, sigma, ix-dx, iy-dy, iz-dz, axis, 0.0::DOUBLE, d FROM u3, ax) q GROUP BY 1, 2, 3, 4, 5, 6),
ed AS MATERIALIZED (SELECT g1.* FROM g1 JOIN n USING (structure_id) JOIN ax USING (axis) WHERE least(ix, iy, iz) >= 0 AND ix+dx < nx AND iy+dy < ny AND iz+dz < nz),
ct AS (SELECT structure_id, sigma, s, {counts} FROM ed JOIN st USING (structure_id, sigma) GROUP BY 1, 2, 3), need AS (SELECT structure_id, least(500.0, count(*)*0.5) AS need FROM a GROUP BY 1),
lv AS (SELECT structure_id, sigma, structure_id || '/' || sigma AS m, CASE WHEN n0 >= need THEN s WHEN n1 >= need THEN s/2 WHEN n2 >= need THEN s/4 ELSE s/8 END AS l FROM ct JOIN need USING (structure_id)),
at0 AS MATERIALIZED (SELECT m, ((ix*ny+iy)*nz+iz)*3+axis AS vid, lox+ix+CASE WHEN axis=0 THEN (l-d0)/(d1-d0) ELSE 0 END AS x, loy+iy+CASE WHEN axis=1 THEN (l-d0)/(d1-d0) ELSE 0 END AS y, loz+iz+CASE WHEN axis=2 THEN (l-d0)/(d1-d0) ELSE 0 END AS z
  FROM ed JOIN lv USING (structure_id, sigma) JOIN n USING (structure_id) WHERE (d0 > l) <> (d1 > l)),
{cases}cube AS (SELECT structure_id, sigma, ix-ox AS ix, iy-oy AS iy, iz-oz AS iz, CAST(sum(bit) AS BIGINT) AS mask FROM u3 JOIN lv USING (structure_id, sigma), o WHERE d > l GROUP BY 1, 2, 3, 4, 5),
fc AS MATERIALIZED (SELECT m, ((ix*ny+iy)*nz+iz)*8+nth AS fid, {", ".join(f"(((ix+{k}.x)*ny+iy+{k}.y)*nz+iz+{k}.z)*3+{k}.axis AS {k}" for k in "abc")} FROM cube JOIN lv USING (structure_id, sigma) JOIN n USING (structure_id) JOIN cases USING (mask) WHERE least(ix, iy, iz) >= 0 AND ix+1 < nx AND iy+1 < ny AND iz+1 < nz),
{relaxed_sql("sm", "fc", "at0", 3)}, cuts(cutoff) AS (VALUES {cut}),
near AS MATERIALIZED (SELECT m, vid, min({DIST}) AS dist FROM sm a JOIN lv USING (m) JOIN b USING (structure_id) WHERE {DIST} < {max(cutoffs)} GROUP BY 1, 2),
hit AS (SELECT m, fid, min(dist) AS dist FROM (SELECT m, fid, unnest([a, b, c]) AS vid FROM fc) q JOIN near USING (m, vid) GROUP BY 1, 2),
pf AS MATERIALIZED (SELECT m, cutoff, fid, a, b, c FROM fc JOIN hit USING (m, fid), cuts WHERE dist < cutoff),
ad AS (SELECT m, cutoff, min(fid) AS f, max(fid) AS g FROM (SELECT m, cutoff, fid, unnest([{{'u': least(a,b), 'v': greatest(a,b)}}, {{'u': least(b,c), 'v': greatest(b,c)}}, {{'u': least(c,a), 'v': greatest(c,a)}}]) AS e FROM pf) q GROUP BY m, cutoff, e HAVING count(*)=2),
ad2 AS MATERIALIZED (SELECT m, cutoff, f, g FROM ad UNION ALL SELECT m, cutoff, g, f FROM ad), c0 AS (SELECT m, cutoff, fid, fid AS label FROM pf)"""
    for k in range(14):  # the least label of neighbours, then the label of the label
        sql += f""", h{k} AS MATERIALIZED (SELECT c.m, c.cutoff, c.fid, least(c.label, coalesce(q.label, c.label)) AS label FROM c{k} c LEFT JOIN (SELECT m, cutoff, f, min(label) AS label FROM ad2 JOIN c{k} x USING (m, cutoff) WHERE x.fid=g GROUP BY 1, 2, 3) q ON c.m=q.m AND c.cutoff=q.cutoff AND c.fid=q.f),
c{k + 1} AS MATERIALIZED (SELECT h.m, h.cutoff, h.fid, j.label FROM h{k} h JOIN h{k} j ON h.m=j.m AND h.cutoff=j.cutoff AND h.label=j.fid)"""
    sql += f""", big AS (SELECT m, cutoff, label FROM (SELECT m, cutoff, label, unnest([a, b, c]) AS vid FROM pf JOIN c14 USING (m, cutoff, fid)) q GROUP BY 1, 2, 3 HAVING count(DISTINCT vid) >= {least_vertices}),
rf0 AS MATERIALIZED (SELECT pf.m AS mesh, cutoff, pf.m || '/' || cutoff || '/' || label AS m, fid, a, b, c FROM pf JOIN c14 USING (m, cutoff, fid) JOIN big USING (m, cutoff, label)),
rv AS MATERIALIZED (SELECT DISTINCT q.m, q.vid, x, y, z FROM (SELECT mesh, m, unnest([a, b, c]) AS vid FROM rf0) q JOIN sm ON sm.m=q.mesh AND sm.vid=q.vid), {relaxed_sql("rs", "rf0", "rv", 5)},
total AS (SELECT f.mesh AS m, f.cutoff, sum({CROSS}) AS area FROM rf0 f JOIN rs p ON f.m=p.m AND f.a=p.vid JOIN rs q ON f.m=q.m AND f.b=q.vid JOIN rs r ON f.m=r.m AND f.c=r.vid GROUP BY 1, 2)
SELECT structure_id, '{param}' AS param, {param} AS value, round(coalesce(area, 0), 4) AS area FROM lv CROSS JOIN cuts LEFT JOIN total USING (m, cutoff)"""
    return f"WITH {sql}"


@query(sweep_sql("cutoff", [1.5], [3 + i / 2 for i in range(11)]), "atoms")
def p3_sweep_cutoff(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return sweeps.sweep_cutoff(a, points(b)).withColumn("area", F.round("area", 4))


@query(sweep_sql("sigma", [0.5, 1.0, 1.5, 2.0, 2.5, 3.0], [5.0]), "atoms")
def p4_sweep_sigma(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return sweeps.sweep_sigma(a, points(b)).withColumn("area", F.round("area", 4))


def unchecked(f: Query) -> Query:
    """Registers a query that SQL can't state; tests hold it against properties."""
    QUERIES[f.__name__] = f
    return f


@unchecked
def p2_distortion_report(spark, sf_dir):
    a, b = map(materialize, sides(spark, sf_dir))
    faces, at = sweeps.surface(a)
    patches = sweeps.interface(faces, materialize(sweeps.distances(at, points(b), 5.0)), 5.0)
    return reports.distortion_report(patches, at, structure.first_two_chains(view(spark, sf_dir, "atoms")))


@unchecked
def g6_harmonic(spark, sf_dir):
    faces, at = flatten.cleaned(*meshes(spark, sf_dir))
    return flatten.harmonic(faces, at, materialize(flatten.longest_loop(flatten.boundary_loops(faces))))


@unchecked
def g7_conformal(spark, sf_dir):
    return flatten.flattened(*flatten.cleaned(*meshes(spark, sf_dir)))


@unchecked
def p1_interface_map(spark, sf_dir):
    a, b = map(materialize, sides(spark, sf_dir))
    faces, at = sweeps.surface(a)
    patches = sweeps.interface(faces, materialize(sweeps.distances(at, points(b), 5.0)), 5.0)
    return reports.maps_of(patches, at, a, b)[0].points
