"""Boundary loops and plane coordinates of patches. Tables are keyed by mesh_id; all patches share each job.

A patch that can't be flattened (no faces, fewer than 3 vertices, a boundary of fewer than 3, a system
without a finite solution) has no rows in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize, shuffled, tidy
from . import mesh
from .project import normal_uv

SOLVE = "no long, i long, x double"
LARGE = 200_000  # unknowns of one system that a single task may hold (some 50 MB); see solve()


def directed_boundary(faces: DataFrame) -> DataFrame:
    """mesh_id, u, v: edges with one face, in the direction of that face."""
    ends = F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    edges = faces.select("mesh_id", ends.alias("e")).groupBy("mesh_id", F.least("e.u", "e.v").alias("lo"), F.greatest("e.u", "e.v").alias("hi"))
    return edges.agg(F.count("*").alias("n"), F.max("e").alias("e")).where("n = 1").select("mesh_id", "e.u", "e.v")


def task_loops(edges):
    """no, loop, pos, n, vid of the closed loops of the directed edges of the meshes in a task."""
    import numpy as np
    import pandas as pd

    keys = mesh.Keys(edges["no"], edges[["u", "v"]])
    rows = sorted(map(tuple, keys.of(edges["no"].to_numpy(), edges[["u", "v"]].to_numpy()).tolist()))
    out, into = {}, {}
    for u, v in rows:
        out.setdefault(u, []).append((u, v))  # in order of v
        into.setdefault(v, []).append((u, v))  # in order of u
    step = {e: (out[v][k] if k < len(out.get(v, ())) else None) for v, es in into.items() for k, e in enumerate(es)}
    found, seen = [], set()
    for first in rows:
        if first in seen:
            continue
        loop, at = [], first
        while at is not None and at not in seen:
            seen.add(at)
            loop.append(at)
            at = step[at]
        if at == first:  # else an open end
            found += [(first[0], k, len(loop), e[0]) for k, e in enumerate(loop)]
    found = np.array(found, np.int64).reshape(-1, 4)
    return pd.DataFrame({"no": keys.no(found[:, 0]), "loop": keys.id(found[:, 0]), "pos": found[:, 1], "n": found[:, 2], "vid": keys.id(found[:, 3])})


def task_boundary(no, corner):
    """no, u, v of `directed_boundary` of the faces in a task, by the mesh and the keys of the corners of each face."""
    import numpy as np
    import pandas as pd

    ends = np.concatenate([corner[:, [0, 1]], corner[:, [1, 2]], corner[:, [2, 0]]])
    edge = np.sort(ends, axis=1)
    order = np.lexsort((edge[:, 1], edge[:, 0]))
    start = np.flatnonzero(np.r_[True, (np.diff(edge[order], axis=0) != 0).any(axis=1)][: len(order)])
    one = order[start[np.diff(np.r_[start, len(order)]) == 1]]
    return pd.DataFrame({"no": np.tile(no, 3)[one], "u": ends[one, 0], "v": ends[one, 1]})


@tidy
def boundary_loops(faces: DataFrame, large: int = LARGE) -> DataFrame:
    """mesh_id, loop, pos, n, vid: the vertices of every closed boundary, in the direction of its faces; written.

    A loop starts at, and is named by, its lowest vid. Where loops touch in a vertex, its incoming and
    outgoing edges are paired in order of vid; a vertex passed twice has two rows. The edges of a mesh that has up to `large`
    faces are found and followed in one task, those of larger ones by joins.
    """
    faces = faces.select("mesh_id", "a", "b", "c")
    kind = faces.schema["mesh_id"].dataType.simpleString()
    (dealt,), sizes, most = mesh.task_numbers(faces)
    big = sizes.where(F.col("size") > large).select("mesh_id")

    def run(f):
        names = mesh.Names(f["mesh_id"])
        keys = mesh.Keys(names.nos[0], f[["a", "b", "c"]])
        edges = task_boundary(names.nos[0], keys.of(names.nos[0], f[["a", "b", "c"]].to_numpy()))
        out = task_loops(edges.assign(u=keys.id(edges["u"].to_numpy()), v=keys.id(edges["v"].to_numpy())))
        return out.assign(mesh_id=names.ids[out["no"].to_numpy()])[["mesh_id", "loop", "pos", "n", "vid"]]

    some = dealt.join(big, "mesh_id", "left_anti") if most > large else dealt
    out = materialize(some.groupBy("task").applyInPandas(lambda f: run(f), f"mesh_id {kind}, loop long, pos long, n long, vid long"))
    return materialize(out.unionByName(joined_loops(materialize(directed_boundary(faces.join(big, "mesh_id", "left_semi")))))) if most > large else out


def joined_loops(edges: DataFrame) -> DataFrame:
    """`boundary_loops` by pointer doubling: each round doubles the stretch of edges whose lowest edge is known."""
    into = edges.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id", "v").orderBy("u")))
    out = edges.withColumn("k", F.row_number().over(Window.partitionBy("mesh_id", "u").orderBy("v")))
    node = F.struct("u", "v")
    step = into.select("mesh_id", node.alias("e"), F.col("v").alias("at"), "k").join(out.select("mesh_id", F.col("u").alias("at"), "k", node.alias("next")), ["mesh_id", "at", "k"], "left")
    state = materialize(step.select("mesh_id", "e", "next", F.col("e").alias("low"), F.lit(0).cast("long").alias("d")))
    size = 1
    while True:
        far = state.select("mesh_id", F.col("e").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("d").alias("d2"))
        both = state.join(far, ["mesh_id", "next"], "left")
        lower = F.col("low2") < F.col("low")
        new = materialize(both.select("mesh_id", "e", F.col("next2").alias("next"), F.when(lower, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("d2") + size).otherwise(F.col("d")).alias("d"), F.coalesce(lower, F.lit(False)).alias("moved")))
        state, size = new.drop("moved"), 2 * size
        if not new.where("moved").limit(1).count():
            break
    whole = Window.partitionBy("mesh_id", "low")
    closed = state.withColumns({"n": F.count("*").over(whole), "open": F.max(F.col("next").isNull()).over(whole)}).where(~F.col("open"))
    return closed.select("mesh_id", F.col("low.u").alias("loop"), F.pmod(F.col("n") - F.col("d"), F.col("n")).alias("pos"), "n", F.col("e.u").alias("vid"))


def longest_loop(loops: DataFrame) -> DataFrame:
    """The loop of most vertices of each mesh (the lowest vid on ties), if it has 3 or more."""
    sizes = loops.groupBy("mesh_id", "loop").agg(F.count("*").alias("size"))
    best = sizes.groupBy("mesh_id").agg(F.max_by("loop", F.struct("size", -F.col("loop"))).alias("loop"), F.max("size").alias("size")).where("size >= 3")
    return loops.join(shuffled(best.select("mesh_id", "loop")), ["mesh_id", "loop"], "left_semi")


def farthest(loop: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, first, far: the first vertex of a loop and the one at the largest distance from it (the lowest vid on ties)."""
    at = shuffled(loop.select("mesh_id", "pos", "vid")).join(vertices, ["mesh_id", "vid"])
    first = at.where("pos = 0").select("mesh_id", F.col("vid").alias("first"), *[F.col(k).alias(f"f{k}") for k in "xyz"])
    d2 = sum(((F.col(k) - F.col(f"f{k}")) * (F.col(k) - F.col(f"f{k}")) for k in "xyz"), F.lit(0.0))
    return at.join(shuffled(first), "mesh_id").groupBy("mesh_id", "first").agg(F.max_by("vid", F.struct(d2, -F.col("vid"))).alias("far"))


def circle(loop: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, vid, arc, u, v: the loop on the unit circle, by the length of its chords."""
    ring = Window.partitionBy("mesh_id").orderBy("pos")
    at = shuffled(loop.select("mesh_id", "pos", "vid")).join(vertices, ["mesh_id", "vid"])
    back = [F.lag(k).over(ring).alias(f"p{k}") for k in "xyz"]
    ends = [F.last(k).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"e{k}") for k in "xyz"]
    gap = lambda p: F.sqrt(sum(((F.col(k) - F.col(f"{p}{k}")) * (F.col(k) - F.col(f"{p}{k}")) for k in "xyz"), F.lit(0.0)))
    step = at.select("*", *back, *ends).withColumn("len", F.coalesce(gap("p"), F.lit(0.0))).withColumn("close", F.when(F.col("pos") == 0, gap("e")).otherwise(0.0))
    total = F.sum(F.col("len") + F.col("close")).over(Window.partitionBy("mesh_id"))
    arc = step.withColumns({"arc": F.sum("len").over(ring.rowsBetween(Window.unboundedPreceding, 0)), "total": total})
    turn = F.col("arc") / F.when(F.col("total") > 0, F.col("total")) * (2 * math.pi)
    return arc.select("mesh_id", "vid", "arc", F.cos(turn).alias("u"), F.sin(turn).alias("v"))


def largest_component(faces: DataFrame) -> DataFrame:
    """The faces of the component with most vertices (the lowest vid on ties)."""
    part = faces.join(shuffled(mesh.components(faces)), ["mesh_id", "fid"])
    sizes = mesh.corners(part, "component").groupBy("mesh_id", "component").agg(F.count_distinct("vid").alias("n"), F.min("vid").alias("low"))
    best = sizes.groupBy("mesh_id").agg(F.max_by("component", F.struct("n", -F.col("low"), -F.col("component"))).alias("component"))
    return part.join(shuffled(best), ["mesh_id", "component"], "left_semi").select("mesh_id", "fid", "a", "b", "c")


def cleaned(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Merged vertices, valid faces of the largest component; meshes of fewer than 3 vertices go; both are written."""
    return mended(faces, vertices, lambda m: m.merged().valid(1e-12).used().largest(), lambda f, v: joined_largest(*joined_clean(f, v)), large)


@tidy
def mended(faces: DataFrame, vertices: DataFrame, task, joined, large: int) -> tuple[DataFrame, DataFrame]:
    """`mesh.by_mesh`; meshes with a vertex that isn't finite go by joins too, since comparisons of such values differ in tasks."""
    odd = materialize(vertices.where(f"not coalesce({mesh.FINITE}, false)").select("mesh_id").distinct())
    if not odd.limit(1).count():
        return mesh.by_mesh(faces, vertices, task, joined, large)
    plain = mesh.by_mesh(*(df.join(odd, "mesh_id", "left_anti") for df in (faces, vertices)), task, joined, large)
    rest = joined(*(materialize(df.join(odd, "mesh_id", "left_semi")) for df in (faces, vertices)))
    return tuple(materialize(x.unionByName(y.select(x.columns))) for x, y in zip(plain, rest, strict=True))


def conformal_entries(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, i, j, re, im: the Hermitian matrix of conformal energy.

    For the corners i and j of a face, with e the edges opposite them, conj(e_i) e_j / (2 area): re are
    the cotangent weights of Dirichlet energy, im is 1, -1 or 0 by orientation.
    """
    out = faces.select("mesh_id", "a", "b", "c")
    for p in "abc":
        out = out.join(shuffled(vertices.select("mesh_id", F.col("vid").alias(p), F.array("x", "y", "z").alias(f"p{p}"))), ["mesh_id", p])
    minus = lambda s, t: F.zip_with(s, t, lambda x, y: x - y)
    dot = lambda s, t: F.aggregate(F.zip_with(s, t, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    out = out.withColumns({"ea": minus("pc", "pb"), "eb": minus("pa", "pc"), "ec": minus("pb", "pa")})
    area2 = F.sqrt(F.greatest(dot("ea", "ea") * dot("eb", "eb") - dot("ea", "eb") * dot("ea", "eb"), F.lit(0.0)))
    out = out.withColumn("area2", area2).where("area2 > 0")
    turn = {"ab": 1.0, "bc": 1.0, "ca": 1.0, "ba": -1.0, "cb": -1.0, "ac": -1.0}
    items = [F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (dot(f"e{p}", f"e{q}") / F.col("area2")).alias("re"), F.lit(turn.get(p + q, 0.0)).alias("im")) for p in "abc" for q in "abc"]
    return out.select("mesh_id", F.explode(F.array(*items)).alias("t")).groupBy("mesh_id", "t.i", "t.j").agg(F.sum("t.re").alias("re"), F.sum("t.im").alias("im"))


def task_cg(rows, tol: float = 1e-10):
    """no, i, x of the systems in a task from their rows no, i, j, w; j is null on the right-hand side. Systems that don't converge have no rows.

    All systems take their rounds side by side, each with numbers of its own, until the last one ends.
    """
    import numpy as np
    import pandas as pd

    no, right, w = rows["no"].to_numpy(), rows["j"].isna().to_numpy(), rows["w"].to_numpy()
    keys = mesh.Keys(no, rows["i"])
    names, at = np.unique(keys.of(no, rows["i"].to_numpy()), return_inverse=True)
    n, part = len(names), np.unique(names // keys.span, return_inverse=True)[1]
    count = np.bincount(part)
    dot = lambda p, q: np.bincount(part, p * q, len(count))
    b = np.bincount(at[right], w[right], n)
    i, j, w = at[~right], np.searchsorted(names, keys.of(no[~right], rows["j"].to_numpy()[~right].astype(np.int64))), w[~right]
    diag = np.bincount(i[i == j], w[i == j], n)
    inverse = 1 / np.where(diag > 0, diag, 1.0)
    x, r = np.zeros(n), b.copy()
    p = inverse * r
    rz = dot(r, p)
    goal, left = tol * tol * rz, 20 * count + 100
    going = rz > goal
    with np.errstate(all="ignore"):
        while going.any():
            ap = np.bincount(i, w * p[j], n)
            curve = dot(p, ap)
            going = going & (curve > 0)
            step = np.where(going, rz / curve, 0.0)[part]
            x, r = np.where(step != 0, x + step * p, x), np.where(step != 0, r - step * ap, r)
            z = inverse * r
            new = dot(r, z)
            p = np.where(going[part], z + (new / rz)[part] * p, p)
            rz, left = np.where(going, new, rz), left - going
            going = going & (rz > goal) & (left > 0)
        fine = (rz <= goal) & (np.bincount(part, ~np.isfinite(x)) == 0)
    kept = fine[part]
    return pd.DataFrame({"no": keys.no(names[kept]), "i": keys.id(names[kept]), "x": x[kept]})


def spark_cg(a: DataFrame, b: DataFrame, tol: float = 1e-10) -> DataFrame:
    """key, i, x by the same iteration with joins and sums, for systems of any size; each round is written. Systems that don't converge give no rows."""
    diag = a.where("i = j").select("key", "i", (1 / F.col("w")).alias("m"))
    state = b.join(diag, ["key", "i"]).select("key", "i", F.lit(0.0).alias("x"), F.col("w").alias("r"), "m", (F.col("w") * F.col("m")).alias("p"))
    rz = F.sum(F.col("r") * F.col("r") * F.col("m"))
    dots = materialize(state.groupBy("key").agg(rz.alias("rz")).withColumn("goal", F.col("rz") * tol * tol))
    state = materialize(state)
    done = state.where("false")
    rounds = 20 * (b.groupBy("key").count().agg(F.max("count")).first()[0] or 0) + 100  # as in one task
    for _ in range(rounds):
        over = dots.where("rz <= goal").select("key")
        if over.limit(1).count():
            done = done.unionByName(state.join(over, "key", "left_semi"))
            state = state.join(over, "key", "left_anti")
        dots = dots.where("rz > goal")
        if not dots.limit(1).count():
            break
        ap = a.join(state.select("key", F.col("i").alias("j"), F.col("p").alias("pj")), ["key", "j"]).groupBy("key", "i").agg(F.sum(F.col("w") * F.col("pj")).alias("ap"))
        with_ap = materialize(state.join(ap, ["key", "i"]).join(dots, "key"))
        curve = with_ap.groupBy("key").agg(F.sum(F.col("p") * F.col("ap")).alias("curve")).where("curve > 0")
        moved = with_ap.join(curve, "key").withColumn("alpha", F.col("rz") / F.col("curve"))
        moved = materialize(moved.select("key", "i", "m", "p", "rz", "goal", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), (F.col("r") - F.col("alpha") * F.col("ap")).alias("r")))
        new = moved.groupBy("key").agg(rz.alias("new"))
        state = materialize(moved.join(new, "key").select("key", "i", "x", "r", "m", (F.col("r") * F.col("m") + F.col("new") / F.col("rz") * F.col("p")).alias("p")))
        dots = materialize(moved.groupBy("key").agg(rz.alias("rz"), F.first("goal").alias("goal")))
    return done.select("key", "i", "x").where("not isnan(x)")


def solve(a: DataFrame, b: DataFrame, large: int = LARGE) -> DataFrame:
    """key, i, x with A x = b for the sparse positive definite systems a(key, i, j, w), b(key, i, w): conjugate gradients.

    Systems of up to `large` unknowns run in one task, small ones many at a time, larger ones as joins over all executors.
    """
    a, b = materialize(a), materialize(b)
    names = mesh.bundled(b.groupBy("key").agg(F.count("*").alias("size")))
    rows = a.unionByName(b.withColumn("j", F.lit(None).cast("long"))).join(names.where(F.col("size") <= large), "key")
    small = rows.select("task", "no", "i", "j", "w").groupBy("task").applyInPandas(lambda rows: task_cg(rows), SOLVE)
    out = small.join(names.select("key", "no"), "no").select("key", "i", "x")
    big = names.where(F.col("size") > large).select("key")
    if big.limit(1).count():
        out = out.unionByName(spark_cg(a.join(big, "key", "left_semi"), b.join(big, "key", "left_semi")))
    return out


def reduced(entries: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the unknowns that known(key, i, x) leaves."""
    free = entries.join(shuffled(known.select("key", "i")), ["key", "i"], "left_anti")
    at = known.select("key", F.col("i").alias("j"), "x")
    split = materialize(free.join(shuffled(at), ["key", "j"], "left"))
    a = split.where("x is null").select("key", "i", "j", "w")
    return a, split.groupBy("key", "i").agg(F.sum(F.when(F.col("x").isNull(), 0.0).otherwise(-F.col("w") * F.col("x"))).alias("w"))


def harmonic(faces: DataFrame, vertices: DataFrame, loop: DataFrame, large: int = LARGE) -> DataFrame:
    """mesh_id, vid, u, v: the loop on the unit circle, other vertices at the least Dirichlet energy."""
    axis = F.explode(F.array(F.lit(0), F.lit(1))).alias("axis")
    key = F.struct("mesh_id", "axis").alias("key")
    entries = conformal_entries(faces, vertices).select("mesh_id", "i", "j", F.col("re").alias("w"), axis).select(key, "i", "j", "w")
    ring = circle(loop, vertices).groupBy("mesh_id", "vid").agg(F.first("u").alias("u"), F.first("v").alias("v"))
    known = materialize(ring.select("mesh_id", F.col("vid").alias("i"), "u", "v", axis).select(key, "i", F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v")).alias("x")))
    both = solve(*reduced(entries, known), large).unionByName(known)
    one = lambda k: F.max(F.when(F.col("key.axis") == k, F.col("x")))
    uv = both.groupBy("key.mesh_id", F.col("i").alias("vid")).agg(one(0).alias("u"), one(1).alias("v"))
    # A mesh whose system was not solved for both axes has no map.
    every = mesh.corners(faces).groupBy("mesh_id").agg(F.count_distinct("vid").alias("n"))
    solved = uv.where("u is not null and v is not null").groupBy("mesh_id").agg(F.count("*").alias("n"))
    return uv.join(shuffled(every.join(shuffled(solved), ["mesh_id", "n"]).select("mesh_id")), "mesh_id", "left_semi")


def conformal(faces: DataFrame, vertices: DataFrame, loop: DataFrame, large: int = LARGE) -> DataFrame:
    """mesh_id, vid, u, v at the least conformal energy, the first vertex of the loop at (0, 0), the farthest at (1, 0)."""
    def part(i: int, j: int, w: Column) -> Column:
        return F.struct((F.col("i") * 2 + i).alias("i"), (F.col("j") * 2 + j).alias("j"), w.alias("w"))

    re, im = F.col("re"), F.col("im")
    parts = F.explode(F.array(part(0, 0, re), part(0, 1, -im), part(1, 0, im), part(1, 1, re)))
    entries = conformal_entries(faces, vertices).select(F.col("mesh_id").alias("key"), parts.alias("t")).select("key", "t.*").where("w <> 0 or i = j")
    pins = F.explode(F.array(*[F.struct((F.col(p) * 2 + c).alias("i"), F.lit(x).alias("x")) for p, c, x in (("first", 0, 0.0), ("first", 1, 0.0), ("far", 0, 1.0), ("far", 1, 0.0))]))
    known = materialize(farthest(loop, vertices).where("first <> far").select(F.col("mesh_id").alias("key"), pins.alias("t")).select("key", "t.*"))
    entries = entries.join(shuffled(known.select("key").distinct()), "key", "left_semi")
    both = solve(*reduced(entries, known), large).unionByName(known)
    one = lambda c: F.max(F.when(F.col("i") % 2 == c, F.col("x")))
    uv = both.groupBy(F.col("key").alias("mesh_id"), F.floor(F.col("i") / 2).alias("vid")).agg(one(0).alias("u"), one(1).alias("v"))
    solved = uv.groupBy("mesh_id").agg(F.count("*").alias("n")).where("n > 2").select("mesh_id")  # the pins alone are no map
    return uv.join(shuffled(solved), "mesh_id", "left_semi")


def task_systems(m: mesh.Mesh):
    """(rows no, i, j, w of the reduced systems of `conformal` of the meshes in a task, the pinned vertices); i and j are 2 * place of the vertex + axis."""
    import numpy as np
    import pandas as pd

    (t, _), n = m.placed(), len(m.vid)
    no = m.vid // m.span
    loops = task_loops(task_boundary(no[t[:, 0]], t))
    sizes = loops.groupby(["no", "loop"]).size().reset_index(name="size")
    best = sizes[sizes["size"] >= 3].sort_values(["no", "size", "loop"], ascending=[True, False, True]).drop_duplicates("no")
    ring = loops.merge(best[["no", "loop"]], on=["no", "loop"])
    first, at = ring["loop"].to_numpy(), ring["vid"].to_numpy()
    d2 = ((m.at[at] - m.at[first]) ** 2).sum(axis=1)
    far = ring.assign(d2=d2).sort_values(["no", "d2", "vid"], ascending=[True, False, True]).drop_duplicates("no")
    far = far[far["loop"] != far["vid"]]
    pins = np.stack([far["loop"].to_numpy(), far["vid"].to_numpy()], 1).astype(np.int64)
    t = t[np.isin(no[t[:, 0]], far["no"].to_numpy())]
    p, q, r = (m.at[t[:, k]] for k in range(3))
    e = [r - q, p - r, q - p]
    dot = lambda x, y: (x * y).sum(axis=1)
    area2 = np.sqrt(np.maximum(dot(e[0], e[0]) * dot(e[1], e[1]) - dot(e[0], e[1]) ** 2, 0.0))
    fine = ~(area2 <= 0)
    t, e, area2 = t[fine], [x[fine] for x in e], area2[fine]
    pairs = [(x, y) for x in range(3) for y in range(3)]
    place = np.concatenate([t[:, x] * n + t[:, y] for x, y in pairs])
    re = np.concatenate([dot(e[x], e[y]) / area2 for x, y in pairs])
    im = np.concatenate([np.full(len(t), {0: 0.0, 1: 1.0, 2: -1.0}[(y - x) % 3]) for x, y in pairs])
    names, back = np.unique(place, return_inverse=True)
    re, im = (np.bincount(back.ravel(), w, len(names)) for w in (re, im))
    i, j = names // max(n, 1) * 2, names % max(n, 1) * 2
    i, j, w = np.r_[i, i, i + 1, i + 1], np.r_[j, j + 1, j, j + 1], np.r_[re, -im, im, re]
    x = np.full(2 * n, np.nan)
    x[2 * pins[:, 0]], x[2 * pins[:, 0] + 1], x[2 * pins[:, 1]], x[2 * pins[:, 1] + 1] = 0.0, 0.0, 1.0, 0.0
    free = ((w != 0) | (i == j)) & np.isnan(x[i])
    i, j, w = i[free], j[free], w[free]
    known = ~np.isnan(x[j])
    right = np.bincount(i, np.where(known, -w * np.where(known, x[j], 0.0), 0.0), 2 * n)
    at = np.unique(i)
    rows = pd.DataFrame({"i": np.r_[i[~known], at], "j": np.r_[j[~known].astype(float), np.full(len(at), np.nan)], "w": np.r_[w[~known], right[at]]})
    return rows.assign(no=no[rows["i"].to_numpy() // 2])[["no", "i", "j", "w"]], pins


@tidy
def conformal_maps(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> DataFrame:
    """`conformal` along the longest boundary of each mesh; written. The system of a mesh of up to `large` rows is made and solved in one task, so that it is neither written nor shuffled."""
    faces, vertices = faces.select("mesh_id", F.lit(0).cast("long").alias("fid"), "a", "b", "c"), vertices.select("mesh_id", "vid", "x", "y", "z")
    kind = faces.schema["mesh_id"].dataType.simpleString()
    parts, sizes, most = mesh.mesh_parts(faces, vertices, large)

    def run(f, v):
        import numpy as np
        import pandas as pd

        names, named, _, m = mesh.task_mesh(f, v)
        m = m.chosen(m.placed()[1].all(axis=1), slice(None))
        rows, pins = task_systems(m)
        x = np.full(2 * len(m.vid), np.nan)
        if len(rows):
            got = task_cg(rows)
            x[got["i"].to_numpy()] = got["x"].to_numpy()
        solved = np.isin(m.vid // m.span, (m.vid // m.span)[np.flatnonzero(~np.isnan(x)) // 2])  # the pins alone are no map
        x[2 * pins[:, 0]], x[2 * pins[:, 0] + 1], x[2 * pins[:, 1]], x[2 * pins[:, 1] + 1] = 0.0, 0.0, 1.0, 0.0
        u, v = x[::2], x[1::2]
        kept = solved & ~np.isnan(u)
        return pd.DataFrame({"mesh_id": names.ids[named.no(m.vid[kept])], "vid": named.id(m.vid[kept]), "u": u[kept], "v": v[kept]})

    out = materialize(parts[0].cogroup(parts[1]).applyInPandas(run, f"mesh_id {kind}, vid long, u double, v double"))
    if most <= large:
        return out
    faces, vertices = (df.join(sizes.where(F.col("size") > large), "mesh_id", "left_semi") for df in (faces, vertices))
    loop = materialize(longest_loop(boundary_loops(faces)))
    return materialize(out.unionByName(conformal(faces.join(loop.select("mesh_id").distinct(), "mesh_id", "left_semi"), vertices, loop, large)))


def flattened(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> DataFrame:
    """mesh_id, vid, u, v in [0, 1], method: conformal, harmonic for meshes where that has no solution; written. Faces and vertices should be `cleaned`."""
    return maps_and_loops(faces, vertices, large)[0]


@tidy
def maps_and_loops(faces: DataFrame, vertices: DataFrame, large: int) -> tuple[DataFrame, DataFrame]:
    """(`flattened`, the longest loops of meshes that have no conformal map), both written."""
    first = conformal_maps(faces, vertices, large)
    done = first.select("mesh_id").distinct()
    rest = faces.join(done, "mesh_id", "left_anti")
    loop = materialize(longest_loop(boundary_loops(rest)))
    uv = normal_uv(first).withColumn("method", F.lit("conformal"))
    if loop.limit(1).count():
        names = loop.select("mesh_id").distinct()
        second = harmonic(*(df.join(names, "mesh_id", "left_semi") for df in (faces, vertices)), loop, large)
        uv = uv.unionByName(normal_uv(second).withColumn("method", F.lit("harmonic")))
    return materialize(uv), loop


def flattened_or_not(names: DataFrame, faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(`flattened`, status): mesh_id and reason of the meshes of names that have no map; the first is written."""
    uv, loop = maps_and_loops(faces, vertices, large)
    has = lambda df, name: df.select("mesh_id").distinct().withColumn(name, F.lit(True))
    left = names.select("mesh_id").distinct().join(uv, "mesh_id", "left_anti").join(has(faces, "whole"), "mesh_id", "left").join(has(loop, "open"), "mesh_id", "left")
    reason = F.when(F.col("whole").isNull(), "no valid faces").when(F.col("open").isNull(), "no boundary").otherwise("no solution")
    return uv, left.select("mesh_id", reason.alias("reason"))


def clean(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Merged vertices, valid faces, all components; both are written."""
    return mended(faces, vertices, lambda m: m.merged().valid(1e-12).used(), joined_clean, large)


def joined_clean(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    faces, vertices = mesh.merged(faces, vertices)
    faces = materialize(mesh.valid_faces(faces, vertices, 1e-12))
    return faces, materialize(mesh.used_vertices(faces, vertices))


def largest(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The largest components of `clean` meshes; meshes of fewer than 3 vertices go; both are written."""
    return mesh.by_mesh(faces, vertices, lambda m: m.largest(), joined_largest, large)


def joined_largest(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    faces = materialize(largest_component(faces))
    vertices = mesh.used_vertices(faces, vertices)
    enough = vertices.groupBy("mesh_id").agg(F.count("*").alias("n")).where("n >= 3").select("mesh_id")
    return faces.join(shuffled(enough), "mesh_id", "left_semi"), materialize(vertices.join(shuffled(enough), "mesh_id", "left_semi"))
