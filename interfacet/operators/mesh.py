"""Mesh operators: edges, areas, centroids.

Components and smoothing are iterative: meshes of up to LARGE rows go through all rounds in one task, partitioned
once by mesh, small ones many at a time; larger ones go round by round as joins over all executors, with equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize, shuffled, tidy

LARGE = 200_000  # rows of one mesh that a single task may hold (some 50 MB)
BUNDLE = 50_000  # rows of small meshes that go through a task together; a call for each would cost more than its work


def bundled(sizes: DataFrame) -> DataFrame:
    """sizes(.., size) with no (a number for each row, as a cheap key) and task (the bundle it goes with: some BUNDLE rows of small ones, a larger one alone); written."""
    names = materialize(sizes.withColumn("no", F.monotonically_increasing_id()))
    alone = F.col("size") > BUNDLE
    total = names.where(~alone).agg(F.sum("size")).first()[0] or 0
    return names.withColumn("task", F.when(alone, -1 - F.col("no")).otherwise(F.pmod(F.hash("no"), F.lit(total // BUNDLE + 32)).cast("long")))


def numbered(*tables: DataFrame) -> DataFrame:
    """mesh_id, size (rows of all tables), no, task: see `bundled`."""
    rows = tables[0].select("mesh_id")
    for t in tables[1:]:
        rows = rows.unionAll(t.select("mesh_id"))
    return bundled(rows.groupBy("mesh_id").agg(F.count("*").alias("size")))


class Keys:
    """Ids of several meshes as one range of numbers inside a task, in order of mesh and id."""

    def __init__(self, nos, *ids):
        import numpy as np

        self.nos = np.unique(nos)
        self.ids = np.unique(np.concatenate([np.asarray(x, np.int64).ravel() for x in ids]))
        self.span = max(len(self.ids), 1)

    def of(self, no, ids):
        """The key of each id; a row of ids belongs to the mesh of that row."""
        import numpy as np

        mesh = np.searchsorted(self.nos, no)
        return (mesh[:, None] if ids.ndim > 1 else mesh) * self.span + np.searchsorted(self.ids, ids)

    def no(self, keys):
        return self.nos[keys // self.span]

    def id(self, keys):
        return self.ids[keys % self.span] if len(self.ids) else keys


def adjacency(faces: DataFrame) -> DataFrame:
    """mesh_id, u, v (edge), f1, f2: pairs of faces at edges that have exactly two."""
    ends = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    edges = faces.select("mesh_id", "fid", ends.alias("e")).groupBy("mesh_id", "e.u", "e.v")
    return edges.agg(F.count("*").alias("n"), F.min("fid").alias("f1"), F.max("fid").alias("f2")).where("n = 2").drop("n")


def boundary(faces: DataFrame) -> DataFrame:
    """mesh_id, u, v: edges with one face."""
    ends = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    return faces.select("mesh_id", ends.alias("e")).groupBy("mesh_id", "e.u", "e.v").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def cornered(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners (ax .. cz) and their area."""
    out = faces
    for p in ("a", "b", "c"):
        out = out.join(shuffled(vertices.select("mesh_id", F.col("vid").alias(p), *[F.col(k).alias(f"{p}{k}") for k in "xyz"])), ["mesh_id", p])
    u, v = ([F.col(f"{p}{k}") - F.col(f"a{k}") for k in "xyz"] for p in ("b", "c"))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return out.withColumn("area", F.sqrt(sum(c * c for c in cross)) / 2)


def measured(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their area and centre (gx, gy, gz)."""
    return cornered(faces, vertices).select("mesh_id", "fid", "area", *[((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"g{k}") for k in "xyz"])


def surface(faces: DataFrame) -> DataFrame:
    """mesh_id, area and area-weighted centroid, from measured faces."""
    return faces.groupBy("mesh_id").agg(F.sum("area").alias("area"), *[(F.sum(F.col("area") * F.col(f"g{k}")) / F.sum("area")).alias(f"c{k}") for k in "xyz"])


def corners(faces: DataFrame, *keep: str) -> DataFrame:
    """mesh_id, vid and the columns of keep, a row for each corner of each face."""
    return faces.select("mesh_id", *keep, F.explode(F.array("a", "b", "c")).alias("vid"))


def valid_faces(faces: DataFrame, vertices: DataFrame, least_area: float = 1e-9) -> DataFrame:
    """Faces of an area above least_area, each set of vertices once (the lowest fid stays)."""
    large = cornered(faces, vertices).where(F.col("area") > least_area)
    key = F.array_sort(F.array("a", "b", "c"))
    once = large.groupBy("mesh_id", key.alias("k")).agg(F.min_by(F.struct("a", "b", "c"), "fid").alias("t"), F.min("fid").alias("fid"))
    return once.select("mesh_id", "fid", "t.a", "t.b", "t.c")


def merged(faces: DataFrame, vertices: DataFrame, step: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Faces and vertices after vertices equal to within step became the one of the lowest vid."""
    at = [F.round(F.col(k) / step).alias(f"r{k}") for k in "xyz"]
    same = vertices.select("mesh_id", "vid", *at)
    first = same.groupBy("mesh_id", "rx", "ry", "rz").agg(F.min("vid").alias("to"))
    names = same.join(shuffled(first), ["mesh_id", "rx", "ry", "rz"]).select("mesh_id", "vid", "to")
    out = faces
    for p in ("a", "b", "c"):
        out = out.join(shuffled(names.withColumnRenamed("vid", p).withColumnRenamed("to", f"{p}1")), ["mesh_id", p]).drop(p).withColumnRenamed(f"{p}1", p)
    kept = vertices.join(shuffled(names.where("vid = to").select("mesh_id", "vid")), ["mesh_id", "vid"], "left_semi")
    return out.select("mesh_id", "fid", "a", "b", "c"), kept


FINITE = " and ".join(f"{k} is not null and not isnan({k}) and abs({k}) < double('infinity')" for k in "xyz")


def validated(faces: DataFrame, vertices: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """A whole mesh made fit for slicing: finite vertices, equal ones merged, no empty or repeated faces, no unused vertices. Both are written."""
    return finished(faces, vertices, 0, large)


def finished(faces: DataFrame, vertices: DataFrame, rounds: int, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """A whole mesh `smoothed`, then `validated`; both are written. The tables should be written ones, as they are read more than once."""

    def joined(f, v):
        v = joined_smoothed(f, v, rounds) if rounds else v
        f, v = merged(f, materialize(v.where(FINITE)))
        f = materialize(valid_faces(materialize(f), v, 0.0))
        return f, used_vertices(f, v)

    def task(m):
        return m.smoothed(rounds).finite().merged().valid(0.0).used()

    return by_mesh(faces, vertices, task, joined, large)


def sanitised(faces: DataFrame, vertices: DataFrame, rounds: int = 5, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Patches, each a mesh of its own, without faces of no area and equal vertices, then smoothed; a patch that smoothing breaks keeps its vertices."""

    def joined(f, v):
        f, v = merged(valid_faces(f, v, 1e-9), v)
        f = materialize(f)
        return f, joined_smoothed(f, materialize(used_vertices(f, v)), rounds)

    return by_mesh(faces, vertices, lambda m: m.sanitised(rounds), joined, large)


@tidy
def sanitised_areas(faces: DataFrame, vertices: DataFrame, rounds: int = 5, large: int = LARGE) -> DataFrame:
    """mesh_id, area of patches after `sanitised`, of which the meshes themselves are neither written nor shuffled; written. A mesh that keeps no face has no row."""
    faces, vertices = faces.select("mesh_id", "fid", "a", "b", "c"), vertices.select("mesh_id", "vid", "x", "y", "z")
    kind = faces.schema["mesh_id"].dataType.simpleString()
    parts, sizes, most = mesh_parts(faces, vertices, large)

    def run(f, v):
        import numpy as np
        import pandas as pd

        names, _, fids, m = task_mesh(f, v)
        m = m.sanitised(rounds)
        p, q, r = (m.at[m.placed()[0][:, k]] for k in range(3))
        area = np.sqrt((np.cross(q - p, r - p) ** 2).sum(axis=1)) / 2
        no = fids.no(m.fid)
        here = np.unique(no)
        return pd.DataFrame({"mesh_id": names.ids[here], "area": np.bincount(no, area, len(names.ids))[here]})

    out = materialize(parts[0].cogroup(parts[1]).applyInPandas(run, f"mesh_id {kind}, area double"))
    if most <= large:
        return out
    rest = sanitised(*(df.join(sizes.where(F.col("size") > large), "mesh_id", "left_semi") for df in (faces, vertices)), rounds, large)
    return materialize(out.unionByName(measured(*rest).groupBy("mesh_id").agg(F.sum("area").alias("area"))))


class Mesh:
    """Meshes inside a task; every step gives new ones, as the function of its name does for tables."""

    def __init__(self, fid, corner, vid, at, span):
        self.fid, self.corner, self.vid, self.at = fid, corner, vid, at  # keys, in order; corners are vids
        self.span = span  # of the keys of vertices: see Keys

    def placed(self):
        """(place of each corner among the vertices, whether it is one)."""
        import numpy as np

        place = np.minimum(np.searchsorted(self.vid, self.corner), max(len(self.vid) - 1, 0))
        return place, self.vid[place] == self.corner if len(self.vid) else np.zeros(self.corner.shape, bool)

    def chosen(self, faces, vertices) -> Mesh:
        return Mesh(self.fid[faces], self.corner[faces], self.vid[vertices], self.at[vertices], self.span)

    def finite(self) -> Mesh:
        import numpy as np

        return self.chosen(slice(None), np.isfinite(self.at).all(axis=1))

    def merged(self, step: float = 1e-8) -> Mesh:
        import numpy as np

        if not len(self.vid):
            return self.chosen(slice(0), slice(0))
        spot = np.sign(self.at) * np.floor(np.abs(self.at / step) + 0.5)
        _, first, back = np.unique(np.column_stack([self.vid // self.span, spot]), axis=0, return_index=True, return_inverse=True)
        to = self.vid[first[back.ravel()]]
        place, known = self.placed()
        whole = known.all(axis=1)
        return Mesh(self.fid[whole], to[place[whole]], self.vid[to == self.vid], self.at[to == self.vid], self.span)

    def valid(self, least_area: float) -> Mesh:
        import numpy as np

        place, known = self.placed()
        whole = np.flatnonzero(known.all(axis=1))
        p, q, r = (self.at[place[whole, k]] for k in range(3))
        whole = whole[np.sqrt((np.cross(q - p, r - p) ** 2).sum(axis=1)) / 2 > least_area]
        first = np.unique(np.sort(self.corner[whole], axis=1), axis=0, return_index=True)[1]
        return self.chosen(whole[np.sort(first)], slice(None))

    def largest(self, least_vertices: int = 3) -> Mesh:
        """The component with most vertices of each mesh (the lowest vertex, then the lowest face on ties) and its vertices, if it has least_vertices."""
        import numpy as np

        label = face_labels(self.corner)
        pairs = np.unique(np.stack([np.repeat(label, 3), self.corner.ravel()], 1), axis=0)
        names, first, size = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        low = pairs[first, 1]
        order = np.lexsort((names, low, -size, low // self.span))
        best = order[np.unique((low // self.span)[order], return_index=True)[1]]
        best = names[best][size[best] >= least_vertices]
        return self.chosen(np.isin(label, best), slice(None)).used()

    def used(self) -> Mesh:
        import numpy as np

        return self.chosen(slice(None), np.isin(self.vid, self.corner))

    def sanitised(self, rounds: int) -> Mesh:
        return self.valid(1e-9).merged().used().smoothed(rounds)

    def smoothed(self, rounds: int) -> Mesh:
        return Mesh(self.fid, self.corner, self.vid, smoothed_at(self, rounds), self.span) if rounds else self


def task_numbers(*tables: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """(the tables with a column task, the sizes of meshes in all tables together, the largest of them): see `bundled`.

    Small meshes are dealt by a hash of their id, which takes no join and no shuffle of their own; only meshes that
    go alone, of which there are at most as many as BUNDLE goes into all rows, are joined to the tables.
    """
    rows = tables[0].select("mesh_id")
    for t in tables[1:]:
        rows = rows.unionAll(t.select("mesh_id"))
    sizes = materialize(rows.where("mesh_id is not null").groupBy("mesh_id").agg(F.count("*").alias("size")))
    total, most = (x or 0 for x in sizes.agg(F.sum(F.when(F.col("size") <= BUNDLE, F.col("size"))), F.max("size")).first())
    task = F.pmod(F.xxhash64("mesh_id"), F.lit(total // BUNDLE + 32))
    tables = [t.where("mesh_id is not null") for t in tables]
    if most <= BUNDLE:
        return [t.withColumn("task", task) for t in tables], sizes, most
    alone = materialize(sizes.where(F.col("size") > BUNDLE).select("mesh_id", F.monotonically_increasing_id().alias("no")))
    return [t.join(alone, "mesh_id", "left").withColumn("task", F.when(F.col("no").isNull(), task).otherwise(-1 - F.col("no"))).drop("no") for t in tables], sizes, most


class Names:
    """Meshes inside a task by numbers, from the mesh_id of its rows."""

    def __init__(self, *ids):
        import pandas as pd

        nos, self.ids = pd.factorize(pd.concat(ids, ignore_index=True))
        self.nos, at = [], 0
        for x in ids:
            self.nos.append(nos[at : at + len(x)])
            at += len(x)


def task_mesh(f, v):
    """(names of the meshes, keys of vertices, keys of faces, Mesh) of the rows of a task."""
    import numpy as np

    names = Names(f["mesh_id"], v["mesh_id"])
    fno, vno = names.nos
    nos, corner = np.concatenate([fno, vno]), f[["a", "b", "c"]].to_numpy()
    named, fids = Keys(nos, v["vid"], corner), Keys(nos, f["fid"])
    fkey, vkey = fids.of(fno, f["fid"].to_numpy()), named.of(vno, v["vid"].to_numpy())
    frow, vrow = np.argsort(fkey, kind="stable"), np.argsort(vkey, kind="stable")
    at = v[["x", "y", "z"]].to_numpy(dtype=float, na_value=np.nan)
    return names, named, fids, Mesh(fkey[frow], named.of(fno[frow], corner[frow]), vkey[vrow], at[vrow], named.span)


def mesh_parts(first: DataFrame, second: DataFrame, large: int) -> tuple[list, DataFrame, int]:
    """(both tables grouped by task, without meshes of over `large` rows in both together; the sizes of meshes; the largest of them): see `task_numbers`."""
    tables, sizes, most = task_numbers(first, second)
    if most > large:
        big = sizes.where(F.col("size") > large)
        tables = [t.join(big, "mesh_id", "left_anti") for t in tables]
    return [t.withColumnRenamed("task", key).groupBy(key) for key, t in zip(("face_task", "task"), tables, strict=True)], sizes, most


@tidy
def by_mesh(faces: DataFrame, vertices: DataFrame, task, joined, large: int) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the meshes after task(Mesh), for each mesh of up to `large` rows, and after joined(faces, vertices) for larger ones; written."""
    faces, vertices = faces.select("mesh_id", "fid", "a", "b", "c"), vertices.select("mesh_id", "vid", "x", "y", "z")
    kind = faces.schema["mesh_id"].dataType.simpleString()
    parts, sizes, most = mesh_parts(faces, vertices, large)

    def run(f, v):
        import pandas as pd

        names, named, fids, m = task_mesh(f, v)
        m = task(m)
        corner = named.id(m.corner)
        one = pd.DataFrame({"mesh_id": names.ids[fids.no(m.fid)], "id": fids.id(m.fid), **{k: corner[:, i] for i, k in enumerate("abc")}})
        two = pd.DataFrame({"mesh_id": names.ids[named.no(m.vid)], "id": named.id(m.vid), **{k: m.at[:, i] for i, k in enumerate("xyz")}})
        out = pd.concat([one, two], ignore_index=True).reindex(columns=["mesh_id", "id", *"abcxyz"])
        return out.astype({k: "Int64" for k in "abc"})

    both = materialize(parts[0].cogroup(parts[1]).applyInPandas(run, f"mesh_id {kind}, id long, a long, b long, c long, x double, y double, z double"))
    out = [both.where("a is not null").select("mesh_id", F.col("id").alias("fid"), "a", "b", "c"), both.where("a is null").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z")]
    if most <= large:
        return out[0], out[1]
    big = sizes.where(F.col("size") > large)
    rest = joined(*(df.join(big, "mesh_id", "left_semi") for df in (faces, vertices)))
    return tuple(materialize(x.unionByName(y)) for x, y in zip(out, rest, strict=True))


def used_vertices(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.join(shuffled(corners(faces)), ["mesh_id", "vid"], "left_semi")


def touched_faces(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Faces with any vertex in chosen(mesh_id, vid)."""
    hit = corners(faces, "fid").join(chosen, ["mesh_id", "vid"], "left_semi").select("mesh_id", "fid")
    return faces.join(hit, ["mesh_id", "fid"], "left_semi")


def face_labels(corner):
    """For each face the lowest face that it reaches over edges of two faces: the lowest label hooked until nothing changes."""
    import numpy as np

    ends = np.sort(np.concatenate([corner[:, [0, 1]], corner[:, [1, 2]], corner[:, [2, 0]]]), axis=1)
    order = np.lexsort((ends[:, 1], ends[:, 0]))
    start = np.flatnonzero(np.r_[True, (np.diff(ends[order], axis=0) != 0).any(axis=1)][: len(order)])
    start = start[np.diff(np.r_[start, len(order)]) == 2]
    p, q = order[start] % max(len(corner), 1), order[start + 1] % max(len(corner), 1)
    label = np.arange(len(corner))
    while True:
        now, low = label.copy(), np.minimum(label[p], label[q])
        np.minimum.at(now, label[p], low)
        np.minimum.at(now, label[q], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return label
        label = now


def task_components(faces):
    """component of each face of the meshes in a task."""
    faces = faces.sort_values(["no", "fid"])
    corner = Keys(faces["no"], faces[["a", "b", "c"]]).of(faces["no"].to_numpy(), faces[["a", "b", "c"]].to_numpy())
    return faces.assign(component=faces["fid"].to_numpy()[face_labels(corner)])[["no", "fid", "component"]]


def star_components(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, component by alternating large and small stars; each round is written, and one that changes nothing ends the loop."""
    star = ["mesh_id", "hub"]
    links = materialize(adjacency(faces).select("mesh_id", F.col("f1").alias("lo"), F.col("f2").alias("hi")).distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("mesh_id", "lo", "hi").cast("decimal(20,0)"))).first()
    before = state(links)
    while before[0]:
        both = links.select("mesh_id", F.col("lo").alias("hub"), F.col("hi").alias("n")).union(links.select("mesh_id", F.col("hi"), F.col("lo")))
        least = both.groupBy(*star).agg(F.least(F.min("n"), F.first("hub")).alias("m"))
        large = both.join(least, star).where("n > hub").select("mesh_id", F.col("n").alias("hub"), F.col("m").alias("n")).distinct()
        least = large.groupBy(*star).agg(F.min("n").alias("m"))
        small = large.join(least, star)
        pairs = small.select("mesh_id", F.col("m").alias("lo"), F.col("n").alias("hi")).union(small.select("mesh_id", "m", "hub"))
        new = materialize(pairs.where("lo < hi").distinct())
        now = state(new)
        links = new
        if now == before:
            break
        before = now
    root = links.groupBy("mesh_id", F.col("hi").alias("fid")).agg(F.min("lo").alias("component"))
    return faces.select("mesh_id", "fid").join(root, ["mesh_id", "fid"], "left").withColumn("component", F.coalesce("component", "fid"))


def components(faces: DataFrame, large: int = LARGE) -> DataFrame:
    """mesh_id, fid, component (lowest fid reached over edges of exactly two faces). Faces should be a written table, as it is read more than once."""
    names = numbered(faces)
    small = faces.join(names.where(F.col("size") <= large), "mesh_id").select("task", "no", "fid", "a", "b", "c")
    found = small.groupBy("task").applyInPandas(task_components, "no long, fid long, component long")
    out = found.join(names, "no").select("mesh_id", "fid", "component")
    big = names.where(F.col("size") > large)
    return out.unionByName(star_components(faces.join(big, "mesh_id", "left_semi"))) if big.limit(1).count() else out


def patches(faces: DataFrame, least_vertices: int = 50) -> DataFrame:
    """Faces with patch_id and original_index: components of enough vertices, numbered by their lowest vid; the index counts dropped ones."""
    part = faces.join(components(faces), ["mesh_id", "fid"])
    sizes = corners(part, "component").groupBy("mesh_id", "component").agg(F.count_distinct("vid").alias("vertices"), F.min("vid").alias("low"))
    order = Window.partitionBy("mesh_id").orderBy("low", "component")
    kept = sizes.withColumn("original_index", F.row_number().over(order)).where(F.col("vertices") >= least_vertices)
    return part.join(kept.withColumn("patch_id", F.row_number().over(order)), ["mesh_id", "component"]).select("mesh_id", "patch_id", "original_index", "vertices", "fid", "a", "b", "c")


def task_nested(faces, values, least_vertices: int):
    """no, step, patch_id, fid, a, b, c of the patches of the meshes in a task at each of the ascending values, where the faces of a dist below it are present.

    Components are merged from one value to the next as faces appear; only an edge that gets its third face, and so joins
    no two faces any more, makes them start anew.
    """
    import numpy as np
    import pandas as pd

    faces = faces.sort_values(["no", "fid"])
    n, ids, dist = len(faces), faces[["a", "b", "c"]].to_numpy(), faces["dist"].to_numpy()
    keys = Keys(faces["no"], ids)
    corner = keys.of(faces["no"].to_numpy(), ids)
    ends = np.sort(np.concatenate([corner[:, [0, 1]], corner[:, [1, 2]], corner[:, [2, 0]]]), axis=1)
    order = np.lexsort((ends[:, 1], ends[:, 0]))
    edge = np.empty(3 * n, np.int64)
    edge[order] = np.cumsum(np.r_[True, (np.diff(ends[order], axis=0) != 0).any(axis=1)][: 3 * n]) - 1
    out, label, shared = [], np.arange(n), np.zeros(edge.max() + 1 if n else 0, bool)
    for step, value in enumerate(values):
        present = dist < value
        here = order[present[order % n]] if n else order
        count = np.bincount(edge[here], minlength=len(shared))
        two = count == 2
        if (shared & ~two).any():
            label = np.arange(n)
        shared = two
        p, q = (here[two[edge[here]]] % n).reshape(-1, 2).T if n else (order, order)
        while True:
            now, low = label.copy(), np.minimum(label[p], label[q])
            np.minimum.at(now, label[p], low)
            np.minimum.at(now, label[q], low)
            while (now[now] != now).any():
                now = now[now]
            if (now == label).all():
                break
            label = now
        rows = np.flatnonzero(present)
        pairs = np.unique(np.repeat(label[rows], 3) * (corner.max() + 1 if n else 1) + corner[rows].ravel())
        part, vid = np.divmod(pairs, corner.max() + 1 if n else 1)
        names, first, size = np.unique(part, return_index=True, return_counts=True)
        good = size >= least_vertices
        names, low = names[good], vid[first[good]]
        rank = np.lexsort((names, low))  # by mesh, since keys are
        mesh = low[rank] // keys.span
        patch = np.zeros(n, np.int64)
        patch[names[rank]] = np.arange(len(rank)) - np.searchsorted(mesh, mesh) + 1
        kept = rows[patch[label[rows]] > 0]
        out.append(faces.iloc[kept][["no", "fid", "a", "b", "c"]].assign(step=step, patch_id=patch[label[kept]]))
    return pd.concat(out)[["no", "step", "patch_id", "fid", "a", "b", "c"]]


@tidy
def near_patches(faces: DataFrame, near: DataFrame, values, least_vertices: int = 50, large: int = LARGE) -> DataFrame:
    """mesh_id, value, patch_id, fid, a, b, c: for each of values the `patches` of the faces that have a vertex of near(mesh_id, vid, dist) with a dist below it; written.

    A mesh of up to `large` rows in both tables finds its faces in the task that splits them, so that corners are neither joined
    nor shuffled; larger ones go by joins and `nested_patches`.
    """
    values = sorted({float(v) for v in values})
    faces, near = faces.select("mesh_id", "fid", "a", "b", "c"), near.select("mesh_id", "vid", "dist")
    kind = faces.schema["mesh_id"].dataType.simpleString()
    if not values:
        return faces.where("false").selectExpr("mesh_id", "CAST(NULL AS double) AS value", "CAST(fid AS int) AS patch_id", "fid", "a", "b", "c")
    parts, sizes, most = mesh_parts(faces, near, large)

    def run(f, v):
        import numpy as np

        names = Names(f["mesh_id"], v["mesh_id"])
        fno, vno = names.nos
        keys = Keys(np.concatenate([fno, vno]), v["vid"], f[["a", "b", "c"]])
        vkey, corner = keys.of(vno, v["vid"].to_numpy()), keys.of(fno, f[["a", "b", "c"]].to_numpy())
        row = np.argsort(vkey, kind="stable")
        vkey, dist = np.r_[vkey[row], -1], np.r_[v["dist"].to_numpy()[row], np.inf]
        place = np.searchsorted(vkey[:-1], corner)
        of_face = np.where(vkey[place] == corner, dist[place], np.inf).min(axis=1)
        hit = of_face < np.inf
        out = task_nested(f.loc[hit, ["fid", "a", "b", "c"]].assign(no=fno[hit], dist=of_face[hit]), values, least_vertices)
        return out.assign(mesh_id=names.ids[out["no"].to_numpy()], value=np.array(values)[out["step"].to_numpy()])[["mesh_id", "value", "patch_id", "fid", "a", "b", "c"]]

    out = materialize(parts[0].cogroup(parts[1]).applyInPandas(run, f"mesh_id {kind}, value double, patch_id int, fid long, a long, b long, c long"))
    if most <= large:
        return out
    faces, near = (t.join(sizes.where(F.col("size") > large), "mesh_id", "left_semi") for t in (faces, near))
    hits = corners(faces, "fid").join(near, ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(F.min("dist").alias("dist"))
    part = materialize(faces.join(hits, ["mesh_id", "fid"]).select("mesh_id", "fid", "a", "b", "c", "dist"))
    return materialize(out.unionByName(nested_patches(part, values, least_vertices, large)))


def nested_patches(faces: DataFrame, values, least_vertices: int = 50, large: int = LARGE) -> DataFrame:
    """mesh_id, value, patch_id, fid, a, b, c: for each of values the `patches` of the faces(mesh_id, fid, a, b, c, dist) whose dist is below it.

    A mesh of up to `large` faces goes through all values in one task, which merges components as faces appear; of larger
    ones each value has its own copy. Faces should be a written table, as it is read more than once.
    """
    values = sorted({float(v) for v in values})
    if not values:
        return faces.where("false").selectExpr("mesh_id", "dist AS value", "CAST(fid AS int) AS patch_id", "fid", "a", "b", "c")
    names = numbered(faces)
    some = faces.join(names.where(F.col("size") <= large), "mesh_id").select("no", "fid", "a", "b", "c", "dist")
    found = some.groupBy("no").applyInPandas(lambda f: task_nested(f, values, least_vertices)[["no", "step", "patch_id", "fid"]], "no long, step int, patch_id int, fid long")
    at = F.element_at(F.array(*map(F.lit, values)), F.col("step") + 1).alias("value")
    out = found.join(names, "no").select("mesh_id", at, "patch_id", "fid").join(faces.drop("dist"), ["mesh_id", "fid"]).select("mesh_id", "value", "patch_id", "fid", "a", "b", "c")
    big = names.where(F.col("size") > large).select("mesh_id")
    if not big.limit(1).count():
        return out
    copies = faces.join(big, "mesh_id", "left_semi").withColumn("value", F.explode(F.array(*map(F.lit, values)))).where("dist < value")
    copies = materialize(copies.select(F.struct("mesh_id", "value").alias("mesh_id"), "fid", "a", "b", "c"))
    return out.unionByName(patches(copies, least_vertices).select("mesh_id.mesh_id", "mesh_id.value", "patch_id", "fid", "a", "b", "c"))


def volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, volume: sum of v0 . (v1 x v2) / 6."""
    out = faces
    for p in ("a", "b", "c"):
        out = out.join(vertices.select("mesh_id", F.col("vid").alias(p), *[F.col(k).alias(f"{p}{k}") for k in "xyz"]), ["mesh_id", p])
    det = F.expr("ax*(by*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-by*cx)")
    return out.groupBy("mesh_id").agg((F.sum(det) / 6).alias("volume"))


def relaxed(faces: DataFrame, vertices: DataFrame, weight: float = 0.5) -> DataFrame:
    """Vertices moved by weight towards the mean of their neighbours; vertices without any stay."""
    pairs = F.explode(F.array(*[F.struct(F.col(p).alias("vid"), F.col(q).alias("n")) for p in "abc" for q in "abc" if p != q]))
    links = faces.select("mesh_id", pairs.alias("e")).select("mesh_id", "e.vid", "e.n").distinct()
    near = vertices.select("mesh_id", F.col("vid").alias("n"), *[F.col(k).alias(f"n{k}") for k in "xyz"])
    mean = links.join(near, ["mesh_id", "n"]).groupBy("mesh_id", "vid").agg(*[F.avg(f"n{k}").alias(f"n{k}") for k in "xyz"])
    return vertices.join(mean, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *[F.coalesce(F.col(k) + weight * (F.col(f"n{k}") - F.col(k)), F.col(k)).alias(k) for k in "xyz"])


def smoothed_at(m: Mesh, rounds: int):
    """The places of the vertices after rounds of `relaxed` and scaling; as they were for meshes where that gives a value that isn't finite."""
    import numpy as np

    n, at = len(m.vid), m.at
    if not n or not len(m.corner):
        return at
    t, known = m.placed()
    pairs = [(p, q) for p in range(3) for q in range(3) if p != q]
    links = np.unique(np.concatenate([(t[:, p] * n + t[:, q])[known[:, p] & known[:, q]] for p, q in pairs]))
    i, j = links // n, links % n
    degree = np.bincount(i, minlength=n)[:, None]
    whole = t[known.all(axis=1)]
    mesh = np.unique(m.vid // m.span, return_inverse=True)[1]
    size = lambda x: np.bincount(mesh[whole[:, 0]], np.einsum("ij,ij->i", x[whole[:, 0]], np.cross(x[whole[:, 1]], x[whole[:, 2]])), mesh[-1] + 1)
    with np.errstate(all="ignore"):
        before = size(at)
        for _ in range(rounds):
            mean = np.stack([np.bincount(i, at[j, k], n) for k in range(3)], axis=1) / degree
            at = np.where(degree > 0, at + 0.5 * (mean - at), at)
            at = at * np.power(before / size(at), 1 / 3)[mesh, None]
    fine = np.bincount(mesh, ~np.isfinite(at).all(axis=1)) == 0
    return np.where(fine[mesh, None], at, m.at)


def joined_smoothed(faces: DataFrame, vertices: DataFrame, rounds: int) -> DataFrame:
    """`smoothed` by joins; each round is written."""
    out, was = vertices, volume(faces, vertices).withColumnRenamed("volume", "v0")
    for _ in range(rounds):
        moved = relaxed(faces, out)
        ratio = was.join(volume(faces, moved), "mesh_id").select("mesh_id", F.pow(F.try_divide("v0", "volume"), F.lit(1.0 / 3)).alias("s"))
        out = materialize(moved.join(ratio, "mesh_id").select("mesh_id", "vid", *[(F.col(k) * F.col("s")).alias(k) for k in "xyz"]))
    bad = out.where("isnan(x) or isnan(y) or isnan(z) or x is null or abs(x) = double('infinity')").select("mesh_id").distinct()
    good = out.join(bad, "mesh_id", "left_anti")
    return good.unionByName(vertices.select("mesh_id", "vid", "x", "y", "z").join(good.select("mesh_id").distinct(), "mesh_id", "left_anti"))


def smoothed(faces: DataFrame, vertices: DataFrame, rounds: int = 3, large: int = LARGE) -> DataFrame:
    """rounds of `relaxed`, each scaled about the origin to the volume before; a mesh with a value that isn't finite keeps its vertices.

    Both tables should be written ones, as they are read more than once.
    """
    vertices = vertices.select("mesh_id", "vid", "x", "y", "z")
    names = numbered(faces, vertices)
    some = names.where(F.col("size") <= large)

    def run(f, v):
        import numpy as np
        import pandas as pd

        f, v = f.rename(columns={"face_task_no": "no"}), v.rename(columns={"task_no": "no"})
        keys = Keys(np.concatenate([f["no"], v["no"]]), v["vid"], f[["a", "b", "c"]])
        v = v.assign(key=keys.of(v["no"].to_numpy(), v["vid"].to_numpy())).sort_values("key")
        corner = keys.of(f["no"].to_numpy(), f[["a", "b", "c"]].to_numpy())
        at = smoothed_at(Mesh(np.arange(len(f)), corner, v["key"].to_numpy(), v[["x", "y", "z"]].to_numpy(), keys.span), rounds)
        return pd.DataFrame({"no": v["no"].to_numpy(), "vid": v["vid"].to_numpy(), **{k: at[:, i] for i, k in enumerate("xyz")}})

    parts = [df.join(some, "mesh_id").select(F.col("task").alias(key), F.col("no").alias(f"{key}_no"), *cols).groupBy(key) for key, df, cols in (("face_task", faces, ("a", "b", "c")), ("task", vertices, ("vid", "x", "y", "z")))]
    moved = parts[0].cogroup(parts[1]).applyInPandas(run, "no long, vid long, x double, y double, z double")
    out = materialize(moved.join(names, "no").select("mesh_id", "vid", "x", "y", "z"))
    big = names.where(F.col("size") > large)
    if not big.limit(1).count():
        return out
    return out.unionByName(joined_smoothed(*(df.join(big, "mesh_id", "left_semi") for df in (faces, vertices)), rounds))
