"""Isosurfaces of sparse densities: vertices on grid edges, triangles in cubes. Absent cells are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize, tidy
from . import density

AXES = ("x", "y", "z")
CELL = ["structure_id", "ix", "iy", "iz"]


def starts(cells: DataFrame, level: float = 0.1) -> DataFrame:
    """structure_id, start: the level, or half the largest density where that is not above it."""
    top = cells.groupBy("structure_id").agg(F.max("d").alias("top")).where("top > 0")
    return top.select("structure_id", F.when(F.lit(level) >= F.col("top"), F.col("top") * 0.5).otherwise(F.lit(level)).alias("start"))


def crosses(level: Column) -> Column:
    return (F.col("d0") > level) != (F.col("d1") > level)


def crossing_edges(cells: DataFrame, grid: DataFrame, start: DataFrame) -> DataFrame:
    """structure_id, ix, iy, iz, axis, d0, d1, start and the grid: every grid edge that crosses start or its half, quarter or eighth.

    A cell meets its neighbours in windows along the axes, so edges that cross nothing are never made; planes
    of equal z hold the neighbours along x and y, planes of equal x those along z.
    """
    above = sum(((F.col("d") > F.col("start") / 2**i).cast("int") for i in range(4)), F.lit(0))
    at = cells.select(*CELL, "d").join(start, "structure_id").withColumn("above", above).repartition("structure_id", "iz")
    items = []
    for j, k in enumerate(AXES):
        if k == "z":
            at = at.repartition("structure_id", "ix")
        line = Window.partitionBy("structure_id", *[f"i{o}" for o in AXES if o != k]).orderBy(f"i{k}")
        at = at.withColumns({f"next{k}": F.lead(F.struct(f"i{k}", "d", "above")).over(line), f"last{k}": F.lag(f"i{k}").over(line)})
        follows = F.coalesce(F.col(f"next{k}")[f"i{k}"] == F.col(f"i{k}") + 1, F.lit(False))
        up = lambda c, k=k, follows=follows: F.when(follows, F.col(f"next{k}")[c]).otherwise(0)
        first = F.coalesce(F.col(f"last{k}") < F.col(f"i{k}") - 1, F.lit(True))
        edge = lambda back, d0, d1, k=k, j=j: F.struct(*[(F.col(f"i{o}") - int(back and o == k)).alias(f"i{o}") for o in AXES], F.lit(j).alias("axis"), d0.alias("d0"), d1.alias("d1"))
        items += [F.when(F.col("above") != up("above"), edge(False, F.col("d"), up("d"))), F.when(first & (F.col("above") > 0), edge(True, F.lit(0.0), F.col("d")))]
    edges = at.select("structure_id", "start", F.explode(F.array_compact(F.array(*items))).alias("e")).select("structure_id", "start", "e.*")
    upper = F.element_at(F.array("ix", "iy", "iz"), F.col("axis") + 1) + 1
    inside = (F.least("ix", "iy", "iz") >= 0) & (upper < F.element_at(F.array("nx", "ny", "nz"), F.col("axis") + 1))
    return edges.join(grid, "structure_id").where(inside)


def block_density(place, counts, n, at: tuple[int, int, int], taps: list[tuple[int, float]]):
    """The smoothed density of the block at `at` and of the cells just above it, from the counted cells (their places and counts) that reach it; 0 out of the grid.

    The three passes of `density.smooth` are products with one small matrix for each axis.
    """
    import numpy as np

    size, low = density.BLOCK, place.min(axis=0)
    d = np.zeros(place.max(axis=0) - low + 1)
    d[tuple((place - low).T)] = counts
    for k in range(3):
        here, first = np.arange(d.shape[k]) + low[k], at[k] * size
        weight = np.zeros((size + 1, len(here)))
        for o, w in taps:
            to = here + o
            to = np.where(to < 0, -to - 1, np.where(to >= n[k], 2 * n[k] - 1 - to, to))
            fits = (to >= max(first, 0)) & (to < min(first + size + 1, n[k]))
            np.add.at(weight, (to[fits] - first, np.flatnonzero(fits)), w)
        d = np.moveaxis(np.tensordot(weight, d, (1, k)), 0, k)
    return d


def above_masks(d, level: float):
    """8 bits for each cube of a block, one for each corner above level."""
    import numpy as np

    size = density.BLOCK
    above = (d > level).astype(np.int64)
    return sum(above[tuple(slice(o, o + size) for o in corner(c))] << c for c in range(8))


def crossed_cubes(d, crossed, at: tuple[int, int, int], n):
    """(places in the block, places in the grid, densities at their lowest corners and next to these) of the crossed cubes whose lowest corner is in the grid."""
    import numpy as np

    found = np.argwhere(crossed)
    place = found + np.array(at) * density.BLOCK
    inside = ((place >= 0) & (place < n)).all(axis=1)
    found, place = found[inside], place[inside]
    return found, place, [d[tuple((found + np.array(o)).T)] for o in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]


def block_cubes(rows, at: tuple[int, int, int], taps: list[tuple[int, float]]):
    """ix, iy, iz, masks, d0, dx, dy, dz of the cubes whose lowest corner is in the block at `at`, from the counted cells that reach it: see `cubes`."""
    import numpy as np
    import pandas as pd

    start, n = float(rows["start"].iloc[0]), rows[["nx", "ny", "nz"]].iloc[0].to_numpy()
    d = block_density(rows[["ix", "iy", "iz"]].to_numpy(), rows["d"].to_numpy(), n, at, taps)
    masks, crossed = np.zeros((density.BLOCK,) * 3, np.int64), np.zeros((density.BLOCK,) * 3, bool)
    for i in range(4):
        mask = above_masks(d, start / 2**i)
        masks |= mask << 8 * i
        crossed |= (mask > 0) & (mask < 255)
    found, place, near = crossed_cubes(d, crossed, at, n)
    return pd.DataFrame({"ix": place[:, 0], "iy": place[:, 1], "iz": place[:, 2], "masks": masks[tuple(found.T)], **dict(zip(("d0", "dx", "dy", "dz"), near, strict=True))})


def cubes_from(cells: DataFrame, grid: DataFrame, start: DataFrame, sigma: float) -> DataFrame:
    """`cubes` of structures whose start is known."""
    taps = density.kernel(sigma)
    kind = cells.schema["structure_id"].dataType.simpleString()

    def run(key, rows):
        out = block_cubes(rows, tuple(int(b) for b in key[1:]), taps)
        out.insert(0, "structure_id", key[0])
        out.insert(1, "start", rows["start"].iloc[0])
        return out

    known = grid.select("structure_id", *[f"n{k}" for k in AXES]).join(start, "structure_id")
    blocks = density.dealt(cells, known, taps[-1][0], 1).groupBy("structure_id", *[f"b{k}" for k in AXES])
    return blocks.applyInPandas(run, f"structure_id {kind}, start double, ix long, iy long, iz long, masks long, d0 double, dx double, dy double, dz double")


def cubes(cells: DataFrame, grid: DataFrame, sigma: float = 1.5, level: float = 0.1) -> DataFrame:
    """structure_id, start, ix, iy, iz, masks, d0, dx, dy, dz: the cubes of the counted cells' smoothed density that cross start, its half, quarter or eighth; written.

    masks has 8 bits for each of the four levels, one for each corner above it; d0 is the density at the lowest corner, dx .. dz
    those next to it. The lowest corner is in the grid, others may not be. Each block smooths its cells and those just above it,
    so that counts are shuffled and no smoothed cells are, nor written. A structure with a cell above the level starts
    there; only for others their largest density is looked for first.
    """
    first = materialize(cubes_from(cells, grid, grid.select("structure_id", F.lit(level).alias("start")), sigma))
    high = first.where(F.greatest("d0", "dx", "dy", "dz") > F.col("start")).select("structure_id").distinct()
    low = materialize(grid.select("structure_id").join(high, "structure_id", "left_anti"))
    if not low.limit(1).count():
        return first
    rest = cells.join(low, "structure_id", "left_semi")
    again = cubes_from(rest, grid, starts(density.smooth(rest, grid, sigma), level), sigma)
    return materialize(first.join(low, "structure_id", "left_anti").unionByName(again))


GRID = [f"{c}{k}" for c in ("n", "lo") for k in AXES]


def block_level(rows, at: tuple[int, int, int], taps: list[tuple[int, float]]):
    """Of one block: (places, masks and densities at and next to the lowest corners of the cubes that cross the level), (its largest density and how many of its edges cross start, its half, quarter and eighth)."""
    size, n = density.BLOCK, rows[["nx", "ny", "nz"]].iloc[0].to_numpy()
    start, level = (float(rows[c].iloc[0]) for c in ("start", "level"))
    d = block_density(rows[["ix", "iy", "iz"]].to_numpy(), rows["d"].to_numpy(), n, at, taps)
    ends = [int(max(0, min(size, n[k] - at[k] * size))) for k in range(3)]  # cells of the block that are in the grid
    own = d[tuple(slice(e) for e in ends)]
    counts = []
    for i in range(4):
        above = d > start / 2**i
        counts.append(0)
        for k in range(3):
            last = [min(e, int(n[j]) - 1 - at[j] * size) if j == k else e for j, e in enumerate(ends)]
            low, high = (above[tuple(slice(o, max(o, e + o)) if j == k else slice(e) for j, e in enumerate(last))] for o in (0, 1))
            counts[-1] += int((low != high).sum())
    mask = above_masks(d, level)
    found, place, near = crossed_cubes(d, (mask > 0) & (mask < 255), at, n)
    return (place, mask[tuple(found.T)], near), (float(own.max()) if own.size else 0.0, *counts)


BLOCK_ROWS = 4_000  # counted cells, before they are dealt to blocks, whose blocks go through a task together


def blocks_at(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `block_level` for the structures of known(structure_id, GRID, sigma, start, level): a row for each cube, and one for each block whose mask is null and that has top, n0 .. n3; written."""
    kind = cells.schema["structure_id"].dataType.simpleString()
    taps = {r["sigma"]: density.kernel(r["sigma"]) for r in known.select("sigma").distinct().collect()}  # widths of kernels, not rows
    reach = F.lit(0)
    for w, t in taps.items():
        reach = F.when(F.col("sigma") == w, t[-1][0]).otherwise(reach)
    block = ["structure_id", "bx", "by", "bz"]

    def run(rows):
        import numpy as np
        import pandas as pd

        keys, first, found, counted = [], [], [], []
        for key, part in rows.groupby(block, sort=False):
            cubes, counts = block_level(part, tuple(int(b) for b in key[1:]), taps[part["sigma"].iloc[0]])
            keys.append(key[0])
            first.append(part.index[0])
            found.append(cubes)
            counted.append(counts)
        which = np.repeat(np.arange(len(found)), [len(p) for p, _, _ in found])
        place, mask = np.concatenate([p for p, _, _ in found]), np.concatenate([m for _, m, _ in found])
        near = [np.concatenate([d[i] for _, _, d in found]) for i in range(4)]
        cubes = pd.DataFrame({**{f"i{k}": place[:, j] for j, k in enumerate(AXES)}, "mask": mask, **dict(zip(("d0", "dx", "dy", "dz"), near, strict=True))})
        counts = pd.DataFrame(counted, columns=["top", "n0", "n1", "n2", "n3"])
        out = pd.concat([cubes, counts], ignore_index=True)
        own = rows.loc[first, ["structure_id", "level", *GRID]].iloc[np.r_[which, np.arange(len(found))]].reset_index(drop=True)
        return pd.concat([own, out.astype({c: "Int64" for c in ("ix", "iy", "iz", "mask", "n0", "n1", "n2", "n3")})], axis=1)

    tasks = cells.count() // BLOCK_ROWS + 32
    dealt = density.dealt(cells, known.select("structure_id", *GRID, "sigma", "start", "level"), reach, 1).withColumn("task", F.pmod(F.xxhash64(*block), F.lit(tasks)))
    schema = f"structure_id {kind}, level double, nx long, ny long, nz long, lox double, loy double, loz double, ix long, iy long, iz long, mask int, d0 double, dx double, dy double, dz double, top double, n0 long, n1 long, n2 long, n3 long"
    return materialize(dealt.groupBy("task").applyInPandas(lambda rows: run(rows), schema))


def needs(atoms: DataFrame) -> DataFrame:
    """structure_id, need: how many vertices a level needs; see `levels`."""
    return atoms.groupBy("structure_id").agg(F.least(F.lit(500.0), F.count("*") * 0.5).alias("need"))


@tidy
def level_cubes(cells: DataFrame, grid: DataFrame, need: DataFrame, sigma: float | str = 1.5, level: float = 0.1) -> DataFrame:
    """structure_id, level, GRID, ix, iy, iz, mask, d0, dx, dy, dz: the cubes of the counted cells' smoothed density that cross the level of their structure, which is that of `levels`; written.

    mask has a bit for each corner above the level; for d0 .. dz and for corners out of the grid see `cubes`. sigma may name a column of grid. Each block also
    counts what lower levels would cross, so that most structures are done at once; only those that need a lower level are smoothed again.
    """
    sizes = materialize(grid.select("structure_id", *GRID, (F.lit(float(sigma)) if isinstance(sigma, float | int) else F.col(sigma)).alias("sigma")).join(need, "structure_id"))
    pick = F.col("start") / 8
    for i in (2, 1, 0):
        pick = F.when(F.col(f"n{i}") >= F.col("need"), F.col("start") / 2**i).otherwise(pick)
    todo, out = sizes.withColumns({"start": F.lit(level), "level": F.lit(level), "last": F.lit(False)}), None
    while True:
        found = blocks_at(cells if out is None else cells.join(todo.select("structure_id"), "structure_id", "left_semi"), todo)
        counts = found.where("mask is null").groupBy("structure_id").agg(F.max("top").alias("top"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])
        known = todo.where("not last").withColumnRenamed("level", "now").join(counts, "structure_id").where("top > 0")
        low = (F.col("start") == level) & (F.col("top") <= level)  # then half the largest density is the start, and has to be counted too
        known = known.select(*sizes.columns, "now", F.when(low, F.col("top") * 0.5).otherwise(F.col("start")).alias("start"), F.when(low, F.col("top") * 0.5).otherwise(pick).alias("level"))
        todo = materialize(known.where("level <> now").drop("now").withColumn("last", F.col("level") != F.col("start")))
        more = todo.limit(1).count() > 0
        done = found.where("mask is not null").drop("top", "n0", "n1", "n2", "n3")
        done = done.join(todo.select("structure_id"), "structure_id", "left_anti") if more else done
        out = done if out is None else out.unionByName(done)
        if not more:
            return out


def level_vertices(cubes: DataFrame, res: float = 1.0) -> DataFrame:
    """`vertices`, from `level_cubes`."""
    crosses_at = lambda k: ((F.col("d0") > F.col("level")) != (F.col(f"d{k}") > F.col("level"))) & (F.col(f"i{k}") + 1 < F.col(f"n{k}"))
    edges = F.explode(F.array_compact(F.array(*[F.when(crosses_at(k), F.struct(F.lit(j).alias("axis"), F.col(f"d{k}").alias("d1"))) for j, k in enumerate(AXES)])))
    return placed_vertices(cubes.withColumn("e", edges).select("structure_id", "level", *GRID, "ix", "iy", "iz", "e.axis", "d0", "e.d1"), res)


def cube_starts(cubes: DataFrame) -> DataFrame:
    """structure_id, start of the structures that have `cubes`."""
    return cubes.groupBy("structure_id").agg(F.first("start").alias("start"))


def cube_edges(cubes: DataFrame, grid: DataFrame) -> DataFrame:
    """`crossing_edges`, as the edges at the lowest corners of `cubes`."""
    items = []
    for j, k in enumerate(AXES):
        crosses_any = F.lit(False)
        for i in range(4):
            crosses_any = crosses_any | ((F.col("d0") > F.col("start") / 2**i) != (F.col(f"d{k}") > F.col("start") / 2**i))
        items.append(F.when(crosses_any & (F.col(f"i{k}") + 1 < F.col(f"n{k}")), F.struct(F.lit(j).alias("axis"), F.col(f"d{k}").alias("d1"))))
    edges = cubes.join(grid, "structure_id").withColumn("e", F.explode(F.array_compact(F.array(*items))))
    return edges.select("structure_id", "start", "ix", "iy", "iz", "e.axis", "d0", "e.d1", *[c for c in grid.columns if c != "structure_id"])


def cube_faces_at(cubes: DataFrame, grid: DataFrame, level: DataFrame) -> DataFrame:
    """`faces`, from `cubes`; level must be their start, its half, quarter or eighth."""
    mask = F.lit(0)
    for i in range(4):
        mask = F.when(F.col("level") == F.col("start") / 2**i, F.shiftright("masks", 8 * i).bitwiseAND(F.lit(255))).otherwise(mask)
    at = cubes.join(level.select("structure_id", "level"), "structure_id").select(*CELL, mask.cast("int").alias("mask"))
    return masked_faces(at, grid)


def levels(edges: DataFrame, start: DataFrame, atoms: DataFrame) -> DataFrame:
    """structure_id, level: the first of start, its half, quarter and eighth with enough vertices (the least of 500 and half the atoms), else the last.

    All four are counted at once.
    """
    counts = edges.groupBy("structure_id").agg(*[F.sum(crosses(F.col("start") / 2**i).cast("long")).alias(f"n{i}") for i in range(4)])
    counts = start.join(counts, "structure_id", "left").na.fill(0, [f"n{i}" for i in range(4)])
    need = atoms.groupBy("structure_id").agg(F.least(F.lit(500.0), F.count("*") * 0.5).alias("need"))
    pick = F.col("start") / 8
    for i in (2, 1, 0):
        pick = F.when(F.col(f"n{i}") >= F.col("need"), F.col("start") / 2**i).otherwise(pick)
    return counts.join(need, "structure_id").select("structure_id", pick.alias("level"), "n0", "n1", "n2", "n3")


def cell_id(x, y, z) -> Column:
    return (x * F.col("ny") + y) * F.col("nz") + z


def vertices(edges: DataFrame, level: DataFrame, res: float = 1.0) -> DataFrame:
    """mesh_id, vid, x, y, z: one vertex for each grid edge that crosses the level, by linear interpolation."""
    return placed_vertices(edges.join(level.select("structure_id", "level"), "structure_id").where(crosses(F.col("level"))), res)


def placed_vertices(e: DataFrame, res: float) -> DataFrame:
    """`vertices` of edges that cross their level."""
    t = (F.col("level") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    at = [(F.col(f"lo{k}") + (F.col(f"i{k}") + F.when(F.col("axis") == j, t).otherwise(0.0)) * res).alias(k) for j, k in enumerate(AXES)]
    return e.select(F.col("structure_id").alias("mesh_id"), (cell_id(F.col("ix"), F.col("iy"), F.col("iz")) * 3 + F.col("axis")).alias("vid"), *at)


def corner(i: int) -> tuple[int, int, int]:
    return i & 1, i >> 1 & 1, i >> 2 & 1


def cube_faces() -> list[list[int]]:
    """Corners of the six sides of a cube, counter-clockwise from outside."""
    out = []
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        low = [0, v, u | v, u]
        out += [low, [c | 1 << axis for c in reversed(low)]]
    return out


def triangles(mask: int) -> list[tuple[tuple[int, int], ...]]:
    """Triangles of a cube whose corners in mask are inside, as cube edges (lower corner, axis).

    On each side every run of inside corners is cut off by one directed segment; that also settles sides
    with two runs alike in both cubes that share them, so surfaces close. Segments join to loops.
    """

    def edge(a: int, b: int) -> tuple[int, int]:
        return min(a, b), (a ^ b).bit_length() - 1

    step = {}
    for side in cube_faces():
        inside = [mask >> c & 1 for c in side]
        for k in range(4):
            if inside[k] and not inside[k - 1]:
                end = k
                while inside[(end + 1) % 4]:
                    end += 1
                step[edge(side[end % 4], side[(end + 1) % 4])] = edge(side[k - 1], side[k])
    out = []
    while step:
        first = min(step)
        loop, at = [first], step.pop(first)
        while at != first:
            loop.append(at)
            at = step.pop(at)
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return out


def faces(cells: DataFrame, grid: DataFrame, level: DataFrame) -> DataFrame:
    """mesh_id, fid, a, b, c: triangles over the vertex ids of `vertices`."""
    near = F.explode(F.array(*[F.struct(*[F.lit(o).alias(k) for k, o in zip(AXES, corner(i), strict=True)], F.lit(1 << i).alias("bit")) for i in range(8)]))
    solid = cells.join(level.select("structure_id", "level"), "structure_id").where("d > level").withColumn("o", near)
    return masked_faces(solid.select("structure_id", *[(F.col(f"i{k}") - F.col(f"o.{k}")).alias(f"i{k}") for k in AXES], F.col("o.bit").alias("bit")).groupBy(*CELL).agg(F.sum("bit").cast("int").alias("mask")), grid)


def masked_faces(cubes: DataFrame, grid: DataFrame) -> DataFrame:
    """The triangles of cubes(structure_id, ix, iy, iz, mask) that are in the grid."""
    return cube_triangles(cubes.join(grid, "structure_id"))


def cube_triangles(cubes: DataFrame) -> DataFrame:
    """The triangles of cubes(structure_id, ix, iy, iz, mask, nx, ny, nz) that are in the grid."""
    spark = cubes.sparkSession
    table = [(m, n, [(*corner(e[0]), e[1]) for e in t]) for m in range(1, 255) for n, t in enumerate(triangles(m))]
    cases = spark.createDataFrame(table, "mask int, nth int, t array<struct<x:int,y:int,z:int,axis:int>>")  # at most 5 rows for each of 254 masks
    cubes = cubes.where("least(ix, iy, iz) >= 0 and ix + 1 < nx and iy + 1 < ny and iz + 1 < nz")
    vid = lambda i: cell_id(*[F.col(f"i{k}") + F.col("t")[i][k] for k in AXES]) * 3 + F.col("t")[i]["axis"]
    found = cubes.join(F.broadcast(cases), "mask")
    return found.select(F.col("structure_id").alias("mesh_id"), (cell_id(F.col("ix"), F.col("iy"), F.col("iz")) * 8 + F.col("nth")).alias("fid"), *[vid(i).alias(c) for i, c in enumerate("abc")])
