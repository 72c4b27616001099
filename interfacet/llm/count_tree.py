"""Similarity join of shingle sets over R-trees of count vectors.

The shingles of a set are hashed into groups. The counts of a fixed number of groups make it a point; the
overlap of two sets is at most the sum of the smaller count of each group, and of two boxes of points at most the sum
of the smaller upper corner, so a tree of boxes drops most pairs unseen. What is left is verified on full sets.

No tree holds all points: in so many dimensions boxes of a whole corpus overlap everywhere. Points are first dealt out by
the contents of groups. Sets of a similarity of p percent differ in at most d = n * (100 - p) / p shingles, n
being the size of the smaller; of more than d groups at least one has the same shingles in both. Sizes fall
into levels, each half as large again as the one before; a set is in the buckets (level, group, contents) of its level, and
of the level below if it may be linked with a set there. Empty groups say nothing: SPARE more groups
make up for as many, and the few sets that have more are in the buckets of empty groups too. So every linked pair meets
in a bucket, and none is left to chance.

In a bucket every class of equal sets is first held against the smallest one; where that leaves more than one
component, blocks of the bucket's classes, or of all buckets of a cluster, are indexed and joined by R-trees inside tasks.

Null, empty and blank texts have an empty set and are linked with nothing; repeated rows are one document; different texts
that share a doc_id are each linked on their own; rows without doc_id are linked with nothing (component_id
null); an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_slices, joined, materialize, mix
from .components import components
from .minhash import CLASS, closed, common, grouped, node, one_text, reached, sets_of, shingle_sets

U = np.uint64
SPARE = 2
DIMS = 32  # groups whose counts are a point's coordinates
LEAF = 16  # points of a leaf
CLUSTER = 4096  # classes of a cluster of buckets that are compared at once, in blocks


def edges(groups: int) -> np.ndarray:
    """The least hash of each group but the first: groups are ranges of hashes, and so of a sorted set."""
    return np.array([(k << 64) // groups for k in range(1, groups)], U)


def counts(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.searchsorted(s, cuts)
    return np.diff(np.concatenate([[0], at, [len(s)]]))


class Levels:
    """Which buckets a set of a given size is in."""

    def __init__(self, percent: int):
        if not 70 <= percent < 100:
            raise ValueError("levels are as wide as a similarity of 70 to 99 percent needs")
        self.percent, self.first, self.cuts = percent, [1], {}

    def apart(self, n: int) -> int:
        """Shingles that are in one of two linked sets only, at most, the smaller having n."""
        return n * (100 - self.percent) // self.percent

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            self.first.append(max(self.first[-1] + 1, -(-3 * self.first[-1] // 2)))
        return int(np.searchsorted(self.first, n, "right")) - 1

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The buckets of a sorted set."""
        n = len(s)
        top = self.of(n)
        prefix = np.concatenate([[U(0)], np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)))])
        out = []
        for level in (top, top - 1):
            if level < 0 or level < top and -(-self.percent * n // 100) >= self.first[top]:
                continue  # too large for any set of the level below
            last = self.first[level + 1] - 1
            groups = self.apart(last) + 1 + SPARE
            if groups not in self.cuts:
                self.cuts[groups] = edges(groups)
            at = np.concatenate([[0], np.searchsorted(s, self.cuts[groups]), [n]])
            size = np.diff(at)
            key = mix((prefix[at[1:]] - prefix[at[:-1]]) * U(0x9FB21C651E98DF25) + mix(np.arange(groups, dtype=U) * U(1 << 20) + U(level)))
            full = size > 0
            out.append(key if (~full).sum() >= groups - self.apart(min(n, last)) else key[full])
        return np.concatenate(out).view(np.int64)


def points(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), n, s1 and s2 (hash of the set), keys (of its buckets)."""

    def run(batches):
        import pyarrow as pa

        rolling, levels = Rolling(), Levels(percent)
        for batch in batches:
            for i, offsets, data in byte_slices(batch, "text"):
                n, s1, s2, keys = [], [], [], []
                for s in shingle_sets(offsets, data, width, rolling):
                    n.append(len(s))
                    s1.append(int(mix(s).sum().astype(np.int64)) if len(s) else None)
                    s2.append(int(mix(s ^ U(0x2545F4914F6CDD1D)).sum().astype(np.int64)) if len(s) else None)
                    keys.append(levels.keys(s) if len(s) else None)
                ids, hs = (batch.column(batch.schema.get_field_index(c)).slice(i, len(n)) for c in ("doc_id", "h"))
                yield pa.RecordBatch.from_arrays([ids, hs, pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n int, s1 long, s2 long, keys array<long>")


class CountTree:
    """An R-tree of count vectors, packed from the top: each split halves the points along the widest side of their box."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.sizes = vectors, vectors.sum(1)
        self.nodes = []  # (lower corner, upper corner, least size, greatest size, children or points, is a leaf)
        self.root = self.packed(np.arange(len(vectors))) if len(vectors) else None

    def packed(self, rows: np.ndarray) -> int:
        v = self.vectors[rows]
        low, high = v.min(0), v.max(0)
        box = (low, high, int(self.sizes[rows].min()), int(self.sizes[rows].max()))
        if len(rows) <= LEAF:
            self.nodes.append((*box, rows, True))
        else:
            by = rows[np.argsort(v[:, int((high - low).argmax())], kind="stable")]
            half = len(by) // 2
            self.nodes.append((*box, (self.packed(by[:half]), self.packed(by[half:])), False))
        return len(self.nodes) - 1

    def self_join(self, percent: int):
        """Arrays (p, q) of pairs of points, each pair once, whose bound lets them be linked."""
        stack = [(self.root, self.root)] if self.root is not None else []
        while stack:
            i, j = stack.pop()
            x, y = self.nodes[i], self.nodes[j]
            if 100 * x[3] < percent * y[2] or 100 * y[3] < percent * x[2] or (100 + percent) * int(np.minimum(x[1], y[1]).sum()) < percent * (x[2] + y[2]):
                continue
            if x[5] and y[5]:
                p, q = x[4], y[4]
                bound = np.minimum(self.vectors[p][:, None], self.vectors[q][None]).sum(2)
                a, b = self.sizes[p][:, None], self.sizes[q][None]
                may = ((100 + percent) * bound >= percent * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if i == j:
                    may = np.triu(may, 1)
                r, c = np.nonzero(may)
                if len(r):
                    yield p[r], q[c]
            elif i == j:
                left, right = x[4]
                stack += [(left, left), (left, right), (right, right)]
            elif y[5] or not x[5] and x[3] - x[2] > y[3] - y[2]:
                stack += [(k, j) for k in x[4]]
            else:
                stack += [(i, k) for k in y[4]]


def bounded(x: np.ndarray, y: np.ndarray, percent: int, cuts: np.ndarray) -> bool:
    return (100 + percent) * int(np.minimum(counts(x, cuts), counts(y, cuts)).sum()) >= percent * (len(x) + len(y))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links(a, b) among pairs(a, b): the bound first, then full sets."""

    def run(batches):
        import pyarrow as pa

        cuts = edges(DIMS)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if found := bounded(np.frombuffer(x, U), np.frombuffer(y, U), percent, cuts):
                    both, union = common(x, y)
                    found = 100 * both >= percent * union
                keep.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, f"a {CLASS}, b {CLASS}")


def tree_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside each block of members(key, i, j, node, comp, grams); of links that would join what is joined already one is enough."""

    def run(table):
        import pyarrow as pa

        nodes = table.column("node").to_pylist()
        comp = [(c["rep"], c["s1"]) for c in table.column("comp").to_pylist()]
        raw = [g.as_py() for g in table.column("grams")]
        cuts = edges(DIMS)
        tree = CountTree(np.array([counts(np.frombuffer(g, U), cuts) for g in raw], np.int64).reshape(len(raw), DIMS))
        root = {c: c for c in comp}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for p, q in tree.self_join(percent):
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                a, b = top(comp[x]), top(comp[y])
                if a == b:
                    continue
                both, union = common(raw[x], raw[y])
                if 100 * both >= percent * union:
                    out.append((nodes[x], nodes[y]))
                    root[max(a, b)] = min(a, b)
        kind = pa.struct([("rep", pa.int64()), ("s1", pa.int64())])
        return pa.table({"a": pa.array([o[0] for o in out], kind), "b": pa.array([o[1] for o in out], kind)})

    return members.groupBy("key", "i", "j").applyInArrow(run, f"a {CLASS}, b {CLASS}")


def by_clusters(member: DataFrame) -> DataFrame:
    """The members of buckets of several components dealt by clusters of such buckets: classes that meet in many buckets meet once.

    A cluster is what components and the buckets they share connect; those of more than CLUSTER classes stay in their buckets.
    """
    comps = materialize(member.select("key", "comp").distinct())
    mixed = materialize(comps.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lead")).where("n > 1"))
    star = comps.join(mixed, "key").select(F.col("lead").alias("a"), F.col("comp").alias("b")).where("a <> b")
    cluster = components(star).select(F.col("node").alias("comp"), "component")
    left = member.join(mixed.select("key"), "key", "left_semi")
    once = materialize(left.select("node", "comp", "size").distinct().join(cluster, "comp"))
    large = materialize(once.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER).select("component"))
    small = once.join(large, "component", "left_anti").select(F.xxhash64("component").alias("key"), "node", "comp", "size")
    rest = left.join(cluster.join(large, "component", "left_semi").select("comp"), "comp", "left_semi")
    return materialize(small.unionByName(rest.select("key", "node", "comp", "size")))


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), group (the smallest class reachable over links; null for rows without a set or an id), one row for each row of docs."""
    rowwise = materialize(points(docs, width, percent))
    classes = one_text(rowwise.where("n > 0 and doc_id is not null"), "n", "keys")
    buckets = classes.select("rep", "s1", F.col("n").alias("size"), F.explode("keys").alias("key"))
    full = materialize(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(joined(buckets, full, ["key"]).withColumnRenamed("n", "members"))
    leads = materialize(shared.groupBy("key").agg(F.min(F.struct("rep", "s1", F.col("size").alias("n"))).alias("lead"), F.count("*").alias("n")))
    near = f"100 * least(size, lead.n) >= {percent} * greatest(size, lead.n)"
    pairs = joined(shared, leads, ["key"]).where(near).select(F.struct("lead.rep", "lead.s1").alias("a"), node().alias("b")).where("a <> b").distinct()
    sets = sets_of(docs, classes, shared, width)
    links = materialize(confirmed(pairs, sets, percent))
    return grouped(rowwise, classes, closed(shared, links, lambda met: tree_links(met.join(sets, "node"), percent), by_clusters))


def similarity_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), one row for each row of docs."""
    return similar_groups(docs, width, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), reached().alias("component_id"))
