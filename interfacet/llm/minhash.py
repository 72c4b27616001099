"""Near-duplicate groups by min-max hashing.

Each permutation gives two values of a document's shingle set, its minimum and its maximum; both
agree between two documents with the probability of their Jaccard similarity, so `bands` bands of
`rows` values need half as many hash evaluations as plain MinHash. Two sets of similarity s miss
each other in all bands with probability (1 - s**rows)**bands: 4e-7 at 0.85 with 20 bands of 4.

Links are confirmed on full sets. Documents with equal sets are one class from the start; in each
bucket every class is first confirmed against the smallest one; where that leaves a bucket in more
than one component, the classes outside its largest component are compared with all of it, in blocks
inside tasks, and only links come out.

Null, empty and blank texts have an empty set and are linked with nothing; repeated rows are one
document; different texts that share a doc_id are each linked on their own; rows without doc_id are
linked with nothing (component_id null, kept); an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_slices, joined, materialize, mix
from .components import components

U = np.uint64
CLASS = "struct<rep:long,s1:long>"  # a class of equal sets: its smallest doc_id and a hash of the set
SLOTS = 1 << 20  # hash values that the first choice of texts goes by: a table of at most so many numbers is sent to all executors
BLOCK = 512  # classes of a bucket that one task compares with as many others,
BLOCK_BYTES = 1 << 24  # fewer where their sets might be larger than this together


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int, rolling: Rolling):
    """The sorted 64-bit shingle hashes of each text, A-Z in lower case, words split at ASCII white space."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    visible = ~((low == 32) | ((low >= 9) & (low <= 13)))
    before = np.concatenate([[False], visible[:-1]]) if len(low) else visible
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(visible & (~before | first[:-1]))
    after = np.concatenate([visible[1:], [False]]) if len(low) else visible
    ends = np.flatnonzero(visible & (~after | first[1:])) + 1
    prefix = rolling.prefix(low)
    words = mix(rolling.of(prefix, starts, ends) + (ends - starts).astype(U))
    at = np.searchsorted(starts, offsets)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), U)
    for j in range(width):
        grams = grams * U(0xD6E8FEB86659FD93) + words[j : j + max(n, 0)]
    grams = mix(grams)
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = np.zeros(1, U)
            for w in words[a:b]:
                whole = whole * U(0xA0761D6478BD642F) + w
            yield mix(whole + U(b - a))
        else:
            yield grams[:0]


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), n, s1 and s2 (hash of the set), keys (of its buckets)."""

    def run(batches):
        import pyarrow as pa

        rolling = Rolling()
        rng = np.random.default_rng(7)
        half = bands * rows // 2
        a, b = rng.integers(0, 1 << 63, half, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, half, dtype=U)
        band = np.arange(bands, dtype=U)
        for batch in batches:
            for i, offsets, data in byte_slices(batch, "text"):
                n, s1, s2, keys = [], [], [], []
                for s in shingle_sets(offsets, data, width, rolling):
                    n.append(len(s))
                    if not len(s):
                        s1.append(None), s2.append(None), keys.append(None)
                        continue
                    s1.append(int(mix(s).sum().astype(np.int64)))
                    s2.append(int(mix(s ^ U(0x2545F4914F6CDD1D)).sum().astype(np.int64)))
                    low, high = np.full(half, ~U(0)), np.zeros(half, U)
                    for j in range(0, len(s), 4096):
                        y = s[j : j + 4096, None] * a + b
                        low, high = np.minimum(low, y.min(0)), np.maximum(high, y.max(0))
                    v = np.stack([low, high], 1).reshape(bands, rows)
                    key = band
                    for j in range(rows):
                        key = mix(key * U(0x9FB21C651E98DF25) + v[:, j])
                    keys.append(key.astype(np.int64))
                ids, hs = (batch.column(batch.schema.get_field_index(c)).slice(i, len(n)) for c in ("doc_id", "h"))
                yield pa.RecordBatch.from_arrays([ids, hs, pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n int, s1 long, s2 long, keys array<long>")


def node() -> Column:
    return F.struct("rep", "s1")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, grams (sorted hashes as bytes) of the classes wanted(rep, h, s1); h is the hash of a text of theirs that has the id rep."""

    def run(batches):
        import pyarrow as pa

        rolling = Rolling()
        for batch in batches:
            for i, offsets, data in byte_slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(offsets, data, width, rolling)]
                cut = [batch.column(batch.schema.get_field_index(c)).slice(i, len(sets)) for c in ("rep", "s1")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(sets, pa.binary())], names=["rep", "s1", "grams"])

    slot = F.pmod(F.xxhash64("rep", "h"), F.lit(SLOTS)).alias("slot")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("h"), "text")
    texts = texts.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")  # most texts aren't shuffled
    texts = texts.join(wanted.hint("shuffle_hash"), ["rep", "h"])
    found = texts.select("rep", "s1", "text").mapInArrow(run, "rep long, s1 long, grams binary")
    return found.select(node().alias("node"), "grams").dropDuplicates(["node"])


def one_text(some: DataFrame, *keep: str) -> DataFrame:
    """The classes of equal sets of some(doc_id, h, s1, s2): s1, s2, rep and h (the smallest doc_id and text hash), and the columns of keep; written."""
    first = F.min(F.struct("doc_id", "h")).alias("first")
    classes = some.groupBy("s1", "s2").agg(first, *[F.first(c).alias(c) for c in keep])
    return materialize(classes.select("s1", "s2", F.col("first.doc_id").alias("rep"), "first.h", *keep))


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """`full_sets` of the classes whose rep and s1 are in nodes; written."""
    wanted = materialize(classes.select("rep", "h", "s1").join(nodes.select("rep", "s1").distinct(), ["rep", "s1"]))
    return materialize(full_sets(docs, wanted, width))


def common(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of intersection and union."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return both, len(x) + len(y) - both


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links(a, b) among pairs(a, b)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both, union = common(x.as_py(), y.as_py())
                keep.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(run, f"a {CLASS}, b {CLASS}")


def compare_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside each block of members(key, i, j, node, comp, grams)."""

    def run(table):
        import pyarrow as pa

        nodes = table.column("node").to_pylist()
        comp = [(c["rep"], c["s1"]) for c in table.column("comp").to_pylist()]
        sets = [np.frombuffer(g.as_py(), U) for g in table.column("grams")]
        order = np.argsort([len(s) for s in sets], kind="stable")
        root = {c: c for c in comp}

        def top(c):
            while root[c] != c:
                c = root[c]
            return c

        out = []
        for p in range(len(order)):
            x = sets[order[p]]
            for q in order[p + 1 :]:
                if 100 * len(x) < percent * len(sets[q]):
                    break
                a, b = top(comp[order[p]]), top(comp[q])
                if a == b:
                    continue
                both, union = common(x.tobytes(), sets[q].tobytes())
                if 100 * both >= percent * union:
                    out.append((nodes[order[p]], nodes[q]))
                    root[max(a, b)] = min(a, b)
        kind = pa.struct([("rep", pa.int64()), ("s1", pa.int64())])
        return pa.table({"a": pa.array([o[0] for o in out], kind), "b": pa.array([o[1] for o in out], kind)})

    return members.groupBy("key", "i", "j").applyInArrow(run, f"a {CLASS}, b {CLASS}")


def meetings(member: DataFrame) -> DataFrame:
    """key, i, j, node, comp: blocks of each bucket of member(key, node, comp, size) that has more than one component.

    Blocks i of the classes outside the bucket's largest component meet each other and those inside it.
    """
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("size").alias("top"))
    bucket = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("comps"), F.max("top").alias("top")).where("comps > 1")
    count = lambda n: F.ceil(n / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("top")))))).cast("long")
    rest = member.join(bucket.select("key", "largest", count(F.col("all") - F.col("most")).alias("out"), count(F.col("most")).alias("in")), "key")
    inside = F.col("comp") == F.col("largest")
    h = F.xxhash64("node")
    rest = rest.withColumn("blk", F.when(inside, F.col("out") + F.pmod(h, F.col("in"))).otherwise(F.pmod(h, F.col("out"))))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("out")).otherwise(F.col("out") + F.col("in")) - 1)))
    rest = materialize(rest.select("key", "node", "comp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")))
    # The same classes meet in many bands: each distinct meeting is compared once.
    met = rest.groupBy("key", "i", "j").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("w")).groupBy("c", "w").agg(F.min(F.struct("key", "i", "j")).alias("m")).select("m.*")
    return rest.join(met, ["key", "i", "j"])


def groups(docs: DataFrame, width: int, percent: int, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), group (the smallest class reachable over links; null for rows without a set or an id), one row for each row of docs."""
    rowwise = materialize(signatures(docs, width, bands, rows))
    classes = one_text(rowwise.where("n > 0 and doc_id is not null"), "n", "keys")
    buckets = classes.select("rep", "s1", "n", F.explode("keys").alias("key"))
    full = materialize(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "s1", "n")).alias("lead")).where("n > 1"))
    shared = materialize(joined(buckets.withColumnRenamed("n", "size"), full, ["key"]).select("key", "rep", "s1", "size", "lead", F.col("n").alias("members")))
    near = f"100 * least(size, lead.n) >= {percent} * greatest(size, lead.n)"
    pairs = shared.select(F.struct("lead.rep", "lead.s1").alias("a"), node().alias("b"), "size", "lead").where(near).where("a <> b").select("a", "b").distinct()
    sets = sets_of(docs, classes, shared, width)
    links = materialize(confirm(pairs, sets, percent))
    return grouped(rowwise, classes, closed(shared, links, lambda met: compare_blocks(met.join(sets, "node"), percent)))


def closed(shared: DataFrame, links: DataFrame, compare, place=lambda member: member) -> DataFrame:
    """node, component over links and over those that compare(blocks) finds in buckets that links leave in more than one component, of three classes or more.

    shared: key, rep, s1, size, members; links: a, b. place may deal the members(key, node, comp, size) of such buckets to other keys.
    """
    comp = components(links)
    member = shared.where("members > 2").select("key", node().alias("node"), "size").join(comp, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("comp"))
    return components(links.union(compare(meetings(place(materialize(member))))))


def grouped(rowwise: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """doc_id, h, n, group for each row of rowwise(doc_id, h, n, s1, s2), from components of classes."""
    named = classes.select("s1", "s2", node().alias("node")).join(comp, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("group"))
    whole = rowwise.join(named, ["s1", "s2"], "left")
    return whole.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, one row for each row of docs."""
    found = groups(docs, width, percent, bands, rows)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), reached().alias("component_id"), F.coalesce(F.col("doc_id") == reached(), F.lit(True)).alias("kept"))


def reached() -> Column:
    """The smallest doc_id of a row's group, which its smallest class has; its own where it has none."""
    return F.coalesce("group.rep", "doc_id")
