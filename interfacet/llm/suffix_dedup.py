"""Removal of every byte covered by a string of `length` bytes that also starts elsewhere.

Each document is cut into anchors by the smallest k-gram hash of every `length`-byte window, so that
equal windows share an anchor at the same place in them: only anchors that occur twice go on.
Windows around an anchor form its segment. Of each kind of segment two occurrences at most are
sorted, by what follows the anchor and by what precedes it: a vectorised mergesort compares two
suffixes by binary search over prefix polynomial hashes, and the common extensions of neighbours in
the two orders say which windows are shared. Extensions are verified against the bytes; where hashes
have lied, the sort is done again with others, in the end by the bytes themselves. Further
occurrences of a kind whose two are equal byte by byte are repeated throughout. Anchors with very
many kinds of segments are counted window by window, which gives the same result. Keys with very
many rows are joined by broadcast, their number being bounded (see `joined`).

Null and empty texts have no bytes; repeated rows repeat each other; equal rows get equal results;
an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_slices, joined, keyed, materialize, mix

U = np.uint64
GRAM = 40
SLICE = 1 << 18  # bytes of text that a task holds arrays of at a time, or one longer text: some 100 bytes each
HELD = 1024  # segments sorted together, or the kinds of one anchor, if those are more
PLACE = np.uint64((1 << 31) - 1)  # low bits of a sliding key hold the place, so that ties go to the right


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, y = 1, x
    while have * 2 <= width:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    return np.minimum(y[: len(y) - (width - have)], y[width - have :])


def choose(data: np.ndarray, offsets: np.ndarray, length: int, rolling: Rolling):
    """hash, place, first window and last window of each anchor of the texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < length:
        return none
    prefix = rolling.prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(rolling.of(prefix, at, at + GRAM))
    least = sliding_min((grams & ~PLACE) | (PLACE - at.astype(U)), length - GRAM + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(ends - np.arange(len(least)) >= length)
    if not len(starts):
        return none
    place = (PLACE - (least[starts] & PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return grams[place[new]].astype(np.int64), place[new], starts[new], starts[last]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """g (hash), id, h (row), at, lo, hi (windows, relative to the text), s1, s2 (hash of the segment)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        rolling = Rolling()
        for batch in batches:
            ids, hs = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "h"))
            for i, offsets, data in byte_slices(batch, "text", SLICE):
                g, at, lo, hi = choose(data, offsets, length, rolling)
                row = np.searchsorted(offsets, at, "right") - 1
                base = offsets[row]
                raw = data.tobytes()
                view = memoryview(raw)
                digest = [xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                s = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest else np.zeros((0, 2), np.int64)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(g), ids.take(take), hs.take(take), *(pa.array((v - base).astype(np.int32)) for v in (at, lo, hi)), pa.array(s[:, 0] ^ (at - lo)), pa.array(np.ascontiguousarray(s[:, 1]))], names=["g", "id", "h", "at", "lo", "hi", "s1", "s2"])

    return docs.select("id", "h", "text").mapInArrow(run, "g long, id long, h long, at int, lo int, hi int, s1 long, s2 long")


def extension(prefix: np.ndarray, rolling: Rolling, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at a and b, at most `most`, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) >> 1, low)
        same = rolling.of(prefix, a, a + mid) == rolling.of(prefix, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, tries: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (data[start:start+size], by group) and each one's common extension with the one before it."""
    for seed in range(tries):
        order, ext = hash_sort(group, data, start, size, Rolling(seed))
        # What the hashes call equal must be, byte by byte; where it isn't, the order can't be trusted either.
        if verified(data, start[np.roll(order, 1)], start[order], ext):
            return order, ext
    return byte_sort(group, data, start, size)


def verified(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a : a + size] equals data[b : b + size] in every row; some SLICE bytes are compared at a time."""
    part = np.cumsum(size) // SLICE
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        n = size[rows]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[rows], n) + within] != data[np.repeat(b[rows], n) + within]).any():
            return False
    return True


def byte_sort(group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes."""
    raw = data.tobytes()
    part = [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    order = sorted(range(len(part)), key=lambda i: (group[i], part[i], i))
    same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    ext = [same(part[a], part[b]) if group[a] == group[b] else 0 for a, b in zip(order, order[1:], strict=False)]
    return np.array(order, np.int64), np.array([0, *ext][: len(order)], np.int64)


def hash_sort(group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Bottom-up mergesort; all merges of a level run together, each element finding its rank in the other run by binary search."""
    prefix = rolling.prefix(data)
    n = len(group)

    def less(x, y):
        """Whether suffix x stands before suffix y; ties by their number."""
        most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
        ext = extension(prefix, rolling, start[x], start[y], most)
        inside = ext < most
        cx, cy = data[np.where(inside, start[x] + ext, 0)], data[np.where(inside, start[y] + ext, 0)]
        by_byte = np.where(size[x] != size[y], size[x] < size[y], x < y)
        return np.where(group[x] != group[y], group[x] < group[y], np.where(inside & (cx != cy), cx < cy, by_byte))

    order, run = np.arange(n), 1
    while run < n:
        at = np.arange(n)
        first = at // (2 * run) * (2 * run)
        middle, last = np.minimum(first + run, n), np.minimum(first + 2 * run, n)
        is_left = at < middle
        low, high = np.where(is_left, middle, first), np.where(is_left, last, middle)
        origin = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            before = less(order[mid], order[open_])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        rank = np.where(is_left, at, at - (middle - first)) + (low - origin)
        merged = np.empty_like(order)
        merged[rank] = order
        order, run = merged, 2 * run
    a, b = order[:-1], order[1:]
    most = np.where(group[a] == group[b], np.minimum(size[a], size[b]), 0)
    ext = extension(prefix, rolling, start[a], start[b], most)
    return order, np.concatenate([[0], ext]) if n else ext


def shared_windows(group: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """Matrix of bools [segment, o]: whether the window that starts o bytes before the anchor is in another segment of the group."""
    n, most = len(group), max(map(len, left), default=0)
    order, ext, rank = [], [], []
    for parts in (right, [x[::-1] for x in left]):
        size = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        o, e = suffix_sort(group, data, np.cumsum(size) - size, size)
        order.append(o), ext.append(e)
        r = np.empty(n, np.int64)
        r[o] = np.arange(n)
        rank.append(r)
    out = np.zeros((n, most + 1), bool)
    lsize, rsize = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for o in range(most + 1):
        has = np.flatnonzero((lsize >= o) & (rsize >= length - o))
        if len(has) < 2:
            continue
        follow, precede = ext[0] < length - o, ext[1] < o
        follow[np.concatenate([[True], group[order[0]][1:] != group[order[0]][:-1]])] = True
        precede[np.concatenate([[True], group[order[1]][1:] != group[order[1]][:-1]])] = True
        cls = np.cumsum(follow)[rank[0][has]] * (n + 1) + np.cumsum(precede)[rank[1][has]]
        _, inverse, count = np.unique(cls, return_inverse=True, return_counts=True)
        out[has, o] = count[inverse] > 1
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]


SEGMENT = ["g", "s1", "s2", "id", "h", "at", "lo", "hi", "left", "right"]
FOUND = "g long, s1 long, s2 long, id long, h long, first int, last int"


def sorted_segments(segments: DataFrame, length: int) -> DataFrame:
    """FOUND: the repeated windows (first, last) of segments, sorted by g in each partition; a kind (g, s1, s2) whose two occurrences are equal has a row with first -1."""

    def solve(part: list[tuple]):
        import pyarrow as pa

        group = np.unique(np.array([r[0] for r in part]), return_inverse=True)[1]
        flags = shared_windows(group, [r[8] for r in part], [r[9] for r in part], length)
        out, kinds = [], {}
        for r, f in zip(part, flags, strict=True):
            body = r[8] + r[9]
            if kinds.setdefault(r[:3], body) is not body and kinds[r[:3]] == body:
                out.append((*r[:5], -1, -1))
            for a, b in runs(f[r[5] - r[7] : r[5] - r[6] + 1]):  # o counts from hi back to lo
                out.append((*r[:5], r[7] - b, r[7] - a + length))
        return batch_of(out)

    def run(batches):
        from .common import rows

        held: list[tuple] = []
        for batch in batches:
            for row in rows(batch):
                if len(held) >= HELD and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return segments.select(*SEGMENT).mapInArrow(run, FOUND)


def batch_of(found: list[tuple]):
    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names=["g", "s1", "s2", "id", "h", "first", "last"])


def counted_windows(segments: DataFrame, length: int) -> DataFrame:
    """FOUND, as by `sorted_segments`, of anchors with too many kinds of segments to sort together: every window by its 128-bit hash."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        from .common import rows

        for batch in batches:
            for g, id_, h, lo, hi, left, right in rows(batch):
                body, n = left + right, hi - lo + 1
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, pa.int64()) for v in (g, id_, h)), pa.array(np.arange(lo, hi + 1, dtype=np.int32)), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], names=["g", "id", "h", "start", "w1", "w2"])

    key, null = ["g", "w1", "w2"], F.lit(None).cast("long")
    windows = segments.select("g", "id", "h", "lo", "hi", "left", "right").mapInArrow(run, "g long, id long, h long, start int, w1 long, w2 long")
    windows = materialize(windows)
    again = joined(windows, materialize(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")), key)
    spans = again.select("g", null.alias("s1"), null.alias("s2"), "id", "h", F.col("start").alias("first"), (F.col("start") + length).cast("int").alias("last"))
    body = F.concat("left", "right")
    same = segments.groupBy("g", "s1", "s2").agg(F.count("*").alias("n"), F.min(body).alias("a"), F.max(body).alias("b")).where("n > 1 and a = b")
    return spans.unionByName(same.select("g", "s1", "s2", null.alias("id"), null.alias("h"), F.lit(-1).alias("first"), F.lit(-1).alias("last")))


def repeated_ranges(docs: DataFrame, length: int, many: int) -> DataFrame:
    """id, h, first, last: byte ranges that are repeated. docs: keyed."""
    found = materialize(anchors(docs, length))
    often = materialize(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    twice = materialize(joined(found, often, ["g"]).drop("n"))
    place = F.struct("id", "h", "at", "lo", "hi")
    kind = ["g", "s1", "s2"]
    kinds = materialize(twice.groupBy(*kind).agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("two")))
    each = materialize(kinds.groupBy("g").agg(F.count("*").alias("n")).withColumn("kinds", F.col("n")))
    asked = joined(kinds.withColumn("both", F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))).drop("n"), each, ["g"])
    asked = asked.select(*kind, "kinds", F.explode("both").alias("o")).select(*kind, "kinds", "o.*")
    per_doc = asked.groupBy("id", "h").agg(F.collect_list(F.struct(*kind, "kinds", "at", "lo", "hi")).alias("asked"))  # at most the anchors of one text
    cut = lambda a: F.struct(*[a[c].alias(c) for c in (*kind, "kinds", "at", "lo", "hi")], F.substring(F.col("raw"), a["lo"] + 1, a["at"] - a["lo"]).alias("left"), F.substring(F.col("raw"), a["at"] + 1, a["hi"] + length - a["at"]).alias("right"))
    texts = docs.select("id", "h", "text").join(per_doc.hint("shuffle_hash"), ["id", "h"]).dropDuplicates(["id", "h"])
    pieces = texts.withColumn("raw", F.encode("text", "utf-8")).select("id", "h", F.explode(F.transform("asked", cut)).alias("a")).select("id", "h", "a.*")
    pieces = materialize(pieces)
    small = sorted_segments(pieces.where(F.col("kinds") <= many).repartition("g").sortWithinPartitions("g"), length)
    shared = materialize(small.unionByName(counted_windows(pieces.where(F.col("kinds") > many), length)))
    # Of kinds with more than two occurrences the others were not sorted; they are equal to the two.
    same = materialize(shared.where("first < 0").select(*kind).distinct().join(kinds.where("n > 2").select(*kind, "n"), kind))
    others = joined(twice, same, kind).select("id", "h", F.col("lo").alias("first"), (F.col("hi") + length).cast("int").alias("last"))
    return shared.where("first >= 0").select("id", "h", "first", "last").unionByName(others)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, many: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, which may begin or end within a character)."""
    docs = keyed(docs.select("doc_id", "text"))
    spans = repeated_ranges(docs, length, many).groupBy("id", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches):
        import pyarrow as pa

        from .common import rows

        for batch in batches:
            ids, numbers, shas, kept = batch.column(0), [], [], []
            for _, text, found in rows(batch):
                raw = (text or "").encode()
                cut, parts, at = merge([(s["first"], s["last"]) for s in found or ()]), [], 0
                for a, b in cut:
                    parts.append(raw[at:a])
                    at = b
                rest = b"".join([*parts, raw[at:]]) if cut else raw
                numbers.append((len(raw), len(raw) - len(rest), len(cut)))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([n[i] for n in numbers], pa.int64()) for i in range(3)), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = docs.join(spans, ["id", "h"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
