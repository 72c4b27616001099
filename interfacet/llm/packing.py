"""Best-fit packing of documents into token sequences by bin completion.

Documents become pieces of at most `capacity` tokens. Only the number of pieces of each length
matters to a packing, so the search runs on that histogram (at most `capacity` rows, however many
documents there are) and Spark then deals pieces to the places that the search has made.

Null and empty texts are documents of one end id; repeated rows are packed each on their own; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .tokens import CACHE, encoder, vocabulary, with_ends

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, cache: int = CACHE) -> DataFrame:
    """One row for each piece; nth counts the pieces of the same length in its partition."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, pid, seen = encoder(path, cache), TaskContext.get().partitionId(), {}
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32()), ("nth", pa.int64())])
        for batch in batches:
            doc_ids = batch.column(0)
            for i, ids, sizes in enc.column(batch.column(1)):
                whole, ends = with_ends(ids, sizes, end_id)
                raw, out = memoryview(whole.view(np.uint8)), []
                for k, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
                    for piece, (start, length) in enumerate(cut(b - a, capacity)):
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        out.append((i + k, piece, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)]), pid, nth))
                columns = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(columns[0])), *(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns[1:], schema.types[1:], strict=True))], schema=schema)
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def least_bins(count: np.ndarray) -> int:
    """A lower bound of the sequences that count (pieces by length, capacity last) needs.

    For every k: pieces over capacity - k stand alone, pieces over half of it need a sequence each, and
    what those leave open can't hold more of the pieces from k to half than its size.
    """
    capacity = len(count) - 1
    length = np.arange(capacity + 1)
    n, size = np.cumsum(count), np.cumsum(count * length)
    half = capacity // 2
    k = np.arange(half + 1)
    upto = capacity - k
    alone, large = n[-1] - n[upto], n[upto] - n[half]
    room = large * capacity - (size[upto] - size[half])
    small = size[half] - np.where(k > 0, size[k - 1], 0)
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(count: np.ndarray, room: int) -> list[int]:
    """The largest fitting piece again and again."""
    out: list[int] = []
    while room:
        fits = np.flatnonzero(count[1 : room + 1])
        if not len(fits):
            break
        x = int(fits[-1]) + 1
        k = min(int(count[x]), room // x)
        out += [x] * k
        count = count.copy() if len(out) == k else count
        count[x] -= k
        room -= k * x
    return out


def best_fit_plan(count: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences): the largest piece left with its best fit, as often as they last."""
    count, out = count.copy(), []
    while count.any():
        top = int(np.flatnonzero(count)[-1])
        count[top] -= 1
        items = (top, *best_fit(count, len(count) - 1 - top))
        count[top] += 1
        n = min(int(count[x]) // items.count(x) for x in set(items))
        out.append((items, n))
        np.subtract.at(count, list(items), n)
    return out


def reachable(count: np.ndarray, room: int) -> tuple[list[int], list[int]]:
    """The lengths up to room in ascending order, and for each how many of them: bit s of sums[i] is set if some of the first i lengths' pieces sum to s."""
    lengths = (np.flatnonzero(count[1 : room + 1]) + 1).tolist()
    mask, sums = (1 << room + 1) - 1, [1]
    for x in lengths:
        have, left, step = sums[-1], min(int(count[x]), room // x), 1
        while left:  # powers of two and a rest give every number of copies
            k = min(step, left)
            have |= have << k * x & mask
            left, step = left - k, 2 * step
        sums.append(have)
    return lengths, sums


def smeared(bits: int, width: int) -> int:
    """Bits moved up by 1 .. width."""
    out, done = bits << 1, 1
    while done < width:
        k = min(done, width - done)
        out, done = out | out << k, done + k
    return out if width else 0


class Effort:
    """Steps that a search may still take."""

    class Spent(Exception):
        pass

    def __init__(self, steps: int):
        self.left = steps

    def take(self, steps: int) -> None:
        self.left -= steps
        if self.left < 0:
            raise self.Spent


def fillings(count: np.ndarray, room: int, waste: int, effort: Effort) -> Iterator[list[int]]:
    """The undominated fillings of room that leave at most `waste` open, the least open first, each found as it is asked for.

    A filling is dominated if a piece that it leaves out could take the place of some of its pieces
    that are no larger together (two or more of them, if equal), or fits beside them. Pieces are chosen
    in falling order, so that a sum of chosen pieces only meets lengths that are decided already, and
    every choice can still be completed.
    """
    lengths, sums = reachable(count, room)
    effort.take(len(lengths))
    have = sum(1 << x for x in lengths)
    for open_ in range(min(waste, room) + 1):
        if not sums[-1] >> (room - open_) & 1:
            continue
        chosen: list[int] = []
        # A level: index to try next, sum still to fill, copies of the last piece, sums of chosen pieces (any, two or more), lengths not used up.
        stack = [[len(lengths) - 1, room - open_, 0, 1, 0, have]]
        while stack:
            effort.take(1)
            level = stack[-1]
            i, need, copies, some, two, left = level
            if not need:
                if not left & ((2 << open_) - 2):
                    yield list(chosen)
                i = -1
            while i >= 0 and not (lengths[i] <= need and sums[i + 1] >> need & 1):
                i -= 1
            if i < 0:
                stack.pop()
                if chosen:
                    chosen.pop()
                continue
            x = lengths[i]
            level[0] = i - 1  # the next try at this level is a smaller piece
            copies = copies + 1 if chosen and chosen[-1] == x else 1
            if copies > count[x]:
                continue
            if copies == count[x]:
                left &= ~(1 << x)
            both, more = some | some << x, two | (some & ~1) << x | two << x
            if left >> x << x & (more | smeared(both & ~1, open_)):
                continue
            chosen.append(x)
            stack.append([i, need - x, copies, both, more, left])


def pack(counts: dict[int, int], capacity: int, steps: int = 500_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), in all as few sequences as the search finds.

    Bin completion: the largest piece left is completed by the undominated fillings, each as often as
    its pieces last (less often in later branches). A branch ends when the sequences that what is left
    needs at least rule out beating the incumbent; the best-fit packing is the first incumbent. The
    search ends when the incumbent meets the lower bound, when no branch is left (both prove it best) or,
    the problem being NP-hard, after `steps` steps (some seconds): all pieces are packed at any value,
    and the search is the same whatever the number of lengths.
    """
    count = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        count[k] = v
    total = int((count * np.arange(capacity + 1)).sum())
    least = least_bins(count)
    size = lambda plan: sum(n for _, n in plan)

    def use(items: tuple[int, ...], n: int) -> None:
        np.subtract.at(count, list(items), n)

    def branches(waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        top = int(np.flatnonzero(count)[-1])
        use((top,), 1)
        left = count.copy()
        use((top,), -1)
        seen = []
        for fill in fillings(left, capacity - top, waste, effort):
            items = (top, *fill)
            seen.append((items, min((int(left[x]) + (x == top)) // items.count(x) for x in set(items))))
            yield seen[-1]
        for items, n in seen:
            for fewer in range(n - 1, 0, -1):
                yield items, fewer

    best = best_fit_plan(count)
    plan: list[tuple[tuple[int, ...], int]] = []
    effort, used = Effort(steps), 0
    stack = [branches((size(best) - 1) * capacity - total)] if size(best) > least else []
    try:
        while stack and size(best) > least:
            effort.take(50)
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if plan:
                    items, n = plan.pop()
                    use(items, -n)
                    used -= n
                continue
            use(*step)
            plan.append(step)
            used += step[1]
            if used + least_bins(count) < size(best):
                if count.any():
                    left = int((count * np.arange(capacity + 1)).sum())
                    stack.append(branches((size(best) - 1 - used) * capacity - left))
                    continue
                best = list(plan)
            plan.pop()
            use(step[0], -step[1])
            used -= step[1]
    except Effort.Spent:
        rest = best_fit_plan(count)  # the branch that was open, with best fit for what it had not packed yet
        if used + size(rest) < size(best):
            best = plan + rest
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank of each of its runs, the run's first sequence, pieces in a sequence, and their offsets."""
    runs: dict[int, list] = {}
    at: dict[int, int] = {}
    first = 0
    for items, times in plan:
        offsets: dict[int, list[int]] = {}
        here = 0
        for x in items:
            offsets.setdefault(x, []).append(here)
            here += x
        for x, where in offsets.items():
            runs.setdefault(x, []).append((at.get(x, 0), first, len(where), where))
            at[x] = at.get(x, 0) + times * len(where)
        first += times
    out = {}
    for x, r in runs.items():
        flat = np.array([o for _, _, _, w in r for o in w])
        k = np.array([q[2] for q in r])
        out[x] = (np.array([q[0] for q in r]), np.array([q[1] for q in r]), k, np.cumsum(k) - k, flat)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 2048, cache: int = CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece; `cache` words are kept by each Python worker."""
    cutup = materialize(pieces(docs, path or vocabulary(), end_id, capacity, cache))
    counts = {r["length"]: r["n"] for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = places(pack(counts, capacity))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                lo, first, k, flat_at, flat = where[int(x)]
                m = length == x
                run = np.searchsorted(lo, rank[m], "right") - 1
                step = rank[m] - lo[run]
                seq[m] = first[run] + step // k[run]
                offset[m] = flat[flat_at[run] + step % k[run]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = cutup.groupBy("pid", "length").agg(F.count("*").alias("n")).select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cutup.join(base, ["pid", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
