"""Runs of words that repeat with a period, by internal pattern matching.

The words of a text are numbered, and its suffixes are sorted by prefix doubling. A run of period q that goes
round three times holds a dyadic block (a stretch of 2**k words at a multiple of 2**k, where 2**k <= q < 2**(k+1);
blocks of 8 words for smaller periods) together with its copy q words on. So each block asks where it
stands again in the neighbouring window: its occurrences are an interval of the suffix array, and a wavelet
tree over that array gives the next one in the window (range successor). A window holds one occurrence, two, or an
arithmetic progression; of a progression the run around the block and the run around its copies are
extended, and only differences between their ends (or the first steps) can be periods. Candidates are extended
both ways by hashes of prefixes and then compared word by word. In all, O(n log n) time and
O(n) memory for a text of n words, whose runs are all found; texts of about 1 MB share one such pass.

Null, empty and blank texts have no words and no runs; every row is judged on its own, so repeated rows, rows
without doc_id and different texts of one doc_id each give a row; an empty table gives none; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

RUN = "struct<start:long,length:long,period:long>"
SMALLEST = 8  # words of the smallest blocks: a run of 24 words holds one and its copy up to 8 words on


class WaveletTree:
    """Order statistics of values in any stretch of a sequence of numbers below 2**bits, for many stretches at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((b, words, ones, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def ones(words, ones, i):
        """How many of the first i bits are set."""
        part = words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return ones[i >> 6] + np.bitwise_count(part)

    def below(self, lo, hi, x):
        """How many values of each stretch [lo, hi) are less than x."""
        found = np.zeros(len(lo), np.int64)
        for b, words, ones, zeros in self.levels:
            a, z = self.ones(words, ones, lo), self.ones(words, ones, hi)
            up = (x >> b & 1).astype(bool)
            found += np.where(up, (hi - lo) - (z - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return found

    def nth(self, lo, hi, k):
        """The value of each stretch that k others precede in order."""
        out = np.zeros(len(lo), np.int64)
        for b, words, ones, zeros in self.levels:
            a, z = self.ones(words, ones, lo), self.ones(words, ones, hi)
            low = (hi - lo) - (z - a)
            up = k >= low
            k = k - np.where(up, low, 0)
            out |= up.astype(np.int64) << b
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return out


class Extender:
    """Common extensions of two places of a sequence of codes, from prefix hashes modulo two primes."""

    PRIMES = (2147483647, 2147483629)

    def __init__(self, codes: np.ndarray, seed: int):
        r = np.random.default_rng(20260301 + seed)
        n = len(codes)
        self.n, self.hashes = n, []
        for p in self.PRIMES:
            up = np.ones(1, np.uint64)
            step = int(r.integers(1 << 20, p))
            while len(up) <= n:
                up = np.concatenate([up, up * np.uint64(step) % np.uint64(p)])
                step = step * step % p
            value = r.integers(1, p, int(codes.max(initial=0)) + 1, dtype=np.uint64)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(value[codes] * up[:n] % np.uint64(p), out=prefix[1:])
            self.hashes.append((np.uint64(p), up, prefix % np.uint64(p)))

    def same(self, i, j, length):
        """Whether the stretches of that length at i and j have equal hashes."""
        out = np.ones(len(i), bool)
        for p, up, prefix in self.hashes:
            x, y = ((prefix[k + length] + p - prefix[k]) % p * up[self.n - k] % p for k in (i, j))
            out &= x == y
        return out

    def forward(self, i, j, most):
        """How far the words from i and from j on are equal, up to most."""
        return self.grown(most, lambda done, step, at: self.same(i[at] + done, j[at] + done, step))

    def backward(self, i, j, most):
        """How far the words before i and before j are equal, up to most."""
        return self.grown(most, lambda done, step, at: self.same(i[at] - done - step, j[at] - done - step, step))

    @staticmethod
    def grown(most, equal):
        done = np.zeros(len(most), np.int64)
        for b in reversed(range(int(most.max(initial=0)).bit_length())):
            at = np.flatnonzero(done + (1 << b) <= most)
            at = at[equal(done[at], np.int64(1 << b), at)]
            done[at] += 1 << b
        return done


def blocks_in_order(codes: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """(suffix array, repeated slots, levels): suffixes sorted text by text; slots whose first words stand again; for each block length
    the blocks that stand again in their text, as (length, places, from, to), the last two being slots.

    start and stop are the first place and the end of the text of every place.
    """
    n = len(codes)
    key = start * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    slots, rank, size = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)
    h, levels, repeated = 1, [], slots[:0]
    key = key[order]
    while len(slots):
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(head, len(slots)))
        size[slots[head]] = count
        rank[order[slots]] = np.repeat(slots[head], count)
        again = np.repeat(count > 1, count)
        slots = slots[again]
        if h == SMALLEST:
            repeated = slots
        pos = order[slots]
        if h >= SMALLEST:
            at = pos[((pos - start[pos]) % h == 0) & (pos + h <= stop[pos])]
            levels.append((h, at, rank[at], rank[at] + size[rank[at]]))
        after = pos + h
        key = rank[pos] * (n + 1) + np.where(after < stop[pos], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots], key = pos[by], key[by]
        h *= 2
    return order, repeated, levels


def candidates(levels, order, repeated, start, stop, extend: Extender):
    """(places, periods): every run of three rounds or more has its period beside one of its places."""
    n = len(order)
    tree = WaveletTree(order[repeated], n.bit_length())
    slot = np.zeros(n + 1, np.int64)
    slot[repeated + 1] = 1
    slot = np.cumsum(slot)
    places, periods = [], []
    for h, at, lo, hi in levels:
        lo, hi = slot[lo], slot[hi]
        for first, last in [(1, h), (h, 2 * h)] if h == SMALLEST else [(h, 2 * h)]:
            a, z = tree.below(lo, hi, at + first), tree.below(lo, hi, np.minimum(at + last, n))
            some = np.flatnonzero(z > a)
            p, m, k = at[some], (z - a)[some], a[some]
            one = tree.nth(lo[some], hi[some], k)
            places.append(p), periods.append(one - p)
            many = np.flatnonzero(m > 1)
            p, one, m = p[many], one[many], m[many]
            two = tree.nth(lo[some][many], hi[some][many], k[many] + 1)
            places.append(p), periods.append(two - p)
            row = np.flatnonzero(m > 2)
            p, one, step = p[row], one[row], (two - one)[row]
            ends = []
            for x in (p, one):
                back = extend.backward(x, x + step, x - start[x])
                on = extend.forward(x, x + step, stop[x] - x - step)
                ends.append((x - back, x + step + on))
            for i in (0, 1):
                q = ends[1][i] - ends[0][i]
                good = (q >= first) & (q < last)
                places.append(p[good]), periods.append(q[good])
    return np.concatenate(places), np.concatenate(periods)


def text_runs(codes: np.ndarray, offsets: np.ndarray, least_words: int, rounds: int):
    """(start, end, period) of the runs in texts whose words are codes[offsets[i]:offsets[i + 1]], in order of start, then period."""
    none = np.zeros((0, 3), np.int64)
    sizes = np.diff(offsets)
    if not len(codes):
        return none
    start, stop = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    order, repeated, levels = blocks_in_order(codes, start, stop)
    if not sum(len(level[1]) for level in levels):
        return none
    for seed in range(100):
        extend = Extender(codes, seed)
        p, q = candidates(levels, order, repeated, start, stop, extend)
        s = p - extend.backward(p, p + q, p - start[p])
        e = p + q + extend.forward(p, p + q, stop[p] - p - q)
        long = e - s >= np.maximum(least_words, rounds * q)
        found = np.unique(np.stack([s[long], e[long], q[long]], 1), axis=0)
        if not len(found):
            return none
        # Of one stretch the smallest period: found is sorted by start, end, period.
        found = found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(1)])]
        if all((codes[a : z - r] == codes[a + r : z]).all() for a, z, r in found):
            return found[np.lexsort((found[:, 2], found[:, 0]))]
    raise RuntimeError("hashes of different words kept agreeing")


def numbered_words(texts):
    """(words, offsets, codes) of an Arrow array of texts: all words, where each text's begin, and a number for each different word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words, ends = split.flatten(), split.offsets.to_numpy()
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(words), 0)  # an edge of white space leaves an empty one
    if not pc.all(full).as_py():
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]
        words = words.filter(full)
    return words, ends, words.dictionary_encode().indices.to_numpy().astype(np.int64)


def collapsed(words, offsets, runs):
    """The texts of the words that no run drops: a run keeps its first period."""
    import pyarrow as pa
    import pyarrow.compute as pc

    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    if not kept.all():
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        words = words.filter(pa.array(kept))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def strongest(runs: np.ndarray):
    """The run of the greatest exact length / period; on ties the first by start, then period."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def find_runs(docs: DataFrame, least_words: int = 24, rounds: int = 3) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period), strongest (of the greatest length / period) and text (the words that no
    run repeats, joined by single spaces), one row for each row of docs.

    A run is a stretch of words with smallest period q, of at least least_words words and rounds * q, that can't be
    extended. rounds is 3 or more, and least_words 3 times the smallest block or more.
    """
    if rounds < 3 or least_words < 3 * SMALLEST:
        raise ValueError("runs go round three times at least, over 24 words at least")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):  # some 1 MB, or one longer text
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
                words, offsets, codes = numbered_words(texts.slice(i, j - i))
                found = text_runs(codes, offsets, least_words, rounds)
                rows = np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], 1)
                at = np.searchsorted(found[:, 0], offsets)
                of = np.searchsorted(offsets, found[:, 0], "right") - 1
                rows[:, 0] -= offsets[of]
                kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
                runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(kind))
                top = [strongest(rows[a:z]) if z > a else None for a, z in zip(at[:-1], at[1:], strict=True)]
                top = pa.array([t and dict(zip(("start", "length", "period"), t, strict=True)) for t in top], kind)
                text = collapsed(words, offsets, found)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), top, text], names=["doc_id", "runs", "strongest", "text"])
                i = j
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, runs array<{RUN}>, strongest {RUN}, text string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, for one in ten ids (by its crc32) with a periodic end: words of it from a place that the crc32 gives."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, "[\x20\x09-\x0d]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(text)
