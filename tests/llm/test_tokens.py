"""Token ids against the library as it is opened, files read back, packing against an exact solver."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from interfacet.llm import packing, rans, tokens
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, texts):
    odd = ["don't  stop", "a, b.\nC", " lead", "trail ", "café   x", "a <|endoftext|> b", "x" * 5000, "word, word. word", "\n".join(["alpha"] * 5000), "''s 's\n'll 5've x.'t", "\ua7ce new", "  \n \u3000x\x1c", "１２ ²½ Ⅷ"]
    r = random.Random(2)
    parts = [*"ab 1'\n\t .,sdtmlvré!xyZ", "'s", "'re", "'ll", "  ", "\n\n", "<|endoftext|>"]
    odd += ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for cache in (50, tokens.CACHE):
        enc = tokens.Encoder(tokens.vocabulary(), cache)
        for t in [*texts, *odd]:
            assert enc.ids(t).tolist() == ids_of(library, t)
        column = pa.array([*texts, *odd])
        for first, ids, n in enc.column(column):
            for k, part in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                assert part.tolist() == ids_of(library, column[first + k].as_py())


def test_ids_of_texts_longer_than_a_part(library, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 5000)
    enc = tokens.Encoder(tokens.vocabulary())
    r = random.Random(3)
    for t in ["alpha  beta gamma\n" * 4000, "x" * 30000, " " * 20000, "".join(r.choice("ab '\ns.") for _ in range(40000)), "a <|endoftext|> b " * 2000]:
        assert enc.ids(t).tolist() == ids_of(library, t)


def test_kinds_equal_the_library_for_all_assigned_letters(library):
    kind = tokens.kinds()
    for want, mark in ((tokens.LETTER, "a"), (tokens.NUMBER, "1"), (tokens.OTHER, ".")):
        chars = [chr(c) for c in range(0x3000) if kind[c] != tokens.UNKNOWN]
        starts = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str("\n".join(mark + c + mark for c in chars))}
        assert all((4 * i + 1 not in starts) == (kind[ord(c)] == want) for i, c in enumerate(chars))


def test_files_read_back(spark, docs, none, library):
    rows = sorted(rans.round_trip(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(((r["doc_id"], zlib.crc32(np.array([*ids_of(library, r["text"]), 2], "<u4").tobytes())) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in rows), key=str) == want
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert rans.round_trip(none).count() == 0


def test_segments_and_blocks(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 4096)
    g = np.random.default_rng(1)
    for ids in (np.arange(5000) % 77, g.integers(0, 70000, 30000), np.zeros(9000, np.int64), np.array([3])):
        assert (rans.unpack_segment(rans.pack_segment(ids)) == ids).all()


def check_packing(rows, docs, library, capacity):
    """Contract of the rows: cuts, ids and gapless places."""
    left = {}
    for d in docs:
        ids = np.array([*ids_of(library, d["text"]), 0], "<u4")
        cut = [ids[s : s + n] for s, n in packing.cut(len(ids), capacity)]
        assert len(cut) == -(-len(ids) // capacity) and all(len(c) == capacity for c in cut[1:])
        start = 0
        for k, c in enumerate(cut):
            key = (d["doc_id"], k, start, len(c), zlib.crc32(c.tobytes()))
            left[key] = left.get(key, 0) + 1
            start += len(c)
    bins = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        left[key] -= 1
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert not any(left.values())
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_documents(docs, none, library, capacity):
    rows = packing.pack_documents(docs, capacity=capacity).collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] += 1
    assert check_packing(rows, docs.collect(), library, capacity) == packing.least_bins(count)
    assert packing.pack_documents(none).count() == 0


def exact(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_search_equals_an_exact_solver():
    r = random.Random(3)
    for _ in range(300):
        capacity = r.choice([10, 20, 31, 50])
        counts = {}
        for _ in range(r.randint(1, 10)):
            x = r.randint(1, capacity) if r.random() < 0.3 else r.randint(max(1, capacity // 6), capacity // 2)
            counts[x] = counts.get(x, 0) + 1
        plan = packing.pack(counts, capacity, 10_000_000)
        packed = {}
        for items, n in plan:
            assert sum(items) <= capacity
            for x in items:
                packed[x] = packed.get(x, 0) + n
        assert packed == counts and sum(n for _, n in plan) == exact([x for x, n in counts.items() for _ in range(n)], capacity)


def test_search_beats_best_fit_on_many_lengths():
    g = np.random.default_rng(4)
    lengths, n = np.unique(g.integers(300, 1200, 5000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    count = np.zeros(2049, np.int64)
    count[lengths] = n
    size = lambda plan: sum(k for _, k in plan)
    assert len(lengths) > 800 and packing.least_bins(count) <= size(packing.pack(counts, 2048)) < size(packing.best_fit_plan(count))
    start = time.time()
    for counts in ({x: 1 + x % 3 for x in range(1, 700)}, {**{x: 2 for x in range(1, 60)}, **{1999 - x: 3 for x in range(50)}}, dict.fromkeys(range(2, 2048, 7), 3)):
        packing.pack(counts, 2048)
    assert time.time() - start < 60
    assert packing.pack({}, 2048) == [] and packing.pack({1: 10**9}, 2048) == [((1,) * 2048, 10**9 // 2048), ((1,) * (10**9 % 2048), 1)]


def test_fillings_are_undominated_and_ordered():
    count = np.zeros(21, np.int64)
    count[[2, 3, 5, 9, 10]] = [2, 3, 2, 1, 1]
    found = list(packing.fillings(count, 12, 2, packing.Effort(10_000)))
    assert found[0] == [10, 2] and [12 - sum(f) for f in found] == sorted(12 - sum(f) for f in found)
    assert [5, 5, 2] not in found  # 10 takes the place of 5 and 5
