"""Runs of words against a search of every period, and the planted query against SQL."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from interfacet.llm import periods, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=24, rounds=3):
    """(start, length, period) of all runs, by walking along every period."""
    out = {}
    for q in range(1, len(w) // rounds + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, rounds * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def some_words(r):
    k, w = r.choice([1, 2, 2, 3, 50]), []
    while len(w) < r.choice([0, 30, 100, 200, 400]):
        if w and r.random() < 0.5:
            p = r.randint(1, min(len(w), r.choice([3, 8, 40])))
            w += (w[-p:] * 6)[: r.randint(1, 6 * p)]
        else:
            w += [r.randrange(k) for _ in range(r.randint(1, 20))]
    return w[:450]


def test_runs_of_codes():
    r = random.Random(3)
    for least, rounds in ((24, 3), (30, 4)):
        for _ in range(150):
            docs = [some_words(r) for _ in range(r.randint(1, 4))]
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
            got = periods.text_runs(np.array(sum(docs, []), np.int64), offsets, least, rounds).tolist()
            want = [[s + o, s + n + o, q] for d, o in zip(docs, offsets.tolist(), strict=False) for s, n, q in plain_runs(d, least, rounds)]
            assert got == want


def test_runs_of_difficult_words():
    """Fibonacci and Thue-Morse words, one word only, periods of powers of two, one long period."""
    fib = ["0", "01"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(4096))
    texts = [fib[-1], thue, thue[:512] * 3, "0" * 500, "01" * 40 + "1" * 30, "".join(f"{i:03d}" for i in range(64)) * 4]
    for t in texts:
        w = np.array([int(c) for c in t], np.int64)
        got = periods.text_runs(w, np.array([0, len(w)]), 24, 3)
        assert [(s, e - s, q) for s, e, q in got.tolist()] == plain_runs(t)


def test_wavelet_tree():
    r = np.random.default_rng(4)
    v = r.integers(0, 300, 1000)
    tree = periods.WaveletTree(v, 9)
    lo = r.integers(0, 1000, 200)
    hi = lo + r.integers(1, 1001 - lo)
    x = r.integers(0, 310, 200)
    assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < y).sum()) for a, b, y in zip(lo, hi, x, strict=True)]
    k = r.integers(0, hi - lo)
    assert tree.nth(lo, hi, k).tolist() == [int(np.sort(v[a:b])[i]) for a, b, i in zip(lo, hi, k, strict=True)]


def test_hashes_that_lie_are_found_out(monkeypatch):
    """Where hashes of different words agree, the words tell, and another seed is taken."""
    w = np.array([0, 1, 2] * 20 + [3, 1, 4] * 20, np.int64)
    made, seeds = periods.Extender, []

    def lying(codes, seed):
        seeds.append(seed)
        return made(codes if seed else codes % 3, seed)

    monkeypatch.setattr(periods, "Extender", lying)
    assert [(s, e - s, q) for s, e, q in periods.text_runs(w, np.array([0, len(w)]), 24, 3).tolist()] == plain_runs(w.tolist())
    assert len(seeds) > 1


def check(docs):
    want = []
    for r in docs.collect():
        w = [x for x in re.split("[\x20\x09-\x0d]+", r["text"] or "") if x]
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want.append((r["doc_id"], runs, top, " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["text"]) for r in periods.find_runs(docs).collect()]
    assert sorted(got, key=lambda x: (x[0] is not None, str(x))) == sorted(want, key=lambda x: (x[0] is not None, str(x)))


def test_runs_of_texts(spark, docs, none):
    r = random.Random(5)
    rows = [(i, " \n\x0b".join(f"w{x}é" for x in some_words(r)) + r.choice(["", " ", "\t"]), 1, 2) for i in range(60)]
    rows += [(7, "a b " * 40 + "c d " * 40, 1, 2), (8, "x " * 30, 1, 2), (8, "x " * 30, 1, 2), (None, "x\x1cy " * 30, 1, 2), (9, "long " * 20000 + "z", 1, 2)]  # ties of strength, repeated rows, a long text
    check(docs.unionByName(spark.createDataFrame(rows[:-1], docs.schema)))
    long = periods.find_runs(spark.createDataFrame(rows[-1:], docs.schema)).first()
    assert [tuple(x) for x in long["runs"]] == [(0, 20000, 1)] and long["text"] == "long z"
    assert periods.find_runs(none).count() == 0


def test_planted_ends(spark, docs):
    def plain(i, t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        if i is None or not w or (h := zlib.crc32(str(i).encode())) % 10:
            return t
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, n)])

    rows = [(100 + i, "  " + " ".join(f"w{k}" for k in range(i)), 1, 2) for i in range(150)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = both.select("doc_id", "text", periods.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert [r["new"] for r in got] == [plain(r["doc_id"], r["text"]) for r in got]
    assert sum(r["new"] != r["text"] for r in got) > 5


@pytest.mark.parametrize("name", ["op11_periodic_runs"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, (type(got.first())(**dict(zip(cols, r, strict=True))) for r in want.select(*cols).fetchall())))
