"""Codes of vectors against searches of every entry, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from interfacet.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) of rows (vec_id, vector, label), sorted."""
    good = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    w = len(good[0][1]) // parts
    piece = lambda v, p: v[p * w : p * w + w]
    first = {}
    for i, v, _ in sorted(g[:2] + (0,) for g in good if g[0] is not None):
        first.setdefault(i, v)
    books = [[piece(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(piece(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [near(v, p)[1] for _, v, _ in good]
            mine = [[piece(g[1], p) for g, a in zip(good, at, strict=True) if a == j] for j in range(len(books[p]))]
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][j] for j, m in enumerate(mine)])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(v, p) for p in range(parts)] for _, v, _ in good]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, lab), e in zip(good, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i if i is not None else -1, "".join(f"{j:02x}" for _, j in f), e, total[lab], sha) for (i, _, lab), f, e in zip(good, found, error, strict=True)), key=str)


def got(df):
    return sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


KIND = "vec_id long, embedding array<float>, label int, code string, error int, ints int, n int, of string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], KIND)


def test_codes_equal_plain_search(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=16) / 3], int(r.integers(0, 4)) if i % 5 else None) for i in r.permutation(90)]
    rows += [(200 + i, rows[i][1], 9) for i in range(10)] + [rows[0], rows[0], (3, [0.5] * 16, 1), (None, [0.25] * 16, 1), (None, [0.25] * 16, None)]  # ties, repeated rows, one id twice, no id
    bad = [(-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-2, [float("-inf")] + [0.0] * 15, None)]
    assert got(vector_codes.compress(frame(spark, rows + bad))) == plain(rows + bad)
    some = [(i, v, lab) for i, v, lab in rows if i is not None and i < 5]  # fewer ids than entries
    assert got(vector_codes.compress(frame(spark, some))) == plain(some)
    other = [(-9, [1.0] * 15, 1), (300, [1.0] * 24, 1), (301, [], 1)]  # lengths that don't fit
    assert got(vector_codes.compress(frame(spark, rows + other))) == plain(rows)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 8, 1)]):
        assert got(vector_codes.compress(frame(spark, rows))) == []


def test_search_finds_lowest_of_ties():
    r = np.random.default_rng(1)
    for k in (1, 2, 7, 16, 40):
        entries, x = r.integers(-3, 4, (k, 3)), r.integers(-4, 5, (300, 3))
        entries[k // 2 :] = entries[: k - k // 2]  # equal entries
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        e, d = vector_codes.Orchard(entries).search(x)
        assert (e == every.argmin(1)).all() and (d == every.min(1)).all()


def test_search_skips_entries():
    """Far entries are never looked at: the lists end beyond twice the distance."""
    entries = np.array([[0], [1000], [2000], [3000], [4000]])
    index = vector_codes.Orchard(entries)
    asked = []

    class Watched(np.ndarray):
        def __getitem__(self, i):
            asked.extend(np.atleast_1d(i).tolist() if not isinstance(i, tuple) else [])
            return super().__getitem__(i)

    index.entries = entries.view(Watched)
    assert index.search(np.array([[3]]))[0][0] == 0 and set(asked) == {0}


@pytest.mark.parametrize("name", ["op13_orchard_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    have = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(have.columns) == cols and len(have)
    key = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert key(have) == key(want)
