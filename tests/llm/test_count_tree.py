"""The similarity join against all pairs and against SQL, and its buckets and trees alone."""

import random

import duckdb
import numpy as np
import pytest
from interfacet.llm import common, count_tree, minhash, queries
from test_operators import local, near_groups

SF = "/root/testdata/sf0.001"


def check(docs, width, percent):
    want = near_groups(local(docs), width, percent)
    got = [tuple(r) for r in count_tree.similarity_join(docs, width, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 71)])
def test_join_of_texts(docs, none, width, percent):
    check(docs, width, percent)
    assert count_tree.similarity_join(none, width, percent).count() == 0


def families(r, n, words=120, change=0.25):
    """Near copies of a few texts, from copies with one word changed to copies that only share most."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(1, words))]
        for _ in range(r.randint(1, 12)):
            new = list(base)
            for _ in range(r.randint(0, int(len(base) * change * r.random() ** 3) + 1)):
                at = r.randrange(len(new) + 1)
                new[at : at + r.choice([0, 1])] = [word()]
            out.append(" ".join(new))
    return out


def test_join_of_families(spark, monkeypatch):
    r = random.Random(11)
    texts = families(r, 40) + ["a b c", "a b c d", *[" ".join(f"w{i}" for i in range(k)) for k in (9, 10, 11, 12, 21, 22)]]
    shared = [(i // 2, t) for i, t in enumerate(texts)]  # two texts for each id
    for block, leaf, hot, cluster in ((512, 16, 1000, 4096), (4, 2, 3, 6)):
        monkeypatch.setattr(count_tree, "CLUSTER", cluster)
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(count_tree, "LEAF", leaf)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        check(spark.createDataFrame(shared, "doc_id long, text string"), 1, 80)


def test_template_family(spark, monkeypatch):
    """A bucket of classes that share most of a text, few of them linked."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    r = random.Random(2)
    template = [f"t{i}" for i in range(70)]
    texts = [" ".join(template + [f"x{r.randrange(60)}" for _ in range(r.choice([12, 13, 30]))]) for _ in range(120)]
    for cluster in (4096, 1):
        monkeypatch.setattr(count_tree, "CLUSTER", cluster)
        check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 80)


def test_every_linked_pair_meets():
    r = np.random.default_rng(9)
    met = 0
    for percent in (72, 80, 90, 95):
        levels = count_tree.Levels(percent)
        for _ in range(1500):
            n = int(r.integers(1, 60) if r.random() < 0.7 else r.integers(60, 900))
            union = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            n = len(union)
            out = r.choice(n, min(n - 1, int(n * (100 - percent) / 100)), replace=False)
            mine = r.random(len(out)) < r.choice([0, 0.5, 1])
            a, b = np.delete(union, out[mine]), np.delete(union, out[~mine])
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * n
            met += 1
            assert np.intersect1d(levels.keys(a), levels.keys(b)).size
    assert met == 6000


def test_tree_finds_all_pairs_within_the_bound():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 16, 17, 300):
        base = r.integers(0, 30, (max(n // 3, 1), 32))
        v = np.abs(base[r.integers(0, len(base), n)] + (r.random((n, 32)) < 0.1)) if n else np.zeros((0, 32), int)
        size = v.sum(1)
        want = {(i, j) for i in range(n) for j in range(i) if 190 * np.minimum(v[i], v[j]).sum() >= 90 * (size[i] + size[j]) and 100 * min(size[i], size[j]) >= 90 * max(size[i], size[j])}
        got = [tuple(sorted((int(a), int(b)), reverse=True)) for p, q in count_tree.CountTree(v).self_join(90) for a, b in zip(p, q, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["op12_count_tree_join"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.select(*cols).fetchall())
