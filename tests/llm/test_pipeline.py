"""Each stage of the pipeline against a brute-force version, on rows without ids, shared ids and repeated rows."""

import random
import re

import corpus_pipeline
import pytest
from interfacet.llm import secrets
from test_operators import near_groups
from test_tokens import check_packing
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents as rows) with toxic texts, near copies, benchmark passages and secrets."""
    r = random.Random(21)
    prose = lambda n: " ".join(word(r) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((40, 25, 13, 5))]
    texts = [prose(r.randint(30, 90)) + (" you idiot, worthless trash" if i % 4 == 0 else "") for i in range(240)]
    texts += [t + " more" for t in texts[1:40:4]] + texts[2:30:4]
    texts += [f"{prose(20)} {items[i % 4][1]} {prose(20)}" for i in range(12)] + [f"{prose(300)} {items[2][1]} {prose(300)}"]
    texts += [f"{prose(20)} token = {''.join(r.choice('0123456789abcdef') for _ in range(32))} {prose(20)}" for _ in range(30)]
    texts += ["", "  ", None, "word"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[1], "en", "s", 1), (None, items[0][1], None, None, None), (None, None, None, None, None), (7, items[0][1], "en", "s", 1), rows[9], rows[9], (9, texts[11], "en", "s", 1), (10_000, prose(30_000), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def run_stage(spark, tables, name, rows=None):
    docs = spark.createDataFrame([(*x, 1, "y") for x in (tables[1] if rows is None else rows)], COLUMNS + ", h int, score string")
    return [tuple(x) for x in dict(corpus_pipeline.STAGES)[name](spark, docs, tables[0]).collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_toxicity_stage(spark, tables):
    got = run_stage(spark, tables, "toxicity")
    assert ordered(got) == ordered(x for x in tables[1] if "idiot" not in (x[1] or ""))


def test_near_duplicate_stage(spark, tables):
    got = run_stage(spark, tables, "near_duplicates")
    once = list(dict.fromkeys(tables[1]))
    distinct = [(x[0], x[1] or "") for x in once]
    groups: dict = {}
    for x, (i, n, _), k in zip(once, near_groups(distinct, 5, 80), group_numbers(distinct), strict=True):
        groups.setdefault(k if n and i is not None else ("alone", x), []).append(x)
    assert len(got) == len(groups) and all(sum(x in g for x in got) == 1 for g in groups.values())
    assert all(min(x[0] for x in g) == next(x[0] for x in got if x in g) for g in groups.values() if g[0][0] is not None)


def group_numbers(rows):
    """The group of each row, by position: near_groups with positions for ids."""
    return [t for _, _, t in near_groups([(None if i is None else k, t) for k, (i, t) in enumerate(rows)], 5, 80)]


def test_decontamination_stage(spark, tables):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    items = [split(x["text"]) for x in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()]
    windows = {tuple(v[a : a + min(13, len(v))]) for v in items for a in range(len(v) - min(13, len(v)) + 1)}

    def contaminated(text):
        w, hit = split(text), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    got = run_stage(spark, tables, "decontamination")
    want = [x for x in tables[1] if not contaminated(x[1])]
    assert ordered(got) == ordered(want) and len(want) < len(tables[1]) - 10


def test_secrets_stage(spark, tables):
    got = run_stage(spark, tables, "secrets")
    assert len(got) == len(tables[1])
    by_id = {x[0]: x for x in got}
    for x in tables[1]:
        base = secrets.base_spans(x[1] or "")
        if x[0] is not None and x[0] not in (7, 9):
            y = by_id[x[0]]
            assert (y[1] == x[1] and y[4] == x[4]) if not base else (y[1] == secrets.redact(x[1], base) and y[4] == len(y[1]))


def test_packing_stage(spark, tables):
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, spark.createDataFrame(tables[1], COLUMNS), tables[0]).collect()
    library = Tokenizer.from_file(corpus_pipeline.packing.vocabulary())
    check_packing(rows, [{"doc_id": x[0], "text": x[1]} for x in tables[1]], library, 2048)


def test_stages_follow_each_other(spark, tables, monkeypatch):
    """run() gives each stage what the one before it kept."""
    seen = []

    def watch(name, stage):
        def run(spark, docs, sf_dir):
            seen.append((name, ordered(map(tuple, docs.collect()))))
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watch(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, tables[0]).collect()
    assert [n for n, _ in seen] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    sizes = [len(rows) for _, rows in seen]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] and {x["doc_id"] for x in packed} == {x[0] for x in seen[-1][1]}
    rows = [list(map(tuple, seen[k][1])) for k in range(5)]
    assert ordered(run_stage(spark, tables, "toxicity", rows[0])) == rows[1] and ordered(run_stage(spark, tables, "decontamination", rows[2])) == rows[3]


def test_empty_tables(spark, tables):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), tables[0]).count() == 0, name
