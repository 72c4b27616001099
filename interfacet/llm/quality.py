"""Quality rules: text statistics, and a learned decision list of threshold conjunctions.

Sequential covering on labelled statistics: a rule grows by the threshold that gains most (FOIL),
is pruned on rows it hasn't grown on, and the rows it covers leave. The list becomes an ordered
Spark conditional expression; what no rule covers is kept.

Null, empty and blank texts have no words and fail the base rules; repeated rows get equal results;
without labels of both kinds the list is empty; an empty table gives an empty result; columns other
than those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_texts, sampled

SAMPLE = 20_000  # labelled rows to learn from at most, chosen by hash
SPACES = bytes([32, 9, 10, 11, 12, 13])
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_digits long, n_marks long, n_distinct long, n_lines long"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(ids) < 4:
        return 0, len(number)
    k = np.int64(len(number))
    pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
    _, inverse, count = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : j + len(hit)] |= hit
    return int(covered.sum()), len(number)


def statistics_of(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    again, distinct = repeated_words(words)
    chars = len(text) - sum(raw.count(b) for b in SPACES)
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    digits = len(raw) - len(raw.translate(None, bytes(range(48, 58))))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), again, upper, digits, raw.count(b"!"), distinct, len(lines)


def text_statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and STATS."""
    keep = [c for c in docs.columns if c != "text"]
    names = [s.split()[0] for s in STATS.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [statistics_of(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array([o[i] for o in out], pa.int64()) for i in range(len(names)))], names=[*keep, *names])

    schema = docs.select(*keep).schema
    for s in STATS.split(", "):
        schema = schema.add(*s.split())
    return docs.select(*keep, "text").mapInArrow(run, schema)


def ratios() -> dict[str, Column]:
    """What the learned rules test."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars, "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars, "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / words, "distinct_share": F.col("n_distinct") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "word_length": F.col("word_chars") / words,
    }


Rule = list[tuple[str, str, float]]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, t in rule:
        out &= x[name] >= t if op == ">=" else x[name] <= t
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, conditions: int) -> Rule:
    rule: Rule = []
    while len(rule) < conditions:
        now = covers(rule, x)
        p0, n0 = int((now & bad).sum()), int((now & ~bad).sum())
        if not p0 or not n0:
            break
        best, base = (0.0, None), math.log2(p0 / (p0 + n0))
        for name, v in x.items():
            for t in np.unique(np.quantile(v[now], np.linspace(0, 1, 65), method="nearest")):
                for op, m in ((">=", v >= t), ("<=", v <= t)):
                    p, n = int((now & m & bad).sum()), int((now & m & ~bad).sum())
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, (name, op, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, conditions: int = 4, rules: int = 12) -> list[Rule]:
    """Ordered rules, each for bad rows with at least `precision` on the rows it was pruned on."""
    out: list[Rule] = []
    part = np.random.default_rng(3).random(len(bad)) < 0.67
    left = np.ones(len(bad), bool)
    while len(out) < rules and (left & bad).sum() >= 3:
        g, v = left & part, left & ~part
        if not (g & bad).any():
            break
        rule = grow({k: a[g] for k, a in x.items()}, bad[g], conditions)
        worth = lambda r: (lambda m: ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum()))(covers(r, x) & v)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = covers(rule, x) & left
        if not rule or (m & bad).sum() < 3 or (m & bad).sum() < precision * m.sum() or (m & v & bad).sum() < precision * (m & v).sum():
            break
        out.append(rule)
        left &= ~m
    return out


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that holds rejects, and no rule keeps."""
    out = F.lit(True)
    value = ratios()
    for rule in reversed(rules):
        test = F.lit(True)
        for name, op, t in rule:
            test = test & (value[name] >= t if op == ">=" else value[name] <= t)
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stats = text_statistics(labelled_texts(docs, sampled(known, sample, "doc_id")))
    stats = stats.where(~base_failed())  # the list is for what the base rules leave
    names = list(ratios())
    got = stats.select("doc_id", "quality", *[c.alias(n) for n, c in ratios().items()]).toPandas().sort_values("doc_id", kind="stable")
    bad = got["quality"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return decision_list({n: got[n].to_numpy(float) for n in names}, bad)


def apply_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the statistics, base_failed and kept."""
    rules = learn(docs, labels, sample)
    stats = text_statistics(docs.select("doc_id", "text"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))
