"""Toxicity by a learned lexicon, matched with one edit allowed.

Terms (words, and stems that open words) are learned from labelled rows by an exact binomial test.
A trie of the terms is intersected with the Levenshtein automaton of distance 1 and made
deterministic, so that all words of a batch walk one transition table together. Words and stems of
5 letters or more may hold one edit, in the learned lexicon at the first letter too; shorter ones
must be exact, as must those whose edited forms are ordinary words of clean training texts. Hits with a
quotation mark on both sides within WINDOW characters are counted apart from others, and a logistic
model learns what each count weighs in the score. Only the text is an input of a score.

It learns from at most `sample` labelled rows, chosen by hash. Terms are words of 3 to 24 letters and
their openings; the lexicon has LEXICON terms at most.

Null and empty texts have no hits and get the score of such texts; repeated rows get equal scores;
without any label of each class the score is 0.5; an empty table gives an empty result; columns
other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_texts, materialize, rows, sampled

SAMPLE = 20_000  # labelled rows to learn from at most; see learn()
WINDOW, QUOTES = 30, "\"“”„«»‹›"
LEXICON = 150
STEMS = range(4, 8)  # lengths of stems
EDITS = 64  # see ordinary()
SEP, OTHER = 0, 1


def is_training(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


@cache
def separators() -> np.ndarray:
    """Class of every code point: a letter or digit of no term, or what stands between words."""
    return np.fromiter((OTHER if chr(c).isalnum() else SEP for c in range(0x110000)), np.int16, 0x110000)


class Automaton:
    """Deterministic product of the trie of `terms` (a stem ends in *) with distance 1; `first` allows the edit at the first letter; `exact` terms take none."""

    def __init__(self, terms: list[str], fuzzy_from: int = 5, first: bool = False, exact: frozenset[str] = frozenset()):
        self.letters = {c: i + 2 for i, c in enumerate(sorted({c for t in terms for c in t.rstrip("*")}))}
        trie, ends = [{}], {}
        for t in terms:
            at = 0
            for c in t.rstrip("*"):
                if c not in trie[at]:
                    trie.append({})
                    trie[at][c] = len(trie) - 1
                at = trie[at][c]
            ends.setdefault(at, set()).add(("fuzzy " if len(t.rstrip("*")) >= fuzzy_from and t not in exact else "") + ("stem" if t.endswith("*") else "word"))
        free = lambda node: first or node
        begun = (-1, 1)  # a stem with one edit has opened the word

        def close(states):
            """A letter left out costs an edit and reads nothing."""
            out = set(states) | {(child, 1) for node, e in states if e == 0 and free(node) for child in trie[node].values()}
            return frozenset(out | {begun} if any(e and "fuzzy stem" in ends.get(node, ()) for node, e in out) else out)

        def step(states, c):
            out = set()
            for node, e in states:
                if (node, e) == begun:
                    out.add(begun)
                    continue
                if c in trie[node]:
                    out.add((trie[node][c], e))
                if e == 0 and free(node):
                    out.add((node, 1))
                    out.update((child, 1) for child in trie[node].values())
            return close(out)

        def kind(states):
            kinds = {(k, e) for node, e in states for k in ends.get(node, ())}
            right = lambda name: kinds & {(name, 0), ("fuzzy " + name, 0)}
            return 3 if right("stem") else 1 if right("word") else 2 if begun in states or ("fuzzy word", 1) in kinds else 0

        start = close({(0, 0)})
        names, todo, table, kinds = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(self.letters) + 2)}, {0: 0, 1: 0}
        while todo:
            s = todo.pop()
            row = []
            for c in (None, "\0", *self.letters):
                t = frozenset() if c is None else step(s, c)
                if t not in names:
                    names[t] = len(names)
                    kinds[names[t]] = kind(t)
                    if kinds[names[t]] != 3:
                        todo.append(t)
                    else:
                        table[names[t]] = [names[t]] * (len(self.letters) + 2)  # a stem takes any rest
                row.append(names[t])
            table[names[s]] = row
        self.table = np.array([table[i] for i in range(len(names))], np.int32)
        self.kind = np.array([kinds[i] for i in range(len(names))], np.int8)

    def classes(self) -> np.ndarray:
        """Class of each code point."""
        out = separators().copy()
        for c, i in self.letters.items():
            out[ord(c)] = i
        return out


def matches(auto: Automaton, classes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code points, place and kind of each hit, and the number of words."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = np.append(classes[code], SEP)
    word = cls != SEP
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    state, at = np.ones(len(starts), np.int32), starts.copy()
    done, kinds = [], []
    begun = starts
    while len(at):
        c = cls[at]
        over = (c == SEP) | (auto.kind[state] == 3)
        if over.any():
            k = auto.kind[state[over]]
            done.append(begun[over][k > 0]), kinds.append(k[k > 0])
        state = auto.table[state, c]
        live = (state > 0) & ~over
        state, at, begun = state[live], at[live] + 1, begun[live]
    none = np.zeros(0, np.int64)
    return code, np.concatenate([none, *done]), np.concatenate([none, *kinds]), len(starts)


def hits(auto: Automaton, classes: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """Counts of hits (exact, one edit, stem, any of these between quotation marks), and the number of words."""
    code, where, what, n = matches(auto, classes, text)
    out = np.zeros(4)
    if len(where):
        quote = np.concatenate([[0], np.cumsum(np.isin(code, [ord(q) for q in QUOTES]))])
        left = quote[where] > quote[np.maximum(where - WINDOW, 0)]
        right = quote[np.minimum(where + WINDOW, len(code))] > quote[where]
        np.add.at(out, np.where(left & right, 3, what - 1), 1.0)
    return out, n


def features(found: np.ndarray, n: int) -> list[float]:
    exact, edits, stems, quoted = found
    plain = float(exact + edits + stems)
    return [1.0, *np.log1p([exact + edits, edits, stems, quoted]), math.log1p(plain * 100 / max(n, 20)), float(plain > 0)]


def terms_of(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]{3,24}", (text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def count_terms(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """term, n: the texts of sample that hold each term."""

    def run(batches):
        import pyarrow as pa

        n: Counter = Counter()
        for batch in batches:
            for (text,) in rows(batch):
                n.update(terms_of(text) if only is None else terms_of(text) & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def edited(auto: Automaton, classes: np.ndarray, text: str) -> set[str]:
    """The words of text that are one edit from a term."""
    code, where, what, _ = matches(auto, classes, text)
    out = set()
    for i in where[what == 2]:
        end = i
        while end < len(code) and classes[code[end]] != SEP:
            end += 1
        out.add("".join(map(chr, code[i:end])))
    return out


def count_edits(sample: DataFrame, terms: list[str]) -> dict[str, int]:
    """For each term how often the texts of sample hold words one edit from it, each word once a text."""

    def words(batches):
        import pyarrow as pa

        auto, n = Automaton(terms, first=True), Counter()
        classes = auto.classes()
        for batch in batches:
            for (text,) in rows(batch):
                n.update(edited(auto, classes, text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    def by_term(batches):
        import pyarrow as pa

        found: dict[str, int] = {}
        for batch in batches:
            found.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        text, n = " ".join(found), {}
        for t in terms if found else []:  # one at a time: a table of classes takes 2 MB
            auto = Automaton([t], first=True)
            n[t] = sum(found[w] for w in edited(auto, auto.classes(), text))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    counted = sample.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.mapInArrow(by_term, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def ordinary(toxic: dict[str, int], edits: dict[str, int], n_toxic: int, n_clean: int) -> frozenset[str]:
    """Terms that must be exact: clean texts hold words one edit from them, not EDITS times more rarely than toxic texts hold the term."""
    return frozenset(t for t, b in edits.items() if toxic[t] / n_toxic < EDITS * b / n_clean)


def tail(a: int, n: int, p: float) -> float:
    """log10 of the chance of a or more of n, each with chance p."""
    k = np.arange(a, n + 1)
    of = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])  # logarithms of factorials
    logs = of[n] - of[k] - of[n - k] + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(logs.max() + np.log(np.exp(logs - logs.max()).sum())) / math.log(10)


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int = LEXICON, chance: float = 0.01) -> list[str]:
    """Terms that toxic texts hold far more often than chance allows for that many terms: words, and stems that no other stem stands for."""
    p = n_toxic / (n_toxic + n_clean)
    good = {}
    for t, a in toxic.items():
        b = clean.get(t, 0)
        if a / n_toxic >= 8 * b / n_clean and (x := tail(a, a + b, p)) <= math.log10(chance / len(toxic)):
            good[t] = x
    chosen: list[str] = []
    for t in sorted(good, key=lambda t: (good[t], -len(t), t)):  # of equal stems the longest
        stem = t.rstrip("*")
        if t.endswith("*") and any(c.endswith("*") and (stem.startswith(c[:-1]) or c.startswith(stem)) for c in chosen):
            continue
        chosen.append(t)
    return chosen[:most]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Automaton, np.ndarray]:
    """Automaton and weights from the training rows of labels, at most `sample` of them, chosen by hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_training(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    texts = materialize(labelled_texts(docs, sampled(known, sample, "doc_id")))
    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Automaton([]), np.zeros(7)
    toxic = {r["term"]: r["n"] for r in count_terms(texts.where("toxic = 1"), None).where("n >= 4").collect()}
    clean = {r["term"]: r["n"] for r in count_terms(texts.where("toxic = 0"), frozenset(toxic)).collect()}
    terms = lexicon(toxic, clean, counts[1], counts[0])
    auto = Automaton(terms, first=True, exact=ordinary(toxic, count_edits(texts.where("toxic = 0"), terms), counts[1], counts[0]))
    found = np.array([[r["toxic"], r["n"], *r["found"]] for r in find(texts.withColumns({"id": F.col("toxic").cast("long"), "h": F.lit(0).cast("long")}), auto).select(F.col("id").alias("toxic"), "n", "found").collect()])
    return auto, fit(np.array([features(r[2:], int(r[1])) for r in found]), found[:, 0])


def find(docs: DataFrame, auto: Automaton) -> DataFrame:
    """id, h, n (words), found (hits)."""

    def run(batches):
        import pyarrow as pa

        classes = auto.classes()
        for batch in batches:
            out = [(id_, h, *hits(auto, classes, text or "")) for id_, h, text in rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[2].tolist() for o in out], pa.list_(pa.float64()))], names=["id", "h", "n", "found"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, n long, found array<double>")


def scored(docs: DataFrame, auto: Automaton, w: np.ndarray) -> DataFrame:
    """The rows of docs with all their columns, and score."""

    def run(batches):
        import pyarrow as pa

        classes = auto.classes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            z = [float(np.dot(w, features(*hits(auto, classes, t.as_py() or "")))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def reject(docs: DataFrame, auto: Automaton, w: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold."""
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return scored(base, auto, w).where(F.col("score") < threshold)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text) with held_out, score and predicted."""
    auto, w = learn(docs, labels, sample)
    held = F.coalesce(~is_training(F.col("doc_id")), F.lit(False))
    return scored(docs.select("doc_id", "text"), auto, w).select("doc_id", "text", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
