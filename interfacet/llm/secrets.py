"""Secret scans: rules find the base spans, a character convolutional network adds others.

The network scores every long token, those that a rule covers too; base spans stay whatever it says,
and each token it finds is a span of its own, whole even where a rule covers a part. It sees the whole
token, in windows where it is long, and the characters around it, and is trained in numpy on labelled
findings: the rules' own values, and values drawn anew from the letters that the rules allow, against
ordinary tokens, words and words run together of the same texts (trigger words are blanked half of the
time). It is calibrated on other findings, and its threshold keeps at least `recall` of those.

It learns from at most `sample` different texts with findings, chosen by hash, and in each from EACH
findings, tokens and words of every sort, drawn from the whole text.

Null and empty texts have no spans; repeated rows get equal spans; without findings to learn from
nothing is added; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, sampled

# The base rules.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
TRIGGERS = ("pass", "secret", "token", "api")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SIDE, BODY = 16, 40
ALPHABETS = (ascii_letters, ascii_lowercase, ascii_uppercase + digits, "ABCDEF" + digits, ascii_letters + digits, ascii_letters + digits + "+/", ascii_letters + digits + "_-")  # of values drawn anew
SAMPLE = 4000  # texts to learn from at most
EACH = 4  # findings, tokens, words of each sort to learn from in a text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    if any(t in low for t in TRIGGERS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def views(text: str, start: int, end: int) -> list[bytes]:
    """Codes of the token between its surroundings, SIDE + BODY + SIDE numbers below 128; a long token gives windows that overlap by half."""
    last = max(start, end - BODY)
    out = []
    for a in [*range(start, last, BODY // 2), last]:
        b = min(a + BODY, end)
        s = text[max(0, a - SIDE) : a].rjust(SIDE, "\0") + text[a:b].ljust(BODY, "\0") + text[b : b + SIDE].ljust(SIDE, "\0")
        out.append(bytes([min(ord(c), 127) for c in s]))
    return out


class CharCNN:
    """Embedding, one convolution, maximum over places, logistic output."""

    def __init__(self, width: int = 5, filters: int = 24, dim: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {"E": r.normal(0, 0.3, (128, dim)), "W": r.normal(0, 0.2, (width * dim, filters)), "b": np.zeros(filters), "v": r.normal(0, 0.2, filters), "c": np.zeros(1)}
        self.scale = np.array([1.0, 0.0])

    def forward(self, x: np.ndarray):
        e = self.p["E"][x]
        n = x.shape[1] - self.width + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(self.width)], 2)
        a = cols @ self.p["W"] + self.p["b"]
        at = a.argmax(1)
        top = np.take_along_axis(a, at[:, None], 1)[:, 0]
        return cols, at, top, np.maximum(top, 0) @ self.p["v"] + self.p["c"][0]

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, rate: float = 0.01, seed: int = 6) -> None:
        r = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                k = order[i : i + 64]
                cols, at, top, z = self.forward(x[k])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]) / len(k)
                g = {"v": np.maximum(top, 0).T @ d, "c": np.array([d.sum()])}
                da = d[:, None] * self.p["v"] * (top > 0)
                picked = cols[np.arange(len(k))[:, None], at]  # row, filter, width * dim
                g["W"], g["b"] = np.einsum("nf,nfk->kf", da, picked), da.sum(0)
                dcols = np.einsum("nf,kf->nfk", da, self.p["W"]).reshape(len(k), at.shape[1], self.width, -1)
                g["E"] = np.zeros_like(self.p["E"])
                for j in range(self.width):
                    np.add.at(g["E"], np.take_along_axis(x[k], at + j, 1), dcols[:, :, j])
                t += 1
                for name, v in g.items():
                    a, b = m[name]
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.p[name] = self.p[name] - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on findings that the training hasn't seen."""
        from .toxicity import fit

        z = self.logits(x)
        w = fit(np.stack([z, np.ones_like(z)], 1), y, 0.01)
        self.scale = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 1024])[3] for i in range(0, len(x), 1024)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) * self.scale[0] + self.scale[1], -30, 30)))


def drawn(r: np.random.Generator) -> str:
    """A random value of one of ALPHABETS, padded like base64 now and then."""
    letters = ALPHABETS[r.integers(len(ALPHABETS))]
    return "".join(letters[i] for i in r.integers(len(letters), size=r.integers(16, 65))) + "=" * (int(r.integers(3)) if "+" in letters else 0)


def examples(text: str, h: int) -> list[tuple[bytes, int]]:
    """Views with labels from one text: 1 for findings of the rules, 2 for values drawn in their places and those of words, 0 for ordinary tokens."""
    base, out = base_spans(text), []
    r = np.random.default_rng(h & 0xFFFFFFFF)
    taken: list[tuple[int, int]] = []  # the spans of the rules, merged
    for s, _, e in base:
        if taken and s <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))

    def put(before: str, token: str, after: str, label: int) -> None:
        seen = before[-SIDE:]
        out.extend((v, label) for v in views(seen + token + after[:SIDE], len(seen), len(seen) + len(token)))

    def free(pattern) -> list[tuple[int, int]]:
        found = [m.span() for m in re.finditer(pattern, text)]
        at = [bisect_left(taken, (b, b)) for _, b in found]  # the rule spans that begin before b
        return [(a, b) for (a, b), i in zip(found, at, strict=True) if not i or taken[i - 1][1] <= a]

    words = free(r"[A-Za-z]{2,}")
    for i in sorted(r.permutation(len(base))[:EACH]):
        start, kind, end = base[i]
        m = ASSIGN.match(text, start) if kind == 0 else None
        a, b = m.span(2) if m else (start, end)
        seen = text[max(0, a - SIDE) : a]
        blank = re.sub(r"[A-Za-z]", " ", seen)
        for before in (seen, blank):
            put(before, text[a:b], text[b : b + SIDE], 1)
        put(blank if r.random() < 0.5 else seen, drawn(r), text[b : b + SIDE], 2)
        for a, b in [words[i] for i in r.integers(len(words), size=2)] if words else []:
            put(text[max(0, a - SIDE) : a], drawn(r), text[b : b + SIDE], 2)
    for found in (free(TOKEN), free(r"\S{6,}")):
        for i in r.permutation(len(found))[:EACH]:
            a, b = found[i]
            put(text[max(0, a - SIDE) : a], text[a:b], text[b : b + SIDE], 0)
    for i in r.permutation(max(0, len(words) - 5))[: EACH + 2]:  # words run together, as in names and paths, and rules of one sign
        joined = ("", "_", "-", "/")[r.integers(4)].join(text[a:b] for a, b in words[i : i + 6])
        kind = r.integers(8)
        joined = joined.upper() if kind < 2 else "=-_+/"[r.integers(5)] * 64 if kind == 2 else joined
        put(text[max(0, words[i][0] - SIDE) : words[i][0]], joined[: r.integers(16, 65)], text[words[i][1] : words[i][1] + SIDE], 0)
    return out


def labelled(docs: DataFrame, sample: int) -> list[tuple[bytes, int]]:
    """The examples of at most `sample` different texts with findings, chosen by hash: the texts' hashes are chosen first, the texts fetched then."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [o for text, h in rows(batch) for o in examples(text, h)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())], names=["x", "y"])

    h = F.xxhash64("text").alias("h")
    hinted = docs.where(F.col("text").rlike("[0-9a-f]{16}|AKIA") | F.lower("text").rlike(r"(password|passwd|secret|token|api_?key)[\"']? *[:=]")).select(h).distinct()
    chosen = F.broadcast(sampled(materialize(hinted), sample, "h"))  # `sample` numbers
    texts = docs.select("text", h).join(chosen, "h").groupBy("h").agg(F.first("text").alias("text")).select("text", "h")
    return [(bytes(r["x"]), r["y"]) for r in texts.mapInArrow(run, "x binary, y int").collect()]


def train(docs: DataFrame, recall: float, sample: int) -> tuple[CharCNN, float]:
    """Network and threshold, learned from docs."""
    return fitted(sorted(labelled(docs, sample)), recall)


def fitted(rows_: list[tuple[bytes, int]], recall: float) -> tuple[CharCNN, float]:
    """Network and threshold; the threshold keeps `recall` of the calibration findings, found and drawn each, and passes no ordinary token of them where the classes part."""
    kind = np.array([r[1] for r in rows_], int)
    y = (kind > 0).astype(float)
    if len(set(y.tolist())) < 2 or y.sum() < 8:
        return CharCNN(), 2.0
    x = np.frombuffer(b"".join(r[0] for r in rows_), np.uint8).reshape(len(rows_), -1)
    later = np.random.default_rng(8).random(len(y)) < 0.3
    net = CharCNN()
    net.train(x[~later], y[~later])
    if later.sum() < 4 or len(set(y[later].tolist())) < 2:
        return net, 0.9
    net.calibrate(x[later], y[later])
    p = net.probability(x[later])
    keep = min(float(np.quantile(p[kind[later] == k], 1 - recall, method="lower")) for k in set(kind[later].tolist()) - {0})
    clean = float(p[y[later] == 0].max())
    return net, keep if clean >= keep else (keep + clean) / 2  # recall first; between the classes where they part


def spans_of(text: str, net: CharCNN, threshold: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules and the network; a token counts by the window that scores highest."""
    base = base_spans(text)
    found = []
    more = candidates(text)
    for i in range(0, len(more), 512):
        part = more[i : i + 512]
        seen = [views(text, *m) for m in part]
        first = np.cumsum([0, *map(len, seen)])[:-1]
        p = np.concatenate([net.probability(np.frombuffer(b"".join(v for vs in seen for v in vs), np.uint8).reshape(-1, 2 * SIDE + BODY)[j : j + 1024]) for j in range(0, sum(map(len, seen)), 1024)])
        found += [(a, 3, b) for (a, b), q in zip(part, np.maximum.reduceat(p, first), strict=True) if q >= threshold]
    return sorted(base + found)


def find_secrets(docs: DataFrame, recall: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """doc_id and spans (start, kind, end in code points, by start, then kind) of every row of docs."""
    net, threshold = train(docs, recall, sample)

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
        for batch in batches:
            spans = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans_of(t.as_py() or "", net, threshold)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with the spans replaced by the mark; spans that overlap share one."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_rows(docs: DataFrame, recall: float = 0.95, sample: int = SAMPLE, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs (with text and n_chars) without their secrets; untouched rows stay as they are."""
    net, threshold = train(docs, recall, sample)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("text", "n_chars")}
            texts, sizes = [], []
            for t, n in zip(batch.column(at["text"]), batch.column(at["n_chars"]), strict=True):
                text, size = t.as_py(), n.as_py()
                if text and (spans := spans_of(text, net, threshold)):
                    text = redact(text, spans, mark)
                    size = len(text)
                texts.append(text), sizes.append(size)
            cols = list(batch.columns)
            cols[at["text"]], cols[at["n_chars"]] = pa.array(texts, pa.string()), pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    base = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return base.mapInArrow(run, base.schema)
