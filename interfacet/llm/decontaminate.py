"""Benchmark decontamination by winnowing, in DataFrame functions only.

The smallest k-gram hash of every window of k-grams is a fingerprint; a passage that a document and
an item share over a whole window of words then shares a fingerprint. Documents that share any are
candidates, and in those the hits are extended: every window of words is compared as words.

Null, empty and wordless texts have no words and no hits; a wordless item has no window; repeated
rows get equal results; an empty table of documents gives an empty result, an empty benchmark none
contaminated; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what separates words, once A-Z are in lower case
BROADCAST_ROWS = 1_000_000  # fingerprints up to here (16 MB) are sent to all executors; more are shuffled


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def count_up(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(hashes: Column, k: int, width: int) -> Column:
    """The winnowed k-gram hashes of an array of word hashes, every window of `width` k-grams giving its smallest."""
    grams = F.transform(count_up(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i + 1, k))) if k > 1 else hashes
    if width == 1:
        return F.array_distinct(grams)
    # The array of hashes is bound once, not computed again for each window.
    return F.array_distinct(F.flatten(F.transform(F.array(grams), lambda g: F.transform(count_up(F.size(g) - (width - 1)), lambda i: F.array_min(F.slice(g, i + 1, width))))))


def with_fingerprints(rows: DataFrame, key: list[str], k: int, width: int) -> DataFrame:
    hashed = rows.select(*key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*key, F.explode(fingerprints(F.col("hashes"), k, width)).alias("fp"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated: a row for each row of docs."""
    return judged(docs, benchmark, window, percent).drop("id", "h")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The columns of `contamination`, and id and h, the key of the row (see `keyed`).

    A document word inside any occurrence of a window of an item is hit. contaminated: any word is
    hit and the hits are at least `percent` of the words.
    """
    docs = keyed(docs.select("doc_id", "text"))
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    shortest = items.agg(F.min(F.least(F.size("words"), F.lit(window)))).first()[0] or window  # one number
    k = max(1, min(8, shortest - 5)) if shortest > 1 else 1
    width = shortest - k + 1
    probes = materialize(with_fingerprints(benchmark.select("item_id", "text"), ["item_id"], k, width).select("fp").distinct())
    probes = F.broadcast(probes) if probes.count() <= BROADCAST_ROWS else probes
    candidates = materialize(with_fingerprints(docs, ["id", "h"], k, width).join(probes, "fp", "left_semi").select("id", "h").distinct())

    size = F.least(F.size("words"), F.lit(window))
    windows = items.withColumn("len", size).select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.array_join(F.slice("words", i + 1, F.col("len")), " "))).alias("win")).distinct()
    windows = materialize(windows)
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `window` numbers
    lists = docs.join(candidates, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("id", "h", words(F.col("text")).alias("words"))
    grams = F.array(*[F.struct(F.lit(n).alias("len"), count_up(F.size("words") - (n - 1)).alias("at")) for n in lengths or [window]])
    spread = materialize(lists).select("id", "h", "words", F.explode(grams).alias("g")).select("id", "h", "g.len", F.explode(F.transform("g.at", lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, F.col("g.len")), " ").alias("win")))).alias("w")).select("id", "h", "len", "w.at", "w.win")
    hits = materialize(spread.join(windows, ["win", "len"]).select("id", "h", "at", "len", "item_id"))

    before = Window.partitionBy("id", "h").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    places = hits.select("id", "h", "at", "len").distinct().withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = places.groupBy("id", "h").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("at", "seen"))).cast("long").alias("n_hit"))
    named = hits.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = covered.join(named, ["id", "h"])
    total = docs.select("doc_id", "id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    whole = total.join(found, ["id", "h"], "left").select("id", "h", "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return whole.select("id", "h", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))
