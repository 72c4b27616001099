"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, count_tree, decontaminate, minhash, packing, periods, quality, rans, secrets, site_tree, suffix_dedup, toxicity, vector_codes
from .common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_chat(chat.format_chat(turns)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ': ', ':\ ') AS name,
    coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN opens THEN 6 + length(name) ELSE 3 END + CASE WHEN closes THEN 9 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")  # noqa: E731
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


def op7_winnowed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periods.find_runs(docs)
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, milli.alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op11_sql() -> str:
    """Places with equal windows of 8 words, q words apart; stretches of them are runs."""
    table_ = "SELECT i, i AS c0 FROM range(256) t(i)"
    for k in range(8):
        table_ = f"SELECT i, CASE WHEN c{k} % 2 = 1 THEN xor(c{k} // 2, 3988292384) ELSE c{k} // 2 END AS c{k + 1} FROM ({table_})"
    return f"""
WITH crc AS (SELECT list(c8 ORDER BY i) AS c FROM ({table_})),
o AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, doc_id, w, len(w) AS n, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda x, y: xor(x // 256, c[CAST(xor(x, y) % 256 AS BIGINT) + 1]))) AS h FROM o, crc),
a AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS cyclic, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, (h // 10) % 8 AS g FROM k),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN cyclic THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) ELSE w END AS w FROM a),
win AS (SELECT r, i, array_to_string(w[i + 1:i + 8], ' ') AS win FROM (SELECT r, w, unnest(range(greatest(n - 7, 0))) AS i FROM d)),
j AS (SELECT x.r, x.i, y.i - x.i AS q FROM win x JOIN win y ON x.r = y.r AND x.win = y.win AND x.i < y.i),
s AS (SELECT r, q, min(i) AS s, max(i) + 8 + q AS e FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM j) GROUP BY r, q, island),
runs AS MATERIALIZED (SELECT r, s, e - s AS l, min(q) AS q FROM s WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
t AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s, l, q), (-CAST(l AS DOUBLE) / q, s, q)) AS top, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT r, list(DISTINCT i) AS i FROM (SELECT r, unnest(range(s + q, s + l)) AS i FROM runs) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone.i IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda x: NOT list_contains(gone.i, x)), lambda x: w[x + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN gone USING (r)
"""


def op12_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM g),
u AS (SELECT doc_id, n, unnest(s) AS x FROM g JOIN n USING (doc_id)),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.reached = e.a)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(min(reached), n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.doc_id GROUP BY n.doc_id, n
"""


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part against every entry, round after round."""
    sql = f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT r, CAST(floor(i * {parts} / n) AS BIGINT) AS part, i % (n // {parts}) AS pos, x
  FROM (SELECT r, len(ints) AS n, unnest(range(len(ints))) AS i, unnest(ints) AS x FROM k)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM v JOIN f USING (r))"""
    for t in range(rounds + 1):
        sql += f""",
b{t} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM v JOIN c{t} USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)"""
        if t < rounds:
            sql += f""",
s{t} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN b{t} USING (r, part) GROUP BY part, entry, pos),
c{t + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{t} LEFT JOIN s{t} USING (part, entry, pos))"""
    return f"""{sql},
o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM b{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM o JOIN k USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_quality_rules, op3_secret_scan, op4_suffix_dedup, op5_toxicity, op6_minmax_near_duplicates, op7_winnowed_contamination, op8_site_style_tree, op9_rans_tokens, op10_best_fit_packing, op11_periodic_runs, op12_count_tree_join, op13_orchard_codes, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op7_winnowed_contamination": OP7_SQL, "op11_periodic_runs": op11_sql(), "op12_count_tree_join": OP12_SQL, "op13_orchard_codes": op13_sql()}
