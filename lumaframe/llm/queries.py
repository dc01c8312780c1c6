"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm import collocations, decontamination, filter_audit, language_model, license_scan, line_dedup, minhash, mixing, neighbours, quality_rules, suffix_dedup, token_files, toxicity
from lumaframe.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        runs.alias("spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Words are found with what stands before them (p), cut where their hashes say so (c), put together as
#: units (u) and ranked among equal ones (k); removed units that touch make runs (s), and the rest is joined.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS pieces FROM documents),
p AS (SELECT doc_id, unnest(range(len(pieces))) AS i, len(pieces) AS n, unnest(pieces) AS piece FROM d),
w AS (SELECT doc_id, i, n, translate(regexp_replace(piece, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
        CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM p),
g AS (SELECT *, upto - length(word) AS start, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) AS g FROM w),
c AS (SELECT *, i = n - 1 OR (g + 7 * lead(g) OVER o) % 6 = 0 AS cut FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = 0 OR lag(cut) OVER o AS opens, min(CASE WHEN cut THEN i + 1 END) OVER (o ROWS BETWEEN 19 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, list(word ORDER BY i) AS words, list(start ORDER BY i) AS starts FROM g GROUP BY doc_id),
u AS (SELECT doc_id, i, until, array_to_string(words[i + 1 : until], ' ') AS unit, start AS a, coalesce(starts[until + 1], length(body)) AS b FROM e JOIN t USING (doc_id) JOIN d USING (doc_id) WHERE opens AND until IS NOT NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) AS nth FROM u) WHERE nth > 1),
m AS (SELECT *, i > coalesce(lag(until) OVER (PARTITION BY doc_id ORDER BY i), -1) AS new FROM k),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
s AS (SELECT doc_id, run, min(a) AS a, max(b) AS b, max(until) - min(i) AS words FROM r GROUP BY doc_id, run),
f AS (SELECT doc_id, run, a, b, words, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
h AS (SELECT doc_id, count(*) AS n_spans, sum(words) AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, string_agg(substring(body, z + 1, a - z), '' ORDER BY a) || substring(any_value(body), max(b) + 1) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  coalesce(spans, '') AS spans, sha256(coalesce(kept, body)) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").cast("long").alias("n_passages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("needed", ",").alias("needed"), "permitted")


def op8_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.host_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, source, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS failed FROM f GROUP BY source),
p AS (SELECT avg(failed / n) AS mu, greatest(var_pop(failed / n) - avg(failed / n * (1 - failed / n) / n), 1e-6) AS v FROM h),
k AS (SELECT source, (failed + mu * greatest(mu * (1 - mu) / v - 1, 1.0)) / (n + greatest(mu * (1 - mu) / v - 1, 1.0)) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source
"""


def tokenizer_path() -> str:
    """The production tokenizer's file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Words in pieces (w), what follows each (g), the counts of one to three words (f1 to f3), both kinds of candidates (c2, c3) and what is dropped.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws[i + 1] AS w1, ws[i + 2] AS w2, ws[i + 3] AS w3 FROM (SELECT lang, ws, unnest(range(len(ws))) AS i FROM w)),
t AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1 AS w, count(*) AS f FROM g GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
x AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, a.f AS l, b.f AS r, f2.f::HUGEINT * f2.f * 1000000 // (a.f::HUGEINT * b.f) AS score
       FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.w = f2.w1 JOIN f1 b ON b.lang = f2.lang AND b.w = f2.w2 LEFT JOIN x ON x.lang = f2.lang AND x.w1 = f2.w1 AND x.w2 = f2.w2 WHERE longer IS NULL OR 100 * longer < 50 * f2.f),
s AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, a.f AS l1, q.f AS r1, p.f AS l2, b.f AS r2,
        f3.f::HUGEINT * f3.f * 1000000 // (a.f::HUGEINT * q.f) AS s1, f3.f::HUGEINT * f3.f * 1000000 // (p.f::HUGEINT * b.f) AS s2
      FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.w = f3.w1 JOIN f1 b ON b.lang = f3.lang AND b.w = f3.w3
        JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Failures by document (f), documents by mask (c), the orders (o) and what each step of an order does.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT part, n, good, toxic, fails, filter_order, step, contains(fails, substr(filter_order, step, 1)) AS own,
        len(list_intersect(string_split(fails, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND step > 1 AND fails <> '' AS gone FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
h AS (SELECT part, substr(filter_order, step, 1) AS x, sum(n) AS shapley FROM k WHERE own AND NOT gone GROUP BY 1, 2)
SELECT k.part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = substr(filter_order, step, 1)), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(any_value(shapley), 0) AS BIGINT) AS shapley
FROM k LEFT JOIN h ON k.part = h.part AND h.x = substr(filter_order, step, 1)
GROUP BY k.part, filter_order, step
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_language_model": op3_language_model,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_decontamination": op6_decontamination,
        "op7_license_scan": op7_license_scan,
        "op8_minhash_classes": op8_minhash_classes,
        "op9_quality_rules": op9_quality_rules,
        "op10_token_files": op10_token_files,
        "op11_collocations": op11_collocations,
        "op12_neighbours": op12_neighbours,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op9_quality_rules": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op13_filter_audit": OP13_SQL,
    }
