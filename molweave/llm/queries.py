"""Registered queries over the given tables, one per operator, with the SQL that must give the same rows where there is one."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.llm import audit, backoff, chosen_path, collision, exact, langid, lengths, licenses, mixing, packing, pages, toxicity, variants
from molweave.plans.registry import query
from molweave.plans.sql import u


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _phrase_starts(phrase: str) -> str:
    parts = phrase.split()
    same = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(parts))
    return f"list_filter(range(0, len(ws)), lambda i: {same})"


_FOLDED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STARTS = ", ".join(f"{_phrase_starts(phrase)} AS at_{i}" for i, phrase in enumerate(licenses.BASE))
_ALL_STARTS = " || ".join(f"at_{i}" for i in range(len(licenses.BASE)))
_BASE_LABELS = ", ".join(f"CASE WHEN len(at_{i}) > 0 THEN '{label}' END" for i, label in enumerate(licenses.BASE.values()))
_TEMPLATES = ", ".join(
    f"('{label}', {sorted(set(t.split()))}, {licenses.needed(len(set(t.split())), licenses.THRESHOLD)})" for label, t in licenses.TEMPLATES
)
LICENSE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_FOLDED} AS t FROM documents),
w AS (SELECT doc_id, rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
b AS (SELECT doc_id, rid, len(ws) AS n_words, {_STARTS} FROM w),
lines AS (SELECT rid, regexp_extract_all(line, '{_WORD}') AS ws
          FROM (SELECT rid, unnest(regexp_split_to_array(t, '[

]+')) AS line FROM d)),
blocks AS (SELECT rid, ws[s + 1 : s + {licenses.WINDOW}] AS block
           FROM (SELECT rid, ws, unnest(range(0, greatest(1, len(ws) - {licenses.STRIDE}), {licenses.STRIDE})) AS s FROM lines)),
templates(label, tokens, c) AS (VALUES {_TEMPLATES}),
met AS (SELECT rid, label, max(len(list_intersect(tokens, list_distinct(block))) / len(tokens)) AS best
        FROM blocks JOIN templates ON len(list_intersect(tokens, list_distinct(block))) >= c GROUP BY rid, label),
per AS (SELECT rid, list(label) AS met, max(best) AS best FROM met GROUP BY rid)
SELECT doc_id, n_words, len({_ALL_STARTS}) AS n_base, list_min({_ALL_STARTS}) AS first_word, list_max({_ALL_STARTS}) AS last_word,
       array_to_string(list_sort(list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL) || coalesce(met, []))), ',') AS labels,
       greatest(CASE WHEN len({_ALL_STARTS}) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS score
FROM b LEFT JOIN per USING (rid)"""


@query("op2_license_scan", LICENSE_SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm,
                  length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM p"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


_WEIGHT_LIST = ", ".join(map(str, mixing.WEIGHTS))
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  {u(mixing.SEED, 'doc_id')} AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(([{_WEIGHT_LIST}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS BIGINT) AS weight
      FROM s),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t, CAST(sum(weight) AS BIGINT) AS w FROM w),
o AS (SELECT *, coalesce(CAST(sum({mixing.CAP} * source_size) OVER r AS DOUBLE), 0.0) AS full_before,
             coalesce(CAST(sum(weight) OVER r AS BIGINT), 0) AS weight_before, row_number() OVER (ORDER BY source_size / weight, source) AS k
      FROM w WINDOW r AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT {mixing.BUDGET} * t - full_before AS amount, total.w - weight_before AS weight_left FROM o, total
          WHERE o.weight * ({mixing.BUDGET} * t - full_before) < {mixing.CAP} * source_size * (total.w - weight_before) OR t = 0
          ORDER BY k LIMIT 1),
r AS (SELECT source, source_size,
             least({mixing.CAP} * source_size, weight * amount / CAST(weight_left AS DOUBLE)) AS target
      FROM w, level)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * CAST(CASE WHEN r.source_size = 0 THEN 0 ELSE
         floor(r.target / r.source_size) + CASE WHEN d.draw < r.target / r.source_size - floor(r.target / r.source_size) THEN 1 ELSE 0 END
       END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source"""


@query("op5_mix_sources", MIX_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_SHINGLE = chosen_path.SHINGLE
JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS ws FROM documents),
k AS (SELECT doc_id, ws, array_to_string(ws, ' ') AS words FROM w),
reps AS (SELECT words, any_value(ws) AS ws, min(doc_id) AS rep, count(*) AS n_copies FROM k WHERE len(ws) > 0 GROUP BY words),
s AS (SELECT DISTINCT rep, array_to_string(ws[i : i + {_SHINGLE - 1}], ' ') AS run
      FROM (SELECT rep, ws, unnest(range(1, greatest(1, len(ws) - {_SHINGLE - 1}) + 1)) AS i FROM reps)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n na ON na.rep = c.a JOIN n nb ON nb.rep = c.b
      WHERE 10 * c.c >= {round(10 * chosen_path.THRESHOLD)} * (na.n + nb.n - c.c)),
r AS (SELECT rep AS node, rep AS low FROM reps UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node),
g AS (SELECT node, min(low) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT k.doc_id, coalesce(g.class_id, k.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(reps.n_copies, 1) AS n_copies
FROM k LEFT JOIN reps USING (words) LEFT JOIN g ON g.node = reps.rep LEFT JOIN l ON l.a = reps.rep"""


@query("op7_ngram_jaccard_join", JACCARD_SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("op9_nearest_neighbours")
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf_dir, "documents"))


_LETTERS = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(audit.FILTERS))
AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{audit.WORD}') AS ws FROM documents),
m AS (SELECT doc_id, part,
             CAST(len(ws) < {audit.LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < {audit.DISTINCT_PERCENT} * len(ws) AS INT)
             + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.CAPITAL_PERCENT} * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '{audit.MARKS}') AS INT)
             + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(c, b) AS (VALUES {_LETTERS}),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a JOIN f b ON b.c <> a.c
      JOIN f c ON c.c NOT IN (a.c, b.c) JOIN f d ON d.c NOT IN (a.c, b.c, c.c) JOIN f e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
      FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
             sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant,
             sum(n) FILTER (mask = bit) AS unique_fails, sum(g) FILTER (mask & bit > 0 AND mask & earlier = 0) AS good_lost,
             sum(x) FILTER (mask & bit > 0 AND mask & earlier = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in audit.COUNTS[:-1])},
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(table(spark, sf_dir, "documents"))


@query("op12_lm_scoring")
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_texts(table(spark, sf_dir, "documents"))
