"""Queries over the test tables for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import alignment, bpe, fingerprints, jaccard_join, langid, license_texts, licenses, lm, oracles, packing, quality_model, quality_rules, simhash, token_counts, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("broken", "source_row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    x = bpe.bpe_decode(bpe.bpe_encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).drop("source_row")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_jaccard_join, op2_token_counts, op3_fingerprints, op4_license_scan, op5_quality_rules, op6_packing, op7_bpe, op8_lm_scores, op9_quality_model, op10_language_id]
    ops += [op11_vector_codes, op12_simhash, op13_alignment, pipeline]
    return {f.__name__: f for f in ops}


_OP1 = """
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), e' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS k FROM words),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM n, unnest(generate_series(1, greatest(k - 4, least(k, 1)))) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.size + y.size - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(z.size, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id
"""


def _op4() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_texts.templates())
    grams = "CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)] END"
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    least = licenses.LEAST
    return f"""
WITH t0 AS (SELECT license, w, row_number() OVER (ORDER BY license, w) AS t FROM (SELECT DISTINCT license, {words.format("t")} AS w FROM (VALUES {rows}) v(license, t))),
t1 AS (SELECT t, license, len(w) AS words, {grams} AS b FROM t0),
tg AS (SELECT t, g, min(i) AS place FROM (SELECT t, unnest(b) AS g, generate_subscripts(b, 1) - 1 AS i FROM t1) GROUP BY t, g),
tn AS (SELECT t, license, words, count(*) AS n, ceil(count(*) * {least} / (2 - {least})) AS fewest, greatest(1, words // {licenses.SPAN}) AS width FROM t1 JOIN tg USING (t) GROUP BY t, license, words),
d0 AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT doc_id, unnest(b) AS g, generate_subscripts(b, 1) - 1 AS i FROM (SELECT doc_id, {grams} AS b FROM d0 WHERE len(w) > 0)),
hit AS (SELECT doc_id, t, g, i - place AS s FROM d JOIN tg USING (g)),
cand AS (SELECT doc_id, t FROM hit JOIN tn USING (t) GROUP BY doc_id, t, fewest HAVING count(DISTINCT g) >= fewest),
starts AS (SELECT doc_id, t, floor(s / width) AS bin, s, count(*) AS c FROM hit JOIN cand USING (doc_id, t) JOIN tn USING (t) GROUP BY ALL),
bins AS (SELECT doc_id, t, bin, arg_min(s, (-c, s)) AS s FROM starts JOIN tn USING (t) GROUP BY doc_id, t, bin, n HAVING sum(c) >= {licenses.VOTES} * n),
win AS (SELECT doc_id, t, bin, license, n, greatest(s, 0) AS a, greatest(1, words - 1 - (greatest(s, 0) - s)) AS size FROM bins JOIN tn USING (t)),
like_ AS (SELECT win.doc_id, win.t, bin, license, 2 * count(DISTINCT tg.g) / (count(DISTINCT d.g) + n) AS dice FROM win JOIN d ON d.doc_id = win.doc_id AND i >= a AND i < a + size LEFT JOIN tg ON tg.t = win.t AND tg.g = d.g GROUP BY win.doc_id, win.t, bin, license, n),
best AS (SELECT doc_id, count(*) AS n_matches, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM like_ WHERE dice >= {least} GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, coalesce(dice, 0.0)::DOUBLE AS dice FROM documents LEFT JOIN best USING (doc_id)
"""


def _op5() -> str:
    rules = quality_rules.CUTOFFS
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cs in rules.items() for i, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules) + " END"
    p = quality_rules.RISK / len(rules)
    return f"""
WITH w AS (SELECT doc_id, lang, text, CASE WHEN trim(text, e' \\t\\n\\x0b\\x0c\\r') = '' THEN []::VARCHAR[] ELSE string_split_regex(trim(text, e' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]+') END AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY 1),
m AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share, n_upper / greatest(n_letters, 1) AS upper_share,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM m),
g AS (SELECT * FROM (VALUES {grid}) x(rule, place, cutoff)),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1),
held AS (SELECT lang, rule, place, cutoff, quality > 0 AS good, {value} > cutoff AS over FROM v JOIN lab USING (doc_id), g WHERE NOT base_failed),
counts AS (SELECT lang, rule, place, cutoff, count_if(good)::BIGINT AS n, count_if(good AND over)::BIGINT AS k, count_if(NOT good AND over)::BIGINT AS caught FROM held GROUP BY ALL),
tested AS (SELECT *, (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM unnest(generate_series(0, k)) s(i)) <= {quality_rules.MISS / len(rules)} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM counts)) AND k <= n * {p} AS passed FROM counts),
run AS (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY place) AS upto, caught - {quality_rules.PRICE} * k AS gain FROM tested),
best AS (SELECT lang, rule, arg_min(cutoff, (-gain, place)) AS cutoff FROM run WHERE upto AND gain > 0 GROUP BY 1, 2),
broken AS (SELECT DISTINCT v.doc_id FROM v JOIN best ON best.lang IS NOT DISTINCT FROM v.lang WHERE {value} > best.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": _OP1, "op4_license_scan": _op4(), "op5_quality_rules": _op5(), "op11_vector_codes": oracles.vector_codes()}
