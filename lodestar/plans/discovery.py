"""Queries on estimates, vocabularies, ranking, post-filters, staged text, sentences and more streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text as T
from lodestar.plans import parsing
from lodestar.plans.binding import Catalog
from lodestar.plans.queries import col, count, inline, query
from lodestar.sources import listings, sinks
from lodestar.sources.shared import kept


@query("""WITH {S}, u AS (SELECT * FROM (VALUES ('old world', 'asia'), ('old world', 'europe'), ('old world', 'africa'), ('new world', 'america')) t(term, child))
 SELECT term, count(*) AS n FROM u JOIN samples ON source_database = child GROUP BY 1""")
def onto_umbrella(k: Catalog) -> DataFrame:
    children = inline(k, "term string, source_database string", [("old world", "asia"), ("old world", "europe"), ("old world", "africa"), ("new world", "america")])
    per = k.samples().groupBy("source_database").agg(count())  # one row per source
    return children.join(per, "source_database").groupBy("term").agg(F.sum("n").alias("n"))


_ESTIMATE = """WITH {S}, h AS (SELECT count_if(tissue_standard IN ('1-URGENT', '2-HIGH'))::DOUBLE / count(*) AS a, count_if(disease_category = 'F')::DOUBLE / count(*) AS b, count(*) AS n FROM samples), e AS (SELECT greatest(1, floor(n * (a * b)))::BIGINT AS estimate FROM h)"""


@query(_ESTIMATE + """ SELECT estimate, CASE WHEN estimate > 100000 THEN 20 WHEN estimate > 10000 THEN 50 WHEN estimate > 1000 THEN 100
  ELSE 200 END AS suggested, estimate >= 5000 AS warn FROM e""")
def cardinality_est(k: Catalog) -> DataFrame:
    # Shares of a field's values add up, fields multiply as if independent.
    n = F.count(F.lit(1))
    share = lambda p: F.count_if(p).cast("double") / n
    product = share(col("tissue_standard").isin("1-URGENT", "2-HIGH")) * share(col("disease_category") == "F")
    x = k.samples().agg(F.greatest(F.lit(1).cast("long"), F.floor(n * product)).alias("estimate"))
    return x.select("estimate", F.when(col("estimate") > 100000, 20).when(col("estimate") > 10000, 50).when(col("estimate") > 1000, 100).otherwise(200).alias("suggested"), (col("estimate") >= 5000).alias("warn"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1),
 s AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS mean FROM l), tf AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN ('the', 'that', 'which')
  GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 z AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS x
  FROM tf JOIN df USING (token) JOIN l USING (doc_id), s GROUP BY 1)
 SELECT doc_id, round(x, 6) AS score FROM z ORDER BY score DESC, doc_id LIMIT 20""")
def fts_bm25_top(k: Catalog) -> DataFrame:
    # BM25 with k1 = 1.2, b = 0.75. Lengths and term counts come from one scan, without exploding the texts; they are written,
    # since conditions and orders on a score would cut the texts into words again, once for each place that it is used in.
    terms = ("the", "that", "which")
    x = k.table("documents").select("doc_id", T.tokens(col("text")).alias("w"))
    x = x.select("doc_id", F.size("w").alias("dl"), *[(F.size("w") - F.size(F.array_remove("w", q))).alias(f"tf{i}") for i, q in enumerate(terms)])
    x = kept(x, "counted").filter("dl > 0")
    s = x.agg(count(), (F.sum("dl") / F.count("*")).alias("mean"), *[F.count_if(col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()  # one row of totals
    length = 1.2 * (0.25 + 0.75 * col("dl") / F.lit(s.mean))
    parts = [F.log(1 + (F.lit(s.n) - F.lit(s[f"df{i}"]) + 0.5) / (F.lit(s[f"df{i}"]) + 0.5)) * col(f"tf{i}") * 2.2 / (col(f"tf{i}") + length) for i in range(len(terms))]
    return x.select("doc_id", F.round(sum(parts[1:], parts[0]), 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("""SELECT event_type AS pattern, count(*) AS n, max(value) AS slowest FROM events GROUP BY 1 HAVING sum(value::DECIMAL(18,2))::DOUBLE / count(*) > 10
  ORDER BY slowest DESC, pattern LIMIT 10""")
def slow_queries(k: Catalog) -> DataFrame:
    x = k.table("events").groupBy(col("event_type").alias("pattern")).agg(count(), F.max("value").alias("slowest"), (F.sum(col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"))
    return x.filter("mean > 10").drop("mean").orderBy(F.desc("slowest"), "pattern").limit(10)


@query("""WITH {S} SELECT 'SEARCH' || CASE WHEN tissue_standard IS NOT NULL THEN '+tissue' ELSE '' END || CASE WHEN n_cells > 200000 THEN '+cells'
  ELSE '' END AS pattern, count(*) AS n FROM samples GROUP BY 1""")
def group_pattern(k: Catalog) -> DataFrame:
    parts = F.concat_ws("+", F.lit("SEARCH"), F.when(col("tissue_standard").isNotNull(), "tissue"), F.when(col("n_cells") > 200000, "cells"))
    return k.samples().groupBy(parts.alias("pattern")).agg(count())


_FIELDS = {"tissue_standard": {"urgent": ["1-URGENT"], "high": ["2-HIGH"], "low priority": ["5-LOW"]}, "disease_category": {"finished": ["F"], "open": ["O"]}, "source_database": {s: [s] for s in ("asia", "europe", "africa", "america")}}


@query("""WITH {S} SELECT source_database, count(*) AS n FROM samples WHERE tissue_standard IN ('1-URGENT', '2-HIGH') AND (disease_category IS NULL
  OR disease_category NOT IN ('O')) AND n_cells >= 10000 AND year(publication_date) <= 1997 GROUP BY 1 ORDER BY n DESC, source_database LIMIT 20""")
def nl_query_rule(k: Catalog) -> DataFrame:
    q = parsing.parse("Which source has the most urgent or high orders, not open, with at least 10k cells before 1998?", _FIELDS, {"source": "source_database"})
    x = k.samples().filter(parsing.predicate(q, "n_cells", "publication_date"))
    return x.groupBy(q.group_by).agg(count()).orderBy(F.desc("n"), q.group_by).limit(20)
