"""Named queries over the bound catalog, each with SQL of its own that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import facets, fusion
from lodestar.operators import predicates as P
from lodestar.plans.binding import Catalog
from lodestar.sources.shared import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col = F.col

SAMPLES = """samples AS (SELECT o.o_orderkey AS pk, o.o_custkey AS project_pk, s.series_pk, lower(r.r_name) AS source_database, o.o_orderpriority AS tissue,
 NULLIF(o.o_orderpriority, '4-NOT SPECIFIED') AS tissue_standard, o.o_orderstatus AS disease_category, CASE WHEN s.series_pk IS NULL THEN NULL
  ELSE o.o_totalprice END AS n_cells, o.o_orderdate AS publication_date
 FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS series_pk FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey)"""


def query(sql: str | None = None):
    """Register a function of a Catalog under its name; `{S}` in the SQL is the samples view."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("{S}", SAMPLES)
        return f

    return add


def count(c: str = "n") -> Column:
    return F.count("*").alias(c)


def inline(k: Catalog, schema: str, rows: list[tuple]) -> DataFrame:
    return k.spark.createDataFrame(rows, schema)


# Explore: page, total, facets


@query("""WITH {S} SELECT s.pk, s.source_database, s.tissue_standard, s.disease_category, s.n_cells, p.p_name AS series_title, c.c_name AS project_id FROM samples s
 LEFT JOIN part p ON s.series_pk = p.p_partkey LEFT JOIN customer c ON s.project_pk = c.c_custkey
 WHERE s.disease_category IN ('F', 'O') AND s.n_cells >= 100000 ORDER BY s.n_cells DESC NULLS LAST, s.pk LIMIT 50 OFFSET 50""")
def explore_page(k: Catalog) -> DataFrame:
    # The sort keys are on the fact, so the page is cut before the dimensions are joined.
    page = k.samples().filter(col("disease_category").isin("F", "O") & (col("n_cells") >= 100000)).orderBy(F.desc_nulls_last("n_cells"), "pk").offset(50).limit(50)
    x = page.join(k.series(), "series_pk", "left").join(k.projects(), "project_pk", "left")
    return x.select("pk", "source_database", "tissue_standard", "disease_category", "n_cells", col("title").alias("series_title"), "project_id")


@query("WITH {S} SELECT count(*) AS total FROM samples WHERE disease_category IN ('F', 'O') AND n_cells >= 100000")
def explore_total(k: Catalog) -> DataFrame:
    return k.samples().filter(col("disease_category").isin("F", "O") & (col("n_cells") >= 100000)).agg(count("total"))


_FACETS = {"tissue": "tissue_standard", "status": "disease_category", "source": "source_database"}


@query("""WITH {S}, f AS (SELECT *, coalesce(disease_category IN ('F', 'O'), false) AS fs, coalesce(source_database IN ('asia', 'europe'), false) AS fo, coalesce(tissue_standard IN ('1-URGENT', '2-HIGH'), false) AS ft, coalesce(n_cells >= 100000, false) AS fn FROM samples)
 SELECT 'status' AS facet, disease_category AS value, count(*) AS count FROM f WHERE fo AND ft AND fn GROUP BY 2
 UNION ALL SELECT 'source', source_database, count(*) FROM f WHERE fs AND ft AND fn GROUP BY 2
 UNION ALL SELECT 'tissue', tissue_standard, count(*) FROM f WHERE fs AND fo AND fn AND tissue_standard IS NOT NULL GROUP BY 2""")
def facet_self_excluding(k: Catalog) -> DataFrame:
    filters = {"status": col("disease_category").isin("F", "O"), "source": col("source_database").isin("asia", "europe"), "tissue": col("tissue_standard").isin("1-URGENT", "2-HIGH"), "cells": col("n_cells") >= 100000}
    return facets.self_excluding(k.samples(), _FACETS, filters)


@query("""WITH {S} SELECT 'tissue' AS facet, tissue_standard AS value, count(*) AS count FROM samples WHERE tissue_standard IS NOT NULL GROUP BY 2 UNION ALL
 SELECT 'status', disease_category, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'source', source_database, count(*) FROM samples GROUP BY 2""")
def facet_unfiltered(k: Catalog) -> DataFrame:
    return facets.unfiltered(k.samples(), _FACETS)


@query("""WITH v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || ' ' ELSE p_type END AS v FROM part),
 c AS (SELECT lower(trim(v)) AS norm, v, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY norm
  ORDER BY n DESC, v) AS i, sum(n) OVER (PARTITION BY norm) AS t FROM c)
 SELECT v AS value, t::BIGINT AS count FROM r WHERE i = 1""")
def facet_case_folded(k: Catalog) -> DataFrame:
    t = col("p_type")
    return facets.case_folded(k.table("part").select(F.when(col("p_partkey") % 3 == 0, F.upper(t)).when(col("p_partkey") % 3 == 1, F.concat(t, F.lit(" "))).otherwise(t).alias("v")), "v")


@query("SELECT CASE WHEN p_size >= 40 THEN 'h5ad' WHEN p_size >= 20 THEN 'rds' ELSE 'none' END AS format, count(*) AS count FROM part GROUP BY 1")
def facet_derived_format(k: Catalog) -> DataFrame:
    return k.series().groupBy(F.when(col("cell_count") >= 40, "h5ad").when(col("cell_count") >= 20, "rds").otherwise("none").alias("format")).agg(count("count"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def facet_year_desc(k: Catalog) -> DataFrame:
    return k.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(count("count")).orderBy(F.desc("year")).limit(5)


# Filters


def _pks(k: Catalog, p: Column) -> DataFrame:
    return k.samples().filter(p).select("pk", "tissue_standard")


@query("SELECT c_custkey AS project_pk FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def filter_in_ci(k: Catalog) -> DataFrame:
    return k.projects().filter(P.folded_in("category", [" building ", "MACHINERY"])).select("project_pk")


@query("SELECT c_custkey AS project_pk FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_canonical_in(k: Catalog) -> DataFrame:
    vocabulary = [r[0] for r in k.projects().groupBy("category").count().orderBy(F.desc("count"), "category").limit(800).select("category").collect()]
    return k.projects().filter(P.canonical_in("category", [" building ", "Machinery"], vocabulary)).select("project_pk")


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE tissue_standard ILIKE '%urg%' OR tissue_standard ILIKE '%LOW%'")
def filter_like_any(k: Catalog) -> DataFrame:
    return _pks(k, P.like_any("tissue_standard", ["urg", "LOW"]))


@query("""WITH {S} SELECT pk, tissue_standard FROM samples WHERE (tissue_standard IS NULL OR tissue_standard NOT ILIKE '%urg%') AND (tissue_standard IS NULL
  OR tissue_standard NOT ILIKE '%high%')""")
def filter_not_like_null_safe(k: Catalog) -> DataFrame:
    return _pks(k, P.not_like("tissue_standard", ["urg", "high"]))


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE tissue_standard NOT IN ('1-URGENT')")
def filter_not_in_null_dropping(k: Catalog) -> DataFrame:
    return _pks(k, P.not_in("tissue_standard", ["1-URGENT"], keep_null=False))


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE tissue_standard IS NULL OR tissue_standard <> '1-URGENT'")
def filter_not_in_tolerant(k: Catalog) -> DataFrame:
    return _pks(k, P.not_in("tissue_standard", ["1-URGENT"], keep_null=True))


_VOCABULARY = {"urgent": ["1-URGENT", "2-HIGH"], "routine": ["3-MEDIUM", "5-LOW"]}


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE tissue_standard = '1-URGENT' OR tissue ILIKE '%not spec%'")
def filter_tiered_vocab(k: Catalog) -> DataFrame:
    return _pks(k, P.keyword("tissue_standard", "tissue", ["Urgent", "not spec"], _VOCABULARY, excluded=["2-HIGH"]))


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE tissue_standard IN ('3-MEDIUM', '5-LOW')")
def filter_rollup(k: Catalog) -> DataFrame:
    return _pks(k, P.keyword("tissue_standard", "tissue", ["routine"], _VOCABULARY, strict=True))


@query("SELECT p_partkey AS series_pk FROM part WHERE p_type ILIKE '%eco%' OR p_brand ILIKE '%eco%' OR p_type ILIKE '%#1%' OR p_brand ILIKE '%#1%'")
def filter_token_widening(k: Catalog) -> DataFrame:
    return k.series().filter(P.like_any("assay", ["eco", "#1"]) | P.like_any("platform", ["eco", "#1"])).select("series_pk")


@query("""SELECT o_orderkey AS pk FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS hi FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
 WHERE hi >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-04-30'""")
def filter_range_overlap(k: Catalog) -> DataFrame:
    hi = k.table("lineitem").groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("hi"))
    x = k.table("orders").select("o_orderkey", "o_orderdate").join(hi, "o_orderkey")
    return x.filter(P.overlaps("o_orderdate", "hi", F.expr("TIMESTAMP_NTZ '1997-03-01'"), F.expr("TIMESTAMP_NTZ '1997-04-30'"))).select(col("o_orderkey").alias("pk"))


@query("SELECT o_orderkey AS pk FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def filter_temporal(k: Catalog) -> DataFrame:
    d = F.to_date("o_orderdate")
    return k.table("orders").filter((d >= F.lit("1998-01-01").cast("date")) & (d <= F.lit("1998-12-31").cast("date"))).select(col("o_orderkey").alias("pk"))


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE n_cells IS NOT NULL AND tissue_standard IS NOT NULL AND tissue_standard <> ''")
def filter_presence(k: Catalog) -> DataFrame:
    return _pks(k, P.present("tissue_standard") & P.present("n_cells"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 0")
def filter_tristate(k: Catalog) -> DataFrame:
    x = k.table("documents").select("doc_id").join(k.table("labels").select("doc_id", (col("quality") == 1).alias("good")), "doc_id", "left")
    return x.filter(P.flag("good", False)).select("doc_id")


@query("""WITH {S} SELECT s.pk, s.tissue_standard FROM samples s LEFT JOIN part p ON p.p_partkey = s.series_pk WHERE s.tissue ILIKE '%green%' OR p.p_name ILIKE '%green%'""")
def filter_freetext_fallback(k: Catalog) -> DataFrame:
    x = k.samples().join(k.series().select("series_pk", "title"), "series_pk", "left")
    return x.filter(P.like_any("tissue", ["green"]) | P.like_any("title", ["green"])).select("pk", "tissue_standard")


@query("WITH {S} SELECT pk, tissue_standard FROM samples WHERE 1 = 0")
def filter_safety_empty(k: Catalog) -> DataFrame:
    return _pks(k, F.lit(False))


# Joins


@query("WITH {S} SELECT pk FROM samples WHERE series_pk IN (SELECT p_partkey FROM part WHERE p_size >= 25)")
def semi_join_dim(k: Catalog) -> DataFrame:
    return k.samples().join(k.series().filter("cell_count >= 25"), "series_pk", "left_semi").select("pk")


@query("WITH {S} SELECT pk FROM samples WHERE series_pk IS NULL OR series_pk NOT IN (SELECT p_partkey FROM part WHERE p_size >= 25)")
def anti_join_null_fk(k: Catalog) -> DataFrame:
    return k.samples().join(k.series().filter("cell_count >= 25"), "series_pk", "left_anti").select("pk")


@query("""SELECT o_orderkey AS pk FROM orders o WHERE o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def exists_or_parent(k: Catalog) -> DataFrame:
    hit = k.celltypes().filter("name = 'R'").select(col("sample_pk").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return k.table("orders").select("o_orderkey", "o_orderstatus").join(hit, "o_orderkey", "left").filter("o_orderstatus = 'F' or hit").select(col("o_orderkey").alias("pk"))


_LINKS = "links AS (SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS a, doc_id AS b FROM documents) WHERE a IS NOT NULL)"


@query(f"WITH {_LINKS} SELECT a AS doc_id, b AS linked_id FROM links UNION SELECT b, a FROM links")
def links_bidirectional(k: Catalog) -> DataFrame:
    x = k.links()
    return x.select(col("a").alias("doc_id"), col("b").alias("linked_id")).union(x.select(col("b"), col("a"))).distinct()


@query(f"WITH {_LINKS}, b AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links) SELECT y AS linked_id, min(x) AS first_from, count(*) AS n FROM b GROUP BY 1")
def crosslinks_dedup(k: Catalog) -> DataFrame:
    return links_bidirectional(k).groupBy("linked_id").agg(F.min("doc_id").alias("first_from"), count())


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY md5(text)) AS label FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def components(k: Catalog) -> DataFrame:
    return fusion.connected(k.links())


@query("""SELECT coalesce(a.nk, b.nk)::INTEGER AS nation, coalesce(a.n, 0) AS projects, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS nk, count(*) AS n
  FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a
 FULL OUTER JOIN (SELECT s_nationkey AS nk, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.nk = b.nk""")
def stats_sources_full_outer(k: Catalog) -> DataFrame:
    a = k.table("customer").filter("c_acctbal > 5000").groupBy(col("c_nationkey").alias("nation")).agg(count("projects"))
    b = k.table("supplier").filter("s_acctbal > 5000").groupBy(col("s_nationkey").alias("nation")).agg(count("suppliers"))
    return a.join(b, "nation", "full_outer").select("nation", F.coalesce("projects", F.lit(0).cast("long")).alias("projects"), F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
 SELECT l_orderkey AS sample_pk, l_partkey AS part, n AS true_count FROM r WHERE i <= 2""")
def context_capped(k: Catalog) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    x = k.table("lineitem").select("*", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("i"), F.count("*").over(w).alias("true_count"))
    return x.filter("i <= 2").select(col("l_orderkey").alias("sample_pk"), col("l_partkey").alias("part"), "true_count")


# Aggregations and statistics


def _cents(c: str) -> Column:
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


@query("WITH {S} SELECT tissue_standard AS value, count(*) AS count, coalesce(sum(n_cells::DECIMAL(18,2)), 0)::DOUBLE AS total_cells FROM samples GROUP BY 1")
def stats_group_null_bucket(k: Catalog) -> DataFrame:
    return k.samples().groupBy(col("tissue_standard").alias("value")).agg(count("count"), F.coalesce(_cents("n_cells"), F.lit(0.0)).alias("total_cells"))


@query("""SELECT p_type AS assay, p_brand AS platform, count(*) AS n, min(p_size) AS least, max(p_size) AS most, string_agg(DISTINCT p_size::VARCHAR, ','
  ORDER BY p_size::VARCHAR) AS sizes FROM part
 GROUP BY 1, 2 HAVING count(*) >= 12 ORDER BY n DESC, assay, platform LIMIT 40""")
def agg_multi_having(k: Catalog) -> DataFrame:
    sizes = F.array_join(F.array_sort(F.collect_set(col("cell_count").cast("string"))), ",").alias("sizes")
    x = k.series().groupBy("assay", "platform").agg(count(), F.min("cell_count").alias("least"), F.max("cell_count").alias("most"), sizes).filter("n >= 12")
    return x.orderBy(F.desc("n"), "assay", "platform").limit(40)


@query("""WITH {S} SELECT tissue_standard AS value, count(*) AS n FROM samples WHERE tissue_standard IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 3""")
def agg_distribution(k: Catalog) -> DataFrame:
    return k.samples().filter("tissue_standard is not null").groupBy(col("tissue_standard").alias("value")).agg(count()).filter("n >= 2").orderBy(F.desc("n"), "value").limit(3)


@query("""WITH {S} SELECT source_database, disease_category, count(*) AS n, round((sum(n_cells::DECIMAL(18,2))::DOUBLE / count(n_cells)), 4) AS mean_cells FROM samples GROUP BY 1, 2""")
def agg_cross(k: Catalog) -> DataFrame:
    return k.samples().groupBy("source_database", "disease_category").agg(count(), F.round(_cents("n_cells") / F.count("n_cells"), 4).alias("mean_cells"))


@query("SELECT p_type AS assay, count(DISTINCT p_brand) AS platforms, count(DISTINCT p_name) AS titles, max(p_partkey) AS last FROM part GROUP BY 1")
def agg_distinct_multi(k: Catalog) -> DataFrame:
    return k.series().groupBy("assay").agg(F.countDistinct("platform").alias("platforms"), F.countDistinct("title").alias("titles"), F.max("series_pk").alias("last"))


@query("""WITH {S} SELECT count(*) AS total, count(tissue_standard) AS annotated, round_even(100.0 * count(tissue_standard) / count(*), 1)::DOUBLE AS coverage FROM samples""")
def agg_coverage(k: Catalog) -> DataFrame:
    return k.samples().agg(count("total"), F.count("tissue_standard").alias("annotated")).withColumn("coverage", F.bround(100.0 * col("annotated") / col("total"), 1).cast("double"))


@query("""WITH {S} SELECT 'tissue_standard' AS "column", count(*) AS total, count(tissue_standard) AS non_null, count(DISTINCT tissue_standard) AS distinct_values, round_even(100.0::DOUBLE * (count(*) - count(tissue_standard)) / count(*), 2) AS null_pct, count(DISTINCT tissue_standard) / count(*) AS selectivity FROM samples
 UNION ALL SELECT 'series_pk', count(*), count(series_pk), count(DISTINCT series_pk), round_even(100.0::DOUBLE * (count(*) - count(series_pk)) / count(*), 2), count(DISTINCT series_pk) / count(*) FROM samples""")
def field_profile(k: Catalog) -> DataFrame:
    return facets.profile(k.samples().select("tissue_standard", "series_pk"), ["tissue_standard", "series_pk"])


@query("""SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL
  SELECT 'types', count(DISTINCT p_type) FROM part UNION ALL SELECT 'largest', max(o_totalprice) FROM orders""")
def stats_overall_unpivot(k: Catalog) -> DataFrame:
    x = k.table("orders").agg(F.count("*").cast("double").alias("orders"), F.max("o_totalprice").alias("largest")).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), col(m).alias("value")) for m in ("orders", "largest")])).alias("x")).select("x.*")
    y = k.table("customer").select(F.lit("customers").alias("metric")).groupBy("metric").agg(F.count("*").cast("double").alias("value"))
    z = k.table("part").agg(F.countDistinct("p_type").cast("double").alias("value")).select(F.lit("types").alias("metric"), "value")
    return x.union(y).union(z)


@query("""WITH {S} SELECT source_database, count(*) AS samples, count_if(tissue_standard IS NOT NULL)::BIGINT AS with_tissue, count(DISTINCT project_pk) AS projects
  FROM samples GROUP BY 1""")
def stats_by_source(k: Catalog) -> DataFrame:
    return k.samples().groupBy("source_database").agg(count("samples"), F.count_if(col("tissue_standard").isNotNull()).alias("with_tissue"), F.countDistinct("project_pk").alias("projects"))


@query("""WITH {S} SELECT p_type AS assay, count(DISTINCT p_partkey) AS series, count(s.pk) AS samples FROM part LEFT JOIN samples s ON s.series_pk = p_partkey GROUP BY 1""")
def stats_by_assay(k: Catalog) -> DataFrame:
    per = k.samples().filter("series_pk is not null").groupBy("series_pk").agg(count())
    return k.series().join(per, "series_pk", "left").groupBy("assay").agg(count("series"), F.sum(F.coalesce("n", F.lit(0))).alias("samples"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y'), '^20[0-9]{2}$') GROUP BY 1")
def stats_by_year(k: Catalog) -> DataFrame:
    return k.table("orders").groupBy(F.substring(col("o_orderdate").cast("string"), 1, 4).alias("year")).agg(count()).filter(col("year").rlike("^20[0-9]{2}$"))


@query("""WITH {S}, t AS (SELECT s.*, c.c_name FROM samples s JOIN customer c ON c.c_custkey = s.project_pk WHERE lower(s.tissue) LIKE '%urgent%' OR lower(c.c_mktsegment) LIKE '%auto%')
 SELECT count(*) AS samples, count(DISTINCT project_pk) AS projects, min(source_database) AS source_database FROM t""")
def theme_counts(k: Catalog) -> DataFrame:
    x = k.samples().join(k.projects(), "project_pk").filter(F.lower("tissue").like("%urgent%") | F.lower("category").like("%auto%"))
    return x.agg(count("samples"), F.countDistinct("project_pk").alias("projects"), F.min("source_database").alias("source_database"))


@query("SELECT c_custkey AS project_pk, c_acctbal AS total_cells FROM customer WHERE c_acctbal IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20")
def trending_topk(k: Catalog) -> DataFrame:
    return k.projects().filter("total_cells is not null").select("project_pk", "total_cells").orderBy(F.desc("total_cells"), "project_pk").limit(20)


@query("SELECT p_type AS name, count(*) AS n FROM part WHERE p_type ILIKE '%e%' GROUP BY 1 HAVING count(*) >= 10 ORDER BY lower(p_type)")
def catalogue_search(k: Catalog) -> DataFrame:
    return k.series().filter(P.like_any("assay", ["e"])).groupBy(col("assay").alias("name")).agg(count()).filter("n >= 10").orderBy(F.lower("name"))


@query("""WITH {S} SELECT value, n FROM (SELECT tissue AS value, count(*) AS n FROM samples WHERE lower(trim(tissue)) NOT IN ('4-not specified') GROUP BY 1)
  ORDER BY n DESC, value LIMIT 15""")
def topn_excluding(k: Catalog) -> DataFrame:
    return k.table("orders").filter(~P.folded_in("o_orderpriority", ["4-not specified"])).groupBy(col("o_orderpriority").alias("value")).agg(count()).orderBy(F.desc("n"), "value").limit(15)


@query("""WITH {S} SELECT count_if(series_pk IS NOT NULL)::BIGINT AS with_series, count_if(tissue_standard IS NOT NULL AND tissue_standard <> '')::BIGINT AS with_tissue FROM samples""")
def availability_counts(k: Catalog) -> DataFrame:
    return k.samples().agg(F.count_if(P.present("series_pk")).alias("with_series"), F.count_if(P.present("tissue_standard")).alias("with_tissue"))


@query("""SELECT event_type AS model, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(round(value * 100)::BIGINT) * p / 1000000.0, 9)::DOUBLE AS cost
  FROM events JOIN (VALUES ('click', 3), ('view', 1), ('purchase', 15)) t(m, p) ON m = event_type GROUP BY 1, 2, p""")
def token_cost(k: Catalog) -> DataFrame:
    prices = inline(k, "model string, p int", [("click", 3), ("view", 1), ("purchase", 15)])
    x = k.table("events").select(col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round(col("value") * 100).cast("long").alias("tokens")).join(F.broadcast(prices), "model")
    return x.groupBy("model", "day", "p").agg(count("calls"), F.sum("tokens").alias("t")).select("model", "day", "calls", F.round(col("t") * col("p") / 1000000.0, 9).cast("double").alias("cost"))


# Windows, set operations, planning


@query("""WITH {S}, r AS (SELECT pk, source_database, row_number() OVER (PARTITION BY source_database ORDER BY pk) AS i FROM samples WHERE disease_category = 'F')
  SELECT pk, source_database FROM r WHERE i <= 40""")
def stratified_union(k: Catalog) -> DataFrame:
    x = k.samples().filter("disease_category = 'F'")
    return x.withColumn("i", F.row_number().over(Window.partitionBy("source_database").orderBy("pk"))).filter("i <= 40").select("pk", "source_database")


@query("""WITH {S}, r AS (SELECT pk, source_database, row_number() OVER (PARTITION BY source_database
  ORDER BY pk) AS turn, min(pk) OVER (PARTITION BY source_database) AS first FROM samples) SELECT pk, source_database, turn::INTEGER AS turn FROM r ORDER BY r.turn, first LIMIT 100""")
def round_robin(k: Catalog) -> DataFrame:
    return fusion.round_robin(k.samples().select("pk", "source_database"), "source_database", "pk", 100).select("pk", "source_database", "turn")


@query("""SELECT year, n, sum(n) OVER (ORDER BY year)::BIGINT AS cumulative, n / sum(n) OVER () AS share FROM (SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n
  FROM orders GROUP BY 1)""")
def cumulative_growth(k: Catalog) -> DataFrame:
    x = k.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(count())  # one row per year
    return x.select("*", F.sum("n").over(Window.orderBy("year")).alias("cumulative"), (col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("SELECT p_name AS value, count(*) AS n FROM part WHERE p_name ILIKE 'a%' OR p_name ILIKE 'b%' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def autocomplete_prefix(k: Catalog) -> DataFrame:
    return k.series().filter(col("title").ilike("a%") | col("title").ilike("b%")).groupBy(col("title").alias("value")).agg(count()).orderBy(F.desc("n"), "value").limit(10)


@query("""WITH {S}, h AS (SELECT tissue_standard AS v, count(*) AS n FROM samples GROUP BY 1), t AS (SELECT count(*) AS total FROM samples)
  SELECT v AS value, n / total AS selectivity, greatest(1, floor(total * (n / total)))::BIGINT AS rows FROM h, t WHERE v IS NOT NULL""")
def selectivity_est(k: Catalog) -> DataFrame:
    total = k.table("orders").count()
    s = col("n") / F.lit(total)
    return k.samples().filter("tissue_standard is not null").groupBy(col("tissue_standard").alias("value")).agg(count()).select("value", s.alias("selectivity"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(total) * s)).alias("rows"))


@query("""WITH {S}, c AS (SELECT count(*) AS none FROM samples WHERE tissue_standard = 'urgent'), z AS (SELECT pk, source_database FROM samples, c WHERE (none > 0
  AND tissue_standard = 'urgent') OR (none = 0 AND tissue_standard ILIKE '%urgent%')) SELECT * FROM z""")
def fuzzy_fallback(k: Catalog) -> DataFrame:
    # The strict candidate first; only if it is empty its relaxed form; an empty result stays empty.
    strict = k.samples().filter(col("tissue_standard").isin("urgent"))
    return (k.samples().filter(P.relaxed("tissue_standard", ["urgent"])) if strict.isEmpty() else strict).select("pk", "source_database")


@query("""WITH {S}, f AS (SELECT coalesce(disease_category = 'P', false) AS a, coalesce(source_database = 'africa', false) AS b, coalesce(n_cells >= 400000, false) AS c FROM samples)
 SELECT 'status' AS dropped, count_if(b AND c)::BIGINT AS n FROM f UNION ALL SELECT 'source', count_if(a AND c)::BIGINT FROM f UNION ALL SELECT 'cells', count_if(a AND b)::BIGINT FROM f""")
def broaden_counts(k: Catalog) -> DataFrame:
    filters = {"status": col("disease_category") == "P", "source": col("source_database") == "africa", "cells": col("n_cells") >= 400000}
    x = k.samples().agg(*[F.count_if(P.all_of([F.coalesce(p, F.lit(False)) for f, p in filters.items() if f != name])).alias(name) for name in filters])
    return x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dropped"), col(n).alias("n")) for n in filters])).alias("x")).select("x.*")


# Fusion, mirrors, ranking


@query("""WITH r AS (SELECT doc_id, source, md5(text) AS h, row_number() OVER (PARTITION BY md5(text), source ORDER BY doc_id) AS i FROM documents)
 SELECT min(doc_id) AS first_id, count(*) AS records_merged, count(DISTINCT source) AS source_count FROM r GROUP BY h, i""")
def fuse_hash_merge(k: Catalog) -> DataFrame:
    x = fusion.merge_keys(k.table("documents").select("doc_id", "source", F.md5("text").alias("h")), "h", "source", "doc_id")
    return x.groupBy("h", "group_no").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("records_merged"), F.countDistinct("source").alias("source_count")).drop("h", "group_no")


@query("""SELECT md5(text) AS h, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, max(n_chars) AS n_chars, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1""")
def fuse_aggregate(k: Catalog) -> DataFrame:
    d = k.table("documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("h"))
    return d.groupBy("h").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.max("n_chars").alias("n_chars"), F.min_by("lang", "doc_id").alias("lang"))


@query("""WITH {S} SELECT pk, CASE WHEN tissue_standard IS NULL THEN 'miss' WHEN tissue_standard = '1-URGENT' THEN 'match' WHEN tissue_standard ILIKE '%urg%'
  OR tissue_standard ILIKE '%high%' THEN 'partial' ELSE 'miss' END AS tissue FROM samples""")
def facet_match(k: Catalog) -> DataFrame:
    t = col("tissue_standard")
    return k.samples().select("pk", F.when(t == "1-URGENT", "match").when(F.coalesce(P.like_any("tissue_standard", ["urg", "high"]), F.lit(False)), "partial").otherwise("miss").alias("tissue"))


_TOKENS = r"[a-zA-Z0-9\-]+"


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-zA-Z0-9\\-]+'), lambda x: len(x) > 1)) AS n, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-zA-Z0-9\\-]+'), lambda x: len(x) > 1)) AS d FROM part)
 SELECT p_partkey AS series_pk, round(3.0 * len(list_intersect(n, ['green', 'steel', 'promo'])) + len(list_intersect(d, ['green', 'steel', 'promo'])) + 0.001 * least(len(n) + len(d), 20), 6)::DOUBLE AS score FROM t""")
def rank_lexical(k: Catalog) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("green", "steel", "promo")])
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(_TOKENS), 0), lambda t: F.length(t) > 1))
    x = k.series().select("series_pk", tokens("title").alias("n"), tokens("assay").alias("d"))
    hit = lambda c: F.size(F.array_intersect(c, wanted))
    return x.select("series_pk", F.round(3.0 * hit("n") + hit("d") + 0.001 * F.least(F.size("n") + F.size("d"), F.lit(20)), 6).alias("score"))


# Full text and ontology


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'the')
  AND list_contains(w, 'that')""")
def fts_match_all(k: Catalog) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    return k.table("documents").select("doc_id", w.alias("w")).filter(F.array_contains("w", "the") & F.array_contains("w", "that")).select("doc_id")


_HIERARCHY = "edges AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {_HIERARCHY}, up(child, ancestor) AS (SELECT child, parent FROM edges UNION SELECT u.child, e.parent FROM up u JOIN edges e ON u.ancestor = e.child) SELECT ancestor, count(*) AS descendants FROM up GROUP BY 1")
def onto_closure(k: Catalog) -> DataFrame:
    edges = k.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    edges = edges.union(k.table("customer").select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    return closure(edges).groupBy("ancestor").agg(count("descendants"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor) over edges (child, parent): all ancestors of each node, once. Each round writes the pairs that are
    new in it alone; a cycle ends, as its pairs are known, and makes a node its own ancestor."""
    fresh = kept(edges.select("child", col("parent").alias("ancestor")).distinct(), "closure")
    rounds, up = [fresh], edges.select(col("child").alias("ancestor"), "parent")
    while True:  # as many rounds as the hierarchy is deep
        found = fresh.join(up, "ancestor").select("child", col("parent").alias("ancestor")).distinct()
        for known in rounds:
            found = found.join(known, ["child", "ancestor"], "left_anti")
        fresh = kept(found, "closure")
        if fresh.isEmpty():
            return reduce(DataFrame.union, rounds)
        rounds.append(fresh)


@query("""SELECT n_name AS term, count(*) AS sample_count FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = (SELECT r_regionkey FROM region
  WHERE r_name = 'ASIA') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def onto_children_expand(k: Catalog) -> DataFrame:
    children = k.table("region").filter("r_name = 'ASIA'").join(k.table("nation"), col("r_regionkey") == col("n_regionkey"))
    return children.join(k.table("customer"), col("c_nationkey") == col("n_nationkey")).groupBy(col("n_name").alias("term")).agg(count("sample_count")).orderBy(F.desc("sample_count"), "term").limit(20)


# Parsing, scalar functions, exports


@query("""SELECT p_partkey AS series_pk, '@misc{series' || p_partkey || ', title={' || p_name || '}, note={' || p_type || '}}' AS entry FROM part WHERE p_name <> ''""")
def export_bibtex(k: Catalog) -> DataFrame:
    return k.series().filter(P.present("title")).select("series_pk", F.format_string("@misc{series%d, title={%s}, note={%s}}", "series_pk", "title", "assay").alias("entry"))


#: Keys in a line of a manifest.
LINE = 1000


@query(f"""WITH r AS (SELECT o_custkey AS project_pk, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // {LINE} AS part FROM orders)
 SELECT project_pk, part, string_agg(o_orderkey::VARCHAR, chr(9) ORDER BY o_orderkey) AS line FROM r GROUP BY 1, 2""")
def manifest_tsv(k: Catalog) -> DataFrame:
    """Lines of at most so many keys; a project of more has several."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    x = k.table("orders").select(col("o_custkey").alias("project_pk"), "o_orderkey", F.floor(place / LINE).alias("part"))
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda o: o.cast("string"))
    return x.groupBy("project_pk", "part").agg(F.array_join(keys, "\t").alias("line"))


# Feedback, sessions, streams


@query("SELECT event_type AS pattern, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 6) AS mean FROM events GROUP BY 1")
def feedback_running_mean(k: Catalog) -> DataFrame:
    return k.table("events").groupBy(col("event_type").alias("pattern")).agg(count(), F.round(_cents("value") / F.count("*"), 6).alias("mean"))


@query("SELECT b.le, count_if(value <= b.le)::BIGINT AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (25.0), (100.0), (500.0)) b(le) GROUP BY 1")
def latency_histogram(k: Catalog) -> DataFrame:
    bounds = (1.0, 5.0, 25.0, 100.0, 500.0)
    x = k.table("events").agg(*[F.count_if(col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return x.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY n DESC, event_type) AS i FROM c) SELECT user_id, event_type, n FROM r WHERE i <= 2""")
def pattern_topk(k: Catalog) -> DataFrame:
    c = k.table("events").groupBy("user_id", "event_type").agg(count())
    return c.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("i <= 2").drop("i")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_limit_sliding(k: Catalog) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-60_000_000, 0)
    return k.table("events").withColumn("micros", F.unix_micros(col("ts").cast("timestamp"))).select("event_id", F.count("*").over(w).alias("in_window"))


_SESSIONS = """SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def sessions(k: Catalog) -> DataFrame:
    return k.table("events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(count()).select("user_id", "n")


@query("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_turns(k: Catalog) -> DataFrame:
    return k.table("conversations").groupBy("conv_id").agg(count("turns"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@query("""SELECT o_custkey AS project_pk, count(*) AS n FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' GROUP BY 1 ORDER BY n DESC, project_pk LIMIT 3""")
def theme_top_projects(k: Catalog) -> DataFrame:
    return k.table("orders").filter(F.lower("o_orderpriority").like("%urgent%")).groupBy(col("o_custkey").alias("project_pk")).agg(count()).orderBy(F.desc("n"), "project_pk").limit(3)
