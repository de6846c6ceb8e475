"""Queries on what a search gives: relaxed and dropped filters, lexical ranks, first names of a table, exports, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import filters as L
from lodestar.operators import ranking
from lodestar.plans.binding import Catalog, register_views
from lodestar.plans.queries import SAMPLES, query
from lodestar.plans.routing import A, annotated
from lodestar.sources import sinks
from lodestar.sources.shared import new_path

col, lit = F.col, F.lit


@query(f"""WITH {A}, s AS (SELECT count(*) AS n FROM a WHERE disease IN ('Bolt', 'widget') AND tissue IN ('urgent') AND n_cells >= 100000 AND coalesce(sex_normalized NOT IN ('male'), true))
 SELECT pk, 'relaxed' AS how FROM a, s WHERE n = 0 AND (disease ILIKE '%bolt%' OR disease ILIKE '%widget%') AND tissue ILIKE '%urgent%' AND n_cells >= 100000
  AND coalesce(sex_normalized NOT IN ('male'), true)""")
def filter_relaxed(k: Catalog) -> DataFrame:
    """Strict filters on four fields find nothing; equalities with text are relaxed, bounds and exclusions are not."""
    asked = [L.Filter("disease", "disease", "in", ("Bolt", "widget")), L.Filter("tissue", "tissue", "in", ("urgent",)), L.Filter("cells", "n_cells", ">=", (100000,)), L.Filter("sex", "sex_normalized", "not in", ("male",))]
    x, how = L.found(annotated(k), asked)
    return x.select("pk", lit(how).alias("how"))


@query(f"""WITH {A}, f AS (SELECT coalesce(cell_type IN ('no such'), false) AS c, coalesce(disease IN ('red bolt', 'hot gear'), false) AS d, coalesce(tissue IN ('1-URGENT'), false) AS t, coalesce(organism_common IN ('asia'), false) AS o, coalesce(n_cells >= 10, false) AS n FROM a),
 z AS (SELECT 'cell type' AS dropped, 'no such' AS was, count_if(d AND t AND o AND n)::BIGINT AS n FROM f UNION ALL SELECT 'disease', 'red bolt, hot gear', count_if(c
  AND t AND o AND n)::BIGINT FROM f UNION ALL SELECT 'tissue', '1-URGENT', count_if(c AND d AND o AND n)::BIGINT FROM f)
 SELECT * FROM z WHERE n > 0""")
def broaden_suggestions(k: Catalog) -> DataFrame:
    """Of five filters that find nothing together the three that may be dropped first; the organism never is."""
    asked = [L.Filter("organism", "organism_common", "in", ("asia",)), L.Filter("tissue", "tissue", "in", ("1-URGENT",)), L.Filter("cells", "n_cells", ">=", (10,)), L.Filter("disease", "disease", "in", ("red bolt", "hot gear")), L.Filter("cell type", "cell_type", "in", ("no such",))]
    return L.broadened(annotated(k), asked, ["cell type", "assay", "disease", "tissue", "category", "cells"])


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-zA-Z0-9\\-]+'), lambda x: len(x) > 1))"


@query(f"""WITH p AS (SELECT p_partkey AS series_pk, {_WORDS.format("p_name")} AS t, {_WORDS.format("p_type || ' of ' || p_brand")} AS d
  FROM part), q AS (SELECT ['red', 'promo', 'bolt', 'of'] AS q)
 SELECT series_pk, round(3.0 * len(list_intersect(t, q)) + len(list_intersect(d, q)) + CASE WHEN list_has_all(list_concat(t, d), ['red', 'promo']) THEN 0.5
  ELSE 0 END + CASE WHEN list_has_all(list_concat(t, d), ['bolt']) THEN 0.5 ELSE 0 END
 + 0.001 * least(len(t), 20), 6)::DOUBLE AS score FROM p, q""")
def rank_lexical_categories(k: Catalog) -> DataFrame:
    """Words of the query in title and description, and terms of categories whose words are all there."""
    x = k.table("part").select(col("p_partkey").alias("series_pk"), col("p_name").alias("title"), F.concat("p_type", lit(" of "), "p_brand").alias("description"))
    return x.select("series_pk", F.round(ranking.lexical("Red PROMO bolt, of a", ["red promo", "Bolt", "!"], "title", "description"), 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey AS series_pk, lower(p_name) AS t FROM part) SELECT series_pk, contains(t, 'hot gear') OR contains(t, 'small cell')
  OR list_has_any(regexp_extract_all(t, '[a-z0-9-]+'), ['hot', 'gear']) AS said FROM p""")
def phrases_said(k: Catalog) -> DataFrame:
    """A phrase by its telling words: generic nouns count only within the whole phrase."""
    return k.series().select("series_pk", ranking.says(col("title"), ["Hot gear", "small cell", " "], ["small", "cell", "type"]).alias("said"))


#: Names with other words for them, in the order in which they are looked for.
KINDS = [("red bolt", ["crimson bolt"]), ("bolt", ["screw"]), ("small ring", []), ("ring", ["o ring"])]


@query("""WITH t AS (SELECT p_partkey AS id, replace(p_name, ' ', CASE p_size % 4 WHEN 0 THEN '-' WHEN 1 THEN '_' WHEN 2 THEN '' ELSE ' ' END) || CASE
  WHEN p_partkey % 7 = 0 THEN ' Screw' ELSE '' END AS t FROM part)
 SELECT id, CASE WHEN regexp_matches(t, '(?i)\\b(red[\\s_-]?bolt|crimson[\\s_-]?bolt)\\b') THEN 'red bolt' WHEN regexp_matches(t, '(?i)\\b(bolt|screw)\\b') THEN 'bolt'
  WHEN regexp_matches(t, '(?i)\\bsmall[\\s_-]?ring\\b') THEN 'small ring' WHEN regexp_matches(t, '(?i)\\b(ring|o[\\s_-]?ring)\\b') THEN 'ring' END AS name FROM t""")
def first_matches(k: Catalog) -> DataFrame:
    """The first name of an ordered table that a text has."""
    between = F.get(F.array(*map(lit, ("-", "_", "", " "))), (col("p_size") % 4).cast("int"))
    t = F.concat(F.replace("p_name", lit(" "), between), F.when(col("p_partkey") % 7 == 0, " Screw").otherwise(""))
    return k.table("part").select(col("p_partkey").alias("id"), T.first_named(t, KINDS).alias("name"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, p_type || '; ' || p_brand AS sources FROM part")
def export_csv(k: Catalog) -> DataFrame:
    """Results as CSV files with chosen fields, lists joined, read back."""
    at = new_path(k.spark, "csv")
    x = k.table("part").select(col("p_partkey").alias("id"), col("p_name").alias("title"), F.array("p_type", "p_brand").alias("sources"), "p_size")
    sinks.to_csv(x, at, fields=["id", "title", "none", "sources", "p_size"], excluded=["p_size"])
    return k.spark.read.option("header", True).csv(at)


@query("SELECT p_partkey AS id, p_name AS title, p_type AS sources, (SELECT count(*) FROM part) AS total_count, 'parts' AS summary FROM part")
def export_json(k: Catalog) -> DataFrame:
    """Results as JSON lines beside an envelope, read back."""
    at = new_path(k.spark, "json")
    x = k.table("part").select(col("p_partkey").alias("id"), col("p_name").alias("title"), F.array("p_type").alias("sources"))
    sinks.to_json(x, at, fields=["id", "title"], beside=("sources",), summary="parts")
    envelope = k.spark.read.schema("summary string, total_count long").json(f"{at}/envelope").first()  # one line
    rows = k.spark.read.schema("data struct<id: long, title: string>, sources array<string>").json(f"{at}/results")
    return rows.select("data.id", "data.title", F.array_join("sources", "; ").alias("sources"), lit(envelope.total_count).alias("total_count"), lit(envelope.summary).alias("summary"))


@query(f"""WITH {SAMPLES} SELECT source_database, count(*) AS samples, count(DISTINCT project_pk) AS projects, count(DISTINCT series_pk) AS series, round(sum(n_cells), 2) AS cells, round(avg(n_cells), 4) AS mean_cells,
 count(tissue_standard) AS with_tissue, count(disease_category) AS with_disease FROM samples WHERE source_database IS NOT NULL GROUP BY 1""")
def source_table(k: Catalog) -> DataFrame:
    """Statistics of each source, in SQL over the tiers' views."""
    _, _, samples, *_ = register_views(k, f"v{abs(hash(k.path)) % 10**9}_")
    return k.spark.sql(f"""SELECT source_database, count(*) AS samples, count(DISTINCT project_pk) AS projects, count(DISTINCT series_pk) AS series, round(sum(n_cells), 2) AS cells, round(avg(n_cells), 4) AS mean_cells,
 count(tissue_standard) AS with_tissue, count(disease_category) AS with_disease FROM {samples} WHERE source_database IS NOT NULL GROUP BY 1""")
