"""Queries of the explore filters that route users' words to curated columns, over an annotated samples view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import entities as E
from lodestar.operators import routing as R
from lodestar.plans.binding import Catalog
from lodestar.plans.queries import count, query

col = F.col

#: Samples with raw and curated annotations: raw text from the part's name, curated values from its type and brand.
A = """{S}, a AS (SELECT s.pk, s.project_pk, s.series_pk, s.source_database, s.tissue, s.n_cells, s.publication_date, p.p_name AS disease,
 CASE WHEN s.pk % 3 = 0 THEN NULL ELSE p.p_type END AS disease_standard, p.p_brand AS disease_category, CASE WHEN p.p_partkey % 2 = 0 THEN replace(p.p_name, ' ', '+ ')
  ELSE p.p_name END AS cell_type,
 n.n_name AS organism, CASE WHEN n.n_nationkey < 20 THEN s.source_database END AS organism_common, s.disease_category AS sex, CASE s.disease_category
  WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS sex_normalized,
 c.c_mktsegment AS sample_type, c.c_name AS cell_line_name, p.p_size - 20 AS age_min, p.p_size - 10 AS age_max, CASE WHEN p.p_partkey % 4 = 0 THEN 'week'
  WHEN p.p_partkey % 4 <> 1 THEN 'year' END AS age_unit
 FROM samples s LEFT JOIN part p ON s.series_pk = p.p_partkey LEFT JOIN customer c ON s.project_pk = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
DISEASES = R.Vocabulary(specific={"bolt": "bolt"}, category={"first brand": "Brand#1", "bolt": "Brand#2"}, standard={"bolt": "PROMO", "small goods": "SMALL"})


def annotated(k: Catalog) -> DataFrame:
    s = k.samples().withColumnRenamed("disease_category", "sex")
    p = k.table("part").withColumnRenamed("p_partkey", "series_pk")
    c = k.table("customer").join(F.broadcast(k.table("nation")), col("c_nationkey") == col("n_nationkey"), "left").withColumnRenamed("c_custkey", "project_pk")
    return s.join(p, "series_pk", "left").join(c, "project_pk", "left").select(
        "pk", "project_pk", "series_pk", "source_database", "tissue", "n_cells", "publication_date", col("p_name").alias("disease"), F.when(col("pk") % 3 != 0, col("p_type")).alias("disease_standard"),
        col("p_brand").alias("disease_category"), F.when(col("series_pk") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("+ "))).otherwise(col("p_name")).alias("cell_type"), col("n_name").alias("organism"),
        F.when(col("n_nationkey") < 20, col("source_database")).alias("organism_common"), "sex", F.when(col("sex") == "F", "female").when(col("sex") == "O", "male").alias("sex_normalized"),
        col("c_mktsegment").alias("sample_type"), col("c_name").alias("cell_line_name"), (col("p_size") - 20).alias("age_min"), (col("p_size") - 10).alias("age_max"),
        F.when(col("series_pk") % 4 == 0, "week").when(col("series_pk") % 4 != 1, "year").alias("age_unit"),
    )


def _where(k: Catalog, condition) -> DataFrame:
    return annotated(k).filter(condition).select("pk")


@query(f"WITH {A} SELECT pk FROM a WHERE disease_category IN ('Brand#1') OR disease_standard IN ('PROMO', 'SMALL') OR disease ILIKE '%bolt%' OR disease ILIKE '%gizmo%'")
def filter_disease_routed(k: Catalog) -> DataFrame:
    return _where(k, R.routed(["Bolt ", "first brand", "small goods", "gizmo"], DISEASES, "disease", "disease_category", "disease_standard"))


@query(f"WITH {A} SELECT pk FROM a WHERE disease ILIKE '%bolt%' OR disease ILIKE '%RED%'")
def filter_disease_strict(k: Catalog) -> DataFrame:
    return _where(k, R.routed(["bolt", "RED"], DISEASES, "disease", "disease_category", "disease_standard", strict=True))


@query(f"WITH {A} SELECT pk FROM a WHERE cell_type ILIKE '%small% ring%' OR cell_type ILIKE '%gear%' OR cell_type ILIKE '%cog%' OR tissue ILIKE '%urgent%' OR cell_type ILIKE '%urgent%'")
def filter_cell_type_widened(k: Catalog) -> DataFrame:
    return _where(k, R.widened(["small+ ring", "gear", "urgent"], "cell_type", {"gear": ["%gear%", "%cog%"]}, {"urgent": "tissue"}))


@query("""WITH {S}, m AS (SELECT p_partkey FROM part WHERE p_type ILIKE '%promo%' OR p_brand ILIKE '%promo%' OR p_type ILIKE '%promo v3%' OR p_brand ILIKE '%promo v3%'
  OR p_type ILIKE '%Brand#12%' OR p_brand ILIKE '%Brand#12%')
 SELECT pk FROM samples WHERE series_pk IN (SELECT p_partkey FROM m)""")
def filter_assay_widened(k: Catalog) -> DataFrame:
    return k.samples().join(k.series().filter(R.assay_matches(["PROMO v3", "Brand#12"])).select("series_pk"), "series_pk", "left_semi").select("pk")


@query("""WITH {S} SELECT pk FROM samples WHERE series_pk IS NULL OR series_pk NOT IN (SELECT p_partkey FROM part WHERE p_type ILIKE '%eco%' OR p_brand ILIKE '%eco%')""")
def filter_assay_excluded(k: Catalog) -> DataFrame:
    return k.samples().join(k.series().filter(R.assay_matches(["eco"])).select("series_pk"), "series_pk", "left_anti").select("pk")


@query("""SELECT p_partkey AS series_pk FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL
  ELSE p_brand END AS p FROM part)
 WHERE NOT (coalesce(a, '') ILIKE '%eco%' OR coalesce(p, '') ILIKE '%eco%' OR coalesce(a, '') ILIKE '%#1%' OR coalesce(p, '') ILIKE '%#1%')""")
def filter_assay_excluded_on_series(k: Catalog) -> DataFrame:
    gaps = k.series().withColumn("assay", F.when(col("series_pk") % 3 != 0, col("assay"))).withColumn("platform", F.when(col("series_pk") % 5 != 0, col("platform")))
    return gaps.filter(~R.assay_matches(["eco", "#1"], null_as_empty=True)).select("series_pk")


@query(f"WITH {A} SELECT pk FROM a WHERE organism_common IN ('asia') OR organism ILIKE '%nation_2%'")
def filter_organism(k: Catalog) -> DataFrame:
    return _where(k, R.organism_matches([" Asian ", "nation_2"], {"asian": "asia"}, "organism_common", "organism"))


@query(f"WITH {A} SELECT pk, 'normalized' AS by FROM a WHERE sex_normalized = 'female' UNION ALL SELECT pk, 'raw' FROM a WHERE sex = 'P'")
def filter_sex(k: Catalog) -> DataFrame:
    x = annotated(k)
    by = lambda v, name: x.filter(R.sex_is(v, "sex_normalized", "sex")).select("pk", F.lit(name).alias("by"))
    return by("female", "normalized").union(by("P", "raw"))


@query(f"WITH {A} SELECT pk FROM a WHERE sample_type IN ('BUILDING', 'MACHINERY') OR cell_line_name ILIKE '%00012%'")
def filter_sample_type(k: Catalog) -> DataFrame:
    return _where(k, R.sample_type_in(["BUILDING"], "sample_type", ("BUILDING", "MACHINERY"), "cell_line_name", "00012"))


@query("SELECT o_orderkey AS pk FROM orders WHERE substr(o_orderdate::VARCHAR, 1, 4) IN ('1996', '1999')")
def filter_year_in(k: Catalog) -> DataFrame:
    return k.table("orders").filter(F.substring(col("o_orderdate").cast("string"), 1, 4).isin("1996", "1999")).select(col("o_orderkey").alias("pk"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE source END AS doi FROM documents) SELECT doc_id FROM d
  WHERE doi IS NULL OR doi = ''""")
def filter_absence(k: Catalog) -> DataFrame:
    d = k.table("documents").select("doc_id", F.when(col("doc_id") % 4 == 0, "").when(col("doc_id") % 4 != 1, col("source")).alias("doi"))
    return d.filter(col("doi").isNull() | (col("doi") == "")).select("doc_id")


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS h FROM part)
  SELECT p_partkey AS series_pk, 'without, or unknown' AS kind FROM f WHERE h IS NULL OR h = 0
 UNION ALL SELECT p_partkey, 'known to be without' FROM f WHERE h = 0 UNION ALL SELECT p_partkey, 'with' FROM f WHERE h = 1""")
def filter_tristate_both(k: Catalog) -> DataFrame:
    """A flag that is false: NULL counts as false on the explore page and not in the engine."""
    f = k.series().select("series_pk", F.when(col("series_pk") % 3 == 1, 0).when(col("series_pk") % 3 == 2, 1).alias("h"))
    kinds = {"without, or unknown": F.coalesce(col("h"), F.lit(0)) == 0, "known to be without": col("h") == 0, "with": col("h") == 1}
    return f.select("series_pk", F.explode(F.array(*[F.when(c, F.lit(name)) for name, c in kinds.items()])).alias("kind")).filter("kind is not null")


@query(f"WITH {A} SELECT pk FROM a WHERE age_max >= 5 AND age_min <= 12 AND age_min IS NOT NULL AND age_max IS NOT NULL AND (age_unit = 'year' OR age_unit IS NULL)")
def filter_age_overlap(k: Catalog) -> DataFrame:
    return _where(k, (col("age_max") >= 5) & (col("age_min") <= 12) & (col("age_unit").isNull() | (col("age_unit") == "year")))


@query(f"WITH {A} SELECT pk, 'text alone' AS kind FROM a WHERE tissue ILIKE '%ring%' OR disease ILIKE '%ring%' UNION ALL SELECT pk, 'beside a filter' FROM a WHERE sex_normalized = 'male'")
def filter_freetext_only(k: Catalog) -> DataFrame:
    """Free text is looked for in raw columns only if no other filter was recognised."""
    x = annotated(k)

    def found(filters: list, text: str, kind: str) -> DataFrame:
        condition = filters[0] if filters else R.any_of([R.contains_any(c, [text]) for c in ("tissue", "disease")])
        return x.filter(condition).select("pk", F.lit(kind).alias("kind"))

    return found([], "ring", "text alone").union(found([col("sex_normalized") == "male"], "ring", "beside a filter"))


THEMES = {"moving parts": ([("disease", ["gear", "bolt", "rod"]), ("tissue", ["urgent", "high"])], True), "small or red": ([("disease", ["small", "red"]), ("disease_standard", ["small"])], False), "nothing": ([("disease", ["no such"])], True)}
_THEMES = f"""WITH {A}, t AS (SELECT 'moving parts' AS theme, * FROM a WHERE (disease ILIKE '%gear%' OR disease ILIKE '%bolt%' OR disease ILIKE '%rod%')
  AND (tissue ILIKE '%urgent%' OR tissue ILIKE '%high%')
 UNION ALL SELECT 'small or red', * FROM a WHERE disease ILIKE '%small%' OR disease ILIKE '%red%' OR disease_standard ILIKE '%small%')"""


@query(f"{_THEMES} SELECT theme, count(*) AS n, count(DISTINCT project_pk) AS projects FROM t GROUP BY 1")
def theme_all(k: Catalog) -> DataFrame:
    """Every saved theme in one pass over the samples."""
    tagged = _themed(k)
    return tagged.groupBy("theme").agg(count(), F.countDistinct("project_pk").alias("projects"))


def _themed(k: Catalog) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(R.theme(groups, together), F.lit(name)) for name, (groups, together) in THEMES.items()]))
    return annotated(k).select("pk", "project_pk", "source_database", F.explode(hits).alias("theme"))


@query(f"""{_THEMES}, c AS (SELECT theme, project_pk, min(source_database) AS source_database, count(*) AS n FROM t GROUP BY 1, 2)
 SELECT theme, project_pk, source_database, n, r FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, project_pk) AS r FROM c) WHERE r <= 3""")
def theme_top3(k: Catalog) -> DataFrame:
    from pyspark.sql.window import Window

    per = _themed(k).groupBy("theme", "project_pk").agg(F.min("source_database").alias("source_database"), count())
    w = Window.partitionBy("theme").orderBy(F.desc("n"), "project_pk")
    return per.withColumn("r", F.row_number().over(w)).filter("r <= 3")


@query(f"""WITH {A} SELECT pk FROM a WHERE (coalesce(disease_standard IN ('PROMO', 'LARGE', 'SMALL'), false) OR (disease_standard IS NULL AND (disease ILIKE '%promo%'
  OR disease ILIKE '%large%' OR disease ILIKE '%small%')))
 AND coalesce(organism_common IN ('asia', 'europe'), false)""")
def filter_entities(k: Catalog) -> DataFrame:
    entities = [R.Entity("disease", ["PROMO", "LARGE"]), R.Entity("disease", ["SMALL"]), R.Entity("organism", ["asia", "europe"]), R.Entity("disease", ["ECONOMY"], negated=True)]
    return _where(k, R.entities_match(entities, {"disease": ("disease_standard", "disease"), "organism": ("organism_common", "organism_common")}))


@query(f"WITH {A} SELECT pk FROM a WHERE cell_type ILIKE '%gear%' OR cell_type ILIKE '%bolt%' OR cell_type ILIKE '%plate%'")
def filter_celltype_ontology(k: Catalog) -> DataFrame:
    """A cell-type word, or a value that the ontology adds and the word itself does not cover."""
    words = ["gear"]
    more = R.beyond(words, ["hot gear", "bolt", "plate"], "cell_type")
    return _where(k, R.any_of([R.contains_any("cell_type", words), *([more] if more is not None else [])]))


# Entities and words by tiers

DISEASE = E.Tiers(
    raw="disease", standard="disease_standard", upper="disease_category", own={"bolts": "bolt"}, upper_of={"first brand": "Brand#1"},
    standard_of={"promos": "PROMO", "bulk": "LARGE"}, above={"PROMO": "Brand#2"},
)
TISSUE = E.Tiers(
    raw="tissue", standard="tissue_standard", upper="tissue_level", upper_of={"top": "1", "second": "2"},
    standard_of={"routine": ["3-MEDIUM", "5-LOW"], "urgent": "1-URGENT", "spec": ["4-NOT SPECIFIED"]}, deep=frozenset({"spec"}),
)
_LEVELS = f"""WITH {A}, t AS (SELECT *, nullif(tissue, '4-NOT SPECIFIED') AS tissue_standard, split_part(tissue, '-', 1) AS tissue_level FROM a)"""


def _levels(k: Catalog) -> DataFrame:
    return annotated(k).select("*", F.nullif("tissue", F.lit("4-NOT SPECIFIED")).alias("tissue_standard"), F.split_part("tissue", F.lit("-"), F.lit(1)).alias("tissue_level"))


@query(f"""{_LEVELS} SELECT pk FROM t WHERE (disease_standard ILIKE '%bolt%' OR disease ILIKE '%bolt%' OR disease_category = 'Brand#1' OR disease_standard IN ('PROMO')
  OR disease_category = 'Brand#2'
 OR disease_standard IN ('LARGE') OR disease ILIKE '%hot ring%' OR disease ILIKE '%steel%')
 AND (tissue_level = '1' OR tissue_standard IN ('3-MEDIUM') OR tissue_standard IN ('4-NOT SPECIFIED') OR tissue ILIKE '%spec%')""")
def filter_entities_tiered(k: Catalog) -> DataFrame:
    """Diseases by text, category, standard value and raw text; tissues by level and by standard values but the excluded."""
    named = [("disease", "Bolts", ["x"]), ("disease", "first brand", ["x"]), ("disease", "Promo goods", ["x"]), ("disease", "bulk", ["x"]), ("disease", "steel", ["hot ring"]), ("tissue", "top", ["x"]), ("tissue", "Routine", ["x"]), ("tissue", "spec", ["x"])]
    entities = [E.Entity(kind, text, values, "promos" if text == "Promo goods" else "") for kind, text, values in named]
    entities += [E.Entity("tissue", "second", ["x"], negated=True), E.Entity("disease", "gear", [])]
    x = _levels(k)
    return x.filter(E.entities_condition(entities, {"disease": DISEASE, "tissue": TISSUE}, excluded={"tissue": ["5-low"]})).select("pk")


@query(f"""{_LEVELS} SELECT pk FROM t WHERE (cell_type IN ('red ring', 'hot gear') OR cell_type ILIKE '%gear%' OR tissue ILIKE '%gear%' OR cell_type ILIKE '%small%bolt%'
  OR cell_type ILIKE '%plate%')
 AND (tissue ILIKE '%1-urgent%' OR tissue ILIKE '%urgent%')""")
def filter_entities_cells(k: Catalog) -> DataFrame:
    """Cell types by value and pattern; a tissue whose only value is excluded is searched for as text."""
    entities = [E.Entity("cell_type", "gear", ["red ring", "hot gear"]), E.Entity("cell_type", "bolts", [], "b"), E.Entity("cell_type", "odd bolt", ["red ring"], "bolt+"), E.Entity("tissue", "urgent", ["1-URGENT"])]
    x = _levels(k)
    return x.filter(E.entities_condition(entities, {"tissue": TISSUE}, ("cell_type", {"bolt+": ["%small%bolt%", "%plate%"]}, {"gear": "tissue"}), {"tissue": ["1-Urgent"]})).select("pk")


@query(f"""{_LEVELS} SELECT pk FROM t WHERE tissue_level IN ('1', '3') AND (tissue_standard IN ('3-MEDIUM', '4-NOT SPECIFIED') OR tissue ILIKE '%spec%' OR tissue ILIKE '%-urg%')""")
def filter_words_tiered(k: Catalog) -> DataFrame:
    """Levels on one side, standard values and raw text of deep and unknown words on the other; both must be met."""
    tiers = E.Tiers("tissue", "tissue_standard", "tissue_level", upper_of={"top": "1", "second": "2", "third": "3"}, standard_of=TISSUE.standard_of, deep=TISSUE.deep)
    return _levels(k).filter(E.words_condition(["top", "Second ", "third", "routine", "spec", "-urg"], tiers, excluded=["5-LOW", "2"])).select("pk")
