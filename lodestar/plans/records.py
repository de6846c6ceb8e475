"""Queries on records: identifiers and mirrors, fusion and ranking, projections, staged text, downloads and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import accessions as I
from lodestar.functions import text as T
from lodestar.operators import fusion, ranking
from lodestar.plans.binding import Catalog
from lodestar.plans.queries import count, query
from lodestar.plans.routing import A, annotated
from lodestar.sources import listings, sinks

col, lit = F.col, F.lit


def text(x: str) -> Column:
    return col(x).cast("string")


def pick(index: Column, *values: Column) -> Column:
    return F.get(F.array(*values), index.cast("int"))


# Identifiers

_IDS = """ids AS (SELECT doc_id, source, n_chars, lang, text, CASE doc_id % 9 WHEN 0 THEN 'GSE' WHEN 1 THEN 'e-geod-' WHEN 2 THEN 'S-GEOD-' WHEN 3 THEN 'E-MTAB-'
  WHEN 4 THEN 'S-BSST-' WHEN 5 THEN 's-bsst' WHEN 6 THEN 'E-ANND-' WHEN 7 THEN 'SAMEA1000000' ELSE 'PRJNA' END || (doc_id // 18) AS id FROM documents),
 keys AS (SELECT *, CASE WHEN doc_id % 9 <= 2 THEN 'GEO:' WHEN doc_id % 9 <= 5 THEN 'MTAB:' WHEN doc_id % 9 = 6 THEN 'ANND:' END || (doc_id // 18) AS key FROM ids)"""


def ids(k: Catalog) -> DataFrame:
    kinds = ("GSE", "e-geod-", "S-GEOD-", "E-MTAB-", "S-BSST-", "s-bsst", "E-ANND-", "SAMEA1000000", "PRJNA")
    d = k.table("documents").select("doc_id", "source", "n_chars", "lang", "text")
    return d.withColumn("id", F.concat(pick(col("doc_id") % 9, *map(lit, kinds)), F.floor(col("doc_id") / 18).cast("string")))


@query(f"""WITH {_IDS}, o AS (SELECT DISTINCT a.doc_id, b.source || '/' || b.id AS name FROM keys a JOIN keys b ON a.key = b.key AND a.source || '/' || a.id <> b.source || '/' || b.id),
 m AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS mirrors, count(*) AS n FROM o GROUP BY 1)
 SELECT doc_id, id, key, coalesce(mirrors, '') AS mirrors, coalesce(n, 0) AS n_mirrors FROM keys LEFT JOIN m USING (doc_id)""")
def mirrors(k: Catalog) -> DataFrame:
    """The records of the same study under other accessions or in other sources: all of them, and how many."""
    x = ids(k).select("doc_id", "source", "id").withColumn("key", fusion.canonical_key(col("id")))
    return fusion.mirrors(x, "key", "source", "id").select("doc_id", "id", "key", "mirrors", "n_mirrors")


@query(f"""WITH {_IDS} SELECT doc_id, CASE WHEN upper(id) LIKE 'GSE%' OR upper(id) LIKE 'PRJNA%' OR upper(id) LIKE 'E-%' THEN 'project'
  WHEN upper(id) LIKE 'SAME%' THEN 'sample' WHEN doc_id % 2 = 0 THEN 'series' ELSE 'project' END AS entity,
 CASE WHEN id LIKE 'SAMEA1%' THEN 'sample' WHEN id LIKE 'PRJNA%' THEN 'study' END AS family FROM ids""")
def entity_types(k: Catalog) -> DataFrame:
    """What an id stands for: by its prefix, else by the columns that the record has."""
    x = ids(k).withColumn("series_id", F.when(col("doc_id") % 2 == 0, col("id")))
    return x.select("doc_id", I.entity_of(col("id"), series=col("series_id"), sample=lit(None).cast("string")).alias("entity"), I.family_of(col("id")).alias("family"))


@query("""WITH c AS (SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 3 = 0 THEN 'SAMEA' || (1000000 + o_orderkey)
  WHEN o_orderkey % 3 = 1 THEN 'GSM' || o_orderkey END AS sample_id, CASE
  WHEN o_orderkey % 2 = 0 THEN 'SRP' || (2000000 + o_orderkey) END AS series_id, 'PRJNA' || o_custkey AS project_id FROM orders)
 SELECT pk, CASE WHEN pk % 3 = 0 THEN sample_id WHEN pk % 2 = 0 THEN series_id ELSE project_id END AS accession FROM c""")
def archive_accession(k: Catalog) -> DataFrame:
    """The most specific id by which the archive can be asked: of the sample, else the series, else the project."""
    o, key = k.table("orders"), col("o_orderkey")
    sample = F.when(key % 3 == 0, F.concat(lit("SAMEA"), text_of(1000000 + key))).when(key % 3 == 1, F.concat(lit("GSM"), text_of(key)))
    series = F.when(key % 2 == 0, F.concat(lit("SRP"), text_of(2000000 + key)))
    x = o.select(key.alias("pk"), sample.alias("sample_id"), series.alias("series_id"), F.concat(lit("PRJNA"), text("o_custkey")).alias("project_id"))
    return x.select("pk", F.coalesce(*[F.when(I.family_of(col(c)).isNotNull(), col(c)) for c in ("sample_id", "series_id", "project_id")]).alias("accession"))


def text_of(c: Column) -> Column:
    return c.cast("string")


_LOOKUP = """asked AS (SELECT doc_id AS asked_no, CASE doc_id % 4 WHEN 0 THEN 'Customer#' || lpad((doc_id % 700)::VARCHAR, 9, '0') WHEN 1 THEN (doc_id % 400)::VARCHAR
  WHEN 2 THEN '10.1/' || (doc_id % 300) ELSE 'S' || doc_id END AS id FROM documents)"""


@query(f"""WITH {_LOOKUP}, f AS (SELECT asked_no, id, 0 AS step, c_custkey AS pk FROM asked JOIN customer ON c_name = id UNION ALL SELECT asked_no, id, 1, p_partkey
  FROM asked JOIN part ON regexp_full_match(id, '[0-9]+') AND p_partkey::VARCHAR = id
 UNION ALL SELECT asked_no, id, 2, s_suppkey FROM asked JOIN supplier ON '10.1/' || s_suppkey = id UNION ALL SELECT asked_no, id, 3, o_orderkey FROM asked
  JOIN orders ON 'S' || o_orderkey = id)
 SELECT asked_no, id, step, min(pk) AS pk FROM f WHERE (asked_no, step) IN (SELECT asked_no, min(step) FROM f GROUP BY 1) GROUP BY 1, 2, 3""")
def id_lookup_cascade(k: Catalog) -> DataFrame:
    """Ids looked up in turn by name, by number, by DOI and as a sample; the first step that finds any counts."""
    i = col("doc_id") % 4
    kinds = [F.concat(lit("Customer#"), F.lpad(text_of(col("doc_id") % 700), 9, "0")), text_of(col("doc_id") % 400), F.concat(lit("10.1/"), text_of(col("doc_id") % 300)), F.concat(lit("S"), text("doc_id"))]
    asked = k.table("documents").select(col("doc_id").alias("asked_no"), pick(i, *kinds).alias("id"))
    steps = [(k.table("customer"), "c_name", "c_custkey", ""), (k.table("part"), "p_partkey", "p_partkey", ""), (k.table("supplier"), "s_suppkey", "s_suppkey", "10.1/"), (k.table("orders"), "o_orderkey", "o_orderkey", "S")]
    found = None
    for n, (t, name, pk, prefix) in enumerate(steps):
        own = asked.filter(col("id").rlike("^[0-9]+$")) if n == 1 else asked
        part = own.join(t.select(F.concat(lit(prefix), text(name)).alias("id"), col(pk).cast("long").alias("pk")), "id").select("asked_no", "id", lit(n).alias("step"), "pk")
        found = part if found is None else found.union(part)
    best = found.groupBy("asked_no", "id").agg(F.min(F.struct("step", "pk")).alias("b"))
    return best.select("asked_no", "id", "b.step", "b.pk")


@query("""WITH x AS (SELECT o_orderkey AS pk, o_custkey FROM orders WHERE o_orderkey % 50 = 0)
  SELECT pk, c_custkey AS project_pk, c_name AS project_id, c_acctbal AS total_cells FROM x JOIN customer ON c_custkey = o_custkey""")
def samples_of_projects(k: Catalog) -> DataFrame:
    """Samples with their project; without one they are left out."""
    s = k.table("orders").filter("o_orderkey % 50 = 0").select(col("o_orderkey").alias("pk"), col("o_custkey").alias("project_pk"))
    return s.join(k.projects(), "project_pk").select("pk", "project_pk", "project_id", "total_cells")


@query("""WITH d AS (SELECT 'Customer#' || lpad((doc_id % 300)::VARCHAR, 9, '0') AS project_id, lang, n_chars FROM documents)
 SELECT project_id, c_custkey AS project_pk, docs, chars FROM (SELECT project_id, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM d GROUP BY 1) LEFT
  JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) ON c_name = project_id""")
def projects_by_natural_key(k: Catalog) -> DataFrame:
    """A join on a natural key that need not be unique: both sides have one row a key before they are joined."""
    d = k.table("documents").select(F.concat(lit("Customer#"), F.lpad(text_of(col("doc_id") % 300), 9, "0")).alias("project_id"), "n_chars")
    own = k.projects().groupBy("project_id").agg(F.min("project_pk").alias("project_pk"))
    return d.groupBy("project_id").agg(count("docs"), F.sum("n_chars").alias("chars")).join(own, "project_id", "left").select("project_id", "project_pk", "docs", "chars")


_LINKS = "links AS (SELECT lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS a, doc_id AS b FROM documents)"


@query(f"""WITH {_LINKS}, e AS (SELECT a AS own, b AS other, 0 AS way FROM links WHERE a IS NOT NULL UNION ALL SELECT b, a, 1 FROM links
  WHERE a IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY own, other ORDER BY way) AS r FROM e)
 SELECT own, other, source AS other_source, n_chars AS other_chars FROM f LEFT JOIN documents ON doc_id = other WHERE r = 1""")
def crosslinks_titled(k: Catalog) -> DataFrame:
    """Links seen from either end, each other record once, with what is known of it."""
    e = k.links()
    both = e.select(col("a").alias("own"), col("b").alias("other")).union(e.select("b", "a")).distinct()
    return both.join(k.table("documents").select(col("doc_id").alias("other"), col("source").alias("other_source"), col("n_chars").alias("other_chars")), "other", "left").select("own", "other", "other_source", "other_chars")


@query("""WITH asked AS (SELECT doc_id, doc_id % 37 AS asked FROM documents), al AS (SELECT n_nationkey + 25 AS alias, n_nationkey AS pk FROM nation UNION ALL
  SELECT n_nationkey, 0 FROM nation)
 SELECT doc_id, asked, coalesce(n.n_nationkey, al.pk) AS pk FROM asked LEFT JOIN nation n ON n_nationkey = asked LEFT JOIN al ON n.n_nationkey IS NULL AND alias = asked
  WHERE coalesce(n.n_nationkey, al.pk) IS NOT NULL""")
def alias_guard(k: Catalog) -> DataFrame:
    """An id of its own wins; only ids without a row are looked up as aliases, and ids without either go."""
    asked = k.table("documents").select("doc_id", (col("doc_id") % 37).cast("int").alias("asked"))
    nation = k.table("nation").select(col("n_nationkey").alias("asked"))
    aliases = nation.select((col("asked") + 25).alias("asked"), col("asked").alias("pk")).union(nation.select("asked", lit(0)))
    own = asked.join(nation, "asked", "left_semi").select("doc_id", "asked", col("asked").alias("pk"))
    return own.union(asked.join(nation, "asked", "left_anti").join(aliases, "asked").select("doc_id", "asked", "pk"))


@query("""WITH a AS (SELECT doc_id, source, 'src' || (doc_id % 25) AS alias FROM documents), m AS (SELECT source AS alias, min(doc_id) AS study FROM documents GROUP BY 1)
 SELECT doc_id, alias, study FROM a JOIN m USING (alias)""")
def alias_studies(k: Catalog) -> DataFrame:
    """Many aliases resolved at once; aliases of no study go."""
    d = k.table("documents")
    return d.select("doc_id", F.concat(lit("src"), text_of(col("doc_id") % 25)).alias("alias")).join(d.groupBy(col("source").alias("alias")).agg(F.min("doc_id").alias("study")), "alias").select("doc_id", "alias", "study")


# Fusion and ranking


@query(f"""WITH {A}, g AS (SELECT disease, tissue, sex_normalized, n_cells, age_min, source_database, pk FROM a WHERE disease IS NOT NULL AND tissue IS NOT NULL),
 f AS (SELECT disease, tissue, max(sex_normalized) AS sex, max(n_cells) AS n_cells, max(age_min) AS age, count(DISTINCT source_database) AS k, count(*) AS c, min(pk) AS first FROM g GROUP BY 1, 2)
 SELECT disease, tissue, round_even((40.0::DOUBLE * (2 + (sex IS NOT NULL)::INT + (coalesce(n_cells, 0) <> 0)::INT + (coalesce(age, 0) <> 0)::INT)) / 5 + least(k / 3, 1.0) * 25 + CASE WHEN first % 4 = 0 THEN 20 WHEN first % 4 = 1 THEN 15 WHEN first % 4 = 2 THEN 10 ELSE 0 END + least(c / 100, 1.0) * 15, 1) AS score FROM f""")
def quality_score(k: Catalog) -> DataFrame:
    """0 to 100 of fused records: filled fields, sources, availability, citations."""
    x = annotated(k).filter("disease is not null and tissue is not null").groupBy("disease", "tissue")
    x = x.agg(F.max("sex_normalized").alias("sex"), F.max("n_cells").alias("n_cells"), F.max("age_min").alias("age"), F.countDistinct("source_database").alias("sources"), count("citations"), F.min("pk").alias("first"))
    flags = {"has_h5ad": 0, "has_rds": 1, "access_url": 2}
    x = x.select("*", *[(col("first") % 4 == v).alias(n) for n, v in flags.items()])
    return x.select("disease", "tissue", ranking.quality(["disease", "tissue", "sex", "n_cells", "age"], "sources", [("has_h5ad", 20), ("has_rds", 15), ("access_url", 10)], "citations").alias("score"))


#: Records that a fused one names.
NAMED = 20


@query(f"""WITH d AS (SELECT text, source, doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS cells, CASE WHEN doc_id % 2 = 0 THEN ''
  ELSE lang END AS tissue, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 0 ELSE 1 END AS rank FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS place FROM d)
 SELECT md5(text) AS h, count(*) AS merged, count(DISTINCT source) AS source_count, coalesce(arg_min(nullif(cells, 0), (rank, doc_id)) FILTER (nullif(cells, 0) IS NOT NULL), 0) AS cells,
 coalesce(arg_min(nullif(tissue, ''), (rank, doc_id)) FILTER (nullif(tissue, '') IS NOT NULL), '') AS tissue,
 string_agg(doc_id || ' (' || source || ')', '; ' ORDER BY rank, doc_id) FILTER (place <= {NAMED}) AS ids, max(doc_id % 50) AS citations FROM r GROUP BY text""")
def fuse_records(k: Catalog) -> DataFrame:
    """Each group's best source gives the fields; what it lacks ('' and 0 too) comes from the next; most citations win. The
    first records are named, and all counted: each task keeps so many of a group before they meet."""
    cells, tissue = F.when(col("doc_id") % 3 == 0, 0).otherwise(col("n_chars")), F.when(col("doc_id") % 2 == 0, "").otherwise(col("lang"))
    d = k.table("documents").select(F.md5("text").alias("h"), "source", "doc_id", cells.alias("cells"), tissue.alias("tissue"))
    d = d.withColumn("rank", F.when(col("source").isin("src0", "src1", "src2"), 0).otherwise(1))

    def best(c: str, falsy) -> Column:
        value = F.nullif(col(c), lit(falsy))
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.struct("rank", "doc_id"))), lit(falsy)).alias(c)

    x = d.groupBy("h").agg(count("merged"), F.countDistinct("source").alias("source_count"), best("cells", 0), best("tissue", ""), F.max(col("doc_id") % 50).alias("citations"))
    first = d.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("rank", "doc_id"))).filter(col("place") <= NAMED)
    named = first.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(text("doc_id"), lit(" ("), "source", lit(")")).alias("name")))).alias("ids"))
    named = named.select("h", F.array_join(F.transform("ids", lambda i: i["name"]), "; ").alias("ids"))
    same = x.h.eqNullSafe(named.h)
    return x.join(named, same).select(x.h, "merged", "source_count", "cells", "tissue", "ids", "citations")


@query("""WITH RECURSIVE t AS (SELECT doc_id, source, md5(text) AS h, CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(lang, '') || (n_chars // 10) END AS key FROM documents),
 c AS (SELECT *, CASE WHEN h IS NULL OR doc_id % 4 = 3 THEN doc_id ELSE coalesce(min(doc_id) FILTER (doc_id % 4 <> 3) OVER (PARTITION BY h), doc_id) END AS grp FROM t),
 groups AS (SELECT grp, min(doc_id) AS place, arg_min(key, doc_id) FILTER (key <> '') AS hash, list_sort(list_distinct(list(source))) AS sources FROM c GROUP BY 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY place) AS i FROM groups WHERE hash IS NOT NULL),
 walk(hash, i, merged, grp, record) AS (SELECT hash, i, [{'record': grp, 's': sources}], grp, grp FROM g WHERE i = 1
  UNION ALL SELECT hash, i, CASE WHEN p > 0 THEN list_concat(list_concat(merged[:p - 1], [{'record': merged[p].record, 's': list_concat(merged[p].s, sources)}]), merged[p + 1:]) ELSE list_append(merged, {'record': grp, 's': sources}) END,
  grp, CASE WHEN p > 0 THEN merged[p].record ELSE grp END FROM (SELECT g.hash, g.i, w.merged, g.grp, g.sources, coalesce(list_position(list_transform(w.merged, lambda x: len(list_intersect(x.s, g.sources)) = 0), true), 0) AS p FROM walk w JOIN g ON g.hash = w.hash AND g.i = w.i + 1)),
 r AS (SELECT doc_id, source, coalesce(record, c.grp) AS record FROM c LEFT JOIN walk ON walk.grp = c.grp)
 SELECT record, count(*) AS merged, count(DISTINCT source) AS sources, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY 1""")
def fuse_results(k: Catalog) -> DataFrame:
    """The whole fusion: copies are tied by links, then groups with one key are merged across sources, in the order they came."""
    key = F.when(col("doc_id") % 11 == 0, "").otherwise(F.concat(F.coalesce("lang", lit("")), F.floor(col("n_chars") / 10).cast("string")))
    d = k.table("documents").select("doc_id", "source", F.md5("text").alias("h"), key.alias("key"))
    firsts = d.filter("doc_id % 4 <> 3 and h is not null")
    links = firsts.join(firsts.groupBy("h").agg(F.min("doc_id").alias("a")), "h").select("a", col("doc_id").alias("b")).filter("a <> b")
    x = fusion.fused(d.drop("h"), links, "doc_id", "source", "key", "doc_id")
    return x.groupBy("record").agg(count("merged"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""WITH g AS (SELECT md5(text) AS h, count(*) AS n, max(n_chars) AS score, min(doc_id) AS first FROM documents GROUP BY text)
  SELECT h, n, score, row_number() OVER (ORDER BY score DESC, first) AS place FROM g ORDER BY place LIMIT 100""")
def fused_sorted(k: Catalog) -> DataFrame:
    """Fused records by score, equal ones in the order they came in."""
    g = k.table("documents").groupBy(F.md5("text").alias("h")).agg(count(), F.max("n_chars").alias("score"), F.min("doc_id").alias("first"))
    top = g.orderBy(F.desc("score"), "first").limit(100)
    return top.select("h", "n", "score", F.row_number().over(Window.orderBy(F.desc("score"), "first")).alias("place"))


_WANT = {"disease": ["bolt", "gear"], "tissue": ["small", "red ring"], "tech": ["promo", "economy"]}
_HITS = {f: " OR ".join(f"contains(lower({{0}}), '{w}')" for w in ws) for f, ws in _WANT.items()}


@query(f"""WITH p AS (SELECT p_partkey AS pk, p_name AS title, p_type || ' goods' AS description, CASE p_size % 3 WHEN 0 THEN 'homo sapiens'
  WHEN 1 THEN 'mus musculus' END AS organism, 2015 + p_size % 12 AS year, p_size % 5 AS mirrors FROM part),
 h AS (SELECT *, {", ".join(f"({q.format("title || ' ' || description")})::INT AS {f}, ({q.format('title')})::INT AS {f}_title" for f, q in _HITS.items())},
 list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9-]+'), lambda x: x NOT IN ('the', 'of', 'hot'))) AS tokens FROM p)
 SELECT pk, round(2.0 * (disease + tissue + tech) + CASE WHEN disease_title + tissue_title + tech_title >= 2 THEN 1.0 ELSE 0.0 END + CASE organism
  WHEN 'homo sapiens' THEN 0.6 WHEN 'mus musculus' THEN -0.6 ELSE 0.0 END
 + CASE WHEN year BETWEEN 2018 AND 2022 THEN 0.5 ELSE 0.0 END + 0.3 * len(list_intersect(tokens, ['bolt', 'small', 'widget'])) / greatest(len(list_distinct(list_concat(tokens, ['bolt', 'small', 'widget']))), 1) + 0.2 * sqrt(mirrors), 6) + 0.0 AS score FROM h""")
def rank_intent(k: Catalog) -> DataFrame:
    """Parts as results of a structured intent."""
    i = col("p_size")
    x = k.table("part").select(col("p_partkey").alias("pk"), col("p_name").alias("title"), F.concat("p_type", lit(" goods")).alias("description"), F.when(i % 3 == 0, "homo sapiens").when(i % 3 == 1, "mus musculus").alias("organism"), (2015 + i % 12).alias("year"), (i % 5).alias("mirrors"))
    intent = ranking.Intent(fields=_WANT, species=["Homo sapiens"], years=(2018, 2022), words=["bolt", "small", "widget"], stop=["the", "of", "hot"])
    return x.select("pk", (F.round(ranking.intent_score(intent, "title", "description", "organism", "year", "mirrors"), 6) + 0.0).alias("score"))


@query("""WITH p AS (SELECT p_partkey AS pk, (contains(lower(p_name), 'bolt'))::INT + (contains(lower(p_name), 'small'))::INT + (contains(lower(p_name), 'red'))::INT AS hits FROM part) SELECT pk, hits, row_number() OVER (ORDER BY hits DESC, pk) AS place FROM p WHERE hits > 0 ORDER BY place LIMIT 200""")
def rank_keyword_hits(k: Catalog) -> DataFrame:
    """Results by how many of the keywords they have, equal ones in the order they came in."""
    x = k.series().select(col("series_pk").alias("pk"), ranking.hits(F.lower("title"), ["bolt", "small", "red"]).alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "pk").limit(200)
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), "pk")))


@query(f"""WITH {A} SELECT pk, CASE WHEN tissue IS NULL THEN 'miss' WHEN lower(tissue) IN ('1-urgent') THEN 'match' WHEN tissue ILIKE '%urg%'
  OR tissue ILIKE '%high%' THEN 'partial' ELSE 'miss' END AS tissue,
 CASE WHEN disease IS NULL THEN 'miss' WHEN lower(disease) IN ('red bolt', 'hot gear') THEN 'match' WHEN disease ILIKE '%bolt%' THEN 'partial' ELSE 'miss' END AS disease FROM a""")
def facet_match_map(k: Catalog) -> DataFrame:
    asked = {"tissue": (["1-urgent"], ["urg", "high"]), "disease": (["red bolt", "hot gear"], ["bolt"])}
    grades = F.create_map(*[x for f, (whole, part) in asked.items() for x in (lit(f), ranking.grade(f, whole, part))])
    return annotated(k).select("pk", grades.alias("m")).select("pk", *[col("m")[f].alias(f) for f in asked])


# Post-filters over results

_RESULTS = """r AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'n/a'
  ELSE 'published ' || (1990 + n_chars % 40) END AS date, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 'Musculus' ELSE CASE lang
  WHEN 'en' THEN 'Homo sapiens' ELSE 'Mus musculus' END END AS organism,
 CASE WHEN doc_id % 13 < source[4:]::INT THEN 'bulk RNA' ELSE 'single-cell RNA' END AS title FROM documents)"""


def results(k: Catalog) -> DataFrame:
    d, i = k.table("documents"), col("doc_id")
    date = F.when(i % 11 == 1, "n/a").when(i % 11 != 0, F.concat(lit("published "), text_of(1990 + col("n_chars") % 40)))
    organism = F.when(i % 9 == 1, "Musculus").when(i % 9 != 0, F.when(col("lang") == "en", "Homo sapiens").otherwise("Mus musculus"))
    title = F.when(i % 13 < F.substring("source", 4, 9).cast("int"), "bulk RNA").otherwise("single-cell RNA")
    return d.select("doc_id", "source", date.alias("date"), organism.alias("organism"), title.alias("title"))


@query(f"WITH {_RESULTS} SELECT doc_id, date FROM r WHERE try_cast(regexp_extract(date, '(19|20)[0-9]{{2}}') AS INT) BETWEEN 2005 AND 2015 OR try_cast(regexp_extract(date, '(19|20)[0-9]{{2}}') AS INT) IS NULL")
def postfilter_year(k: Catalog) -> DataFrame:
    """A result without a year is not held against it."""
    year = T.year_of(col("date"))
    return results(k).filter(year.isNull() | year.between(2005, 2015)).select("doc_id", "date")


@query(f"WITH {_RESULTS} SELECT doc_id, organism, 'asked for' AS kind FROM r WHERE organism IS NULL OR contains(lower(organism), 'mus musculus') OR contains('mus musculus', lower(organism)) UNION ALL SELECT doc_id, organism, 'default' FROM r")
def postfilter_species(k: Catalog) -> DataFrame:
    """By part of a name either way; the default species filters nothing."""

    def kept(species: str, kind: str) -> DataFrame:
        have, asked = F.lower("organism"), lit(species.lower())
        x = results(k).select("doc_id", "organism", lit(kind).alias("kind"))
        return x if species == "Homo sapiens" else x.filter(have.isNull() | have.contains(asked) | asked.contains(have))

    return kept("Mus musculus", "asked for").union(kept("Homo sapiens", "default"))


@query(f"WITH {_RESULTS}, h AS (SELECT source, bool_or(title = 'single-cell RNA') AS any_hit FROM r GROUP BY 1) SELECT doc_id, title FROM r JOIN h USING (source) WHERE title = 'single-cell RNA' OR NOT any_hit")
def postfilter_nonempty(k: Catalog) -> DataFrame:
    """The filter acts in a source only if something of the source is left by it."""
    x = results(k).withColumn("hit", col("title").rlike("(?i)single[- ]cell|scRNA"))
    some = x.groupBy("source").agg(F.bool_or("hit").alias("some"))
    return x.join(F.broadcast(some), "source").filter("hit or not some").select("doc_id", "title")


@query("""WITH a AS (SELECT doc_id, doc_id // 3 AS q, CASE doc_id % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN upper(lang) ELSE CASE WHEN doc_id % 2 = 0 THEN 'EUROPE'
  ELSE source END END AS value FROM documents), k AS (SELECT *, value IN (SELECT r_name FROM region) AS known FROM a)
 SELECT q, value FROM k WHERE known OR q NOT IN (SELECT q FROM k WHERE known)""")
def vocab_prune(k: Catalog) -> DataFrame:
    """Of a question's values unknown ones go only where a known one remains."""
    i = col("doc_id")
    value = F.when(i % 3 == 0, "ASIA").when(i % 3 == 1, F.upper("lang")).otherwise(F.when(i % 2 == 0, "EUROPE").otherwise(col("source")))
    known = k.table("region").select(col("r_name").alias("value"), lit(True).alias("known"))
    x = k.table("documents").select(F.floor(i / 3).alias("q"), value.alias("value")).join(F.broadcast(known), "value", "left")
    return x.withColumn("some", F.count("known").over(Window.partitionBy("q"))).filter("known or some = 0").select("q", "value")


# Projections


@query(f"""WITH {A} SELECT pk, project_pk, series_pk, source_database, tissue, n_cells, strftime(publication_date, '%Y-%m-%d') AS published, disease, disease_standard, disease_category, cell_type, organism, organism_common, sex, sex_normalized, sample_type, cell_line_name, age_min, age_max, age_unit,
 coalesce(organism_common, organism) AS best_organism, nullif(substr(disease, 1, 6), '') AS short_text, coalesce(pk % 3 = 1, false) AS has_h5ad, year(publication_date)::INT AS year FROM a ORDER BY n_cells DESC NULLS LAST, pk LIMIT 300""")
def explore_wide(k: Catalog) -> DataFrame:
    """The 24 columns of an explore row: cleaned over raw values, cut texts ('' is NULL), flags as booleans."""
    x = annotated(k).orderBy(F.desc_nulls_last("n_cells"), "pk").limit(300)
    extra = {"best_organism": F.coalesce("organism_common", "organism"), "short_text": F.nullif(F.substring("disease", 1, 6), lit("")), "has_h5ad": F.coalesce(col("pk") % 3 == 1, lit(False)), "year": F.year("publication_date")}
    return x.select(*[c for c in x.columns if c != "publication_date"], F.date_format("publication_date", "yyyy-MM-dd").alias("published"), *[c.alias(n) for n, c in extra.items()])


#: Columns that a caller may sort by, and what they stand for.
SORTS = {"cells": "n_cells", "date": "publication_date", "source": "source_database"}


@query(f"WITH {A} SELECT pk, source_database FROM a ORDER BY source_database ASC NULLS LAST, pk LIMIT 5000")
def sort_whitelisted(k: Catalog) -> DataFrame:
    """Sorted by a named column if it is one of those allowed, else by cells; the page is bounded by the limit's policy."""
    return sorted_page(annotated(k), "source", False, 20).select("pk", "source_database")


def sorted_page(x: DataFrame, by: str, descending: bool, limit: int) -> DataFrame:
    c = col(SORTS.get(by, "n_cells"))
    return x.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "pk").limit(fetch_limit(limit))


def fetch_limit(limit: int) -> int:
    """Rows that are fetched for a page: ten times as many, within bounds, as some are filtered out later."""
    return min(max(10 * limit, 5_000), 20_000)


@query("SELECT doc_id, lang, n_chars FROM documents")
def drop_internal(k: Catalog) -> DataFrame:
    return k.table("documents").drop("text", "source", "raw_metadata")


# Staged text


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars || 'M' WHEN 1 THEN n_chars || '.5K' WHEN 2 THEN n_chars::VARCHAR WHEN 3 THEN '-'
  ELSE '' END AS size, CASE doc_id % 5 WHEN 0 THEN n_chars * 1048576 WHEN 1 THEN n_chars * 1024 + 512 WHEN 2 THEN n_chars END AS bytes FROM documents""")
def parse_sizes(k: Catalog) -> DataFrame:
    n = text("n_chars")
    x = k.table("documents").select("doc_id", pick(col("doc_id") % 5, F.concat(n, lit("M")), F.concat(n, lit(".5K")), n, lit("-"), lit("")).alias("size"))
    return x.select("doc_id", "size", T.size_bytes(col("size")).alias("bytes"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE n_chars * (1024 ** (doc_id % 5))::BIGINT END AS n FROM documents)
 SELECT doc_id, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1024 ** 2)
  WHEN n < 1024 ** 4 THEN printf('%.1f GB', n / 1024 ** 3) WHEN n IS NOT NULL THEN printf('%.1f TB', n / 1024 ** 4) END AS label FROM d""")
def human_bytes(k: Catalog) -> DataFrame:
    x = k.table("documents").select("doc_id", F.when(col("doc_id") % 6 != 5, col("n_chars") * F.pow(lit(1024), col("doc_id") % 5).cast("long")).alias("n"))
    return x.select("doc_id", "n", T.human_size(col("n")).alias("label"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN lang = source THEN lang ELSE lang || ', ' || source END WHEN 1 THEN '' WHEN 2 THEN source END AS clean FROM documents""")
def list_literal(k: Catalog) -> DataFrame:
    """Lists that were stored as Python text: distinct items joined; other text as it is."""
    quoted = F.concat(lit("['"), "lang", lit("', '"), "source", lit("', '"), "lang", lit("']"))
    raw = pick(col("doc_id") % 4, quoted, lit("[]"), col("source"), lit(None).cast("string"))
    return k.table("documents").select("doc_id", T.unlisted(raw).alias("clean"))


_ENA = """e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fastq' WHEN 1 THEN 'submitted'
  ELSE 'sra' END AS kind, 'ftp/' || lang || ';ftp/' || source AS url, n_chars || ';' AS size, md5(lang) AS md5 FROM documents WHERE doc_id % 4 <> 3)"""


@query(f"WITH {_ENA} SELECT doc_id, kind, 0 AS i, 'ftp/' || lang AS url, n_chars AS bytes, md5(lang) AS md5 FROM documents JOIN e USING (doc_id) UNION ALL SELECT doc_id, kind, 1, 'ftp/' || source, NULL, NULL FROM documents JOIN e USING (doc_id)")
def parse_multivalue_zip(k: Catalog) -> DataFrame:
    """Files of a run: the first class of files that has any; urls, sizes and sums zipped, short lists padded with NULL."""
    d, kinds = k.table("documents"), ("fastq", "submitted", "sra")
    some = col("doc_id") % 4 != 3
    row = F.struct(F.concat(lit("ftp/"), "lang", lit(";ftp/"), "source").alias("url"), F.concat(text("n_chars"), lit(";")).alias("size"), F.md5("lang").alias("md5"))
    staged = d.select("doc_id", *[F.when(some & (col("doc_id") % 3 <= i), row).alias(kind) for i, kind in enumerate(kinds)])
    staged = staged.select("doc_id", *[F.when(col("doc_id") % 3 == i, col(kind)).alias(kind) for i, kind in enumerate(kinds)])
    first = F.coalesce(*[F.when(col(kind).isNotNull(), F.struct(lit(kind).alias("kind"), col(kind).alias("f"))) for kind in kinds])
    x = staged.select("doc_id", first.alias("x")).filter("x is not null")
    zipped = F.arrays_zip(*[F.split(col("x")["f"][c], ";").alias(c) for c in ("url", "size", "md5")])
    x = x.select("doc_id", "x.kind", F.posexplode(zipped).alias("i", "z"))
    return x.select("doc_id", "kind", "i", "z.url", F.nullif("z.size", lit("")).try_cast("long").alias("bytes"), F.nullif("z.md5", lit("")).alias("md5"))


@query("""SELECT doc_id // 100 AS page, source || '_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.tar' ELSE '.txt' END AS name, CASE doc_id % 3
  WHEN 0 THEN n_chars * 1024 WHEN 1 THEN n_chars END AS bytes, doc_id % 2 = 0 AS archive FROM documents""")
def parse_listing(k: Catalog) -> DataFrame:
    """Directory listings of a hundred files each, with a link up, orders of the listing, and its own description."""
    name = F.concat("source", lit("_"), text("doc_id"), F.when(col("doc_id") % 2 == 0, ".tar").otherwise(".txt"))
    size = pick(col("doc_id") % 3, F.concat(text("n_chars"), lit("K")), text("n_chars"), lit("-"))
    line = F.concat(lit('<img src="x.gif"> <a href="'), name, lit('">file</a>   2020-01-01 10:00  '), size, lit(" "))
    head = '<a href="?C=N;O=D">Name</a> <a href="?C=S;O=A">Size</a>\n<a href="/up/">Parent Directory</a>  2020-01-01 10:00  -\n<a href="filelist.txt">f</a> 2020-01-01 10:00  1K\n'
    pages = k.table("documents").groupBy(F.floor(col("doc_id") / 100).alias("page")).agg(F.concat(lit(head), F.array_join(F.collect_list(line), "\n")).alias("html"))
    return listings.listed_files(pages, "page", "html")


@query("SELECT doc_id, md5(text) AS clean FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 2")
def mojibake(k: Catalog) -> DataFrame:
    """Texts that were read as Latin-1 are repaired, sound ones left alone."""
    broken = F.decode(F.encode("text", "utf-8"), "iso-8859-1")
    raw = pick(col("doc_id") % 3, broken, col("text"), lit(None).cast("string"))
    return k.table("documents").select("doc_id", F.md5(T.repaired(raw)).alias("clean"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, round_even(100.0::DOUBLE * count(NULLIF({c}::VARCHAR, '')) / count(*), 2) AS filled, count(DISTINCT {c}) AS distinct_values FROM orders""" for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))))
def data_dictionary(k: Catalog) -> DataFrame:
    return sinks.data_dictionary(k.table("orders"))


# Downloads and exports


@query("""WITH o AS (SELECT doc_id, lang AS type, 'u' || doc_id AS url FROM documents WHERE doc_id % 5 <> 4), a AS (SELECT DISTINCT doc_id // 2 AS id FROM documents),
 j AS (SELECT a.id, o.type, o.url FROM a LEFT JOIN o ON o.doc_id // 2 = a.id) SELECT id, url, 'file' AS kind FROM j WHERE type IN ('en', 'fr') UNION ALL
 SELECT id, string_agg(DISTINCT type, ',' ORDER BY type), CASE WHEN count(type) = 0 THEN 'unresolved' ELSE 'unmatched' END FROM j GROUP BY id
  HAVING count(*) FILTER (type IN ('en', 'fr')) = 0""")
def download_flatten(k: Catalog) -> DataFrame:
    """Files of the types asked for; else the types that were offered instead, or nothing at all."""
    d = k.table("documents")
    asked = d.select(F.floor(col("doc_id") / 2).alias("id")).distinct()
    options = d.filter("doc_id % 5 <> 4").select(F.floor(col("doc_id") / 2).alias("id"), col("lang").alias("type"), F.concat(lit("u"), text("doc_id")).alias("url"))
    x = asked.join(options, "id", "left").groupBy("id").agg(F.collect_list(F.when(col("type").isin("en", "fr"), col("url"))).alias("urls"), F.array_sort(F.collect_set("type")).alias("types"))
    rest = F.array(F.struct(F.when(F.size("types") > 0, F.array_join("types", ",")).alias("url"), F.when(F.size("types") > 0, "unmatched").otherwise("unresolved").alias("kind")))
    files = F.transform("urls", lambda u: F.struct(u.alias("url"), lit("file").alias("kind")))
    return x.select("id", F.inline(F.when(F.size("urls") > 0, files).otherwise(rest)))


@query(f"""WITH {_IDS} SELECT doc_id, CASE WHEN id LIKE 'GSE%' THEN 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || left(id, greatest(len(id) - 3, 3)) || 'nnn/' || id || '/suppl/' WHEN id LIKE 'PRJNA%' OR id LIKE 'SAMEA1%' THEN 'https://www.ebi.ac.uk/ena/browser/view/' || id
 WHEN id LIKE 'E-MTAB-%' OR id LIKE 'E-ANND-%' THEN 'https://www.ebi.ac.uk/biostudies/arrayexpress/studies/' || id END AS url FROM ids""")
def download_options(k: Catalog) -> DataFrame:
    """Where the files of a record are, made from its id."""
    return ids(k).select("doc_id", I.download_url(col("id")).alias("url"))


@query("""WITH c AS (SELECT doc_id, 'https://f/' || (doc_id // 2) AS url, 'file' AS kind FROM documents
  WHERE doc_id % 3 = 0), p AS (SELECT doc_id, 'https://f/' || (doc_id // 2) AS url, CASE WHEN doc_id % 2 = 0 THEN 'folder' ELSE 'page' END AS kind FROM documents),
 u AS (SELECT url, kind, 0 AS o, doc_id FROM c UNION ALL SELECT url, kind, 1, doc_id FROM p WHERE NOT (kind = 'folder' AND url IN (SELECT url FROM c)))
 SELECT url, arg_min(kind, (o, doc_id)) AS kind FROM u GROUP BY 1""")
def download_deep(k: Catalog) -> DataFrame:
    """Files come before pointers, a folder that files replace goes, and each address comes once."""
    d, url = k.table("documents"), F.concat(lit("https://f/"), F.floor(col("doc_id") / 2).cast("string")).alias("url")
    files = d.filter("doc_id % 3 = 0").select(url, lit("file").alias("kind"), lit(0).alias("o"), "doc_id")
    pointers = d.select(url, F.when(col("doc_id") % 2 == 0, "folder").otherwise("page").alias("kind"), lit(1).alias("o"), "doc_id")
    known = files.select("url").distinct().withColumn("found", lit(True))
    pointers = pointers.join(known, "url", "left").filter("not (kind = 'folder' and found is not null)").drop("found")
    return files.union(pointers).groupBy("url").agg(F.min_by("kind", F.struct("o", "doc_id")).alias("kind"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1234' || doc_id WHEN 1 THEN '10.1000/x' || doc_id WHEN 2 THEN '' END AS pmid, CASE
  WHEN doc_id % 5 = 0 THEN '10.2/y' || doc_id END AS doi FROM documents),
 c AS (SELECT doc_id, CASE WHEN regexp_full_match(pmid, '[0-9]+') THEN pmid END AS pmid, coalesce(doi, CASE WHEN pmid LIKE '10.%' THEN pmid END) AS doi FROM d)
 SELECT doc_id, '@article{ref' || doc_id || coalesce(', pmid={' || pmid || '}', '') || coalesce(', doi={' || doi || '}', '') || '}' AS entry FROM c WHERE pmid IS NOT NULL
  OR doi IS NOT NULL""")
def export_references(k: Catalog) -> DataFrame:
    """References: a PMID is of digits, a DOI filed as one is moved, and rows with neither are left out."""
    i = col("doc_id")
    d = k.table("documents").select("doc_id", F.when(i % 4 == 0, F.concat(lit("1234"), text("doc_id"))).when(i % 4 == 1, F.concat(lit("10.1000/x"), text("doc_id"))).when(i % 4 == 2, "").alias("pmid"), F.when(i % 5 == 0, F.concat(lit("10.2/y"), text("doc_id"))).alias("doi"))
    x = d.select("doc_id", F.when(col("pmid").rlike("^[0-9]+$"), col("pmid")).alias("pmid"), F.coalesce("doi", F.when(col("pmid").startswith("10."), col("pmid"))).alias("doi")).filter("pmid is not null or doi is not null")
    field = lambda c: F.coalesce(F.concat(lit(f", {c}={{"), c, lit("}")), lit(""))
    return x.select("doc_id", F.concat(lit("@article{ref"), text("doc_id"), field("pmid"), field("doi"), lit("}")).alias("entry"))


_MANIFESTS = {
    "tsv": "source || chr(9) || 'f' || doc_id || chr(9) || n_chars",
    "bash": "'curl -fL --create-dirs -o ' || chr(39) || source || '/f' || doc_id || chr(39) || ' ' || chr(39) || 'https://f/' || doc_id || chr(39)",
    "aria2": "'https://f/' || doc_id || chr(10) || '  dir=' || source || chr(10) || '  out=f' || doc_id",
    "snakemake": "'    ' || chr(34) || source || '/f' || doc_id || chr(34) || ','",
    "python": "'    (' || chr(34) || 'https://f/' || doc_id || chr(34) || ', ' || chr(34) || source || '/f' || doc_id || chr(34) || '),'",
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, doc_id, {sql} AS line FROM documents" for kind, sql in _MANIFESTS.items()))
def manifest_lines(k: Catalog) -> DataFrame:
    """Lines of the download manifests of every kind, one per file."""
    x = k.table("documents").select("doc_id", col("source").alias("folder"), F.concat(lit("f"), text("doc_id")).alias("name"), F.concat(lit("https://f/"), text("doc_id")).alias("url"), col("n_chars").alias("bytes"))
    return x.select("doc_id", F.explode(sinks.manifest_lines()).alias("kind", "line")).select("kind", "doc_id", "line")


@query("""SELECT -1 AS at, '# rows: ' || count(*) AS line FROM documents UNION ALL SELECT 0, 'doc_id,lang,label' UNION ALL SELECT doc_id + 1, doc_id || ',' || lang || ',' ||
 CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN chr(34) || lang || ',' || source || chr(34)
  ELSE chr(34) || 'say ' || chr(34) || chr(34) || lang || chr(34) || chr(34) || chr(34) END FROM documents""")
def export_metadata(k: Catalog) -> DataFrame:
    """CSV lines under a header of provenance; a value is quoted only if it has a comma or a quotation mark."""
    d = k.table("documents")
    label = pick(col("doc_id") % 3, col("source"), F.concat("lang", lit(","), "source"), F.concat(lit('say "'), "lang", lit('"')))
    rows = d.select((col("doc_id") + 1).alias("at"), sinks.csv_line([text("doc_id"), col("lang"), label]).alias("line"))
    head = d.agg(lit(-1).cast("long").alias("at"), F.concat(lit("# rows: "), F.count("*").cast("string")).alias("line"))
    names = head.select(lit(0).cast("long").alias("at"), lit("doc_id,lang,label").alias("line"))
    return head.union(names).union(rows)


@query("""SELECT source, '## ' || source || ' (' || count(*) || ')' || string_agg(chr(10) || '- ' || left(lang || ' text of ' || n_chars || ' characters, number ' || doc_id, 30), '' ORDER BY doc_id) FILTER (r <= 8) AS page FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source""")
def render_markdown(k: Catalog) -> DataFrame:
    """A section per source: its number of results and the first eight, cut titles."""
    title = F.left(F.concat("lang", lit(" text of "), text("n_chars"), lit(" characters, number "), text("doc_id")), lit(30))
    d = k.table("documents").select("source", "doc_id", F.concat(lit("\n- "), title).alias("line"))
    # Each task keeps eight rows of a source before they meet; results are counted apart.
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 8")
    top = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "line"))).alias("top"))
    x = d.groupBy("source").agg(count()).join(top, "source")
    return x.select("source", F.concat(lit("## "), "source", lit(" ("), text("n"), lit(")"), F.array_join(F.transform("top", lambda t: t["line"]), "")).alias("page"))


@query("SELECT doc_id, regexp_replace(left(lang || ' / ' || source || ': ' || doc_id, 80), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM documents")
def safe_names(k: Catalog) -> DataFrame:
    return k.table("documents").select("doc_id", T.safe_name(F.concat("lang", lit(" / "), "source", lit(": "), text("doc_id"))).alias("name"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def json_props(k: Catalog) -> DataFrame:
    return k.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g') AS c, length(text) AS n FROM (SELECT doc_id, CASE
  WHEN doc_id % 4 = 0 THEN repeat('查找', (1 + length(text) // 8)::INTEGER) || text WHEN doc_id % 4 = 1 THEN '查找' || text ELSE text END AS text FROM documents))
 SELECT doc_id, CASE WHEN length(c) > 0.1 * n THEN 'zh' ELSE 'en' END AS asked_in, length(c) > 0 AS any_cjk FROM t""")
def question_language(k: Catalog) -> DataFrame:
    """Chinese if over a tenth of the characters are."""
    x = k.table("documents").select("doc_id", F.when(col("doc_id") % 4 == 0, F.concat(F.repeat(lit("查找"), (1 + F.floor(F.length("text") / 8)).cast("int")), "text")).when(col("doc_id") % 4 == 1, F.concat(lit("查找"), "text")).otherwise(col("text")).alias("text"))
    share = T.cjk_share(col("text"))
    return x.select("doc_id", F.when(share > 0.1, "zh").otherwise("en").alias("asked_in"), (share > 0).alias("any_cjk"))


# Workspaces and feedback

_LOG = """log AS (SELECT event_id, user_id % 20 AS workspace, event_type AS item, value FROM events)"""


@query(f"WITH {_LOG}, l AS (SELECT workspace, item, arg_max(value, event_id) AS note, max(event_id) AS last, min(event_id) AS added FROM log GROUP BY 1, 2) SELECT workspace, item, note, added FROM l WHERE last % 5 <> 0")
def workspace_items(k: Catalog) -> DataFrame:
    """The state of workspaces from a log of changes: adding twice is adding once, the last change counts, some delete."""
    x = k.table("events").select("event_id", (col("user_id") % 20).alias("workspace"), col("event_type").alias("item"), "value")
    x = x.groupBy("workspace", "item").agg(F.max_by("value", "event_id").alias("note"), F.max("event_id").alias("last"), F.min("event_id").alias("added"))
    return x.filter("last % 5 <> 0").drop("last")


@query(f"WITH {_LOG}, l AS (SELECT workspace, item, max(value) AS value, count(*) AS n FROM log GROUP BY 1, 2) SELECT workspace, to_json({{'workspace': workspace, 'items': list({{'item': item, 'n': n}} ORDER BY item)}})::VARCHAR AS document FROM l GROUP BY 1")
def workspace_export(k: Catalog) -> DataFrame:
    """A workspace as one JSON document."""
    x = k.table("events").groupBy((col("user_id") % 20).alias("workspace"), col("event_type").alias("item")).agg(count())
    return x.groupBy("workspace").agg(F.to_json(F.struct("workspace", F.array_sort(F.collect_list(F.struct("item", "n"))).alias("items"))).alias("document"))
