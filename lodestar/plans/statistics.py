"""Statistics tables, dashboard sections and quality reports, each in as few passes over a tier as its grouping allows."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.stored import StoredCounts, files_of, totals
from lodestar.plans.binding import Catalog, Replaced
from lodestar.plans.queries import count, query
from lodestar.plans.routing import A, annotated
from lodestar.sources.shared import new_path

col = F.col


def unpivoted(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a row of longs."""
    return one_row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one_row.columns]), F.array(*[col(c).cast("long") for c in one_row.columns]))).alias("metric", "value"))


# The overall table

_SECTIONS = ["source_database", "tissue", "disease_standard", "sex_normalized", "organism_common", "sample_type", "age_unit", "disease_category"]
_COVERED = ["disease_standard", "sex_normalized", "organism_common", "age_unit", "age_min", "tissue", "n_cells", "series_pk"]
_DISTINCT = {"tissues": "tissue", "diseases_raw": "disease", "diseases_standard": "disease_standard", "disease_categories": "disease_category", "cell_types": "cell_type", "organisms": "organism", "sexes": "sex_normalized", "sample_types": "sample_type", "sources": "source_database"}


#: Levels of the curated columns and categories that the test tables have none of their own, made of what they have.
_MORE = {
    "tissue_standard": "nullif(tissue, '4-NOT SPECIFIED')", "tissue_l1": "split_part(tissue, '-', 1)", "tissue_leaf": "split_part(tissue, '-', 2)", "disease_l1": "split_part(disease, ' ', 1)",
    "cell_type_standard": "CASE WHEN pk % 7 > 0 THEN lower(cell_type) END", "cell_lineage": "CASE WHEN pk % 5 > 0 THEN split_part(cell_type, ' ', 2) END", "ancestry": "CASE WHEN pk % 11 > 2 THEN organism_common END",
    "dev_stage": "CASE WHEN age_min < 0 THEN 'young' WHEN age_min < 20 THEN 'adult' END", "treatment": "CASE WHEN pk % 4 = 1 THEN sample_type END", "genotype": "CASE WHEN pk % 9 = 1 THEN disease_category END",
    "individual": "CASE WHEN pk % 3 > 0 THEN source_database || ':' || project_pk END", "year": "year(publication_date)",
}
_ALL_COVERED = [*_COVERED, *_MORE]
_ALL_DISTINCT = _DISTINCT | {f"{c}_values": c for c in _MORE if c != "year"}
_WIDE = f"{A}, w AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _MORE.items())} FROM a)"
_OVERALL = f"""WITH {_WIDE}, one AS (SELECT count(*) AS total_samples, {", ".join(f"count({c}) AS samples_with_{c}" for c in _ALL_COVERED)}, {", ".join(f"count(DISTINCT {c}) AS distinct_{n}" for n, c in _ALL_DISTINCT.items())} FROM w)
 SELECT metric, value::BIGINT AS value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)
 UNION ALL SELECT 'total_projects', count(*) FROM customer UNION ALL SELECT 'total_series', count(*) FROM part UNION ALL SELECT 'total_celltypes', count(*) FROM lineitem
 UNION ALL SELECT 'total_entity_links', count(*) - count(DISTINCT text) FROM documents UNION ALL SELECT 'distinct_assays', count(DISTINCT p_type) FROM part UNION ALL SELECT 'distinct_platforms', count(DISTINCT p_brand) FROM part
 UNION ALL SELECT 'newest_year', max(year(o_orderdate)) FROM orders UNION ALL SELECT 'oldest_year', min(year(o_orderdate)) FROM orders"""


def wide(k: Catalog) -> DataFrame:
    return annotated(k).select("*", *[F.expr(e).alias(c) for c, e in _MORE.items()])


@query(_OVERALL)
def stats_overall(k: Catalog) -> DataFrame:
    a = wide(k).agg(F.count("*").alias("total_samples"), *[F.count(c).alias(f"samples_with_{c}") for c in _ALL_COVERED], *[F.countDistinct(c).alias(f"distinct_{n}") for n, c in _ALL_DISTINCT.items()])
    series = k.series().agg(F.count("*").alias("total_series"), F.countDistinct("assay").alias("distinct_assays"), F.countDistinct("platform").alias("distinct_platforms"))
    links = k.table("documents").groupBy(F.xxhash64("text")).agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("total_entity_links"))
    years = k.table("orders").agg(F.max(F.year("o_orderdate")).alias("newest_year"), F.min(F.year("o_orderdate")).alias("oldest_year"))
    rest = [series, k.projects().agg(F.count("*").alias("total_projects")), k.celltypes().agg(F.count("*").alias("total_celltypes")), links, years]
    return reduce(DataFrame.union, map(unpivoted, [a, *rest]))


def stored_counts(k: Catalog, at: str) -> dict[str, StoredCounts]:
    """The stored statistics of the tiers under a folder, refreshed: files of samples are counted again if they changed, or
    if a table that their annotations come from did."""
    others = [f for t in ("lineitem", "customer", "nation", "region", "part") for f in files_of(k.spark, f"{k.path}/{t}.parquet")]
    version = hashlib.sha256(repr(others).encode()).hexdigest()

    def samples(orders: DataFrame) -> DataFrame:
        some = Replaced(k.spark, k.path, {"orders": orders.drop("file")})
        return wide(some).join(orders.select(col("o_orderkey").alias("pk"), "file"), "pk")

    columns = list(dict.fromkeys([*_ALL_COVERED, *_ALL_DISTINCT.values(), *_SECTIONS]))
    specs = {
        "orders": {"columns": columns, "measure": "n_cells", "rows": samples, "version": version},
        "part": {"columns": ["p_type", "p_brand"]}, "customer": {"columns": ["c_mktsegment"]}, "lineitem": {"columns": []},
        "documents": {"columns": ["h"], "rows": lambda d: d.select("file", F.xxhash64("text").alias("h"))},
    }
    found = {t: StoredCounts(k.spark, f"{at}/{t}") for t in specs}
    for t, spec in specs.items():
        found[t].refresh(f"{k.path}/{t}.parquet", **spec)
    return found


def _from_stored(stored: dict[str, StoredCounts]) -> DataFrame:
    """(metric, value) of all metrics, from the stored counts alone."""
    known = {t: totals(s.values()) for t, s in stored.items()}
    a = known["orders"]
    named = lambda df, names, value: df.select(F.explode(F.array_compact(F.array(*[F.when(col("column") == c, F.lit(n)) for n, c in names.items()]))).alias("metric"), F.col(value).cast("long").alias("value"))
    rows = lambda t, n: known[t].filter("column = ''").select(F.lit(n).alias("metric"), F.coalesce("filled", F.lit(0)).alias("value"))
    parts = [named(a.withColumn("filled", F.coalesce("filled", F.lit(0))), {f"samples_with_{c}": c for c in _ALL_COVERED}, "filled")]
    parts += [named(a, {f"distinct_{n}": c for n, c in _ALL_DISTINCT.items()}, "distinct_values"), rows("orders", "total_samples"), rows("part", "total_series"), rows("customer", "total_projects"), rows("lineitem", "total_celltypes")]
    parts.append(named(known["part"], {"distinct_assays": "p_type", "distinct_platforms": "p_brand"}, "distinct_values"))
    parts.append(known["documents"].agg((F.max(F.when(col("column") == "", col("filled"))) - F.max(F.when(col("column") == "h", col("distinct_values")))).alias("value")).select(F.lit("total_entity_links").alias("metric"), "value"))
    years = stored["orders"].values().filter("column = 'year' and value is not null").agg(F.max(col("value").cast("int")).alias("newest_year"), F.min(col("value").cast("int")).alias("oldest_year"))
    return reduce(DataFrame.union, [*parts, unpivoted(years)])


@query(_OVERALL)
def stats_stored(k: Catalog) -> DataFrame:
    """The overall table from stored counts."""
    return _from_stored(stored_counts(k, new_path(k.spark, "stats")))


@query(f"""WITH {A}, g AS (SELECT 'tissue' AS field, tissue AS value, * EXCLUDE (tissue) FROM a UNION ALL SELECT 'disease', disease, * EXCLUDE (tissue) FROM a),
 c AS (SELECT field, value, count(*) AS samples, count(DISTINCT source_database) AS sources, round(sum(n_cells), 2) AS cells FROM g WHERE value IS NOT NULL GROUP BY 1, 2)
 SELECT field, value, samples, sources, cells FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY samples DESC, value) AS r FROM c) WHERE r <= 40""")
def stats_by_field(k: Catalog) -> DataFrame:
    """Samples, sources and cells per value of two fields, the most frequent values of each."""
    from pyspark.sql.window import Window

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), col(f).alias("value")) for f in ("tissue", "disease")]))
    x = annotated(k).select("source_database", "n_cells", pairs.alias("x")).filter("x.value is not null").groupBy("x.field", "x.value")
    x = x.agg(count("samples"), F.countDistinct("source_database").alias("sources"), F.round(F.sum("n_cells"), 2).alias("cells"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("samples"), "value"))).filter("r <= 40").drop("r")


@query(f"WITH {A} SELECT coalesce(sex_normalized, sex, 'unknown') AS sex, coalesce(organism_common, organism, 'unknown') AS organism, count(*) AS n FROM a GROUP BY 1, 2")
def stats_normalized(k: Catalog) -> DataFrame:
    best = lambda a, b: F.coalesce(a, b, F.lit("unknown")).alias(b)
    return annotated(k).groupBy(best("sex_normalized", "sex"), best("organism_common", "organism")).agg(count())




_DASHBOARD = f"""WITH {A} SELECT * FROM ({" UNION ALL ".join(f"SELECT '{s}' AS section, {s} AS key, count(*) AS n, round(sum(n_cells), 2) AS cells FROM a WHERE {s} IS NOT NULL GROUP BY 2" for s in _SECTIONS)}
 UNION ALL SELECT 'year', year(publication_date)::VARCHAR, count(*), round(sum(n_cells), 2) FROM a GROUP BY 2 UNION ALL SELECT 'assay', p_type, count(*), NULL FROM part GROUP BY 2
 UNION ALL SELECT 'platform', p_brand, count(*), NULL FROM part GROUP BY 2 UNION ALL SELECT 'category', c_mktsegment, count(*), NULL FROM customer GROUP BY 2
 UNION ALL SELECT 'totals', 'samples', count(*), NULL FROM orders UNION ALL SELECT 'totals', 'projects', count(*), NULL FROM customer)"""


@query(_DASHBOARD)
def dashboard(k: Catalog) -> DataFrame:
    """All sections of the dashboard. The sample sections are grouping sets of one pass."""
    a = annotated(k).withColumn("year", F.year("publication_date").cast("string"))
    names = [*_SECTIONS, "year"]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), col(s).alias("key")) for s in names]))
    samples = a.select("n_cells", each.alias("x")).filter("x.key is not null").groupBy("x.section", "x.key").agg(count(), F.round(F.sum("n_cells"), 2).alias("cells"))
    plain = lambda df, c, name: df.groupBy(F.lit(name).alias("section"), col(c).alias("key")).agg(count(), F.lit(None).cast("double").alias("cells"))
    total = lambda df, name: df.agg(F.lit("totals").alias("section"), F.lit(name).alias("key"), count(), F.lit(None).cast("double").alias("cells"))
    return reduce(DataFrame.union, [samples, plain(k.series(), "assay", "assay"), plain(k.series(), "platform", "platform"), plain(k.projects(), "category", "category"), total(k.table("orders"), "samples"), total(k.projects(), "projects")])


@query(_DASHBOARD)
def dashboard_stored(k: Catalog) -> DataFrame:
    """All sections of the dashboard from stored counts."""
    stored = stored_counts(k, new_path(k.spark, "stats"))
    names = {t: {c: c for c in cs} for t, cs in {"orders": [*_SECTIONS, "year"]}.items()} | {"part": {"p_type": "assay", "p_brand": "platform"}, "customer": {"c_mktsegment": "category"}}
    parts = []
    for t, sections in names.items():
        x = stored[t].values().filter(col("column").isin(*sections))
        x = x.filter("value is not null") if t == "orders" else x
        section = F.create_map(*[F.lit(y) for pair in sections.items() for y in pair])[col("column")]
        parts.append(x.select(section.alias("section"), col("value").alias("key"), "n", col("total").cast("double").alias("cells")))
    for t, name in (("orders", "samples"), ("customer", "projects")):
        parts.append(stored[t].values().filter("column = ''").select(F.lit("totals").alias("section"), F.lit(name).alias("key"), "n", F.lit(None).cast("double").alias("cells")))
    return reduce(DataFrame.union, parts)


# Reports over results


@query(f"WITH {A}, top AS (SELECT * FROM a ORDER BY n_cells DESC NULLS LAST, pk LIMIT 500) SELECT 'source' AS facet, source_database AS value, count(*) AS n FROM top GROUP BY 2 UNION ALL SELECT 'sex', coalesce(sex_normalized, '(none)'), count(*) FROM top GROUP BY 2")
def facets_of_ranked(k: Catalog) -> DataFrame:
    """Facets of a ranked page alone."""
    top = annotated(k).orderBy(F.desc_nulls_last("n_cells"), "pk").limit(500)
    both = F.array(F.struct(F.lit("source").alias("facet"), col("source_database").alias("value")), F.struct(F.lit("sex").alias("facet"), F.coalesce("sex_normalized", F.lit("(none)")).alias("value")))
    return top.select(F.explode(both).alias("x")).groupBy("x.facet", "x.value").agg(count())


@query(f"WITH {A} SELECT count(*) AS n_groups, sum(n)::BIGINT AS total FROM (SELECT disease, count(*) AS n FROM a GROUP BY 1)")
def group_total(k: Catalog) -> DataFrame:
    return annotated(k).groupBy("disease").agg(count()).agg(F.count("*").alias("n_groups"), F.sum("n").alias("total"))


_FILLED = ["tissue", "disease_standard", "sex_normalized", "age_unit", "n_cells"]


@query(f"""WITH f AS (SELECT text, count(DISTINCT source) AS k FROM documents GROUP BY 1), {A}
 SELECT 'cross_validation' AS part, 'documents' AS key, round(100.0 * avg((k > 1)::INT), 1)::DOUBLE AS value FROM f
 UNION ALL SELECT 'sources', source, count(DISTINCT text)::DOUBLE FROM documents GROUP BY 2
 UNION ALL {" UNION ALL ".join(f"SELECT 'filled', '{c}', round(100.0 * count({'nullif(n_cells, 0)' if c == 'n_cells' else f"nullif({c}, '')"}) / count(*), 1)::DOUBLE FROM a" for c in _FILLED)}""")
def quality_report(k: Catalog) -> DataFrame:
    """Share of fused records of several sources, records per source, and share of records with a field."""
    fused = k.table("documents").select(F.md5("text").alias("h"), "source").distinct()
    cross = fused.groupBy("h").agg(F.count("*").alias("k")).agg(F.lit("cross_validation").alias("part"), F.lit("documents").alias("key"), F.round(100.0 * F.avg((col("k") > 1).cast("int")), 1).alias("value"))
    sources = fused.groupBy(F.lit("sources").alias("part"), col("source").alias("key")).agg(F.count("*").cast("double").alias("value"))
    has = lambda c: F.count(F.nullif(col(c), F.lit(0.0) if c == "n_cells" else F.lit("")))
    one = annotated(k).agg(*[F.round(100.0 * has(c) / F.count("*"), 1).alias(c) for c in _FILLED])
    filled = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in _FILLED]), F.array(*_FILLED))).alias("key", "value")).select(F.lit("filled").alias("part"), "key", "value")
    return cross.union(sources).union(filled)


#: Hosts of download URLs, the first that matches (fixed values).
HOSTS = [("sra.ebi.ac.uk|ena", "ENA/SRA"), ("ncbi.nlm.nih.gov/geo", "GEO"), ("cellxgene", "CellXGene"), ("ebi.ac.uk", "EBI")]


def host_of(url: Column) -> Column:
    return F.coalesce(*[F.when(url.rlike(p.replace(".", r"\.")), name) for p, name in HOSTS], F.lit("other"))


_FILES = """files AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ftp://ftp.sra.ebi.ac.uk/vol1/' WHEN 1 THEN 'https://www.ncbi.nlm.nih.gov/geo/' WHEN 2 THEN 'https://datasets.cellxgene.example/' WHEN 3 THEN 'https://www.ebi.ac.uk/' ELSE 'https://files.example/' END || doc_id AS url,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS bytes FROM documents)"""


def files(k: Catalog) -> DataFrame:
    at = F.array(*[F.lit(x) for x in ("ftp://ftp.sra.ebi.ac.uk/vol1/", "https://www.ncbi.nlm.nih.gov/geo/", "https://datasets.cellxgene.example/", "https://www.ebi.ac.uk/", "https://files.example/")])
    return k.table("documents").select("doc_id", F.concat(F.get(at, (col("doc_id") % 5).cast("int")), col("doc_id").cast("string")).alias("url"), F.when(col("doc_id") % 7 != 0, col("n_chars")).alias("bytes"))


@query(f"""WITH {_FILES}, h AS (SELECT *, CASE WHEN url LIKE '%sra.ebi.ac.uk%' OR url LIKE '%ena%' THEN 'ENA/SRA' WHEN url LIKE '%ncbi.nlm.nih.gov/geo%' THEN 'GEO' WHEN url LIKE '%cellxgene%' THEN 'CellXGene' WHEN url LIKE '%ebi.ac.uk%' THEN 'EBI' ELSE 'other' END AS host FROM files)
 SELECT coalesce(host, 'all') AS host, count(*) AS files, count(nullif(bytes, 0)) AS sized, sum(bytes)::BIGINT AS bytes, count(nullif(bytes, 0)) < count(*) AS partial FROM h GROUP BY ROLLUP (host)""")
def download_estimate(k: Catalog) -> DataFrame:
    """Files and bytes per host and in all; partial where a size is unknown."""
    x = files(k).withColumn("host", host_of(col("url"))).rollup("host").agg(F.count("*").alias("files"), F.count(F.nullif("bytes", F.lit(0))).alias("sized"), F.sum("bytes").alias("bytes"))
    return x.select(F.coalesce("host", F.lit("all")).alias("host"), "files", "sized", "bytes", (col("sized") < col("files")).alias("partial"))


@query("SELECT event_type AS template, count(*) FILTER (value >= 5) AS successes, count(*) AS runs, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def template_stats(k: Catalog) -> DataFrame:
    return k.table("events").groupBy(col("event_type").alias("template")).agg(F.count_if(col("value") >= 5).alias("successes"), count("runs"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def most_common_value(k: Catalog) -> DataFrame:
    """The most common language of each source, at a tie the first in order."""
    per = k.table("documents").groupBy("source", "lang").agg(count())
    best = per.groupBy("source").agg(F.min(F.struct((-col("n")).alias("less"), "lang")).alias("b"))
    return best.select("source", "b.lang", (-col("b.less")).alias("n"))


@query("SELECT c_custkey AS workspace, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def workspace_item_counts(k: Catalog) -> DataFrame:
    """Items of each workspace; empty ones count 0."""
    items = k.table("orders").filter("o_orderstatus = 'F'").groupBy(col("o_custkey").alias("workspace")).agg(F.count("*").alias("items"))
    return k.projects().select(col("project_pk").alias("workspace")).join(items, "workspace", "left").select("workspace", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


@query("SELECT event_type AS job, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1 UNION ALL SELECT 'all', strftime(max(ts), '%Y-%m-%d %H:%M:%S'), arg_max(event_id, (ts, event_id)) FROM events")
def last_updated(k: Catalog) -> DataFrame:
    return k.table("events").rollup("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id")).select(F.coalesce("event_type", F.lit("all")).alias("job"), "last_run", "last_id")


@query("""WITH d AS (SELECT source, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'n/a' ELSE 'published ' || (1990 + n_chars % 40) END AS date, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang || ' sapiens' END AS organism FROM documents),
 y AS (SELECT *, try_cast(regexp_extract(date, '(19|20)[0-9]{2}') AS INTEGER) AS year FROM d)
 SELECT source, count(*) FILTER (year BETWEEN 2000 AND 2010) AS in_year, count(*) FILTER (year NOT BETWEEN 2000 AND 2010) AS out_of_year, count(*) FILTER (year IS NULL) AS unknown_year,
 count(*) FILTER (organism <> '' AND (contains(organism, 'en sapiens') OR contains('en sapiens', organism))) AS species_match, count(*) FILTER (organism <> '' AND NOT (contains(organism, 'en sapiens') OR contains('en sapiens', organism))) AS species_mismatch, count(*) FILTER (organism = '') AS unknown_species FROM y GROUP BY 1""")
def constraint_counts(k: Catalog) -> DataFrame:
    """How many results of each source meet the year and species that were asked for, do not, or cannot be told."""
    i = col("doc_id") % 11
    d = k.table("documents").select("source", F.when(i == 1, "n/a").when(i != 0, F.concat(F.lit("published "), (1990 + col("n_chars") % 40).cast("string"))).alias("date"), F.when(col("doc_id") % 9 == 0, "").otherwise(F.concat("lang", F.lit(" sapiens"))).alias("organism"))
    year, asked = T.year_of(col("date")), F.lit("en sapiens")
    same = F.contains(F.lower("organism"), asked) | F.contains(asked, F.lower("organism"))
    known = F.coalesce(col("organism"), F.lit("")) != ""
    tests = {"in_year": year.between(2000, 2010), "out_of_year": ~year.between(2000, 2010), "unknown_year": year.isNull(), "species_match": known & same, "species_mismatch": known & ~same, "unknown_species": ~known}
    return d.groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


@query("""SELECT 'terms' AS metric, 'all' AS key, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'terms', 'region', count(*) FROM region UNION ALL SELECT 'terms', 'nation', count(*) FROM nation
 UNION ALL SELECT 'terms', 'customer', count(*) FROM customer UNION ALL SELECT 'mappings', 'customer', count(DISTINCT o_custkey) FROM orders""")
def onto_stats(k: Catalog) -> DataFrame:
    tables = {"region": k.table("region"), "nation": k.table("nation"), "customer": k.table("customer")}
    one = reduce(DataFrame.union, [t.select(F.lit(n).alias("key")) for n, t in tables.items()])
    terms = one.rollup("key").agg(count()).select(F.lit("terms").alias("metric"), F.coalesce("key", F.lit("all")).alias("key"), "n")
    return terms.union(k.table("orders").agg(F.lit("mappings").alias("metric"), F.lit("customer").alias("key"), F.countDistinct("o_custkey").alias("n")))


@query("""WITH f AS (SELECT text, list_sort(list(DISTINCT source)) AS sources, max(n_chars) AS score, min(doc_id) AS first FROM documents GROUP BY 1), top AS (SELECT * FROM f ORDER BY score DESC, first LIMIT 200)
 SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM top) GROUP BY 1""")
def fused_source_distribution(k: Catalog) -> DataFrame:
    """Sources of the 200 best fused records."""
    d = k.table("documents").select(F.md5("text").alias("h"), "source", "n_chars", "doc_id")
    top = d.groupBy("h").agg(F.collect_set("source").alias("sources"), F.max("n_chars").alias("score"), F.min("doc_id").alias("first")).orderBy(F.desc("score"), "first").limit(200)
    return top.select(F.explode("sources").alias("source")).groupBy("source").agg(count())


_PROFILED = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS field, count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct, round(count(DISTINCT {c}) / count(*), 6) AS selectivity,
 {f"min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, round(avg({c}), 6) AS mean" if c in ("p_size", "p_retailprice") else "NULL::DOUBLE AS least, NULL::DOUBLE AS most, NULL::DOUBLE AS mean"},
 (SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top FROM part""" for c in _PROFILED if c != "p_retailprice"))
def field_knowledge(k: Catalog) -> DataFrame:
    """A profile of every field: counts, distinct values, selectivity, range and the most frequent values, in two passes."""
    from pyspark.sql.window import Window

    names = [c for c in _PROFILED if c != "p_retailprice"]
    x = k.table("part").select(*names)
    number = {f.name for f in x.schema if f.dataType.typeName() not in ("string",)}
    nothing = F.lit(None).cast("double")

    def facts(c: str) -> Column:
        some = [f(c).cast("double") for f in (F.min, F.max)] + [F.round(F.avg(c), 6)] if c in number else [nothing] * 3
        values = dict(zip(("total", "filled", "distinct_values", "least", "most", "mean"), [F.count("*"), F.count(c), F.countDistinct(c), *some], strict=True))
        return F.struct(F.lit(c).alias("field"), *[v.alias(n) for n, v in values.items()])

    one = x.agg(F.array(*[facts(c) for c in names]).alias("f")).select(F.inline("f"))
    values = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), col(c).cast("string").alias("v")) for c in names])).alias("x")).groupBy("x.field", "x.v").agg(count())
    w = Window.partitionBy("field").orderBy(F.desc("n"), "v")
    top = values.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]), "|").alias("top"))
    share = F.round(100.0 * (col("total") - col("filled")) / col("total"), 2).alias("null_pct")
    return one.join(F.broadcast(top), "field", "left").select("field", "total", "filled", "distinct_values", share, F.round(col("distinct_values") / col("total"), 6).alias("selectivity"), "least", "most", "mean", "top")


@query(f"WITH {A} SELECT 'sum' AS metric, disease_category AS key, round(sum(n_cells), 2) AS value FROM a GROUP BY 2 UNION ALL SELECT 'avg', disease_category, round(avg(n_cells), 6) FROM a GROUP BY 2 UNION ALL SELECT 'count', disease_category, count(*)::DOUBLE FROM a GROUP BY 2")
def metric_aggregate(k: Catalog) -> DataFrame:
    """What an aggregate sentence asks for: the sum, the mean, or by default the number."""
    ways = {"sum": F.round(F.sum("n_cells"), 2), "avg": F.round(F.avg("n_cells"), 6), "count": F.count("*").cast("double")}
    x = annotated(k).groupBy(col("disease_category").alias("key")).agg(*[f.alias(n) for n, f in ways.items()])
    return x.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in ways]), F.array(*ways))).alias("metric", "value"), "key")


@query("""WITH b AS (SELECT event_type, unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::DOUBLE]) AS le, value FROM events)
 SELECT event_type, le::VARCHAR AS le, count(*) FILTER (value <= le) AS cumulative, round(sum(value), 4) AS total, count(*) AS n FROM b GROUP BY 1, 2""")
def latency_summary(k: Catalog) -> DataFrame:
    """A cumulative histogram with the sum and number of observations."""
    bounds = F.array(*[F.lit(float(b)) for b in (5, 10, 25, 50, 100)], F.lit(float("inf")))
    x = k.table("events").select("event_type", "value", F.explode(bounds).alias("le")).groupBy("event_type", "le").agg(F.count_if(col("value") <= col("le")).alias("cumulative"), F.round(F.sum("value"), 4).alias("total"), count())
    return x.select("event_type", F.when(col("le") == float("inf"), "inf").otherwise(col("le").cast("string")).alias("le"), "cumulative", "total", "n")


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 3.0, 15.0), ('view', 0.25, 1.25), ('error', 1.0, 5.0)) t(model, p_in, p_out)),
 d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model, sum(value * 100) AS tin, sum(value * 10) AS tout, count(*) AS calls FROM events GROUP BY 1, 2)
 SELECT day, d.model, calls, round((tin * coalesce(p_in, 2.0) + tout * coalesce(p_out, 8.0)) / 1e6, 9) AS cost, round((tin * coalesce(p_in, 2.0) + tout * coalesce(p_out, 8.0)) / 1e6, 9) > 0.02 AS over_budget FROM d LEFT JOIN p USING (model)""")
def token_budget(k: Catalog) -> DataFrame:
    """Cost of each model's calls by day (budgets start anew each day); models without a price have a default one."""
    prices = k.spark.createDataFrame([("click", 3.0, 15.0), ("view", 0.25, 1.25), ("error", 1.0, 5.0)], "model string, p_in double, p_out double")
    d = k.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), col("event_type").alias("model")).agg(F.sum(col("value") * 100).alias("i"), F.sum(col("value") * 10).alias("o"), count("calls"))
    cost = F.round((col("i") * F.coalesce("p_in", F.lit(2.0)) + col("o") * F.coalesce("p_out", F.lit(8.0))) / 1e6, 9)
    return d.join(F.broadcast(prices), "model", "left").select("day", "model", "calls", cost.alias("cost"), (cost > 0.02).alias("over_budget"))


@query(f"WITH {A}, c AS (SELECT disease AS value, count(*) AS n FROM a WHERE disease IS NOT NULL GROUP BY 1), t AS (SELECT *, round(100.0 * n / sum(n) OVER (), 3)::DOUBLE AS pct, row_number() OVER (ORDER BY n DESC, value) AS r FROM c) SELECT value, n, pct FROM t WHERE r <= 12")
def percent_tiles(k: Catalog) -> DataFrame:
    """The 12 most frequent values with their share of all."""
    per = annotated(k).filter("disease is not null").groupBy(col("disease").alias("value")).agg(count())
    total = per.agg(F.sum("n")).first()[0] or 0
    return per.orderBy(F.desc("n"), "value").limit(12).select("value", "n", F.round(100.0 * col("n") / total, 3).alias("pct"))
