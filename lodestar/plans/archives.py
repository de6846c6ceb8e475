"""Queries over staged files: records of archives, ontologies, release bundles, logs of workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import downloads
from lodestar.plans.binding import Catalog
from lodestar.plans.ontology import _TERMS, terms
from lodestar.plans.queries import closure, count, query
from lodestar.sources import obo, release
from lodestar.sources import staged as S
from lodestar.sources.shared import new_path
from lodestar.streaming import workspaces

col, lit = F.col, F.lit

_RECORDS = """r AS (SELECT p_partkey::VARCHAR AS id, p_name AS title, p_type || ' goods' AS summary, CASE p_size % 3 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Mus musculus' END AS organism,
 CASE WHEN p_size % 4 = 0 THEN 'sample' ELSE 'series' END AS kind, p_brand AS collection, 2010 + p_size % 15 AS year
  FROM part), t AS (SELECT *, lower(title || chr(10) || summary) AS s FROM r)"""


def _staged(k: Catalog) -> str:
    """The parts as staged records, written as JSON lines; the path."""
    i, at = col("p_size"), new_path(k.spark, "staged")
    organism = F.when(i % 3 == 0, "Homo sapiens").when(i % 3 == 1, "Mus musculus")
    x = k.table("part").select(
        col("p_partkey").cast("string").alias("id"), col("p_name").alias("title"), F.concat("p_type", lit(" goods")).alias("summary"), organism.alias("organism"),
        F.when(i % 4 == 0, "sample").otherwise("series").alias("kind"), col("p_brand").alias("collection"), (2010 + i % 15).alias("year"), F.create_map(lit("price"), col("p_retailprice").cast("string")).alias("more"),
    )
    x.write.json(at)
    return at


@query(f"""WITH {_RECORDS} SELECT id, title, year FROM t WHERE (contains(s, 'bolt') OR contains(s, 'widget')) AND contains(s, 'promo') AND organism = 'Mus musculus'
  AND kind = 'series' AND year >= 2014 AND NOT contains(s, 'green')""")
def staged_search(k: Catalog) -> DataFrame:
    """Series of a species with words of every field asked for, since a year, without some words."""
    term = S.term_of({"disease": ["bolt", "Widget"], "tissue": ["promo"]}, species=["Mus musculus"], kind="series", years=S.Years(2014), without=["green", "a"])
    return S.staged(k.spark, _staged(k), term).select("id", "title", "year")


@query(f"""WITH {_RECORDS} SELECT id, collection FROM t WHERE contains(s, 'red') AND contains(s, 'goods') AND collection IN ('Brand#1', 'Brand#12')""")
def staged_scoped(k: Catalog) -> DataFrame:
    """At most two words of each field, in two collections."""
    term = S.scoped_term({"tissue": ["red", "goods", "no such thing"]}, [], ["Brand#1", "Brand#12"])
    return S.staged(k.spark, _staged(k), term).select("id", "collection")


@query(f"""WITH RECURSIVE {_TERMS}, up(child, ancestor) AS (SELECT id, parent FROM terms WHERE parent IS NOT NULL UNION SELECT u.child, t.parent FROM up u
  JOIN terms t ON u.ancestor = t.id WHERE t.parent IS NOT NULL),
 n AS (SELECT child AS id, count(*) AS ancestors FROM up GROUP BY 1)
 SELECT id, label AS name, coalesce(parent, '') AS parents, array_to_string(synonyms, '|') AS synonyms, 'The "' || label || '" itself' AS definition, coalesce(ancestors, 0) AS ancestors FROM terms LEFT JOIN n USING (id)""")
def onto_from_file(k: Catalog) -> DataFrame:
    """An ontology written as an OBO file and read by its stanzas, with the number of each term's ancestors."""
    synonyms = F.array_join(F.transform("synonyms", lambda s: F.concat(lit('synonym: "'), s, lit('" EXACT []\n'))), "")
    stanza = F.concat(lit("[Term]\nid: "), "id", lit("\nname: "), "label", lit('\ndef: "The \\"'), "label", lit('\\" itself" [X:1]\n'), synonyms, F.coalesce(F.concat(lit("is_a: "), "parent", lit(" ! above\n")), lit("")))
    at = new_path(k.spark, "obo")
    terms(k).select(stanza.alias("value")).write.text(at)
    x = obo.read_terms(k.spark, at)
    above = closure(obo.edges(x)).groupBy(col("child").alias("id")).agg(count("ancestors"))
    order = F.array_join("synonyms", "|")
    return x.join(above, "id", "left").select("id", "name", F.array_join("parents", ",").alias("parents"), order.alias("synonyms"), "definition", F.coalesce("ancestors", lit(0)).alias("ancestors"))


_BUNDLE = ["region", "nation", "customer", "part"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n, count(*)::INTEGER AS columns, true AS right FROM (DESCRIBE {t})" for t in _BUNDLE).replace("AS right", "AS unchanged"))
def release_bundle(k: Catalog) -> DataFrame:
    """Four tables released, and whether they and all files read back as they were written."""
    at = new_path(k.spark, "release")
    release.release({t: k.table(t) for t in _BUNDLE}, at)
    x = release.verified(k.spark, at)
    tables = k.spark.read.schema("table string, n long, columns int").json(f"{at}/contents")
    # A table is unchanged if its rows and all of its files are.
    own = x.groupBy(F.when(col("what") == "table", col("name")).otherwise(F.regexp_extract("name", "^([^/]+)/", 1)).alias("name")).agg(F.bool_and("right").alias("unchanged"))
    return tables.select(col("table").alias("name"), "n", "columns").join(own, "name", "left")


_CHANGES = """c AS (SELECT event_id AS event, user_id % 20 AS workspace, CASE WHEN event_id % 97 = 1 THEN 'delete' WHEN event_id % 97 = 40 THEN 'recover'
  WHEN event_id % 11 IN (0, 5) THEN 'remove' ELSE 'add' END AS op, event_type || (event_id % 30) AS item, value::VARCHAR AS note FROM events)"""


@query(f"""WITH {_CHANGES}, s AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('delete', 'recover') THEN op END IGNORE NULLS) OVER (PARTITION BY workspace
  ORDER BY event), 'recover') = 'delete' AS gone FROM c),
 d AS (SELECT workspace, arg_max(gone, event) AS deleted FROM s GROUP BY 1), live AS (SELECT * FROM s WHERE NOT gone AND op IN ('add', 'remove')),
 r AS (SELECT *, max(CASE WHEN op = 'remove' THEN event END) OVER (PARTITION BY workspace, item) AS removed FROM live),
 i AS (SELECT workspace, item, min(event) AS event FROM r WHERE op = 'add' AND (removed IS NULL OR event > removed) GROUP BY 1, 2)
 SELECT d.workspace, deleted, item, event FROM d LEFT JOIN i ON i.workspace = d.workspace WHERE item IS NOT NULL""")
def workspaces_replayed(k: Catalog) -> DataFrame:
    """The items of each workspace after a log of changes, kept by a stream in versions."""
    i, at = col("event_id"), new_path(k.spark, "changes")
    op = F.when(i % 97 == 1, "delete").when(i % 97 == 40, "recover").when((i % 11).isin(0, 5), "remove").otherwise("add")
    k.table("events").select(i.alias("event"), (col("user_id") % 20).alias("workspace"), op.alias("op"), F.concat("event_type", (i % 30).cast("string")).alias("item"), col("value").cast("string").alias("note")).write.json(at)
    return workspaces.kept_by_stream(k.spark, at).filter("item is not null").select("workspace", "deleted", "item", "event")


# Files of records

_OFFERS = """d AS (SELECT doc_id, ['geo', 'ebi', 'ncbi', 'ega', 'hca', 'cellxgene'][doc_id % 6 + 1] AS source, ['GSE', 'E-MTAB-', 'PRJNA', 'EGAD', 'x'][doc_id % 5 + 1] || (1000 + doc_id) AS project_id,
 CASE WHEN doc_id % 3 = 2 THEN 'SRP' || doc_id END AS series_id, CASE doc_id % 4 WHEN 1 THEN 'SRR' || (1000000 + doc_id) WHEN 0 THEN 'SRR' || (10000 + doc_id)
  WHEN 2 THEN '' END AS sample_id, CASE WHEN doc_id % 7 > 2 THEN 'https://h/' || doc_id END AS h5ad_url FROM documents),
 o AS (SELECT doc_id, 'h5ad' AS file_type, h5ad_url AS url FROM d WHERE source = 'cellxgene' AND h5ad_url IS NOT NULL UNION ALL SELECT doc_id, 'hca_portal', h5ad_url
  FROM d WHERE source = 'hca' AND h5ad_url IS NOT NULL
 UNION ALL SELECT doc_id, 'supplementary', 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || left(project_id, len(project_id) - 3) || 'nnn/' || project_id || '/suppl/' FROM d
  WHERE source = 'geo' AND project_id LIKE 'GSE%'
 UNION ALL SELECT doc_id, 'geo_soft', 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || left(project_id, len(project_id) - 3) || 'nnn/' || project_id || '/soft/' || project_id || '_family.soft.gz' FROM d WHERE source = 'geo' AND project_id LIKE 'GSE%'
 UNION ALL SELECT doc_id, 'geo_page', 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || project_id FROM d WHERE source = 'geo' AND project_id LIKE 'GSE%'
 UNION ALL SELECT doc_id, 'fastq', 'ftp://ftp.sra.ebi.ac.uk/vol1/fastq/' || left(sample_id, 6) || '/' || CASE WHEN len(sample_id) > 9 THEN right(sample_id, 3) || '/'
  ELSE '' END || sample_id || '/' FROM d WHERE source = 'ncbi' AND sample_id LIKE 'SRR%'
 UNION ALL SELECT doc_id, 'sra_page', 'https://www.ncbi.nlm.nih.gov/sra/?term=' || series_id FROM d WHERE source = 'ncbi' AND series_id LIKE 'SRP%'
 UNION ALL SELECT doc_id, 'bioproject_page', 'https://www.ncbi.nlm.nih.gov/bioproject/' || project_id FROM d WHERE source = 'ncbi' AND project_id LIKE 'PRJNA%'
 UNION ALL SELECT doc_id, 'arrayexpress_page', 'https://www.ebi.ac.uk/biostudies/arrayexpress/studies/' || project_id FROM d WHERE source = 'ebi' AND project_id LIKE 'E-%'
 UNION ALL SELECT doc_id, t, 'https://www.ebi.ac.uk/biostudies/files/' || project_id || '/' || project_id || '.' || t || '.txt' FROM d, (VALUES ('sdrf'), ('idf')) v(t)
  WHERE source = 'ebi' AND project_id LIKE 'E-%'
 UNION ALL SELECT doc_id, 'ega_metadata', 'https://ega-archive.org/datasets/' || project_id FROM d WHERE source = 'ega' AND project_id LIKE 'EGA%')"""


def _offers(k: Catalog) -> DataFrame:
    i, text = col("doc_id"), lambda c: c.cast("string")
    pick = lambda n, *values: F.get(F.array(*map(lit, values)), (i % n).cast("int"))
    address = F.when(i % 7 > 2, F.concat(lit("https://h/"), text(i)))
    sample = F.when(i % 4 == 1, F.concat(lit("SRR"), text(1000000 + i))).when(i % 4 == 0, F.concat(lit("SRR"), text(10000 + i))).when(i % 4 == 2, "")
    d = k.table("documents").select(
        "doc_id", pick(6, "geo", "ebi", "ncbi", "ega", "hca", "cellxgene").alias("source"), F.concat(pick(5, "GSE", "E-MTAB-", "PRJNA", "EGAD", "x"), text(1000 + i)).alias("project_id"),
        F.when(i % 3 == 2, F.concat(lit("SRP"), text(i))).alias("series_id"), sample.alias("sample_id"), address.alias("h5ad_url"), address.alias("access_url"), *[lit(None).cast("string").alias(c) for c in ("rds_url", "explorer_url")],
    )
    return d.select("doc_id", downloads.options().alias("options"))


@query(f"WITH {_OFFERS} SELECT doc_id, file_type, url FROM o")
def download_files(k: Catalog) -> DataFrame:
    """Every file and page that the sources offer for their records, with its kind."""
    return _offers(k).select("doc_id", F.inline("options"))


@query(f"""WITH {_OFFERS}, a AS (SELECT event_id AS place, event_id * 7 % 400 - 20 AS id, CASE WHEN event_id % 9 = 0 THEN 'https://inline/' || event_id END AS url FROM events),
 f AS (SELECT id, min(place) AS place, arg_max(url, place) FILTER (url IS NOT NULL) AS url FROM a GROUP BY 1), s AS (SELECT id, url FROM f ORDER BY place, id LIMIT 300),
 m AS (SELECT s.id, o.file_type, o.url, 'matched' AS state FROM s JOIN o ON o.doc_id = s.id WHERE file_type IN ('h5ad', 'fastq', 'supplementary')),
 u AS (SELECT s.*, (SELECT string_agg(DISTINCT file_type, ',' ORDER BY file_type) FROM o WHERE o.doc_id = s.id) AS has FROM s WHERE id NOT IN (SELECT id FROM m))
 SELECT id::VARCHAR AS id, file_type, url, state FROM m UNION ALL SELECT id::VARCHAR, CASE WHEN url IS NOT NULL THEN 'file' ELSE has END, url, CASE
  WHEN url IS NOT NULL THEN 'inline' WHEN has IS NOT NULL THEN 'unmatched' ELSE 'unresolved' END FROM u""")
def download_request(k: Catalog) -> DataFrame:
    """A request for files of three kinds: the first 300 ids, addresses that came with it, and what was not found."""
    i = col("event_id")
    asked = k.table("events").select(i.alias("place"), (i * 7 % 400 - 20).cast("string").alias("id"), F.when(i % 9 == 0, F.concat(lit("https://inline/"), i.cast("string"))).alias("url"), lit(None).cast("string").alias("file_type"))
    records = _offers(k).select(col("doc_id").cast("string").alias("id"), "options")
    return downloads.requested(asked, records, ["h5ad", "fastq", "supplementary"])
